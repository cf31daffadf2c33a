"""Memories and states that change in place: buckets are rewritten, versions committed by name, lost writers leave nothing."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs, memory
from quire.sources import versions

DAY = datetime.datetime(2024, 1, 1)


def entries(spark, *rows):
    """(text, translation, seq)"""
    return spark.createDataFrame([(x, "", y, "de", "p", 0.5, DAY, i) for x, y, i in rows], "source_text string, source_html string, translated_html string, target_language string, source_project string, confidence double, updated_at timestamp, seq long")


def held(spark, path, version=None):
    return {r["source_text"]: r["translated_html"] for r in memory.stored(spark, path, version).collect()}


def test_only_buckets_of_changed_keys_are_written(spark, tmp_path):
    path = str(tmp_path / "m")
    assert held(spark, path) == {} and versions.versions(spark, path) == []
    assert memory.remember(spark, path, entries(spark, *[(f"t{i}", f"u{i}", i) for i in range(200)]), buckets=16) == 200
    first = versions.manifest(spark, path)
    assert first["version"] == 1 and first["buckets"] == 16 and len(first["folders"]) == 16
    # Of repeated keys the last wins, blank ones are left, and what is the same is not written.
    assert memory.remember(spark, path, entries(spark, ("t1", "x", 1), ("t1", "new", 2), ("t2", "u2", 3), ("t3", " ", 4), ("more", "m", 5))) == 2
    second = versions.manifest(spark, path)
    changed = {b for b in second["folders"] if second["folders"][b] != first["folders"].get(b)}
    want = {str(r["b"]) for r in memory.keyed(entries(spark, ("t1", "", 0), ("more", "", 0))).select(versions.bucket_of("source_hash", 16).alias("b")).collect()}
    assert changed == want and len(changed) <= 2
    assert held(spark, path) == {f"t{i}": f"u{i}" for i in range(200)} | {"t1": "new", "more": "m"} and held(spark, path, 1)["t1"] == "u1"
    # Five equal fields write nothing, whatever time and confidence say.
    again = entries(spark, ("t1", "new", 1)).withColumn("confidence", F.lit(0.9)).withColumn("updated_at", F.current_timestamp())
    assert memory.remember(spark, path, again) == 0 and versions.versions(spark, path) == [1, 2]
    versions.trimmed(spark, path)
    assert versions.versions(spark, path) == [2] and held(spark, path)["t1"] == "new" and len(held(spark, path)) == 201
    assert len(os.listdir(tmp_path / "m" / "data")) == 2


@pytest.mark.parametrize("at", ["write", "commit"])
def test_a_lost_import_leaves_the_old_version(spark, tmp_path, monkeypatch, at):
    path = str(tmp_path / "m")
    memory.remember(spark, path, entries(spark, ("a", "1", 0), ("b", "2", 0)))
    with monkeypatch.context() as m:
        if at == "commit":
            m.setattr(versions, "_committed", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            change = entries(spark, ("a", "9", 0))
        else:
            # A task fails on the second bucket it writes.
            bad = F.when(F.col("source_text") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("translated_html"))
            change = entries(spark, ("a", "9", 0), ("c", "x", 0)).withColumn("translated_html", bad)
        with pytest.raises((KeyboardInterrupt, Exception)):
            memory.remember(spark, path, change)
    assert held(spark, path) == {"a": "1", "b": "2"} and versions.versions(spark, path) == [1]
    more = entries(spark, ("a", "7", 0), ("d", " ", 1)).withColumn("source_hash", F.lit(None).cast("string"))
    assert memory.take_in(spark, path, more, "p", "de").asDict() == {"imported": 1, "skipped": 1}
    assert held(spark, path) == {"a": "7", "b": "2"}
    versions.trimmed(spark, path)
    assert held(spark, path) == {"a": "7", "b": "2"} and not (tmp_path / "m" / "staged").exists()


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "m")
    memory.remember(spark, path, entries(spark, ("a", "1", 0)))
    m = versions.manifest(spark, path)
    with pytest.raises(RuntimeError, match="another"):
        versions._committed(spark, path, m)
    assert versions.versions(spark, path) == [1] and held(spark, path) == {"a": "1"}


def test_states_and_exports_are_replaced_as_wholes(spark, tmp_path):
    path = str(tmp_path / "states")
    state = lambda *rows: spark.createDataFrame(rows, "job_id string, status string")
    jobs.saved(state(("a", "running"), ("b", "failed")), path)
    old = spark.read.schema("job_id string, status string").json(path)
    jobs.saved(old.withColumn("status", F.lit("done")), path)  # read from where it goes
    assert sorted(map(tuple, spark.read.schema("job_id string, status string").json(path).collect())) == [("a", "done"), ("b", "done")]
    with pytest.raises(Exception, match="lost"):
        jobs.saved(state(("c", "x")).withColumn("status", F.raise_error(F.lit("lost")).cast("string")), path)
    assert spark.read.json(path).count() == 2 and [n for n in os.listdir(tmp_path) if n.startswith("states") and not n.endswith(".new")] == ["states"]
