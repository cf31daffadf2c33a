"""Transforms in rounds: nothing that is written is asked for twice, whatever is lost."""

import os
import uuid

import pandas as pd
import pytest

from quire.plans import transform


def told(path):
    """A transform that notes which rows it is asked for; rows with `no` fail, `twice` fail until asked alone, and `flaky`
    batches fail at first; `die` ends the worker once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        texts = " ".join(rows["source_html"])
        first = not os.path.exists(f"{path}/seen-{rows['id'].iloc[0]}")
        with open(f"{path}/seen-{rows['id'].iloc[0]}", "a"):
            pass
        if "die" in texts and first:
            os._exit(1)
        with open(f"{path}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(",".join(rows["id"]))
        if "no" in texts or "twice" in texts and len(rows) > 1 or "flaky" in texts and first:
            raise ValueError("refused")
        return pd.DataFrame({"id": rows["id"], "translated_html": rows["source_html"].str.upper().str.replace("P>", "p>")})

    return run


def calls(path):
    return [x for n in os.listdir(path) if n.startswith("call-") for x in (path / n).read_text().split(",")]


@pytest.fixture
def rows(spark):
    words = {1: ["a", "b", "c"], 2: ["d", "no", "e", "f"], 3: ["flaky", "g"], 4: ["twice", "h"]}
    return spark.createDataFrame([(b, i, f"{b}-{i}", f"<p>{w}</p>") for b, ws in words.items() for i, w in enumerate(ws)], "batch long, seq long, id string, source_html string")


def test_rounds_equal_the_loop(rows, tmp_path):
    (tmp_path / "log").mkdir()
    out = transform.in_rounds(rows, told(tmp_path / "log"), str(tmp_path / "out"), retries=1, depth=3)
    got = {r["id"]: r for r in out.collect()}
    assert {i for i, r in got.items() if r["error"]} == {"2-1"} and got["2-1"]["error"] == "refused" and len(got) == 11
    assert got["2-0"]["translated_html"] == "<p>D</p>" and (got["2-2"]["part"], got["4-1"]["part"], got["1-0"]["part"]) == ("1", "1", "")
    asked = calls(tmp_path / "log")
    assert asked.count("1-0") == 1 and asked.count("3-1") == 2  # done at once, and at the second attempt
    assert asked.count("2-2") == 3 and asked.count("2-1") == 6  # two attempts each at the whole, the half, and alone
    before = len(asked)
    again = transform.in_rounds(rows, told(tmp_path / "log"), str(tmp_path / "out"), retries=0, depth=0)
    assert calls(tmp_path / "log")[before:].count("2-1") <= 1 and len(calls(tmp_path / "log")) == before + 1  # only what failed is asked for
    assert {r["id"]: r["translated_html"] for r in again.collect()} == {i: r["translated_html"] for i, r in got.items()}


def test_a_lost_run_goes_on(spark, rows, tmp_path):
    """A worker dies in the second round: what the first wrote is not asked for again."""
    (tmp_path / "log").mkdir()
    more = spark.createDataFrame([(5, 0, "5-0", "<p>flaky</p>"), (5, 1, "5-1", "<p>die</p>")], rows.schema)
    both = rows.where("batch IN (1, 3)").unionByName(more)
    (tmp_path / "log" / "seen-5-0").touch()
    with pytest.raises(Exception, match=r"(?i)crashed|exit|connection|reset|EOF|abort"):
        transform.in_rounds(both.withColumn("source_html", both.source_html), _dies_later(tmp_path / "log"), str(tmp_path / "out"), retries=1)
    done = set(calls(tmp_path / "log"))
    out = transform.in_rounds(both, told(tmp_path / "log"), str(tmp_path / "out"), retries=1)
    assert {r["id"] for r in out.where("error IS NULL").collect()} == {"1-0", "1-1", "1-2", "3-0", "3-1", "5-0", "5-1"}
    asked = calls(tmp_path / "log")
    assert done >= {"1-0", "1-1", "1-2"} and all(asked.count(i) == 1 for i in ("1-0", "1-1", "1-2"))


def _dies_later(path):
    """As `told`, but batch 5 fails at first, and ends the worker then."""
    inner = told(path)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows["id"].iloc[0] == "5-0":
            if os.path.exists(f"{path}/once"):
                os._exit(1)
            open(f"{path}/once", "w").close()
            raise ValueError("refused")
        return inner(rows)

    return run


def test_no_rows(rows, tmp_path):
    assert transform.in_rounds(rows.limit(0), transform.constant(), str(tmp_path / "out")).count() == 0
