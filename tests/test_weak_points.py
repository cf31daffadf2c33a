"""Presets' own words, diagnoses in full, settings kept, ids transformed twice, and entities."""

import os
import stat

import pandas as pd
from pyspark.sql import functions as F

from quire import session
from quire.operators import checks, terms, usage
from quire.plans import review, services
from quire.sources import books, html

SF = "/root/testdata/sf0.001"


def test_a_preset_brings_its_own_stop_words(spark):
    df = spark.createDataFrame([(1, "Quick Fox met Old Oak. Sir Fox and The Oak."), (2, "Oak Fox. Wizard.")], "id int, text string")
    found = lambda known: sorted({r["term"] for r in terms.mentions(df, "id", F.col("text"), terms.NAME, known).collect()})
    usual = found(None)
    own = found(terms.preset({"stop_words": ["wizard", "fox"], "leading_words": ["Quick"], "single_words": ["oak"]}))
    assert "Wizard" in usual and "The Oak" not in usual
    assert "Wizard" not in own and "Quick Fox" not in own and "The Oak" in own and "Oak Fox" in own
    assert found(terms.preset({"translations": {"Wizard": "Zauberer"}, "stop_words": ["wizard"]})) and "Wizard" in found(terms.preset({"translations": {"Wizard": "Zauberer"}, "stop_words": ["wizard"]}))
    assert found(terms.preset({"places": ["x"]})) == usual


def test_errors_are_explained(spark):
    said = [("Provider HTTP 429: slow down", "translate"), ("boom", "audit"), ("boom", "translate"), ("  ", "translate"), ("ebook-convert timed out", "prepare")]
    x = spark.createDataFrame(said, "d string, s string").select(usage.explained(F.col("d"), F.col("s")).alias("x")).select("x.*").collect()
    assert [(r["code"], r["retryable"]) for r in x] == [("provider-rate-limit", True), ("output-build-failed", False), ("unexpected-error", False), ("unexpected-error", False), ("conversion-timeout", True)]
    assert x[2]["message"] == x[2]["detail"] == "boom" and x[3]["message"] == "Unknown error" and all(r["title"] and r["guidance"] and r["message"] for r in x)
    assert set(usage.MESSAGES) == set(usage.ADVICE) - {"unexpected-error"}


def test_settings_are_kept(tmp_path):
    path = tmp_path / "deep" / "settings.json"
    assert services.kept(path) == {}
    services.store(path, services.Settings(provider="openai", api_key="k", max_retries=99, model="é"))
    assert services.kept(path)["api_key"] == "k" and services.kept(path)["max_retries"] == 5 and services.kept(path)["model"] == "é"
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    services.store(path, services.Settings(provider="fake", api_key="k"))
    assert services.kept(path)["api_key"] == "" and os.listdir(path.parent) == ["settings.json"]
    path.write_text("{")
    assert services.kept(path) == {}


def test_ids_transformed_twice_are_left_out(spark):
    source = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (1, "b", "B2"), (1, "", "C"), (2, "a", "D"), (1, "c", "E")], "batch int, id string, source_html string")
    target = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (1, "", "w"), (2, "a", "v"), (1, None, "u")], "batch int, id string, translated_html string")
    got = sorted((r["batch"], r["id"], r["source_html"], r["translated_html"]) for r in checks.paired(source, target).collect())
    assert got == [(1, "b", "B", "z"), (1, "b", "B2", "z"), (2, "a", "D", "v")]


def test_all_entities_are_read(spark):
    df = spark.createDataFrame([("&copy; 1 &middot; 2&#8217;s &#x41; &eacute;&nbsp;&lt;b&gt;",), ("plain",), ("<p>&copy;</p>",)], "f string")
    got = [r["x"] for r in df.select(html.paragraphed(F.col("f")).alias("x")).collect()]
    assert got == ["<p>© 1 · 2’s A é &lt;b&gt;</p>", "<p>plain</p>", "<p>&copy;</p>"]


def test_batches_of_pages_and_books_are_bounded(spark, tmp_path):
    """Python gets pages and books in batches of bounded rows and bytes, and gives blocks back a book at a time."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {c: spark.conf.get(c) for c in (rows, size)}
    seen = []

    class Books:
        sparkSession = spark
        select = lambda self, *_: self

        def mapInPandas(self, run, schema):
            frame = pd.DataFrame({"path": [f"b{i}" for i in range(300)], "content": [b""] * 300})
            seen.extend(map(len, run(iter([frame]))))

    try:
        spark.conf.set(rows, "10000")
        spark.conf.set(size, "64m")
        books._read(Books(), lambda book, content: [(book, 1, None)] * 1200, "book string, order int, error string")
        assert int(spark.conf.get(rows)) <= 500 and int(spark.conf.get(size)) <= 4 << 20
        assert sum(seen) == 300 * 1200 and max(seen) <= 500
        spark.conf.set(rows, "10000")
        review.html_fragments(spark, SF)
        assert int(spark.conf.get(rows)) <= 500
        spark.conf.set(size, "1m")
        session.bounded(spark)
        assert spark.conf.get(size) == "1m"
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
