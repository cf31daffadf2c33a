import json
import re
import zipfile
from io import BytesIO

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import markup, replies, split
from quire.functions import text as t
from quire.operators import batches, blocks, checks, links, memory, terms, usage
from quire.plans import queries, transform
from quire.sources import books, formats, glossaries

SF = "/root/testdata/sf0.001"


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_match_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(tuple(str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in x[sorted(x.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_every_query_has_an_oracle():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize(
    ("value", "kept"),
    [("", False), (" \u00a0", False), ("page_12", False), ("12.5 - 3", False), ("#ffaa00", False), ("color: red", False), ("Hello there.", True), ("中文", True), ("Note: it works!", True), ("x", True)],
)
def test_prose(spark, value, kept):
    df = spark.createDataFrame([(value,)], "x string")
    assert df.select(t.has_prose(F.col("x"))).first()[0] is kept


def test_section_kinds(spark):
    labels = ["Chapter 12: x", "chapter", "Table of Contents", "About the Author", None, "Chapter 1st"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(t.section_kind(F.col("x"))).collect()] == ["chapter", "unknown", "front_matter", "back_matter", "unknown", "unknown"]


def test_doc_classify_reads_whole_texts(spark, tmp_path):
    from quire.plans.queries import QUERIES

    rows = [(1, "x " * 150 + "copyright"), (2, "x " * 150 + "about the author"), (3, "x " * 150), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(QUERIES["doc_classify"](spark, str(tmp_path)).collect())
    assert got == {1: "front_matter", 2: "back_matter", 3: "unknown", 4: "unknown"}


def test_term_functions(spark):
    rows = [("The Cat's cat", "Cat", True), ("Concat", "Cat", False), ("価格は", "価", True), ("a.b", "a.b", True), ("axb", "a.b", False), ("x", "", False)]
    df = spark.createDataFrame(rows, "text string, term string, there boolean")
    assert all(r[0] == r[1] for r in df.select("there", t.holds_term(F.col("text"), F.col("term"))).collect())
    got = df.select(t.replace_term(F.col("text"), F.col("term"), F.lit("$1\\"))).collect()
    assert [r[0] for r in got] == ["The $1\\'s cat", "Concat", "$1\\格は", "$1\\", "axb", "x"]
    assert spark.range(1).select(t.clean_term(F.lit("  “Old  King's ”,"))).first()[0] == "Old King"


@pytest.mark.parametrize(("most", "chars", "tokens", "chunks"), [(9, 45, None, [1, 1, 2, 2]), (9, None, 5, [1, 2, 3, 4]), (3, None, None, [1, 1, 1, 2]), (9, 1000, None, [1, 1, 1, 1]), (9, 10, None, [1, 2, 3, 4])])
def test_packing_limits(spark, most, chars, tokens, chunks):
    df = spark.createDataFrame([("f", i, 20) for i in range(4)], "file string, pos int, chars int")
    got = batches.packed(df, "file", [F.col("pos")], F.col("chars"), most, chars, tokens).orderBy("seq").collect()
    assert [r["chunk"] for r in got] == chunks


def test_bad_limits():
    for bad in ((0,), (5, 0), (5, None, -1), ("5",)):
        with pytest.raises(ValueError):
            batches.limits(*bad)


def test_noise_words(spark):
    words = {"The": True, "Monday": True, "The Old King": True, "O’Neil": True, "Sir": True, "Xy": True, "": True, "Oakvale": False, "King Oakvale": False}
    df = spark.createDataFrame([(k, v) for k, v in words.items()], "w string, noise boolean")
    assert df.where(terms.is_noise(F.col("w")) != F.col("noise")).count() == 0


def test_merges(spark):
    s = "source string, translation string, status string, confidence double, locked boolean, pos int"
    old = spark.createDataFrame([("a", "x", "approved", 0.9, True, 1), ("b", "y", "pending", 0.1, False, 2), ("a", "later", "pending", 0.0, False, 3), ("", "z", "pending", 0.0, False, 4)], s)
    new = spark.createDataFrame([("a", "", "pending", 0.0, False, 1), ("c", "w", "pending", 0.5, False, 2)], s)
    get = lambda mode: values(terms.merged(old, new, mode), "source", "translation", "status", "locked")
    assert get("upsert") == [("a", "x", "approved", True), ("b", "y", "pending", False), ("c", "w", "pending", False)]
    assert get("append") == [("a", "x", "approved", True), ("b", "y", "pending", False), ("c", "w", "pending", False)]
    assert get("replace") == [("a", "", "pending", False), ("c", "w", "pending", False)]
    with pytest.raises(ValueError):
        terms.merged(old, new, "other")


def test_identity_rules(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "x")], "batch int, pos int, id string")
    b = spark.createDataFrame([(1, 1, "b"), (1, 2, "b"), (1, 3, "q"), (2, 1, "x")], "batch int, pos int, id string")
    got = values(checks.identity_issues(a, b).where("batch = 1"), "rule", "row_id")
    assert got == [("missing", "a"), ("order changed", ""), ("source id empty", ""), ("target id repeated", "b"), ("unexpected", "q")]
    assert checks.identity_issues(a, b).where("batch = 2").count() == 0


def test_term_hits_equal_all_pairs(spark):
    docs = spark.createDataFrame([(1, "The old Oak Tree fell."), (2, "Oak Trees; Oak"), (3, "naïve 価格 Oak")], "id int, text string")
    names = spark.createDataFrame([("Oak",), ("Oak Tree",), ("価格",), ("zz",)], "source string")
    every = docs.crossJoin(names).where(t.holds_term(F.col("text"), F.col("source"))).select("id", F.col("source").alias("term"))
    assert values(checks.term_hits(docs, names, "text", ["id"]), "id", "term") == values(every, "id", "term")


def test_structure_rules():
    src = '<p class="a" id="i">x <a href="u">y</a></p>'
    assert markup.structure_issues(src, '<p class="a" id="i">z <a href="u">w</a></p>') == []
    rules = lambda g: [r for r, _ in markup.structure_issues(src, g)]
    assert rules("") == rules(None) == ["empty"] and rules("<p>") == rules("<p/><p/>") == ["unparsable"]
    assert rules('<div class="a" id="i"><a href="u"/></div>') == ["root tag", "structure"]
    assert rules('<p class="b" id="i"><a href="u"/></p>') == ["root attribute", "structure"]


def test_structure_repair(spark):
    src = '<p id="i">x <a href="u">y</a><img src="s"/></p>'
    fixed = markup.repaired(src, '<p id="j">z <a href="other">w</a></p>')
    assert {x for x in markup.structure(markup.snippet(fixed))} == set(markup.structure(markup.snippet(src)))
    assert markup.repaired(src, "<broken") == "<broken"
    rows = spark.createDataFrame([("1", src, '<p id="j">z</p>'), ("2", "<p>a</p>", "<p>b</p>")], "id string, source_html string, translated_html string")
    assert values(markup.validated(rows), "id", "rule") == [("1", "root attribute"), ("1", "structure")]
    assert markup.validated(markup.repaired_rows(rows)).count() == 0


def test_replies(spark):
    row = {"id": "a", "translated_html": "<p>é</p>"}
    one = json.dumps(row)
    for reply in (f"[{one}]", json.dumps({"rows": [row]}), f"```json\n[{one}]\n```", one, f"Sure! {one} done", one + "\n" + one, '{"id": "a", "translated_html": "<p class="x">q</p>"}'):
        got = replies.parse(reply)
        assert got[0]["id"] == "a" and got[0]["translated_html"].startswith("<p")
    assert replies.parse("  ") == []
    with pytest.raises(ValueError, match="no idea"):
        replies.parse("no idea")
    df = spark.createDataFrame([(f"[{one}]",), ("none",), (None,)], "r string").select(replies.parsed(F.col("r")).alias("x")).select("x.*").collect()
    assert [len(r["rows"]) for r in df] == [1, 0, 0] and df[1]["error"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .。!\n", max_size=3000), st.integers(100, 1200))
def test_split_is_lossless(text, limit):
    parts = split.cut(text, limit)
    assert "".join(parts) == text and all(0 < len(p) <= max(500, limit - 256) + 1 for p in parts)


def test_split_and_merge(spark):
    df = spark.createDataFrame([("a", "word. " * 500), ("b", "short")], "id string, text string")
    parts = df.select("id", F.posexplode(split.pieces(F.col("text"), 800)).alias("n", "text"))
    assert values(transform.merged(parts), "id", "text") == values(df, "id", "text")


def test_transform_splits_and_resumes(spark):
    rows = spark.createDataFrame([(b, i, f"{b}:{i}", f'<p id="{b}-{i}">text {i}</p>') for b in (1, 2) for i in range(6)], "batch long, seq int, id string, source_html string")

    def fragile(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > 2 or "1:3" in set(part["id"]):
            raise RuntimeError("too much")
        return pd.DataFrame({"id": part["id"], "translated_html": part["source_html"].str.replace("text", "done")})

    out = transform.transformed(rows, fragile, retries=0)
    assert values(out.where("error is not null"), "id") == [("1:3",)] and out.count() == 12
    assert {r["batch"] for r in transform.pending(rows, out).collect()} == {1}
    assert transform.transformed(rows, transform.constant()).where("error is null").count() == 12


def test_books(spark, tmp_path):
    book = books.minimal_book("T & U", ['<h1 id="h">Title one</h1>', '<p class="c">Some <em>inline</em> text</p>', "<p>12</p>", "<ul><li><p>nested</p></li></ul>"])
    (tmp_path / "a.epub").write_bytes(book)
    (tmp_path / "b.epub").write_bytes(b"no zip")
    got = books.blocks(spark, str(tmp_path)).orderBy("book", "seq").collect()
    assert [(r["seq"], r["tag"], r["text"], r["label"]) for r in got[:-1]] == [(1, "h1", "Title one", "T & U"), (2, "p", "Some inline text", "T & U"), (3, "li", "nested", "T & U"), (4, "p", "nested", "T & U")]
    assert got[-1]["error"]
    simple = books.minimal_book("x", ["<p>one</p>", '<p id="k">two <b>three</b></p>'])
    new = {f"{b[1]}::{b[3]:04d}": b[6].replace("two", "zwei") for b in books.read_blocks(simple)}
    again = books.applied(simple, new)
    assert [b[5] for b in books.read_blocks(again)] == ["one", "zwei three"]
    with zipfile.ZipFile(BytesIO(again)) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    with pytest.raises(ValueError):
        books.applied(simple, {})


@pytest.mark.parametrize(("name", "mode", "why"), [("a/../b", 0, "outside"), ("/a", 0, "absolute"), ("C:\\x", 0, "absolute"), ("l", 0o120777, "no regular file"), ("", 0, "no name"), ("a/b", 0o100644, None)])
def test_unsafe_entries(name, mode, why):
    assert books.unsafe(name, mode) == why


def test_formats(spark):
    df = spark.createDataFrame([(x,) for x in ("a/B.EPUB", "x.txt?y=.pdf", "h.htm#z", "p.mobi", "none", ".txt")], "p string")
    assert [r[0] for r in df.select(formats.conversion(F.col("p"))).collect()] == ["native", "internal-text", "internal-html", "calibre", "unsupported", "unsupported"]


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text('Source Term,Target,Aliases,Confidence,Locked\nOak,Eiche,"a; b",0.95,yes\nElm,,,x,no\n')
    csv = glossaries.read(spark, str(tmp_path / "g.csv"))
    assert values(csv, "source", "translation", "confidence", "locked") == [("Elm", "", 0.0, False), ("Oak", "Eiche", 0.95, True)]
    assert csv.where("source = 'Oak'").first()["aliases"] == ["a", "b"]
    (tmp_path / "g.json").write_text(json.dumps({"terms": [{"source": "Oak", "translation": "Eiche", "aliases": ["a"], "confidence": 0.9}]}))
    assert values(glossaries.read(spark, str(tmp_path / "g.json")), "source", "confidence") == [("Oak", 0.9)]
    (tmp_path / "g.md").write_text("# x\n| Source | Translation | Confidence |\n| --- | --- | --- |\n| Oak | Eiche | 0.95 |\n- Elm -> Ulme (3, special, confidence 0.40)\n")
    assert values(glossaries.read(spark, str(tmp_path / "g.md")), "source", "translation", "status", "locked") == [("Elm", "Ulme", "pending", False), ("Oak", "Eiche", "approved", True)]
    assert "| Oak | Eiche | special | 0.95 |" in glossaries.markdown(glossaries.read(spark, str(tmp_path / "g.md"))).first()[0]
    body = "".join(r[0] for r in glossaries.tbx(csv).collect())
    (tmp_path / "g.tbx").write_text(f"<martif><text><body>{body}</body></text></martif>")
    assert values(glossaries.read(spark, str(tmp_path / "g.tbx")), "source", "translation", "confidence") == values(csv, "source", "translation", "confidence")


def test_memory(spark):
    s = memory.SCHEMA
    none = spark.createDataFrame([], s)
    new = spark.sql("SELECT 'Hello  there' source_text, '' source_html, 'Hallo' translated_html, 'de' target_language, 'p' source_project, 1.0D confidence, timestamp'2024-01-01' updated_at, 1 seq")
    first = memory.upserted(none, new.unionByName(new.withColumn("translated_html", F.lit(" ")).withColumn("seq", F.lit(2))))
    again = memory.upserted(first, new.withColumn("updated_at", F.expr("timestamp'2025-01-01'")))
    assert first.count() == 1 and again.first()["updated_at"].year == 2024
    changed = memory.upserted(first, new.withColumn("translated_html", F.lit("Servus")).withColumn("updated_at", F.expr("timestamp'2025-01-01'")))
    assert changed.first()["translated_html"] == "Servus" and changed.first()["updated_at"].year == 2025
    rows = spark.sql("SELECT ' Hello there ' source_text, '' source_html")
    assert memory.hits(rows, first, "de").count() == 1 and memory.hits(rows, first, "fr").count() == 0


def test_links(spark):
    x = spark.createDataFrame([("t/a.html", "../s/b.html#k"), ("t/a.html", "c.html"), ("t/a.html", "#no"), ("t/a.html", "mailto:x@y"), ("t/a.html", "http://e/x")], "file string, value string")
    files = spark.createDataFrame([("t/a.html",), ("s/b.html",)], "file string")
    ids = spark.createDataFrame([("s/b.html", "k")], "file string, id string")
    assert values(links.broken(x, files, ids), "value", "why") == [("#no", "anchor missing"), ("c.html", "file missing")]
    assert spark.range(1).select(links.srcset(F.lit("a.png 1x, b.png 2x"))).first()[0] == ["a.png", "b.png"]


def test_budget_lets_cheaper_ones_pass(spark):
    e = spark.createDataFrame([("j", 1, 60), ("j", 2, 50), ("j", 3, 40), ("j", 4, 1)], "k string, n int, c long")
    assert [r["admitted"] for r in usage.admitted(e, "k", ["n"], "c", 100).orderBy("n").collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    ("text", "stage", "code", "again"),
    [
        ("Upload exceeds configured limit", "x", "upload-too-large", False), ("ebook-convert timed out", "x", "conversion-timeout", True), ("Provider HTTP 401", "x", "provider-authentication", False),
        ("Provider HTTP 503", "x", "provider-error", True), ("Provider HTTP 404", "x", "provider-error", False), ("odd", "audit", "output-build-failed", False), ("odd", "x", "unexpected-error", False),
    ],
)
def test_ladder(spark, text, stage, code, again):
    r = spark.range(1).select(usage.diagnosed(F.lit(text), F.lit(stage)).alias("x")).first()["x"]
    assert (r["code"], r["retryable"]) == (code, again)


def test_blocks(spark):
    df = spark.createDataFrame([(1, " a \n\n \n b\nc"), (2, ""), (3, None)], "k int, x string")
    assert values(blocks.pieces(df, "k", F.col("x"), blocks.PARAGRAPH), "k", "pos", "piece") == [(1, 1, "a"), (1, 2, "b\nc")]
    assert spark.range(1).select(blocks.block_id(F.lit("f"), F.lit(7))).first()[0] == "f::0007"


def test_entry_without_optional_parts():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert re.fullmatch(r"\w+", queries.FLAGSHIP)
