"""Lines numbered by split, terms found by automaton, percentiles from counts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import batches, blocks, checks, folds
from quire.sources import records


def test_lines_of_files_of_many_splits(spark, tmp_path):
    """The numbers are those of reading the file at once, whatever ends lines and wherever splits fall."""
    r = random.Random(1)
    lines = ["" if r.random() < 0.2 else "x" * r.randrange(1, 30) + "é" for _ in range(900)]
    ends = [r.choice(["\n", "\r\n", "\r"]) for _ in lines]
    ends = ["\r\n" if e == "\r" and i + 1 < len(lines) and not lines[i + 1] else e for i, e in enumerate(ends)]  # no CR before an LF of its own
    (tmp_path / "a.jsonl").write_bytes("".join(x + e for x, e in zip(lines, ends, strict=True)).encode())
    (tmp_path / "b.jsonl").write_bytes(b"one\r\n\r\ntwo")
    (tmp_path / "c.jsonl").write_bytes(b"")
    conf = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        x = records.numbered_lines(spark, str(tmp_path / "*.jsonl"))
        got = sorted((r["path"][-7], r["line"], r["value"]) for r in x.collect())
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 50
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = []
    for name in "ab":
        with (tmp_path / f"{name}.jsonl").open(encoding="utf-8") as f:
            want += [(name, i, line.rstrip("\n")) for i, line in enumerate(f, 1) if line.strip()]
    assert got == sorted(want)
    assert sorted(got) == sorted((r["path"][-7], r["line"], r["value"]) for r in records.numbered_lines(spark, str(tmp_path / "*.jsonl")).collect())


TEXTS = ["The Black Tower stood", "BlackTower no", "Black", "", None, "x Black Tower's end", "黑塔在此", "a+b (c) [d]", "Towers Tower", "é Tower é", "Ada met ada"]
TERMS = ["Black Tower", "Tower", "Black", "黑塔", "塔在", "a+b", "(c)", "[d]", "ada", "Ada", "", "zz", "Black Tower stood"]


@pytest.mark.parametrize("letters", [4_000_000, 12])
def test_terms_are_those_of_the_rule(spark, monkeypatch, letters):
    """One automaton, or several parts of the terms."""
    monkeypatch.setattr(checks, "TERM_LETTERS", letters)
    rows = spark.createDataFrame([(i if i else None, "b", x) for i, x in enumerate(TEXTS)], "id long, other string, text string").repartition(3)
    terms = spark.createDataFrame([(x,) for x in TERMS * 2], "source string")
    got = sorted((str(r["id"]), r["other"], r["term"]) for r in checks.term_hits(rows, terms, "text", ["id", "other"]).collect())
    want = rows.crossJoin(terms.distinct()).where(t.holds_term(F.col("text"), F.col("source"))).select(F.col("id").cast("string").alias("id"), "other", "source")  # a few rows
    assert got == sorted((str(r["id"]), r["other"], r["source"]) for r in want.collect()) and len(got) > 12
    assert checks.term_hits(rows, terms.limit(0), "text", ["id"]).count() == 0 and checks.term_hits(rows.limit(0), terms, "text", ["id"]).count() == 0


def test_a_hundred_thousand_terms_without_a_join(spark):
    """Every term starts with the same word, and so do all texts."""
    terms = spark.range(100_000).select(F.concat(F.lit("Lord "), F.col("id").cast("string"), F.lit(" of Mere")).alias("source"))
    rows = spark.range(2000).select("id", F.concat(F.lit("the Lord "), (F.col("id") * 77).cast("string"), F.lit(" of Mere and Lord")).alias("text"))
    hits = checks.term_hits(rows, terms, "text", ["id"])
    assert not re.search("Join|Exchange", hits._jdf.queryExecution().executedPlan().toString())
    got = {r["id"]: r["term"] for r in hits.collect()}
    assert got == {i: f"Lord {77 * i} of Mere" for i in range(2000) if 77 * i < 100_000}


@pytest.mark.parametrize(("percent", "width"), [(95, 1024), (95, 3), (50, 7), (100, 10), (1, 10)])
def test_nearest_rank(spark, percent, width):
    r = random.Random(percent)
    rows = [(r.choice(["a", "b", None]), r.choice([0, 1, 5, r.randrange(200)])) for _ in range(700)] + [("c", 4)]
    counts = spark.createDataFrame(rows, "k string, v long").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {x["k"]: x["p"] for x in folds.nearest_rank(counts, "k", "v", percent, "p", width).collect()}
    want = {}
    for k in ("a", "b", None, "c"):
        v = sorted(x for y, x in rows if y == k)
        want[k] = v[max(0, -(-percent * len(v) // 100) - 1)]
    assert got == want


def test_plans_of_one_language(spark):
    """All blocks in one key: what meets are counts of sizes."""
    blocks = spark.range(20_000).select(F.lit("en").alias("lang"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("chars"))
    got = batches.plan(blocks, "lang", "chars").first()
    v = sorted(r["chars"] for r in blocks.collect())
    assert (got["block_count"], got["total_chars"], got["max_block_chars"], got["p95_block_chars"]) == (20_000, sum(v), v[-1], v[19_000 - 1])
    assert got["batch_chars"] == 5000 and got["oversized"] == sum(x > 5000 for x in v)


WHITE = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"


def test_prose_is_told_without_squeezing(spark):
    """As from squeezed texts, but these aren't made: each pattern that read one made it anew."""
    r = random.Random(6)
    words = ["page_", "PAGE_1", "12", "٣", "#", "ffaa00", "a_b", "color", ":", "=", "red", "é", "x-1", ".", "(", "!", "-%", "中文", "\u200b", "𝒜", ""]
    texts = ["".join(r.choice([*words, *WHITE, "\n", "  "]) for _ in range(r.randrange(9))) for _ in range(20_000)] + [None]
    odd = (r"(?i)^page_\p{Nd}+$", r"^[\p{Nd}\s.,:;!?()\-–—_#]+$", r"^#[0-9A-Fa-f]{3,8}$", r"^[.#]?[A-Za-z_][A-Za-z0-9_-]*\s*[:=]\s*[-#\p{L}\p{N}_.,%() ]+$")
    x = spark.createDataFrame([(v,) for v in texts], "x string").withColumn("v", t.squeeze(F.coalesce("x", F.lit(""))))
    x = x.withColumn("want", F.expr("v <> ''") & F.col("v").rlike(r"\p{L}"))
    for p in odd:
        x = x.withColumn("want", F.col("want") & ~F.col("v").rlike(p))
    got = x.select("x", "want", t.has_prose(F.col("x")).alias("got")).collect()
    assert [g for g in got if g["want"] != g["got"]] == [] and 2000 < sum(g["got"] for g in got) < 18_000
    told = spark.createDataFrame([("a",)], "x string").where(t.has_prose(F.col("x")))
    assert "regexp_replace" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_stripped_at_either_end(spark):
    texts = [f"{a}{x}{b}" for x in ("", "x", "a \t b", "𝒜") for a in ("", *WHITE, "\u2003 \t") for b in ("", *WHITE, "\u2003 \t")] + ["", "\u200bx\u200b"]
    df = spark.createDataFrame([(1, "\n".join(texts)), (2, None), (3, ""), (4, " \n\t")], "k int, x string")
    got = [(r["k"], r["pos"], r["piece"]) for r in blocks.pieces(df, "k", F.col("x"), "\n").orderBy("k", "pos").collect()]
    assert got == [(1, i + 1, x) for i, x in enumerate(y.strip(WHITE) for y in texts if y.strip(WHITE))]
