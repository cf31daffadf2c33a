"""Packing and numbering in ranges: any share of the rows may be of one key, and results are those of a walk."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import batches, folds


@pytest.fixture
def many_ranges(spark):
    """Ranges aren't put together, though they are small here."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def walked(rows, most, chars):
    """(key, seq, weight, chunk) of rows (key, place, weight), one after another."""
    out, last = [], object()
    for k, _, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k != last:
            last, seq, n, total, chunk = k, 0, 0, 0, 1
        if n and (n >= most or total + w > chars):
            n, total, chunk = 0, 0, chunk + 1
        n, total, seq = n + 1, total + w, seq + 1
        out.append((k, seq, w, chunk))
    return sorted(out, key=str)


def rows_of(seed, n, hot):
    r = random.Random(seed)
    keys = [None, *range(1, 40)]
    return [(7 if r.random() < hot else r.choice(keys), i, r.choice([0, 1, 5, 20, 90, 400])) for i in range(n)]


@pytest.mark.parametrize(("hot", "most", "chars"), [(0.4, 20, 300), (1.0, 7, 95), (0.0, 3, 1000), (0.9, 500, 800), (1.0, 100_000, 500), (1.0, 100_000, 10**9), (0.5, 1, 10)])
def test_packing_equals_a_walk(many_ranges, hot, most, chars):
    rows = rows_of(most, 4000, hot)
    df = many_ranges.createDataFrame(rows, "k long, i long, w long").repartition(5)
    got = [(r["k"], r["seq"], int(r["weight"]), r["chunk"]) for r in batches.packed(df, "k", [F.col("i")], F.col("w"), most, chars).collect()]
    assert sorted(got, key=str) == walked(rows, most, chars)


def test_packing_of_one_key_spreads(many_ranges):
    """A table of one key is packed by as many tasks as there are ranges."""
    df = many_ranges.range(200_000).select(F.lit("book").alias("k"), F.col("id").alias("i"), (1 + F.pmod(F.xxhash64("id"), F.lit(300))).alias("w"))
    x = batches._in_ranges(df.select("k", F.col("w").cast("double").alias("weight"), F.col("i").alias("o0")), "k", [F.col("o0")], "string", 20, 1500)
    shares = [r["count"] for r in x.where("head IS NULL").groupBy("part").count().collect()]
    assert len(shares) == 9 and max(shares) < 2 * 200_000 / 9
    p = batches.packed(df, "k", [F.col("i")], F.col("w"), 20, 1500)
    m = p.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("chunk").collect()
    assert [r["chunk"] for r in m] == list(range(1, len(m) + 1)) and all(r["n"] <= 20 and r["w"] <= 1500 and r["b"] - r["a"] + 1 == r["n"] for r in m)
    first = {r["seq"]: r["weight"] for r in p.where("seq > 1").join(F.broadcast(p.groupBy("chunk").agg(F.min("seq").alias("seq")).select("seq")), "seq", "left_semi").collect()}
    assert all(x["n"] == 20 or x["w"] + first[y["a"]] > 1500 for x, y in zip(m, m[1:], strict=False))  # no chunk closes early


def test_packing_of_no_rows_and_null_weights(many_ranges):
    df = many_ranges.createDataFrame([(1, 1, None), (1, 2, 5)], "k long, i long, w long")
    assert batches.packed(df.limit(0), "k", [F.col("i")], F.col("w"), 2, 10).count() == 0
    assert sorted((r["seq"], r["weight"], r["chunk"]) for r in batches.packed(df, "k", [F.col("i")], F.col("w"), 2, 10).collect()) == [(1, 0.0, 1), (2, 5.0, 1)]


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_numbering_within_keys(many_ranges, hot):
    rows = rows_of(3, 3000, hot)
    df = many_ranges.createDataFrame([(k, i, w, f"x{i}") for k, i, w in rows], "k long, i long, w long, more string").repartition(4)
    want = {i: seq for (k, i, w), (_, seq, _, _) in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), sorted(walked(rows, 1, 1), key=lambda r: (r[0] is not None, r[0] or 0, r[1])), strict=True)}
    got = folds.numbered(df, "k", [F.col("i")], "n")
    assert {r["i"]: r["n"] for r in got.collect()} == want and got.columns == ["k", "i", "w", "more", "n"]
    assert folds.numbered(df.limit(0), "k", [F.col("i")]).count() == 0


def test_positions_of_one_value(many_ranges):
    """Rows that agree in the sort column, and nulls of it, are dealt out by the ties."""
    df = many_ranges.range(20_000).select(F.when(F.col("id") % 4 == 0, None).otherwise(F.lit(5)).cast("long").alias("a"), F.col("id").alias("b"))
    x = folds.positions(df, "a", [F.col("b")], "n")
    got = [(r["a"] is not None, r["b"]) for r in x.orderBy("n").collect()]
    assert got == sorted(got) and sorted(r["n"] for r in x.collect()) == list(range(1, 20_001))
    written = folds.written(df.repartitionByRange("a", "b").withColumn("p", F.spark_partition_id()), "test")
    assert max(Counter(r["p"] for r in written.collect()).values()) < 2 * 20_000 / 9


@pytest.mark.parametrize("dealt", ["packed", "numbered", "positions"])
def test_rows_are_worked_out_once(many_ranges, dealt):
    """Ranges are drawn from a sample of written rows, not of rows that are worked out for it once more."""
    seen = many_ranges.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    df = many_ranges.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"), F.udf(count, "long")("id").alias("w"))
    if dealt == "packed":
        x = batches.packed(df, "k", [F.col("i")], F.col("w"), 20, 6000)
    elif dealt == "numbered":
        x = folds.numbered(df, "k", [F.col("i")])
    else:
        x = folds.positions(df, "w", [F.col("i")], "n")
    assert x.count() == 3000 and seen.value == 3000
