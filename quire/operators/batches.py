"""Ordered rows packed into batches of a bounded number of rows and characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.folds import changes, nearest_rank, numbered, positions
from quire.session import forgotten, written

#: Rows that go back to Spark at a time.
SLICE = 10_000


def limits(max_rows: int, max_chars: int | None = None, max_tokens: int | None = None) -> tuple[int, int | None]:
    for n in (max_rows, max_chars, max_tokens):
        if n is not None and (not isinstance(n, int) or n <= 0):
            raise ValueError("batch limits are positive whole numbers")
    chars = [x for x in (max_chars, max_tokens and max_tokens * t.CHARS_PER_TOKEN) if x]
    return max_rows, min(chars) if chars else None


def packed(df: DataFrame, key: str, order: list[Column], weight: Column, max_rows: int, max_chars: int | None = None, max_tokens: int | None = None) -> DataFrame:
    """(key, seq, weight, chunk): rows of a key in order, a chunk closed when it is full by rows or when the
    next row would exceed the characters; a row larger than that is a chunk alone. Weights are whole numbers, null ones 0.
    Without a bound on characters a chunk follows from the place alone.

    A key's chunks hang on each other, but a chunk has at most `max_rows` rows, so within a range of a key's rows the first
    chunk that starts there does so at one of its first `max_rows` rows. Each range is packed as if it began its key, and
    works out what it would end with for each of these starts. A walk over the ranges (a row each) then tells where each is
    entered, and those that are entered otherwise are packed again from there. So a key with any share of the rows is packed
    by as many tasks as there are ranges."""
    rows, chars = limits(max_rows, max_chars, max_tokens)
    x = df.select(key, F.coalesce(weight.cast("double"), F.lit(0.0)).alias("weight"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    by = [*[F.col(f"o{i}") for i in range(len(order))], F.col("weight")]
    if chars is None:
        x = numbered(x, key, by).select(key, "weight", "seq")
        return x.select(key, "seq", "weight", (F.floor((F.col("seq") - 1) / rows) + 1).cast("long").alias("chunk"))
    kind = df.schema[key].dataType.simpleString()
    source = written(x, "rows")  # dealing by ranges reads its rows twice, first for a sample
    x = written(_in_ranges(source, key, by, kind, rows, chars), "packed")
    forgotten(source)
    done = x.where("head IS NULL")
    entries = _entered(x.where("head IS NOT NULL"), key, kind, rows, chars)
    entries = F.broadcast(written(entries, "entries"))  # a row a range at most
    again = done.where("first").join(entries, "part", "left_semi").join(entries, "part")
    own = done.where("NOT first").unionByName(done.where("first").join(entries, "part", "left_anti"))
    return own.select(key, "seq", "weight", "chunk").unionByName(_again(again, key, kind, rows, chars))


def _next(w: np.ndarray, ends: np.ndarray, rows: int, chars: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the chunk after the one that starts with it (ends: where its key ends), and the running
    sum before each row."""
    upto = np.concatenate([[0.0], np.cumsum(w)])
    at = np.arange(len(w))
    fits = np.searchsorted(upto, upto[:-1] + chars, side="right") - 1
    return np.minimum(np.minimum(np.maximum(fits, at + 1), at + rows), ends), upto


def _in_ranges(x: DataFrame, key: str, by: list[Column], kind: str, rows: int, chars: float) -> DataFrame:
    """The rows in ranges of key and order (part), each packed as if keys began there; and for a range's first and last
    key a row of how many rows it has there, the weights of the first of them, and what is open at the end if the first
    chunk starts with each of these. first: whether rows are of the range's first key."""
    sorted_ = x.repartitionByRange(key, *by).sortWithinPartitions(key, *by).select(key, "weight", F.spark_partition_id().alias("part"))

    def pack(keys: pa.Array, w: np.ndarray, starts: np.ndarray, part: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        """Whole keys (starts: of each); whether the first of them is the range's first, and the last its last."""
        n = len(w)
        bounds = np.append(starts, n)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        nxt, upto = _next(w, ends, rows, chars)
        begins, follow, s = np.zeros(n, np.int64), nxt.tolist(), 0
        while s < n:
            begins[s] = 1
            s = follow[s]
        begun, head = np.cumsum(begins), np.repeat(starts, np.diff(bounds))
        out = {"seq": np.arange(n) - head + 1, "chunk": begun - begun[head] + 1, "first": (head == 0) & first}
        for i in range(0, n, SLICE):
            yield frame(keys.slice(i, SLICE), w[i : i + SLICE], part, **{c: v[i : i + SLICE] for c, v in out.items()})
        for s, e in {(int(starts[0]), int(bounds[1])) if first else None, (int(starts[-1]), n) if last else None} - {None}:
            at = np.arange(s, min(s + rows, e))
            lead, chunks = w[at], np.ones(len(at), np.int64)
            while (more := nxt[at] < e).any():
                at[more] = nxt[at[more]]
                chunks[more] += 1
            yield frame(keys.slice(s, 1), [float(e - s)], part, head=[lead], open_rows=[e - at], open_weight=[upto[e] - upto[at]], chunks=[chunks])

    names = ["part", "seq", "chunk", "first", "head", "open_rows", "open_weight", "chunks"]

    def frame(keys: pa.Array, w, part: int, **columns) -> pa.RecordBatch:
        n = len(keys)
        types = {"part": pa.int32(), "seq": pa.int64(), "chunk": pa.int64(), "first": pa.bool_(), "head": pa.list_(pa.float64()), "open_rows": pa.list_(pa.int64()), "open_weight": pa.list_(pa.float64()), "chunks": pa.list_(pa.int64())}
        columns["part"] = np.full(n, part, np.int32)
        return pa.RecordBatch.from_arrays([keys, pa.array(w, pa.float64()), *[pa.array(columns[c], types[c]) if c in columns else pa.nulls(n, types[c]) for c in names]], [key, "weight", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, first, held = None, 0, True, []  # held: the weights of the key that is open, in pieces
        for b in batches:
            if not b.num_rows:
                continue
            keys, w, part = b.column(0), b.column(1).to_numpy(zero_copy_only=False), b.column(2)[0].as_py()
            starts = np.flatnonzero(changes(keys, last))
            open_ = int(sum(map(len, held)))
            if len(starts) and (open_ or starts[-1] > 0):
                # All but the last key are whole.
                cut = int(starts[-1])
                k = pa.concat_arrays([pa.repeat(last[0], open_), keys.slice(0, cut)]) if open_ else keys.slice(0, cut)
                heads = np.concatenate([[0], starts[:-1] + open_]) if open_ else starts[:-1]
                yield from pack(k, np.concatenate([*held, w[:cut]]), np.unique(heads), part, first, False)
                held, first, w = [], False, w[cut:]
            held.append(w)
            last = keys.slice(b.num_rows - 1, 1)
        if held:
            w = np.concatenate(held)
            yield from pack(pa.repeat(last[0], len(w)), w, np.zeros(1, np.int64), part, first, True)

    lists = "head array<double>, open_rows array<long>, open_weight array<double>, chunks array<long>"
    return sorted_.mapInArrow(run, f"`{key}` {kind}, weight double, part int, seq long, chunk long, first boolean, {lists}")


def _filled(open_rows: float, open_weight: float, head: np.ndarray, rows: int, chars: float) -> tuple[int, float, int]:
    """What is open, and how many more rows it took, when rows of weights `head` follow."""
    taken = 0
    for w in head:
        if open_rows >= rows or open_weight + w > chars:
            break
        open_rows, open_weight, taken = open_rows + 1, open_weight + w, taken + 1
    return open_rows, open_weight, taken


def _entered(ranges: DataFrame, key: str, kind: str, rows: int, chars: float) -> DataFrame:
    """(part, entry, chunk, before): of the ranges that go on with their first key, how many of their rows belong to the
    chunk that is open, its number, its rows and weight, and how many rows the key has before. A key's ranges (`weight`: how
    many rows it has in one) stream by in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, state = None, False, (0, 0.0, 0, 0)
        for f in frames:
            out = []
            for k, part, n, head, open_rows, open_weight, chunks in zip(*(f[c].tolist() for c in (key, "part", "weight", "head", "open_rows", "open_weight", "chunks")), strict=True):
                k = None if k is None or k != k else k
                if not begun or k != last:
                    last, begun, state = k, True, (0, 0.0, 0, 0)
                count, weight, chunk, before = state
                if before:
                    out.append((part, count, weight, chunk, before))
                    count, weight, taken = _filled(count, weight, head, rows, chars)
                else:
                    taken = 0
                state = (count, weight, chunk, before + int(n)) if taken == int(n) else (int(open_rows[taken]), float(open_weight[taken]), chunk + int(chunks[taken]), before + int(n))
            yield pd.DataFrame(out, columns=["part", "open", "held", "base", "before"])

    x = ranges.repartition(key).sortWithinPartitions(key, "part").select(key, "part", "weight", "head", "open_rows", "open_weight", "chunks")
    return x.mapInPandas(run, "part int, open long, held double, base long, before long")


def _again(rows_: DataFrame, key: str, kind: str, rows: int, chars: float) -> DataFrame:
    """The rows of ranges that are entered with an open chunk, packed on from there."""
    x = rows_.repartition("part").sortWithinPartitions("part", "seq").select(key, "seq", "weight", "part", "open", "held", "base", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total, chunk = None, 0, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for part, w, open_, held, base in zip(*(b.column(i).to_pylist() for i in (3, 2, 4, 5, 6)), strict=True):
                if part != last:
                    last, count, total, chunk = part, open_, held, base
                if count >= rows or total + w > chars:
                    count, total, chunk = 0, 0.0, chunk + 1
                count, total = count + 1, total + w
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), pc.add(b.column(1), b.column(7)), b.column(2), pa.array(out, pa.int64())], [key, "seq", "weight", "chunk"])

    return x.mapInArrow(run, f"`{key}` {kind}, seq long, weight double, chunk long")


def manifest(packed_rows: DataFrame, key: str) -> DataFrame:
    """One row per batch."""
    m = packed_rows.groupBy(key, "chunk").agg(
        F.count(F.lit(1)).alias("block_count"), F.sum("weight").cast("long").alias("source_chars"), F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq")
    )
    return m.withColumn("estimated_tokens", t.tokens_of_chars(F.col("source_chars")))


def _sizes(blocks: DataFrame, key: str, size: str) -> tuple[DataFrame, DataFrame]:
    """How often each size occurs in each key, and from that per key count, sum, largest and 95th percentile (nearest
    rank)."""
    counts = blocks.where(F.col(size).isNotNull()).groupBy(key, F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    s = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("block_count"), F.sum(size).cast("long").alias("total_chars"), F.max(size).cast("long").alias("max_block_chars"))
    p95 = nearest_rank(counts, key, "size", 95, "p95").select(F.col(key).alias("q_key"), F.col("p95").cast("long").alias("p95_block_chars"))
    return counts, s.join(p95, F.col(key).eqNullSafe(F.col("q_key")), "left").drop("q_key")


def _oversized(s: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """s with how many of each key's blocks are larger than its batches."""
    limits_ = s.select(F.col(key).alias("q_key"), F.col("batch_chars").alias("q_most"))
    over = counts.join(limits_, F.col(key).eqNullSafe(F.col("q_key")) & (F.col("size") > F.col("q_most"))).groupBy("q_key").agg(F.sum("n").alias("oversized"))
    return s.join(over, F.col(key).eqNullSafe(F.col("q_key")), "left").drop("q_key").withColumn("oversized", F.coalesce("oversized", F.lit(0).cast("long")))


def plan(blocks: DataFrame, key: str, size: str) -> DataFrame:
    """Per key: size statistics, the batch size they ask for, and what that gives. The percentile is the
    nearest rank."""
    counts, s = _sizes(blocks, key, size)
    limit = (
        F.when((F.col("total_chars") > 0) & (F.col("total_chars") < 40000) & (F.col("max_block_chars") < 4000), 8000)
        .when((F.col("total_chars") > 800000) | (F.col("p95_block_chars") > 3000), 5000)
        .otherwise(6000)
    )
    s = _oversized(s.withColumn("batch_chars", limit.cast("long")), counts, key)
    return s.withColumn("estimated_batches", F.ceil(F.col("total_chars") / F.col("batch_chars")).cast("long"))


def files(packed_rows: DataFrame, key: str, rank: str) -> DataFrame:
    """One row per batch of a manifest with a column `rank` (the file's place): its number over all files, and the
    names of its input and output."""
    x = positions(packed_rows, rank, [F.col(key), F.col("chunk")], "batch")
    stem = F.regexp_replace(F.element_at(F.split(F.col(key).cast("string"), "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.concat(F.lit("batch_"), F.format_string("%03d", "batch"), F.lit("_"), stem, F.lit("_"), F.format_string("%02d", "chunk"))
    return x.withColumn("input", F.concat(F.lit("batches/"), name, F.lit(".jsonl"))).withColumn("output", F.concat(F.lit("translated/"), name, F.lit(".translated.jsonl")))


def number_of(path: Column) -> Column:
    """The batch's number in a file's name; 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"batch_(\d+)_", 1), F.lit("")).try_cast("long"), F.lit(0).cast("long"))


SUMMARY = ("batch", "file", "chapter_label", "block_count", "input", "output")


def found(manifest_rows: DataFrame, number: int) -> DataFrame:
    """A batch's summary by its number."""
    have = set(manifest_rows.columns)
    blank = {"batch": F.lit(None).cast("long"), "block_count": F.lit(0).cast("long")}
    return manifest_rows.where(F.col("batch") == number).select(*[F.col(c) if c in have else blank.get(c, F.lit("")).alias(c) for c in SUMMARY])


def profile(blocks: DataFrame, key: str, size: str, pdf: Column, asked: int | None = None) -> DataFrame:
    """Per key the whole preparation plan: statistics, batch size (that of a PDF first, or the one asked for),
    what it gives, and warnings. pdf: whether the key's source is one."""
    counts, s = _sizes(blocks, key, size)
    told = blocks.groupBy(key).agg(F.bool_or(pdf).alias("pdf")).withColumnRenamed(key, "q_key")
    s = s.join(told, F.col(key).eqNullSafe(F.col("q_key"))).drop("q_key")
    small = (F.col("total_chars") > 0) & (F.col("total_chars") < 40000) & (F.col("max_block_chars") < 4000)
    limit = F.when(F.col("pdf"), 4500).when(small, 8000).when((F.col("total_chars") > 800000) | (F.col("p95_block_chars") > 3000), 5000).otherwise(6000)
    limit = F.lit(min(max(asked, 1000), 100_000)) if asked is not None else F.least(F.greatest(limit, F.lit(3000)), F.lit(10_000))
    s = _oversized(s.withColumn("batch_chars", limit.cast("long")), counts, key)
    warnings = F.concat_ws(",", F.when(F.col("block_count") == 0, "no-text-detected"), F.when(F.col("oversized") > 0, "oversized-source-blocks"))
    return s.withColumn("estimated_batches", F.greatest(F.lit(1), F.ceil(F.col("total_chars") / F.col("batch_chars"))).cast("long")).withColumn("tokens_per_batch", t.tokens_of_chars(F.col("batch_chars"))).withColumn("warnings", warnings)
