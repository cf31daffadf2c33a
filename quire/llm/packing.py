"""Packing by cutting-stock column generation.

Every document becomes token ids and a closing id 1, cut into pieces: as many full sequences as it fills,
and a rest. The rests' lengths (with a GRAIN of 1 exact, else rounded up to its multiples) form a histogram
of bounded size, which is all that the driver sees. A linear program over patterns (how many pieces of each length a sequence takes)
is solved by the revised simplex method; a knapsack dynamic program prices new columns. Patterns are rounded
down to whole numbers of sequences; what is left of the histogram (fewer pieces than patterns times their
sizes) goes into a few more sequences, largest first. Pieces are ranked within their length, in a fixed
order, and rank intervals map them to the patterns' sequences. Padding is what a sequence lacks of 2048, or
of the next power of two if it holds less than half.

A length may hold a third of all pieces (copies): ranks come from counts of (length, slice) pairs and from
row numbers within a slice, whose number grows with the pieces.

A null text is empty: its only id is 1. Repeated rows are packed as often as they occur; those that agree
in doc_id and text give equal pieces, in any order. An empty table gives no piece. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, frugal, written

LENGTH = 2048
GRAIN = 1
GAP = 1e-4
END_ID = 1
LONG_SPACE = 100_000
ROWS_PER_SLICE = 4000


@lru_cache(1)
def encoding():
    """The vocabulary of byte_bpe_50k.json in tiktoken, whose encoder gives the same ids several times as
    fast as the tokenizers library (held against it in the tests) for the texts that `ids_of` gives it."""
    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def reference(encode_special_tokens: bool):
    """The tokenizers library's own, and the added tokens that it looks for."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = encode_special_tokens
    added = t.get_added_tokens_decoder().values()
    return t, tuple(a.content for a in added if not (encode_special_tokens and a.special))


def ids_of(text: str, encode_special_tokens: bool) -> list[int]:
    """The ids that the tokenizers library gives. Texts with an added token's string, and those with a run of
    white space that tiktoken's expression may fail on, are encoded by that library."""
    t, added = reference(encode_special_tokens)
    spaces = len(text) >= LONG_SPACE and any(m.end() - m.start() >= LONG_SPACE for m in re.finditer(r"\s+", text))
    if spaces or any(a in text for a in added):
        return t.encode(text, add_special_tokens=False).ids
    return encoding().encode_ordinary(text)


PIECES = "doc_id long, key long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, length: int = LENGTH, encode_special_tokens: bool = False) -> DataFrame:
    """Per piece: its document, place, length and the checksum of its ids. key orders equal lengths."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*ids_of(text if isinstance(text, str) else "", encode_special_tokens), END_ID], "<u4")
                key = zlib.crc32(ids.tobytes())
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    rows.append((doc, key, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(frugal(run), PIECES)


def knapsack(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth: unbounded knapsack by dynamic programming over capacities."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_sorted, worth_sorted = sizes[order], worth[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(sizes_sorted, c, "right")
        if n:
            v = best[c - sizes_sorted[:n]] + worth_sorted[:n]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], pick[c] = v[k], order[k]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), pattern


def _largest_first(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first basis, its inverse and the uses of its columns: largest pieces first into a sequence, as often
    (fractions allowed) as some length lasts. Each column uses up a length that no later one has, so in that
    order the basis is triangular."""
    m = len(sizes)
    left, live, order, columns, uses = demand.astype(float), np.ones(m, bool), [], [], []
    descending = np.argsort(-sizes, kind="stable")
    while live.any():
        space, column = capacity, np.zeros(m)
        for i in descending[live[descending]]:
            n = space // int(sizes[i])
            column[i], space = n, space - n * int(sizes[i])
        used = np.flatnonzero(column)
        ratio = left[used] / column[used]
        out = int(used[ratio.argmin()])
        left = np.maximum(left - column * ratio.min(), 0)
        live[out] = False
        order.append(out)
        columns.append(column)
        uses.append(float(ratio.min()))
    lower = np.array(columns).T[order]
    solved = np.zeros((m, m))
    for i in range(m):
        solved[i] = -np.einsum("k,kj->j", lower[i, :i], solved[:i]) if i else 0
        solved[i, i] += 1
        solved[i] /= lower[i, i]
    inverse = np.zeros((m, m))
    inverse[:, order] = solved
    return np.array(columns).T, inverse, np.array(uses)


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used: together they hold the demand exactly. The simplex ends when no
    pattern prices below 1, when a bound (the pieces' sum, or Farley's) proves that less than a sequence, or
    GAP of them, could be saved, or after `most` columns, when what it has so far is still feasible."""
    m = len(sizes)
    if not m:
        return []
    basis, inverse, x = _largest_first(sizes, demand, capacity)
    least = float((sizes * demand).sum()) / capacity
    for _ in range(most):
        duals = inverse.sum(axis=0)
        value, pattern = knapsack(duals, sizes, capacity)
        used = float(x.sum())
        least = max(least, used / value)
        if value <= 1 + 1e-7 or used - least < max(1.0, GAP * used):
            break
        d = (inverse * pattern).sum(axis=1)
        ok = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / d[ok]
        out = int(ratio.argmin())
        basis[:, out] = pattern
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        x = x - ratio[out] * d
        x[out] = ratio[out]
        x = np.maximum(x, 0)
    times = np.floor(x + 1e-9).astype(np.int64)
    whole = basis.astype(np.int64)
    left = demand - (whole * times).sum(axis=1)
    while (left < 0).any():  # rounding errors may have left an x too large
        times[int((whole[int(left.argmin())] * (times > 0)).argmax())] -= 1
        left = demand - (whole * times).sum(axis=1)
    out = [(whole[:, i], int(times[i])) for i in range(m) if times[i]]
    order = np.argsort(-sizes, kind="stable")
    while left.any():  # largest first into what remains of a sequence
        space, pattern = capacity, np.zeros(m, np.int64)
        for i in order:
            n = min(int(left[i]), space // int(sizes[i]))
            pattern[i], space = n, space - n * int(sizes[i])
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, n))
        left = left - pattern * n
    return out


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """For each size the rank intervals: first rank, pieces a sequence, first sequence, slot."""
    sizes = np.array(sorted(histogram), int)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    rows, rank, sequence = [], np.zeros(len(sizes), np.int64), 0
    for pattern, times in patterns(sizes, demand, capacity):
        for i in np.flatnonzero(pattern):
            rows.append((int(sizes[i]), int(rank[i]), int(pattern[i]), sequence))
            rank[i] += pattern[i] * times
        sequence += times
    return pd.DataFrame(rows, columns=["size", "first", "per", "sequence"])


def packed(docs: DataFrame, length: int = LENGTH, grain: int = GRAIN, encode_special_tokens: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.
    encode_special_tokens: as in the tokenizers library, whether added tokens' strings are ordinary text (the
    library's own setting, and that of the query, is False)."""
    batched(docs.sparkSession)
    p = written(pieces(docs, length, encode_special_tokens), "pieces").withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    per_size = written(p.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "sizes")  # a row a size: as many as a sequence has tokens
    slices = F.broadcast(per_size.select("size", F.ceil(F.col("n") / ROWS_PER_SLICE).alias("slices")))
    p = p.join(slices, "size").withColumn("slice", F.pmod(F.xxhash64("doc_id", "key", "start"), F.col("slices"))).drop("slices")
    counts = p.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "counts")
    whole = length // grain
    histogram = {int(r["size"]): int(r["n"]) for r in per_size.collect()}
    table = plan(histogram, whole)
    here = Window.partitionBy("size", "slice").orderBy("doc_id", "start", "key")
    ranked = p.withColumn("row", F.row_number().over(here) - 1).join(counts.select("size", "slice", "before"), ["size", "slice"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("row")).alias("rank"))
    by_size = {int(s): tuple(g[c].to_numpy(np.int64) for c in ("first", "per", "sequence")) for s, g in table.groupby("size")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, slot = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            size, rank = batch["size"].to_numpy(), batch["rank"].to_numpy(np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, per, base = by_size[int(s)]
                k = np.searchsorted(first, rank[at], "right") - 1
                n = rank[at] - first[k]
                sequence[at], slot[at] = base[k] + n // per[k], n % per[k]
            yield batch.assign(sequence_id=sequence, slot=slot)[[x.split()[0] for x in PLACED.split(", ")]]

    placed = ranked.mapInPandas(place, PLACED)
    inside = Window.partitionBy("sequence_id").orderBy(F.col("size").desc(), "slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, sequence_id long, slot long"
