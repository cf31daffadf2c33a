"""N-gram Jaccard join: the blocked sparse product of the document by n-gram incidence matrix with itself.

Documents are rows, 5-word shingles columns; the product's cell (x, y) is the overlap of two shingle sets.
Two documents link when 100 * overlap >= 75 * union. No link between different sets is lost:

1. Documents of equal sets form a class; from here on a class counts as one document.
2. A sketch of fixed size counts how often shingles occur. It only ranks columns, rare ones first, so its
   errors cost time, never results. For sets that link, overlap >= 75/175 of the summed sizes, so they share
   one of the first n - ceil(0.75 n) + 1 columns of either set in that order. Only these entries of the
   matrix are dealt out, by column.
3. In each column block (the documents of one shingle, split by salt where the sketch says it is hot) every
   document is paired with one centre, not with each other. Cells whose size-derived bounds (the ratio of
   sizes; what may still follow the shared column) rule a link out are discarded; the others are computed as
   sparse dot products. Links merge documents into components.
4. Columns that still hold several components get other centres, and cells across components are computed.
5. Columns that still do are expanded, across components only and under the same bounds, and the remaining
   cells are computed. Links found there merge components.

So large groups of near copies cost cells in proportion to their size, and what is not linked by a centre
is still examined. Components come from label propagation over written tables.

A null or empty text has an empty set and is its own component; with fewer than 5 words the whole sequence
is the one shingle. Repeated rows are copies. A null doc_id takes part in linking but names no component
unless all of its component's ids are null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower_words, batched, forgotten, frugal, text_or_empty, written

SHINGLE, PERCENT = 5, 75
SKETCH_BITS, CHUNK_BITS = 22, 16
HOT, MOST_BROADCAST = 2000, 1_000_000
SEEN, FLUSH = 50_000, 250_000
#: Rows of numbers that are worked on at a time.
GATHERED = 32_768
_P = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """64-bit word hashes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = ascii_lower_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), n)], np.uint64)
    s = h[: n - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        s *= _P
        s += h[i : n - SHINGLE + 1 + i]
    return np.unique(_mixed(s))


def digest(s: np.ndarray, salt: int) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16, salt=salt.to_bytes(2, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


PROFILE = "doc_id long, hash long, n long, cls long, check long, chunk int, part int, counts binary"


def _profiles(docs: DataFrame, salt: int) -> DataFrame:
    """Per document: its text's hash, the size of its set and the set's digest; per task: its part of the
    sketch, in chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in PROFILE.split(", ")]
        sketch, waiting, size, part = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0, None

        def add() -> None:
            nonlocal size
            if waiting:
                slots, times = np.unique(np.concatenate(waiting), return_counts=True)
                sketch[slots] += times.astype(np.uint32)
                waiting.clear()
                size = 0

        for batch in batches:
            rows = []
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for doc, key, text in zip(batch["doc_id"], batch["hash"], batch["text"], strict=True):
                s = shingles(text)
                cls, check = digest(s, salt) if len(s) else (None, None)
                rows.append((doc, key, len(s), cls, check, None, None, None))
                waiting.append((s >> np.uint64(64 - SKETCH_BITS)).astype(np.uint32))
                size += len(s)
                if size > FLUSH:
                    add()
            yield _nullable(pd.DataFrame(rows, columns=columns, dtype=object))
        if part is not None:
            add()
            chunks = sketch.reshape(-1, 1 << CHUNK_BITS)
            rows = [(None, None, None, None, None, i, part, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(chunks)]
            yield _nullable(pd.DataFrame(rows, columns=columns, dtype=object))

    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"), F.spark_partition_id().alias("part"))
    return d.mapInPandas(frugal(run, _hashes), PROFILE)


def _nullable(df: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers with nulls, from objects: as floats 64-bit names would lose digits."""
    return df.astype({c: "Int64" if c not in ("chunk", "part") else "Int32" for c in df.columns if c != "counts"})


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches as 4 * log2(1 + count), one byte a slot: 4 MB, whatever the input.
    At most 64 parts of a chunk are summed at a time."""

    def summed(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << CHUNK_BITS, np.uint64)
        for c in group["counts"]:
            total += np.frombuffer(zlib.decompress(c), np.uint32)
        counts = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "part": group["part"].iloc[:1], "counts": [zlib.compress(counts.tobytes(), 1)]})

    parts = profiles.where(F.col("chunk").isNotNull()).select("chunk", "part", "counts")
    out = np.zeros(1 << SKETCH_BITS, np.uint8).reshape(-1, 1 << CHUNK_BITS)
    if (most := parts.agg(F.max("part")).first()[0]) is None:
        return out.reshape(-1)
    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / 64).cast("int")).groupBy("chunk", "part").applyInPandas(summed, "chunk int, part int, counts binary")
        if not (most := most // 64):
            break
    for r in parts.toLocalIterator():
        c = np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
        out[r["chunk"]] = np.minimum(4 * np.log2(1.0 + c), 255).astype(np.uint8)
    return out.reshape(-1)


ENTRY = "column long, salt int, cls long, size int, at int"


def _entries(docs: DataFrame, sketch: np.ndarray, salt: int) -> DataFrame:
    """The leading entries of every class's row of the matrix: column, row, the row's size and the entry's
    place. Columns are named by rank and hash, so that their order is the order of names."""
    spark = docs.sparkSession
    middle = float(np.median(sketch))
    hot = max(middle + 4, 4 * np.log2(1.0 + HOT))  # at least twice the usual count, and over HOT
    shared = spark.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, seen = shared.value, set()
        for batch in batches:
            columns, salts, rows, sizes, ats = [], [], [], [], []
            for text in batch["text"]:
                s = shingles(text)
                n = len(s)
                if not n:
                    continue
                cls, _ = digest(s, salt)
                if cls in seen:
                    continue
                if len(seen) >= SEEN:  # only saves work: equal entries are told apart later
                    seen.clear()
                seen.add(cls)
                rank = ranks[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                name = (rank.astype(np.uint64) << np.uint64(55)) | (s >> np.uint64(9))
                p = n - -(-PERCENT * n // 100) + 1
                name = np.sort(np.partition(name, p - 1)[:p]) if p < n else np.sort(name)
                rank = (name >> np.uint64(55)).astype(float)
                over = rank >= hot
                part = np.zeros(p, np.int32)
                if over.any():
                    part[over] = 1 + cls % np.ceil(np.exp2(rank[over] / 4) / HOT).astype(np.int64)
                columns.append(name.astype(np.int64))
                salts.append(part)
                rows.append(np.full(p, cls))
                sizes.append(np.full(p, n, np.int32))
                ats.append(np.arange(p, dtype=np.int32))
            if columns:
                yield pd.DataFrame(dict(zip(("column", "salt", "cls", "size", "at"), map(np.concatenate, (columns, salts, rows, sizes, ats)), strict=True)))

    return docs.select(text_or_empty().alias("text")).mapInPandas(frugal(run, _hashes), ENTRY)


STAR = "column long, salt int, centre long, centre_size int, centre_at int, cls long, size int, at int"


def _stars(entries: DataFrame, orders: int = 4, step: int = 1) -> DataFrame:
    """Every entry of a column block with the block's centre: the row with fewest entries before this column
    (in steps; ties in one of a few orders of the rows). Entries before it are rarer, so they are what a copy
    has of its own: the centre is the copy nearest to what all have in common, and links to most.
    Blocks of one entry are left out unless salted. Entries stream by in order; only the block's centre is
    kept in memory."""
    order = F.xxhash64("cls", F.pmod(F.col("column"), F.lit(orders)))
    dealt = entries.select("column", "salt", "cls", "size", "at").repartition("column", "salt")  # what orders them is computed after
    ordered = dealt.withColumn("own", F.floor(F.col("at") / step)).withColumn("order", order).sortWithinPartitions("column", "salt", "own", "order", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # column, salt, centre, size, at, last cls
        for b in _gathered(batches):
            c, s, x, n, at = (b.column(k).to_numpy() for k in range(5))
            new = np.empty(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
            new[0] = last is None or last[:2] != (c[0], s[0])
            again = np.zeros(len(c), bool)
            again[1:] = ~new[1:] & (x[1:] == x[:-1])
            again[0] = not new[0] and last[5] == x[0]
            first = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
            own = first >= 0
            k = np.maximum(first, 0)
            centre = np.where(own, x[k], last[2] if last else 0)
            size = np.where(own, n[k], last[3] if last else 0)
            place = np.where(own, at[k], last[4] if last else 0)
            last = (c[-1], s[-1], centre[-1], size[-1], place[-1], x[-1])
            keep = ~again & (~new | (s > 0)) & ((x != centre) | (s > 0))
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[keep], t) for v, t in ((c, pa.int64()), (s, pa.int32()), (centre, pa.int64()), (size.astype(np.int32), pa.int32()), (place.astype(np.int32), pa.int32()), (x, pa.int64()), (n.astype(np.int32), pa.int32()), (at.astype(np.int32), pa.int32()))], [f.split()[0] for f in STAR.split(", ")]
                )

    return ordered.select("column", "salt", "cls", "size", "at").mapInArrow(run, STAR)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = GATHERED) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `rows`: those that Spark hands over are bounded for texts, and what is done to
    columns of numbers costs as much for few rows as for many."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _bounds(n: Column, at: Column, m: Column, bt: Column) -> Column:
    """Whether sizes n and m, and the places of the first entry they share, allow a link: what is shared lies
    at or after these places. Of two sets that link, the first shared entry passes."""
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    return fits & (F.least(n - at, m - bt) * (100 + PERCENT) >= (n + m) * PERCENT)


def _pairs(x: DataFrame, a: str, b: str) -> DataFrame:
    return x.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()


def _rows(docs: DataFrame, classes: DataFrame, pairs: DataFrame, salt: int) -> DataFrame:
    """(cls, sizes, entries): the rows of the matrix that `pairs` (a, b: classes) name, computed once."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = written(classes.groupBy("cls").agg(F.min("hash").alias("hash")).join(ids, "cls", "left_semi").select("hash"), "keys")
    d = docs.select(F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))
    few = keys.count() <= MOST_BROADCAST  # at most 8 MB; beyond that the texts are dealt out
    d = d.join(F.broadcast(keys) if few else keys, "hash", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingles(text)
                cls = digest(s, salt)[0] if len(s) else None
                if cls is not None and cls not in seen:
                    if len(seen) >= SEEN:  # only saves work: copies left go below
                        seen.clear()
                    seen.add(cls)
                    rows.append((cls, _block_sizes(s), s.tobytes()))
            yield pd.DataFrame(rows, columns=["cls", "sizes", "entries"])

    return written(d.select("text").mapInPandas(frugal(sets, _hashes), "cls long, sizes binary, entries binary"), "rows")


def _computed(rows: DataFrame, pairs: DataFrame, payload: str, keep) -> DataFrame:
    """The cells of `pairs` for which keep(payload of a's row, payload of b's row) holds."""
    one = rows.groupBy("cls").agg(F.first(payload).alias(payload))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = np.array([keep(p, q) for p, q in zip(b["left"], b["right"], strict=True)], bool)
            yield b[["a", "b"]][kept]

    cells = pairs.join(one.select(F.col("cls").alias("a"), F.col(payload).alias("left")), "a").join(one.select(F.col("cls").alias("b"), F.col(payload).alias("right")), "b")
    return cells.select("a", "b", "left", "right").mapInPandas(frugal(product), "a long, b long")


def _block_sizes(s: np.ndarray) -> bytes:
    """How many of a set's columns lie in each of 256 blocks of columns."""
    return np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256).astype(np.uint32).tobytes()


def _may_link(p: bytes, q: bytes) -> bool:
    """A block's overlap is at most the smaller of its sizes; the sum of these bounds the whole overlap."""
    x, y = np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)
    most = int(np.minimum(x, y).sum())
    return 100 * most >= PERCENT * (int(x.sum()) + int(y.sum()) - most)


def _do_link(p: bytes, q: bytes) -> bool:
    """The sparse dot product of two rows against the size of their union."""
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    overlap = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * overlap >= PERCENT * (len(x) + len(y) - overlap)


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, salt: int) -> DataFrame:
    """The cells of `pairs` that link: first held against the sizes of column blocks (1 KB a row), then what
    is left computed from whole rows."""
    rows = _rows(docs, classes, pairs, salt)
    near = written(_computed(rows, pairs, "sizes", _may_link), "near")
    links = written(_computed(rows, near, "entries", _do_link), "links")
    forgotten(rows, near)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): the least row reachable, by propagating labels and following them."""
    both = written(edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*"), "edges")
    labels = written(both.groupBy(F.col("u").alias("cls")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    tables = labels
    while True:
        near = both.join(labels.select(F.col("cls").alias("v"), F.col("label").alias("other")), "v").groupBy(F.col("u").alias("cls")).agg(F.min("other").alias("other"))
        step = labels.join(near, "cls").select("cls", F.col("label").alias("before"), F.least("label", "other").alias("label"))
        follow = labels.select(F.col("cls").alias("label"), F.col("label").alias("further"))
        step = step.join(follow, "label").select("cls", "before", F.least("label", "further").alias("label"))
        before, step = tables, written(step, "labels")
        forgotten(before)
        tables, labels = step, step.select("cls", "label")
        if step.where("before <> label").isEmpty():
            forgotten(both)
            return labels


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: only the links between components are propagated, as links of labels."""
    new = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(labels, "cls", "left_anti")
    labels = written(labels.unionByName(new.select("cls", F.col("cls").alias("label"))), "labels")
    side = lambda c: labels.select(F.col("cls").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(side("a"), "a").join(side("b"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    top = components(written(between, "between")).select(F.col("cls").alias("label"), F.col("label").alias("top"))
    return written(labels.join(top, "label", "left").select("cls", F.coalesce("top", "label").alias("label")), "labels")


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' classes (doc_id, hash, n, cls) and the classes' labels (cls, label)."""
    batched(docs.sparkSession)
    for salt in range(8):
        profiles = written(_profiles(docs, salt), "profiles")
        classes = profiles.where(F.col("chunk").isNull()).select("doc_id", "hash", "n", "cls", "check")
        # Two sets of one 64-bit name: all names are made anew.
        if classes.groupBy("cls").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").isEmpty():
            break
    else:
        raise RuntimeError("two different sets share a 64-bit name under each of eight salts")
    stars = written(_stars(_entries(docs, _sketch(profiles), salt)), "stars")
    named = classes.where(F.col("cls").isNotNull())
    # Centres of a hot column's salted blocks meet in one more block.
    second = stars.where((F.col("salt") > 0) & (F.col("cls") == F.col("centre"))).select("column", F.lit(0).alias("salt"), "cls", "size", "at")
    meeting = written(_stars(second), "stars")
    stars = stars.where(F.col("cls") != F.col("centre")).unionByName(meeting)
    ok = _bounds(F.col("size"), F.col("at"), F.col("centre_size"), F.col("centre_at"))
    tested = written(_pairs(stars.where(ok), "centre", "cls"), "pairs")
    links = _linked(docs, named, tested, salt)
    labels = components(links)
    centres = stars.groupBy("column", F.col("centre").alias("cls")).agg(F.first("centre_size").alias("size"), F.first("centre_at").alias("at"))
    open_ = _open(written(stars.select("column", "cls", "size", "at").unionByName(centres), "members"), labels)
    # Columns where several components meet get other centres, and cells across components are computed.
    many = open_.groupBy("column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    salted = open_.join(many, "column", "left").withColumn("salt", F.coalesce(1 + F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / HOT)), F.lit(0)).cast("int"))
    again = _stars(salted.select("column", "salt", "cls", "size", "at"), 16, 4).where(ok & (F.col("cls") != F.col("centre")))
    label = labels.select(F.col("cls").alias("centre"), F.col("label").alias("centre_label"))
    again = again.join(labels, "cls", "left").join(label, "centre", "left")
    across = F.coalesce("label", "cls") != F.coalesce("centre_label", "centre")
    second = written(_pairs(again.where(across), "centre", "cls").join(tested, ["a", "b"], "left_anti"), "pairs")
    labels = _joined(labels, _linked(docs, named, second, salt))
    tested = tested.unionByName(second)
    # What is still open is done in full, across components.
    open_ = _open(open_.drop("label"), labels)
    rest = _across(open_).join(tested, ["a", "b"], "left_anti")
    more = _linked(docs, named, written(rest, "pairs"), salt)
    return classes, _joined(labels, more)


def _across(open_: DataFrame) -> DataFrame:
    """The cells (a, b) that open columns ask for across components. A column of many rows is cut into blocks
    of about HOT, and each pair of blocks meets in a task's group of its own, so no group grows with the
    column; entries go to the blocks' pairs once each."""
    n = open_.groupBy("column").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("blocks"))
    x = open_.join(n, "column").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("column", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cls", "size", "at", "label")
    y = x.select("column", "i", "j", *[F.col(c).alias(f"o_{c}") for c in ("block", "cls", "size", "at", "label")])
    fits = _bounds(F.col("size"), F.col("at"), F.col("o_size"), F.col("o_at")) & (F.col("label") < F.col("o_label"))
    return _pairs(x.join(y, ["column", "i", "j"]).where(fits & ((F.col("i") == F.col("j")) | (F.col("block") != F.col("o_block")))), "cls", "o_cls")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries, with labels, of columns in which several components meet."""
    m = written(members.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "members")
    mixed = m.groupBy("column").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("column")
    return written(m.join(mixed, "column", "left_semi"), "open")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, and the size of the component."""
    classes, labels = classes_and_links(docs)
    own = classes.where(F.col("cls").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("component_size"))
    named = classes.where(F.col("cls").isNotNull())
    per_class = named.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("many"))
    per_class = written(per_class.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls")), "classes")
    ids = per_class.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("many").alias("component_size"))
    per_class = per_class.join(ids, "label").select("cls", "component_id", "component_size")
    out = named.join(per_class, "cls").select("doc_id", "n", "component_id", "component_size")
    return out.unionByName(own).withColumnRenamed("n", "n_shingles")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the least doc_id, and of rows that share it the one
    of the least text hash, once. Documents without words stay."""
    classes, labels = classes_and_links(docs)
    named = classes.where(F.col("cls").isNotNull()).select("doc_id", "hash", "cls")
    best = named.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("best"))
    best = best.join(labels, "cls", "left").groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("best").alias("best"))
    chosen = best.select(F.col("best.doc_id").alias("q_id"), F.col("best.hash").alias("q_hash"))
    keyed = docs.withColumn("q_key", F.xxhash64(text_or_empty()))
    words = F.regexp_like(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]"))
    many = named.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("many"))
    chosen = chosen.join(many, F.col("q_id").eqNullSafe(F.col("doc_id")) & (F.col("q_hash") == F.col("hash"))).select("q_id", "q_hash", "many")
    chosen = written(chosen, "chosen")
    here = F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("q_key") == F.col("q_hash"))
    few = chosen.count() <= MOST_BROADCAST  # at most 24 MB; beyond that the texts are dealt out
    some = lambda c: F.broadcast(c) if few else c
    once = keyed.where(words).join(some(chosen.where("many = 1")), here, "left_semi")
    again = keyed.where(words).join(some(chosen.where("many > 1")), here, "left_semi").dropDuplicates(["doc_id", "q_key"])
    return once.unionByName(again).select(*docs.columns).unionByName(docs.where(~words))
