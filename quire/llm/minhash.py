"""MinHash near-duplicates: an inverted join of signature coordinates, confirmed on whole shingle sets.

A document is its set of distinct 4-word shingles, its signature the least value of the set under each of COORDINATES
hash functions: two sets agree in a coordinate with the probability of their similarity. Documents link when
100 * intersection >= 80 * union.

1. Documents of equal sets form a class, which from here on counts as one document.
2. Every class is posted under each of its coordinate-value pairs. Pairs under which no other class is posted are dropped;
   a class with fewer than MATCHES others can collide with none often enough. Most classes have no near copy, and already
   the first FIRST coordinates tell: only those that share at least two of these with another class are posted in full.
3. Prefix and skip: of two classes that collide MATCHES times, each has one of the other's collisions among its
   COORDINATES - MATCHES + 1 rarest pairs. Only these posting lists are merged; the MATCHES - 1 longest of each class are
   skipped, and looked up in the signatures of what has met.
4. Within a posting list (split by salt where it is long) every class meets one centre, not each other. Collisions
   are counted over whole signatures, pairs below MATCHES discarded, and the others confirmed on whole sets. Links
   merge classes into components.
5. Where lists still hold several components, documents are alike but mostly not linked, and signatures can't tell a
   similarity of 0.7 from one of 0.8. So the classes of these lists are posted by their shingles, of which only lists with
   several components count: what a group of near copies has in common is gone, and a class of which less than 80 % is
   left can't link. The rarest of what is left again suffice as a prefix, and the places of what two classes share
   bound their intersection. Such lists get other centres, and what then still holds several components is
   expanded, in blocks, across components and within bounds only. Pairs that meet so count collisions and are confirmed too.

So large groups of near copies cost in proportion to their size, and no list is left out. At a similarity of 0.8 just, 80
coordinates agree in fewer than 40 places with a probability of 5e-10, and the first 16 in fewer than two with 4e-10, and
more alike sets less often: that is the chance that a link is missed. What is returned as linked is exact.

A null or empty text, or one without words, has an empty set and is its own component; with fewer than 4 words the whole
sequence is the one shingle. Repeated rows are copies. A null doc_id takes part in linking but names no component unless all
of its component's ids are null. Texts are read whole; no documents give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import ascii_lower_words, batched, forgotten, frugal, text_or_empty, written

SHINGLE, PERCENT = 4, 80
COORDINATES, MATCHES, FIRST = 80, 40, 16
#: Sets are gone through in slices of so many shingles, so that signatures of long texts take bounded memory.
SLICE = 512
_SEEDS = jaccard._mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * jaccard._P)
_ODD = jaccard._mixed(_SEEDS) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = ascii_lower_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(jaccard._hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), n)], np.uint64)
    s = h[: n - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        s *= jaccard._P
        s += h[i : n - SHINGLE + 1 + i]
    return np.unique(jaccard._mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    """The leading 32 bits of the least value of a set under each hash function."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), SLICE):
        v = s[None, i : i + SLICE] ^ _SEEDS[:, None]
        v *= _ODD[:, None]
        np.minimum(least, v.min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def profiles(docs: DataFrame, salt: int) -> DataFrame:
    """Per document: its text's hash, the size of its set, the set's digest and, once a class and task at least, its
    signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for doc, key, text in zip(batch["doc_id"], batch["hash"], batch["text"], strict=True):
                s = shingles(text)
                cls, check = jaccard.digest(s, salt) if len(s) else (None, None)
                sign = None
                if cls is not None and cls not in seen:
                    if len(seen) >= jaccard.SEEN:  # only saves work
                        seen.clear()
                    seen.add(cls)
                    sign = signature(s)
                rows.append((doc, key, len(s), cls, check, sign))
            df = pd.DataFrame(rows, columns=["doc_id", "hash", "n", "cls", "check", "signature"], dtype=object)
            yield df.astype({c: "Int64" for c in ("doc_id", "hash", "n", "cls", "check")})

    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))
    return d.mapInPandas(frugal(run, jaccard._hashes), "doc_id long, hash long, n long, cls long, check long, signature array<int>")


def postings(posts: DataFrame, lists: DataFrame, whole: Column, least: Column) -> DataFrame:
    """(column, salt, cls, size, at): the prefixes of classes with posts (cls, n, column) in lists (column, many). whole: how many
    posts a class has in all, least: how many of them it must share. `at` is how many are rarer; `size` the set's."""
    kept = posts.join(lists, "column").groupBy("cls", "n").agg(F.array_sort(F.collect_set(F.struct("many", "column"))).alias("pairs")).where(F.size("pairs") >= least)  # one set's at most
    prefix = F.slice("pairs", F.lit(1), (F.size("pairs") - least + 1).cast("int"))
    x = kept.select("cls", "n", (whole - F.size("pairs")).alias("alone"), F.posexplode(prefix).alias("place", "pair"))
    salt = F.when(F.col("pair.many") > jaccard.HOT, 1 + F.pmod(F.xxhash64("cls"), F.ceil(F.col("pair.many") / jaccard.HOT))).otherwise(0)
    return written(x.select("pair.column", salt.cast("int").alias("salt"), "cls", F.col("n").cast("int").alias("size"), (F.col("alone") + F.col("place")).cast("int").alias("at")), "prefixes")


def _by_coordinate(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The posts of classes (cls, n, column) by coordinate-value pairs, and the lists of several classes."""
    posts = classes.select("cls", "n", F.posexplode("signature").alias("coordinate", "value")).select("cls", "n", F.xxhash64("coordinate", "value").alias("column"))
    posts = written(posts, "posts")
    return posts, posts.groupBy("column").agg(F.count(F.lit(1)).alias("many")).where("many > 1")


def _by_shingle(docs: DataFrame, named: DataFrame, open_: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """The posts of open classes (cls, n, column) by shingle, and the lists of several components. open_: cls, label."""
    keys = written(named.groupBy("cls").agg(F.min("hash").alias("hash")).join(open_, "cls").select("hash", "label"), "keys")
    few = keys.count() <= jaccard.MOST_BROADCAST  # at most 16 MB; beyond that the texts are dealt out
    d = docs.select(F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for text, label in zip(b["text"], b["label"], strict=True):
                s = shingles(text)
                cls, n = jaccard.digest(s, salt)[0], len(s)
                if cls in seen:
                    continue
                if len(seen) >= jaccard.SEEN:  # only saves work: posts that come again count as one
                    seen.clear()
                seen.add(cls)
                yield pd.DataFrame({"cls": np.full(n, cls), "n": np.full(n, n), "label": np.full(n, label), "column": s.view(np.int64)})

    posts = d.join(F.broadcast(keys) if few else keys, "hash").select("text", "label").mapInPandas(frugal(run, jaccard._hashes), "cls long, n long, label long, column long")
    posts = written(posts, "posts")
    lists = posts.groupBy("column").agg(F.count(F.lit(1)).alias("many"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("column", "many")
    forgotten(keys)
    return posts.drop("label"), lists


def _candidates(classes: DataFrame) -> DataFrame:
    """The classes that share at least two of their first coordinates with others."""
    head, shared = _by_coordinate(classes.withColumn("signature", F.slice("signature", 1, FIRST)))
    some = head.join(shared, "column").groupBy("cls").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("cls")
    out = written(classes.join(some, "cls", "left_semi"), "candidates")
    forgotten(head)
    return out


def _fits(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can link."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _bounds(n: Column, at: Column, m: Column, bt: Column) -> Column:
    """Whether sizes n and m, and the places of the first shingle they share, allow a link: what is shared lies at or
    after these places."""
    return _fits(n, m) & (F.least(n - at, m - bt) * (100 + PERCENT) >= (n + m) * PERCENT)


def _colliding(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b: classes) whose signatures agree in MATCHES places."""
    one = lambda c, to: classes.select(F.col("cls").alias(c), F.col("signature").alias(to))
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, e: s + e)
    return pairs.join(one("a", "x"), "a").join(one("b", "y"), "b").where(same >= MATCHES).select("a", "b")


def _linked(docs: DataFrame, named: DataFrame, classes: DataFrame, pairs: DataFrame, salt: int) -> DataFrame:
    """The pairs that collide often enough and whose whole sets link."""
    near = written(_colliding(classes, pairs), "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = written(named.groupBy("cls").agg(F.min("hash").alias("hash")).join(ids, "cls", "left_semi").select("hash"), "keys")
    few = keys.count() <= jaccard.MOST_BROADCAST  # at most 8 MB; beyond that the texts are dealt out
    d = docs.select(F.xxhash64(text_or_empty()).alias("hash"), text_or_empty().alias("text"))
    d = d.join(F.broadcast(keys) if few else keys, "hash", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingles(text)
                cls = jaccard.digest(s, salt)[0] if len(s) else None
                if cls is not None and cls not in seen:
                    if len(seen) >= jaccard.SEEN:  # only saves work: copies left go below
                        seen.clear()
                    seen.add(cls)
                    rows.append((cls, s.tobytes()))
            yield pd.DataFrame(rows, columns=["cls", "entries"])

    rows = written(d.select("text").mapInPandas(frugal(sets, jaccard._hashes), "cls long, entries binary"), "rows")
    links = written(jaccard._computed(rows, near, "entries", similar), "links")
    forgotten(rows, near, keys)
    return links


def similar(p: bytes, q: bytes) -> bool:
    """Whether two sets link."""
    x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    overlap = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * overlap >= PERCENT * (len(x) + len(y) - overlap)


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' classes (doc_id, hash, n, cls) and the classes' labels (cls, label)."""
    batched(docs.sparkSession)
    for salt in range(8):
        whole = written(profiles(docs, salt), "profiles")
        # Two sets of one 64-bit name: all names are made anew.
        if whole.groupBy("cls").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").isEmpty():
            break
    else:
        raise RuntimeError("two different sets share a 64-bit name under each of eight salts")
    named = whole.where(F.col("cls").isNotNull())
    classes = named.where(F.col("signature").isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = _candidates(written(classes, "classes"))
    posts, lists = _by_coordinate(classes)
    entries = postings(posts, lists, F.lit(COORDINATES), F.lit(MATCHES))
    stars = written(jaccard._stars(entries), "stars")
    # Centres of a long list's salted blocks meet in one more block.
    second = stars.where((F.col("salt") > 0) & (F.col("cls") == F.col("centre"))).select("column", F.lit(0).alias("salt"), "cls", "size", "at")
    stars = stars.where(F.col("cls") != F.col("centre")).unionByName(written(jaccard._stars(second), "stars"))
    tested = written(jaccard._pairs(stars.where(_fits(F.col("size"), F.col("centre_size"))), "centre", "cls"), "pairs")
    labels = jaccard.components(_linked(docs, named, classes, tested, salt))
    # The classes of lists where several components meet are posted by shingle, and get other centres.
    open_ = jaccard._open(entries.select("column", "cls", "size", "at"), labels)
    label = written(open_.groupBy("cls").agg(F.first("label").alias("label")), "open")
    forgotten(posts)
    posts, lists = _by_shingle(docs, named, label, salt)
    entries = postings(posts, lists, F.col("n"), F.ceil(F.col("n") * PERCENT / 100).cast("int"))
    forgotten(posts)
    ok = _bounds(F.col("size"), F.col("at"), F.col("centre_size"), F.col("centre_at")) & (F.col("cls") != F.col("centre"))
    again = jaccard._stars(entries, 16, 4).where(ok).join(label, "cls").join(label.select(F.col("cls").alias("centre"), F.col("label").alias("centre_label")), "centre")
    more = written(jaccard._pairs(again.where("label <> centre_label"), "centre", "cls").join(tested, ["a", "b"], "left_anti"), "pairs")
    labels = jaccard._joined(labels, _linked(docs, named, classes, more, salt))
    # What still holds several components is done in full, across components.
    open_ = jaccard._open(entries.select("column", "cls", "size", "at"), labels)
    rest = written(_across(open_).join(tested.unionByName(more), ["a", "b"], "left_anti"), "pairs")
    return whole.select("doc_id", "hash", "n", "cls"), jaccard._joined(labels, _linked(docs, named, classes, rest, salt))


def _across(open_: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that meet in a posting list, by the sizes of their sets: lists are cut by
    octaves of a fraction of 80 % of the size, so that only neighbouring ones can link, and into blocks of about HOT."""
    step = float(-np.log(PERCENT / 100)) * 1.001  # a little more, for what rounding does at the edge
    x = open_.withColumn("octave", F.floor(F.log(F.col("size").cast("double")) / step).cast("int"))
    n = x.groupBy("column", "octave").agg(F.ceil(F.count(F.lit(1)) / jaccard.HOT).cast("int").alias("blocks"))
    x = x.join(n, ["column", "octave"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    up = n.select("column", (F.col("octave") - 1).alias("octave"), F.col("blocks").alias("above"))  # what lies one octave higher
    down = n.select("column", (F.col("octave") + 1).alias("octave"), F.col("blocks").alias("below"))
    x = x.join(up, ["column", "octave"], "left").join(down, ["column", "octave"], "left")
    cell = lambda octave, i, kind, j: F.struct(octave.alias("o"), i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"))
    same = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: cell(F.col("octave"), F.least("block", k), 0, F.greatest("block", k)))
    higher = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: cell(F.col("octave"), F.col("block"), 1, k)))
    lower = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda k: cell(F.col("octave") - 1, k, 1, F.col("block"))))
    empty = F.slice(same, 1, 0)
    x = x.withColumn("cell", F.explode(F.concat(same, F.coalesce(higher, empty), F.coalesce(lower, empty)))).select("column", "cell", "octave", "block", "cls", "size", "at", "label")
    y = x.select("column", "cell", *[F.col(c).alias(f"o_{c}") for c in ("octave", "block", "cls", "size", "at", "label")])
    # In a cell of one block with itself each pair comes twice, in others once: one side is told by block or octave.
    once = F.when(F.col("cell.kind") == 1, F.col("octave") < F.col("o_octave")).when(F.col("cell.i") < F.col("cell.j"), F.col("block") < F.col("o_block")).otherwise(F.col("cls") < F.col("o_cls"))
    return jaccard._pairs(x.join(y, ["column", "cell"]).where(once & (F.col("label") != F.col("o_label")) & _bounds(F.col("size"), F.col("at"), F.col("o_size"), F.col("o_at"))), "cls", "o_cls")


def minhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the document names its component) of every document."""
    classes, labels = classes_and_links(docs)
    own = classes.where(F.col("cls").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    named = classes.where(F.col("cls").isNotNull())
    per_class = named.groupBy("cls").agg(F.min("doc_id").alias("least")).join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    per_class = written(per_class, "classes")
    ids = per_class.groupBy("label").agg(F.min("least").alias("component_id"))
    out = named.join(per_class.join(ids, "label").select("cls", "component_id"), "cls").select("doc_id", "n", "component_id").unionByName(own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
