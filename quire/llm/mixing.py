"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Every source gets a word target (`source_targets`). Its documents' certain copies are the whole part of the
target over the words it has. The rest r is drawn as one more copy of some documents, each with an inclusion
probability of its own: p = r * g / (the mean of g by words in its stratum), where g grows with the share of a
text's words that are distinct, so that texts that repeat themselves are taken less often. Documents rank by
(u / (1 - u)) / (p / (1 - p)) with u a hash of the document in (0, 1).

Strata are a source's documents of like size (a quarter of an octave). From each a sample of fixed size is
taken: the n lowest ranks, n being the stratum's share of the missing words over its largest size, so that no
target is exceeded. The words that rounding leaves, a few documents a source, are filled from a table of how many
documents of each size are left: the largest size that fits first, then the next, and in the end the one exchange
(a document more, or one for another) that comes nearest to the target, from above or below. Of one size the lowest
ranks are taken. So a source ends off its target by at most half of the smallest document that it has left, and mostly
by much less.

A sample is kept as its stratum's last rank taken, so the documents are never dealt out or ordered: ranks are
counted per (stratum, rank bucket), only the bucket in which a sample ends is ordered row by row, and the plan is
a small table (strata and sources) that documents are held against. One source may hold a third of all rows: no
window spans a source or a stratum. The plan is written first, so that Spark broadcasts it only if it knows it to
be small.

Nulls: a null text has size 0, a null source is a source of its own (last in order), a null doc_id is hashed as
such. Empty texts are never taken. Very long texts are counted whole. Rows that agree in doc_id and text share a
rank and are taken or left together, never above the target. An empty table gives an empty result. Extra columns
are ignored by `mix` and kept by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

BUCKETS = 4096
BANDS = 4  # per octave of sizes


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) of `sizes` (source, size): the total is shared by weight, weights
    going round by code point order of the sources; no target exceeds `most` times its source's size.

    Giving the excess to the others by weight until none is above ends at target = min(cap, level * weight)
    for one level. In order of cap / weight the first source that is not capped fixes the level. The only
    windows without a key run over one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("turn", F.row_number().over(turn)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("turn") - 1) % len(weights) + 1).cast("int")).cast("double")
    )
    cap = F.col("source_size") * float(most)
    order = Window.orderBy("ratio", "turn")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    s = (
        s.withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("left_words", F.col("total") - float(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level_here", F.col("left_words") / F.col("left_weight"))
        .withColumn("capped", F.col("ratio") <= F.col("level_here"))
        .withColumn("level", F.min_by(F.when(~F.col("capped"), F.col("level_here")), F.when(~F.col("capped"), F.struct("ratio", "turn"))).over(every))
    )
    return s.select("source", "source_size", F.when(F.col("capped"), cap).otherwise(F.col("level") * F.col("weight")).alias("target"))

def uniform(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number strictly between 0 and 1 from doc_id and text."""
    h = F.xxhash64(F.lit(seed), doc_id, text_or_empty(text))
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(1 << 52)


KEY = ["q_source", "q_null"]  # a source, null told apart


def described(docs: DataFrame, seed: int, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with what a plan is made of: source key, size, u, weight and size band."""
    words = F.regexp_extract_all(text_or_empty(text), F.lit(WORD), F.lit(0))
    d = docs.withColumn("q_words", words).withColumn("q_size", F.size("q_words").cast("long"))
    d = d.withColumn("q_g", 0.5 + F.size(F.array_distinct("q_words")) / F.greatest("q_size", F.lit(1))).drop("q_words")
    d = d.withColumn("q_u", uniform(seed, doc_id, text)).withColumn("q_source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("q_null", F.col(source).isNull())
    return d.withColumn("q_band", F.floor(F.log2(F.greatest("q_size", F.lit(1))) * BANDS).cast("int"))


def ranked(rows: DataFrame, strata: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """rows with their inclusion probability, rank, rank bucket and place in the order of ranks."""
    r = rows.join(strata, [*KEY, "q_band"])
    p = F.least(F.col("q_rest") * F.col("q_g") / F.greatest("q_mean", F.lit(1e-9)), F.lit(1.0))
    r = r.withColumn("q_p", p).withColumn("q_rank", F.when((p > 0) & (F.col("q_size") > 0), F.when(p >= 1, 0.0).otherwise(F.col("q_u") / (1 - F.col("q_u")) / (p / (1 - p)))))
    bucket = F.floor(F.col("q_rank") / (1 + F.col("q_rank")) * BUCKETS).cast("int")
    return r.withColumn("q_bucket", bucket).withColumn("q_place", F.struct("q_rank", F.col(doc_id).alias("id"), F.col("q_u").alias("u")))


def held(rows: DataFrame, cuts: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """rows with q_extra: whether a cut takes them. A cut is a table of (key, edge bucket, last place in it, most
    words of a document) and its key."""
    rows = rows.withColumn("q_extra", F.lit(False))
    for cut, key in cuts:
        here = F.col("q_rank").isNotNull() & (F.col("q_size") <= F.col("c_most")) & ((F.col("q_bucket") < F.col("c_edge")) | ((F.col("q_bucket") == F.col("c_edge")) & (F.col("q_place") <= F.col("c_last"))))
        rows = rows.join(cut, key, "left").withColumn("q_extra", F.col("q_extra") | F.coalesce(here, F.lit(False))).drop("c_edge", "c_last", "c_most")
    return rows


def _cut(open_: DataFrame, limits: DataFrame, key: list[str], weight: Column) -> DataFrame:
    """The cut that takes the lowest ranks of every key whose weights come to at most its limit (key, limit,
    c_most). open_: the rows that may be taken."""
    rows = open_.join(limits, key).where("q_size <= c_most").withColumn("w", weight)
    sums = rows.groupBy(*key, "q_bucket").agg(F.sum("w").alias("w"), F.first("limit").alias("limit"), F.first("c_most").alias("c_most"))
    upto = F.sum("w").over(Window.partitionBy(*key).orderBy("q_bucket"))  # at most BUCKETS rows a key
    sums = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w"))
    # Without a bucket that exceeds the limit all are taken.
    edge = F.min(F.when(F.col("upto") > F.col("limit"), F.struct("q_bucket", "before")))
    edges = sums.groupBy(*key).agg(edge.alias("e"), F.first("limit").alias("limit"), F.first("c_most").alias("c_most"))
    edges = written(edges.select(*key, F.coalesce("e.q_bucket", F.lit(BUCKETS + 1)).alias("c_edge"), F.col("e.before").alias("before"), "limit", "c_most"), "edges")
    last = rows.drop("limit", "c_most").join(edges, key).where("q_bucket = c_edge")
    sofar = F.sum("w").over(Window.partitionBy(*key).orderBy("q_place").rangeBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("sofar", sofar).where("before + sofar <= limit").groupBy(*key).agg(F.max("q_place").alias("c_last"))
    return written(edges.select(*key, "c_edge", "c_most").join(last, key, "left"), "cut")


def plan(rows: DataFrame, weights: tuple[int, ...], most: int, doc_id: str = "doc_id") -> tuple[DataFrame, list[tuple[DataFrame, list[str]]]]:
    """Per (source, band) what `ranked` needs, and the cuts. rows: as `described` gives them, written."""
    sizes = rows.select(F.when(~F.col("q_null"), F.col("q_source")).alias("source"), F.col("q_size").alias("size"))
    targets = source_targets(sizes, weights, most).withColumn("q_null", F.col("source").isNull()).withColumn("q_source", F.coalesce("source", F.lit("")))
    per = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    targets = targets.withColumn("q_whole", F.floor(per).cast("long")).withColumn("q_rest", per - F.floor(per))
    targets = written(targets.select(*KEY, "source_size", "target", "q_whole", "q_rest"), "targets")
    strata = rows.groupBy(*KEY, "q_band").agg((F.sum(F.col("q_size") * F.col("q_g")) / F.greatest(F.sum("q_size"), F.lit(1))).alias("q_mean"))
    strata = written(strata.join(targets, KEY), "strata")
    short, order = ranked(rows, strata, doc_id), ["q_source", "q_null", "q_band"]
    cuts: list[tuple[DataFrame, list[str]]] = []
    need = targets.select(*KEY, (F.col("target") - F.col("q_whole") * F.col("source_size")).alias("need")).where("need >= 1")
    open_ = short.where(F.col("q_rank").isNotNull())
    # Samples of fixed size from every stratum.
    s = open_.groupBy(*order).agg(F.count(F.lit(1)).alias("n"), F.sum("q_size").alias("words"), F.max("q_size").alias("largest")).join(need, KEY)
    share = F.least(F.lit(1.0), F.col("need") / F.sum("words").over(Window.partitionBy(*KEY)))  # one row a band
    s = s.select(*order, F.floor(share * F.col("words") / F.col("largest")).cast("long").alias("limit"), F.col("largest").alias("c_most")).where("limit > 0")
    cuts.append((_cut(open_, written(s, "samples"), order, F.lit(1).cast("long")), order))
    # The words still missing.
    now, size = held(open_, cuts), [*KEY, "q_size"]
    hist = written(now.groupBy(*size).agg(F.count_if(~F.col("q_extra")).alias("left"), F.count_if("q_extra").alias("got")), "sizes")
    gap = hist.groupBy(*KEY).agg(F.sum(F.col("q_size") * F.col("got")).alias("got")).join(need, KEY).select(*KEY, (F.col("need") - F.col("got")).alias("gap"))
    left = hist.where("left > 0").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("q_size").alias("size"), F.col("left").alias("n"))), asc=False).alias("sizes"))  # a row a size
    takes = filled(written(left.join(gap, KEY), "left"), KEY)
    takes = written(takes.select(*KEY, F.col("size").alias("q_size"), F.col("n").alias("limit"), F.col("size").alias("c_most")), "fill")
    cuts.append((_cut(now.where(~F.col("q_extra")), takes, size, F.lit(1).cast("long")), size))
    return strata, cuts


def filled(left: DataFrame, key: list[str]) -> DataFrame:
    """(key, size, n): which sizes to take, and how many of each, for a sum near to a gap. left: key, gap and sizes, an array
    of (size, n) from the largest down. The largest that fits goes first; then every size of which one is left may be
    added, by itself or for one that was taken, and the nearest sum wins (nothing, if that is nearest)."""
    item = "struct<size:bigint,n:bigint>"
    start = F.struct(F.col("gap").cast("double").alias("gap"), F.array().cast(f"array<{item}>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        n = F.least(x["n"], F.floor(F.greatest(acc["gap"], F.lit(0.0)) / x["size"])).cast("bigint")
        more = F.struct(x["size"].alias("size"), n.alias("n"))
        return F.struct((acc["gap"] - n * x["size"]).alias("gap"), F.when(n > 0, F.array_append(acc["taken"], more)).otherwise(acc["taken"]).alias("taken"))

    x = written(left.select(*key, "sizes", F.aggregate("sizes", start, step).alias("f")).select(*key, "sizes", "f.*"), "filled")  # a row a source
    taken = x.select(*key, F.explode("taken").alias("t")).select(*key, F.col("t.size").alias("size"), F.col("t.n").alias("n"))
    sizes = x.select(*key, F.explode("sizes").alias("s")).select(*key, F.col("s.size").alias("size"), F.col("s.n").alias("n"))
    rest = sizes.join(taken.withColumnRenamed("n", "used"), [*key, "size"], "left").where(F.col("n") > F.coalesce("used", F.lit(0))).select(*key, F.col("size").alias("add"))
    none = F.lit(0).cast("bigint")
    away = x.select(*key, "gap", F.explode(F.array_append(F.transform("taken", lambda t: t["size"]), none)).alias("drop"))  # few: each is the largest that fits
    options = away.join(rest, key).unionByName(x.select(*key, "gap", none.alias("drop"), none.alias("add")))
    best = options.groupBy(*key).agg(F.min(F.struct(F.abs(F.col("gap") + F.col("drop") - F.col("add")).alias("off"), "add", "drop")).alias("o"))
    change = lambda c, n: best.select(*key, F.col(f"o.{c}").alias("size"), F.lit(n).cast("bigint").alias("n")).where("size > 0")
    return taken.unionByName(change("add", 1)).unionByName(change("drop", -1)).groupBy(*key, "size").agg(F.sum("n").alias("n")).where("n > 0")


def _narrow(docs: DataFrame, seed: int) -> DataFrame:
    return written(described(docs.select("doc_id", "source", "text"), seed).select("doc_id", *KEY, "q_size", "q_g", "q_u", "q_band"), "sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, p (the inclusion probability that a
    copy beyond the whole ones is ranked by), and u, which with doc_id names the document's text."""
    rows = _narrow(docs, seed)
    strata, cuts = plan(rows, weights, most)
    copies = F.col("q_whole") + F.col("q_extra").cast("long")
    out = held(ranked(rows, strata), cuts)
    return out.select("doc_id", F.col("q_u").alias("u"), F.col("q_size").alias("size"), "source_size", "target", (copies * F.col("q_size")).alias("taken"), copies.alias("copies"), F.col("q_p").alias("p"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with its own columns. Texts are held against
    the plan where they are."""
    strata, cuts = plan(_narrow(docs, seed), weights, most)
    own = {c: f"d{i}" for i, c in enumerate(docs.columns)}  # so that no name clashes
    d = docs.select(*[F.col(c).alias(q) for c, q in own.items()])
    d = held(ranked(described(d, seed, own["doc_id"], own["source"], own["text"]), strata, own["doc_id"]), cuts)
    copies = (F.col("q_whole") + F.col("q_extra").cast("long")) * (F.col("q_size") > 0).cast("long")
    d = d.withColumn("q_copies", copies.cast("int")).where("q_copies > 0").withColumn("q_copy", F.explode(F.sequence(F.lit(1), F.col("q_copies"))))
    return d.select(*[F.col(q).alias(c) for c, q in own.items()])
