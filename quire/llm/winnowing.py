"""Document fingerprints by winnowing, with DataFrame functions only.

A text's words (lower case) are hashed, where each character of a word of more than LONG characters and of
scripts without spaces counts as a word; k-gram hashes are polynomials over word hashes modulo 2**31 - 1,
rolled up by doubling: the hash of 2m words at i is hash_m(i) * B**m + hash_m(i + m). In every window of w
consecutive k-grams the least hash is chosen, the rightmost among equal ones, and its position is kept. So
any run of w + k - 1 words that two texts share gives a common fingerprint, and none shorter than k words
does. Hash and reversed position share one long, so that a plain minimum breaks ties to the right.

A null text is empty and has no fingerprint. A text of fewer than k words has the hash of all its words as
its only k-gram; with fewer than w k-grams there is one window. Two empty fingerprints are alike (1.0); an
empty and another one are not (0.0). Each text is one array in one row, however long; nothing is grouped.
Rows that agree in doc_id and text count once in the order and get the same values; equal doc_ids are ordered by
text hash, null ones come last. An empty table gives no row. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

MODULUS = (1 << 31) - 1
BASE = 1_000_003
K, W = 4, 8
LONG = 64
_SPACE, _SCRIPTS = r"\x20\x09-\x0D", r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def units(low: Column) -> Column:
    """Words, and the characters of longer ones and of scripts without spaces, which only some texts have."""
    words = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{_SCRIPTS}]|[^{_SPACE}{_SCRIPTS}]+"), F.lit(0))
    cut = F.flatten(F.transform(runs, lambda x: F.when(F.length(x) > LONG, F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))).otherwise(F.array(x))))
    return F.when(low.rlike(f"[{_SCRIPTS}]|(?<![^{_SPACE}])[^{_SPACE}]{{{LONG + 1}}}"), cut).otherwise(words)


def fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with column `to`: array of hash * 2**31 + (2**31 - 1 - position). K and W are powers of two.

    Each step reads the one before twice, which keeps Catalyst from merging the projections and computing
    a step again for each use."""
    t, n = f"{to}_t", f"{to}_n"
    df = df.withColumn(t, units(F.lower(F.col(text)))).withColumn(n, F.size(t))
    short = F.transform(F.slice(F.array(F.array_join(t, " ")), 1, F.when(F.col(n) > 0, 1).otherwise(0)), lambda x: F.pmod(F.xxhash64(x), F.lit(MODULUS)))
    df = df.withColumn(t, F.when(F.col(n) < K, short).otherwise(F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(MODULUS)))))
    m = 1
    while m < K:
        power = F.lit(pow(BASE, m, MODULUS)).cast("long")
        later = F.slice(t, m + 1, F.greatest(F.col(n) - m, F.lit(0)))
        df = df.withColumn(t, F.when(F.col(n) < K, F.col(t)).otherwise(F.zip_with(t, later, lambda a, b: (a * power + b) % F.lit(MODULUS))))
        m *= 2
    grams = F.greatest(F.col(n) - (K - 1), F.least(F.col(n), F.lit(1)))
    df = df.withColumn(n, grams).withColumn(t, F.transform(F.slice(t, 1, F.col(n)), lambda h, i: h * F.lit(1 << 31) + (F.lit((1 << 31) - 1) - i)))
    m = 1
    while m < W:
        later = F.slice(t, m + 1, F.greatest(F.col(n) - m, F.lit(0)))
        df = df.withColumn(t, F.zip_with(t, later, lambda a, b: F.least(a, b)))
        m *= 2
    return df.withColumn(to, F.array_distinct(F.slice(t, 1, F.greatest(F.col(n) - (W - 1), F.least(F.col(n), F.lit(1)))))).drop(t, n)


def hashes(fp: Column) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 31).cast("int")))


def rendered(fp: Column) -> Column:
    """hash in hex @ position of the k-gram's first word, joined by spaces."""
    mask = F.lit((1 << 31) - 1)
    return F.array_join(F.transform(fp, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), (mask - x.bitwiseAND(mask)).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of hashes."""
    both, sizes = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return F.when(sizes == 0, 1.0).otherwise(both / (sizes - both))


KEYS = ("key_id", "key_null", "key_text")


def keyed(docs: DataFrame) -> DataFrame:
    t = text_or_empty()
    return docs.select(t.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(KEYS[0]), F.col("doc_id").isNull().alias(KEYS[1]), F.xxhash64(t).alias(KEYS[2]))


def successors(k: DataFrame) -> DataFrame:
    """The key of each document and, as next_*, that of the one after it by descending doc_id (nulls last;
    equal ones by text hash), the first after the last. Only keys are sorted: into ranges, within which a
    window looks ahead; the first key of each range, a row per range, closes the gaps."""
    order = [F.col(KEYS[1]).asc(), F.col(KEYS[0]).desc(), F.col(KEYS[2]).asc()]
    ids = k.select(*KEYS, F.length("text").alias("n_chars")).dropDuplicates([*KEYS])
    ids = written(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    me = F.struct(*KEYS)
    ahead = ids.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy(*order)))
    rank = F.struct(F.col(KEYS[1]).alias("a"), (-F.col(KEYS[0])).alias("b"), F.col(KEYS[2]).alias("c"))
    firsts = ids.groupBy("part").agg(F.min_by(me, rank).alias("first"))
    by_part, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(every)).alias("follow"))
    out = ahead.join(follow, "part").withColumn("next", F.coalesce("next", "follow"))
    return out.select(*KEYS, "n_chars", *[F.col(f"next.{c}").alias(f"next_{c}") for c in KEYS])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last third replaced by the start of the
    next document) and how alike they and the next document's are. Rows that agree in doc_id and text count
    once in the order and get the same values."""
    k = keyed(docs)  # both joins read the same columns of it, so that texts are dealt out once
    after = successors(k)
    need = after.select(*[F.col(c).alias(f"of_{c}") for c in KEYS], *[F.col(f"next_{c}").alias(c) for c in KEYS], F.floor(F.col("n_chars") / 3).cast("int").alias("n_next"))
    given = k.join(need, list(KEYS)).select(*[f"of_{c}" for c in KEYS], F.expr("left(text, n_next)").alias("start"), "text", "n_next")
    given = fingerprint(given, "text", "next_fp").select(*[F.col(f"of_{c}").alias(c) for c in KEYS], "start", "n_next", hashes(F.col("next_fp")).alias("next_hashes"))
    given = given.dropDuplicates([*KEYS])
    d = k.join(given, list(KEYS)).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars as int) - n_next)"), F.col("start")))
    doc_id = F.when(~F.col(KEYS[1]), F.col(KEYS[0])).alias("doc_id")
    d = d.select(doc_id, "text", "n_chars", "edited", "next_hashes")
    d = fingerprint(fingerprint(d, "text", "fp"), "edited", "edited_fp")
    d = d.withColumn("own_hashes", hashes(F.col("fp"))).withColumn("edited_hashes", hashes(F.col("edited_fp")))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered(F.col("fp")).alias("fingerprint"), rendered(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("own_hashes", "edited_hashes").alias("near_edited"), likeness("own_hashes", "next_hashes").alias("near_next"),
    )
