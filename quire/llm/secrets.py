"""Secret scans with a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived (`trigrams`). The index holds,
for every trigram that some query names and every block of documents, the posting list of that block; the
number of blocks grows with the documents, so no list and no group outgrows its block, however common the
trigram. Posting lists are intersected and united block by block as each rule's query says, which gives the
candidates; only these are joined back to their texts and verified with the rule's expression. Rules
without a mandatory trigram scan every text.

Matches are leftmost and do not overlap, per kind; positions are code points. They come from the lengths of
the pieces between matches (`split`) and of the matches themselves.

A null text is empty. Documents are known by doc_id and text hash, so null or repeated doc_ids do no harm
and rows that agree in both get equal results. Equal spans are impossible within a kind; across kinds ties
in start go by the order of the rules. Extra columns are ignored by `scan`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .trigrams import trigram_query

#: Kind, expression, group whose length counts, least length. Base kinds come first.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("stripe", r"sk_live_[0-9A-Za-z]{16,}", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
RULES = BASE_RULES + MORE_RULES
DOCS_PER_BLOCK = 512


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,end>> of the matches whose group has the least length."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("len"), F.transform(part, lambda x: F.length(x)).alias("part"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["gap"]
        end = start + F.coalesce(row["len"], F.lit(0))
        found = F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.coalesce(row["part"] >= least, F.lit(False)), found).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(rows, start, step, lambda acc: acc["found"])).otherwise(none)


def postings(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """(block, trigram, ids): which documents of a block hold a trigram. ids: struct of id, text hash."""
    folded = docs.select("id", "hash", F.lower("text").alias("folded"))
    have = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = folded.select(F.pmod(F.xxhash64("id", "hash"), F.lit(blocks)).alias("block"), F.struct("id", "hash").alias("doc"), F.explode(have).alias("trigram"))
    return rows.groupBy("block", "trigram").agg(F.collect_set("doc").alias("ids"))


def candidates(index: DataFrame, rules) -> DataFrame:
    """(id, hash, rules): the documents that the rules' Boolean queries leave."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("lists"))
    none = F.array().cast(index.schema["ids"].dataType)
    of = lambda t: F.coalesce(F.try_element_at("lists", F.lit(t)), none)
    hits = []
    for kind, pattern, *_ in rules:
        if query := trigram_query(pattern):
            alternatives = [reduce(F.array_intersect, [of(t) for t in sorted(a)]) for a in query]
            hits.append(_tagged(reduce(F.array_union, alternatives), kind))
    found = lists.select(F.explode(F.concat(*hits)).alias("hit")).select("hit.*")
    return found.groupBy("id", "hash").agg(F.collect_set("rule").alias("rules"))


def _tagged(docs: Column, kind: str) -> Column:
    tag = F.lit(kind)
    return F.transform(docs, lambda d: F.struct(d["id"].alias("id"), d["hash"].alias("hash"), tag.alias("rule")))


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs' doc_id, with found: array of struct<start, rank, kind, end> in order, for every row."""
    queried = [r for r in rules if trigram_query(r[1])]
    scanned = [r for r in rules if not trigram_query(r[1])]
    t = text_or_empty()
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(t).alias("hash"), t.alias("text"))
    trigrams = sorted({x for r in queried for a in trigram_query(r[1]) for x in a})
    blocks = max(1, -(-docs.count() // DOCS_PER_BLOCK))
    hits = written(candidates(written(postings(d, trigrams, blocks), "postings"), queried), "candidates")
    rank = {r[0]: i for i, r in enumerate(rules)}

    def tagged(rule, when: Column | None = None) -> Column:
        kind, pattern, group, least = rule
        i, k = F.lit(rank[kind]), F.lit(kind)
        found = F.transform(spans(F.col("text"), pattern, group, least), lambda s: F.struct(s["start"].alias("start"), i.alias("rank"), k.alias("kind"), s["end"].alias("end")))
        return found if when is None else F.when(when, found).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))

    joined = d.join(hits, ["id", "hash"], "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    found = F.concat(*[tagged(r) for r in scanned], *[tagged(r, F.array_contains("rules", r[0])) for r in queried])
    return joined.select("doc_id", "text", F.array_sort(found).alias("found"))


def rendered(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a hash of their spans, and all spans."""
    s = scan(docs)
    base = F.filter("found", lambda x: x["rank"] < len(BASE_RULES))
    count = lambda i: F.size(F.filter("found", lambda x: x["rank"] == i)).cast("long")
    return s.select("doc_id", *[count(i).alias(f"n_{r[0]}") for i, r in enumerate(BASE_RULES)], F.sha2(rendered(base).cast("binary"), 256).alias("base_sha256"), rendered(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret's span replaced by the mask; overlapping spans are masked as one. The other
    columns stay; n_chars, where there is one, follows the text."""
    keys = docs.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("q_id"), F.xxhash64(text_or_empty()).alias("q_hash"))
    found = scan(docs).where(F.size("found") > 0).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("q_id"), F.xxhash64("text").alias("q_hash"), F.col("found").alias("q_found"))
    found = written(found.dropDuplicates(["q_id", "q_hash"]), "found")  # Spark then knows whether it is small
    blank = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.concat(acc["out"], F.when(s["end"] <= acc["at"], "").when(s["start"] < acc["at"], "").otherwise(F.concat(gap, F.lit(mask)))).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    clean = F.aggregate("q_found", blank, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = keys.join(found, ["q_id", "q_hash"], "left").withColumn("text", F.when(F.col("q_found").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("q_found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
