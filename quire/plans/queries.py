"""The registered queries of the core engine. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import batches, blocks, checks, folds, memory, terms, usage

from . import review
from .oracles import ORACLES
from .tables import curated, imported, lines, pairs, table

FLAGSHIP = "batch_manifest"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def txt_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of every document, numbered, with the first one's start as title."""
    p = blocks.pieces(table(spark, d, "documents"), "doc_id", F.col("text"), blocks.PARAGRAPH)
    return p.select("doc_id", F.col("pos").alias("seq"), F.length("piece").cast("long").alias("chars"), F.substring("piece", 1, 80).alias("title"))


@query
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(blocks.block_id(F.col("doc_id").cast("string"), F.col("pos")).alias("id"), "doc_id", "pos", F.length("piece").cast("long").alias("chars"))


@query
def translatable_filter(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).withColumn("kept", t.has_prose(F.col("piece")))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("kept").alias("kept"))


@query
def doc_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.section_kind(F.col("text")).alias("kind"))


@query
def format_detect(spark: SparkSession, d: str) -> DataFrame:
    from quire.sources.formats import conversion, extension

    return table(spark, d, "pages").select("page_id", extension(F.col("url")).alias("extension"), conversion(F.col("url")).alias("conversion"))


@query
def html_title(spark: SparkSession, d: str) -> DataFrame:
    from quire.sources.html import title

    return table(spark, d, "pages").select("page_id", title(F.col("html"), F.lit("untitled")).alias("title"))


@query
def html_sanitized(spark: SparkSession, d: str) -> DataFrame:
    from quire.sources.html import body, sanitized

    return table(spark, d, "pages").select("page_id", F.length(sanitized(body(F.col("html")))).cast("long").alias("chars"))


@query
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every page: external ones, and internal ones by whether some page has the target's path."""
    from quire.sources.html import links, path

    pages = table(spark, d, "pages")
    found = links(pages, "page_id", "html")
    have = pages.select(path(F.col("url")).alias("target")).distinct().withColumn("there", F.lit(True))
    inside = found.withColumn("external", t.is_external(F.col("href"))).withColumn("target", F.when(~F.col("external"), path(F.col("href"))))
    x = inside.join(have, "target", "left")
    return x.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_if("external").alias("external"), F.count_if(~F.col("external") & F.col("there").isNull()).alias("broken"))


@query
def pack_by_count(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).withColumn("chars", F.length("piece"))
    return batches.packed(x, "doc_id", [F.col("pos")], F.col("chars"), 5).select("doc_id", "seq", "chunk")


@query
def pack_by_chars(spark: SparkSession, d: str) -> DataFrame:
    x = lines(spark, d).withColumn("chars", F.length("piece"))
    return batches.packed(x, "doc_id", [F.col("pos")], F.col("chars"), 20, 1500).select("doc_id", "seq", "chunk")


@query
def pack_lineitem(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")]
    p = batches.packed(x, "l_orderkey", order, F.col("l_quantity"), 4, 80)
    return p.groupBy("l_orderkey", "chunk").agg(F.count(F.lit(1)).alias("items"), F.sum("weight").cast("long").alias("quantity"))


@query
def batch_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: documents to lines, prose lines to batches of 20 rows and 6000 characters, batches
    numbered by document and described."""
    x = lines(spark, d).where(t.has_prose(F.col("piece"))).withColumn("chars", t.block_chars(F.lit(""), F.col("piece")))
    m = batches.manifest(batches.packed(x, "doc_id", [F.col("pos")], F.col("chars"), 20, 6000), "doc_id")
    return m.select("doc_id", "chunk", "block_count", "source_chars", "start_seq", "end_seq", "estimated_tokens")


@query
def prep_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    x = lines(spark, d).join(docs.select("doc_id", "lang"), "doc_id").withColumn("chars", F.length("piece").cast("long"))
    return batches.plan(x, "lang", "chars")


@query
def token_cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("n", t.tokens_of_text(F.col("text")))
    s = docs.groupBy("lang").agg((F.sum(F.col("n") + 8) + 24).alias("prompt_tokens"), F.sum(F.greatest(F.lit(1), "n")).alias("completion_tokens"))
    return s.withColumn("cost", F.round((F.col("prompt_tokens") * 15 + F.col("completion_tokens") * 60) / 1000, 0).cast("long"))


@query
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = terms.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), terms.CANDIDATE)
    return terms.counted(found, "doc_id", 3).select("term", "frequency", F.col("first.doc_id").alias("first_doc"))


@query
def term_table(spark: SparkSession, d: str) -> DataFrame:
    return terms.table(terms.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), terms.NAME), "doc_id")


@query
def term_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "benchmark").select("item_id", "text")
    return terms.evidence(docs, terms.mentions(docs, "item_id", F.col("text"), terms.NAME), "item_id", "text")


@query
def term_aliases(spark: SparkSession, d: str) -> DataFrame:
    found = terms.mentions(table(spark, d, "documents"), "doc_id", F.col("text"), terms.NAME)
    return terms.aliases(terms.counted(found, "doc_id", 2))


@query
def merge_replace(spark: SparkSession, d: str) -> DataFrame:
    return terms.merged(curated(spark, d), imported(spark, d), "replace")


@query
def merge_append(spark: SparkSession, d: str) -> DataFrame:
    return terms.merged(curated(spark, d), imported(spark, d), "append")


@query
def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return terms.merged(curated(spark, d), imported(spark, d), "upsert")


@query
def glossary_summary(spark: SparkSession, d: str) -> DataFrame:
    return terms.summary(curated(spark, d))


@query
def enforced_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.enforced(curated(spark, d)).select("source", "translation", "status")


@query
def validate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as batches: users' turns against the turns that assistants answer."""
    c = table(spark, d, "conversations")
    side = lambda role, back: c.where(F.col("role") == role).select(F.col("conv_id").alias("batch"), "turn", (F.col("turn") - back).cast("string").alias("id")).withColumnRenamed("turn", "pos")
    return checks.identity_issues(side("user", 0), side("assistant", 1))


@query
def leftover_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like placeholders or hold many Latin words."""
    x = lines(spark, d)
    return x.groupBy("doc_id").agg(F.count_if(F.col("piece").rlike(checks.PLACEHOLDER)).alias("placeholders"), F.count_if(checks.long_leftover(F.col("piece"))).alias("long_latin"))


@query
def long_segments(spark: SparkSession, d: str) -> DataFrame:
    """Long runs of a turn's words found in the turn and its answer."""
    p = pairs(spark, d)
    return p.select("conv_id", "turn", F.size(checks.long_segments(F.col("source"), F.concat_ws(" ", "source", "target"))).cast("long").alias("segments"))


@query
def punctuation_drift(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return p.select("conv_id", "turn", checks.marks_drift(F.col("source"), F.col("target")).alias("drift"))


@query
def untranslated_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    u = checks.unchanged_words(p, ["conv_id", "turn"])
    x = p.join(u, ["conv_id", "turn"], "left").withColumn("visible", F.length(F.regexp_replace("source", f"{t.WS}+", "")))
    return x.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("unchanged"), F.lit(0)).alias("unchanged"), F.sum("visible").alias("visible"))


@query
def chapter_worst(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("chapter", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    issues = e.where(F.col("event_type").isin("error", "signup")).withColumn("severity", F.when(F.col("event_type") == "error", "blocking").otherwise("nonblocking"))
    return checks.roll_up(issues, e, "chapter")


@query
def memory_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose compacted text an earlier document has: reuse by content."""
    k = table(spark, d, "documents").select("doc_id", "lang", t.memory_key(F.lit(""), F.col("text")).alias("source_hash"))
    first = k.groupBy("source_hash", "lang").agg(F.min("doc_id").alias("reused_from"))
    return k.join(first, ["source_hash", "lang"]).where(F.col("doc_id") != F.col("reused_from")).select("doc_id", "source_hash", "reused_from")


@query
def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What the documents leave in a memory that the last writer of a key wins, and how often it changed."""
    k = table(spark, d, "documents").select("doc_id", "text", "lang", "source", t.memory_key(F.lit(""), F.col("text")).alias("source_hash"))
    # A write changes something if the one before it of its key differs; numbers within keys are dealt out in ranges, so the
    # copies of one text may be any share of the rows, and what the memory holds in the end is its fold.
    x = folds.numbered(k.drop("text"), "source_hash", [F.col("doc_id")], "nth")
    before = x.select("source_hash", (F.col("nth") + 1).alias("nth"), F.col("lang").alias("old_lang"), F.col("source").alias("old_source"))
    x = x.join(before, ["source_hash", "nth"], "left")
    writes = x.groupBy("source_hash").agg(F.count_if(F.coalesce((F.col("lang") != F.col("old_lang")) | (F.col("source") != F.col("old_source")), F.lit(True))).alias("writes"))
    entries = k.select(F.lit("").alias("source_html"), "text", "lang", "source", "doc_id").select(
        F.col("text").alias("source_text"), "source_html", F.lit("x").alias("translated_html"), F.col("lang").alias("target_language"), F.col("source").alias("source_project"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("doc_id").alias("seq"),
    )
    held = memory.upserted(spark.createDataFrame([], memory.SCHEMA), entries)
    return held.select("source_hash", F.col("target_language").alias("lang"), F.col("source_project").alias("source")).join(writes, "source_hash")


@query
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label: the work still to do."""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query
def term_hits(spark: SparkSession, d: str) -> DataFrame:
    """Which frequent names occur in which benchmark passages."""
    docs = table(spark, d, "documents")
    names = terms.table(terms.mentions(docs, "doc_id", F.col("text"), terms.NAME), "doc_id").select(F.col("term").alias("source"))
    return checks.term_hits(table(spark, d, "benchmark"), names, "text", ["item_id"])


@query
def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("tokens", F.floor("value").cast("long"))
    return usage.rolled_up(e, "event_type", "tokens").withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query
def usage_delta(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("counter", F.floor("value").cast("long"))
    return usage.deltas(e, "user_id", [F.col("event_id")], "counter").select("event_id", "delta")


@query
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    return usage.tail(table(spark, d, "events"), "user_id", [F.col("event_id")], 20).select("user_id", "event_id", "event_type")


@query
def jobs_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("stage"), F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"))


@query
def budget_admission(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return usage.admitted(e, "user_id", ["event_id"], "cents", 100_000).select("event_id", "admitted")


@query
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("tokens", F.floor("value").cast("long"))
    return usage.rate_limited(e, "user_id", "at", "event_id", "tokens", 2, 40, 21600).select("event_id", "delay")


@query
def diagnostics_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Events' kinds read as error texts."""
    e = table(spark, d, "events")
    said = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("Provider HTTP "), (400 + F.col("event_id") % 130).cast("string")))
        .when(F.col("event_type") == "view", "request timed out").when(F.col("event_type") == "click", "invalid JSON in response").otherwise(F.col("props"))
    )
    x = e.select(usage.diagnosed(said, F.col("event_type")).alias("x"), usage.retryable(said).alias("again"))
    return x.groupBy(F.col("x.code").alias("code"), F.col("x.owner").alias("owner"), F.col("x.retryable").alias("retryable"), "again").agg(F.count(F.lit(1)).alias("events"))


@query
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customers' nations, numbered within the nation: the order of survivors only."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").where(F.col("o_orderstatus") != "P")
    x = x.withColumn("n_name", F.coalesce("n_name", F.lit("")))
    return folds.numbered(x, "n_name", [F.col("o_orderkey")]).select("o_orderkey", "n_name", "seq")


@query
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    kinds = [docs.select(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("lang", "source")]
    return kinds[0].unionByName(kinds[1]).where(F.coalesce("value", F.lit("")) != "").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


QUERIES |= review.QUERIES
ORACLES |= review.ORACLES
