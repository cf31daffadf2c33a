"""A memory of transformed segments, keyed by the hash of their compacted source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.sources import versions

FIELDS = ("source_text", "source_html", "translated_html", "target_language", "source_project")
SCHEMA = "source_hash string, " + ", ".join(f"{c} string" for c in FIELDS) + ", confidence double, updated_at timestamp"


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source_hash", t.memory_key(F.col("source_html"), F.col("source_text")))


def hits(rows: DataFrame, memory: DataFrame, language: str) -> DataFrame:
    """Rows the memory holds in a language, with what it holds. Spark broadcasts the smaller side if its
    size allows, else both are dealt by hash."""
    m = memory.where((F.col("target_language") == language) & (t.strip(F.col("translated_html")) != "")).select("source_hash", "translated_html")
    return keyed(rows).join(m, "source_hash")


def _last(new: DataFrame) -> DataFrame:
    """Of each key the entry of the highest seq; copies meet in an aggregate, however many there are."""
    columns = [*FIELDS, "confidence", "updated_at"]
    x = new.groupBy("source_hash").agg(F.max_by(F.struct(*columns), F.struct("seq", *columns)).alias("q"))
    return x.select("source_hash", "q.*")


def _same(old: str, new: str) -> Column:
    """Whether two entries agree in all fields but time and confidence."""
    out = F.lit(True)
    for c in FIELDS:
        out = out & F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return out


def upserted(memory: DataFrame, new: DataFrame) -> DataFrame:
    """The memory after new segments (with seq, their order): blank ones are left out, the last of a key
    wins, and one that changes nothing keeps its old time."""
    n = _last(keyed(new).where(t.strip(F.coalesce("translated_html", F.lit(""))) != ""))
    keep = F.col("n.source_hash").isNull() | (F.col("m.source_hash").isNotNull() & _same("m", "n"))
    x = memory.alias("m").join(n.alias("n"), F.col("m.source_hash") == F.col("n.source_hash"), "full")
    return x.select(*[F.when(keep, F.col(f"m.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in n.columns])


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A memory that is kept at a path (its last version, if not told)."""
    return versions.current(spark, path, SCHEMA, version)


def remember(spark: SparkSession, path: str, new: DataFrame, buckets: int = versions.BUCKETS) -> int:
    """The kept memory after new segments, as `upserted` has it; only the buckets in which something changes are written,
    and if nothing does there is no new version. Gives how many entries were put."""
    n = _last(keyed(new).where(t.strip(F.coalesce("translated_html", F.lit(""))) != ""))
    return versions.changed(spark, path, SCHEMA, "source_hash", n, _same("old", "new"), buckets)


def take_in(spark: SparkSession, path: str, entries: DataFrame, project: str, language: str, buckets: int = versions.BUCKETS) -> Row:
    """The kept memory after an import, as `imported` has it. Gives how many entries were imported and skipped."""
    e, counts = _importable(entries, project, language)
    versions.changed(spark, path, SCHEMA, "source_hash", e, F.lit(False), buckets)
    return counts.first()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of exported memories: a list, an object with segments or entries (a list or a map), or JSON Lines,
    a file each. Texts of any form are parsed where they are read. What is no object is left out of lists and maps, and is an
    entry of nulls in JSON Lines."""
    import json

    import pandas as pd

    fields = ("source_hash", *FIELDS)

    def entries(text: str) -> list:
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            return [json.loads(line) for line in text.splitlines() if line.strip()]
        if isinstance(value, dict):
            value = value.get("segments") or value.get("entries") or []
            value = list(value.values()) if isinstance(value, dict) else value
        return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []

    def run(frames):
        for f in frames:
            rows = [x if isinstance(x, dict) else {} for text in f["value"] if text.strip() for x in entries(text)]
            out = [(*[str(r[k]) if isinstance(r.get(k), str) else None for k in fields], float(r["confidence"]) if isinstance(r.get("confidence"), (int, float)) else None, r["updated_at"] if isinstance(r.get("updated_at"), str) else None, i) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=[*fields, "confidence", "updated_at", "seq"])

    schema = ", ".join(f"{c} string" for c in fields) + ", confidence double, updated_at string, seq long"
    return spark.read.text(path, wholetext=True).mapInPandas(run, schema).withColumn("updated_at", F.try_to_timestamp("updated_at"))


def _importable(entries: DataFrame, project: str, language: str) -> tuple[DataFrame, DataFrame]:
    text = F.coalesce("source_text", F.lit("")), F.coalesce("source_html", F.lit(""))
    ok = t.strip(F.coalesce("translated_html", F.lit(""))) != ""
    counts = entries.agg(F.count_if(ok).alias("imported"), F.count_if(~ok).alias("skipped"))
    time = F.coalesce("updated_at", F.current_timestamp()) if "updated_at" in entries.columns else F.current_timestamp()
    e = entries.where(ok).select(
        F.coalesce(F.nullif("source_hash", F.lit("")), t.memory_key(text[1], text[0])).alias("source_hash"), text[0].alias("source_text"), text[1].alias("source_html"), "translated_html",
        F.coalesce("target_language", F.lit(language)).alias("target_language"), F.coalesce("source_project", F.lit(project)).alias("source_project"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), time.alias("updated_at"), "seq",
    )
    return _last(e), counts


def imported(memory: DataFrame, entries: DataFrame, project: str, language: str) -> tuple[DataFrame, DataFrame]:
    """The memory after entries (with seq, their order), and one row of how many were imported and skipped. Blank
    translations are skipped, gaps filled, and the later entry of a key stays."""
    e, counts = _importable(entries, project, language)
    return memory.join(e, "source_hash", "left_anti").select(e.columns).unionByName(e), counts


def stats(memory: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    out = memory.agg(F.count(F.lit(1)).alias("segment_entries"), F.countDistinct("source_project").alias("projects"))
    return out.withColumn("term_decisions", F.lit(0).cast("long")) if decisions is None else out.crossJoin(decisions.agg(F.count(F.lit(1)).alias("term_decisions")))


def exported(memory: DataFrame, path: str) -> None:
    """The memory as JSON Lines in order of keys, in the place of what is there."""
    versions.replaced(memory.orderBy("source_hash"), path)


def realigned(source: DataFrame, remembered: DataFrame, provided: DataFrame) -> DataFrame:
    """Every source row (id, pos) with its result: the service's, or else the memory's; null where there is none.
    remembered, provided: id, translated_html."""
    both = remembered.select("id", "translated_html", F.lit(0).alias("rank")).unionByName(provided.select("id", "translated_html", F.lit(1).alias("rank")))
    best = both.groupBy("id").agg(F.max_by(F.struct("translated_html", "rank"), F.struct("rank", "translated_html")).alias("q"))
    return source.join(best, "id", "left").select(*source.columns, "q.translated_html", F.when(F.col("q.rank") == 1, "service").when(F.col("q.rank") == 0, "memory").alias("origin"))
