"""Jobs as tables: states kept as JSON, their lifecycle as events, listings and what may be shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.sources import versions

STATE = "job_id string, status string, filename string, input_format string, target_language string, title string, output_format string, total_batches long, completed_batches long, message string, last_active_at string, api_key string, work_dir string, _corrupt_record string"
DEFAULTS = {"input_format": ".epub", "title": "", "output_format": ".epub", "total_batches": 0, "completed_batches": 0, "message": ""}
#: Columns with secrets or paths, which listings leave out.
PRIVATE = ("api_key", "work_dir", "input_file", "output_file", "report_path")
INTERRUPTED = "Interrupted before completion; resume to go on from what is done."


def restored(states: DataFrame) -> DataFrame:
    """Job states as they are after a restart: what cannot be read or names no job is left out, gaps get
    defaults, and jobs that were at work have failed."""
    x = states.where(F.col("_corrupt_record").isNull()) if "_corrupt_record" in states.columns else states
    x = x.where(F.col("job_id").isNotNull() & F.col("status").isNotNull() & F.col("filename").isNotNull() & F.col("target_language").isNotNull())
    x = x.na.fill({k: v for k, v in DEFAULTS.items() if k in x.columns})
    cut = F.col("status").isin("running", "preparing")
    x = x.withColumn("message", F.when(cut, INTERRUPTED).otherwise(F.col("message"))).withColumn("interrupted", cut)
    return x.withColumn("status", F.when(cut, "failed").otherwise(F.col("status"))).drop("_corrupt_record")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The states (job.json, one object a file) of all jobs under a folder."""
    return restored(spark.read.schema(STATE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", "job.json").json(path))


def saved(states: DataFrame, path: str) -> None:
    """One JSON object a line, in the place of what is there; states may be read from it."""
    versions.replaced(states, path)


#: A job's status after each kind of event.
AFTER = {"created": "preparing", "prepared": "prepared", "started": "running", "resumed": "running", "batch-started": "running", "completed": "completed", "failed": "failed", "restarted": "failed", "budget-stop": "failed"}


#: The stage that an error after an event is of, by how the event's kind starts; else "translate".
STAGES = (("packaging", "package"), ("ai-qa", "audit"), ("validating", "audit"))


def status_after(kind: Column) -> Column:
    out = None
    for k, status in AFTER.items():
        out = (F if out is None else out).when(kind == k, status)
    return out


def folded_status(events: DataFrame, job: str, order: str, kind: str) -> DataFrame:
    """Per job the status that its last event of weight gives, and the stage that an error now would be of."""
    status = status_after(F.col(kind))
    x = events.groupBy(job).agg(F.max_by(F.when(status.isNotNull(), status), F.when(status.isNotNull(), F.col(order))).alias("status"), F.max_by(kind, order).alias("latest"), F.count(F.lit(1)).alias("events"))
    stage = F.when(F.col("latest") == "packaging", "package").when(F.startswith("latest", F.lit("ai-qa")) | (F.col("latest") == "validating"), "audit").otherwise("translate")
    return x.withColumn("status", F.coalesce("status", F.lit("preparing"))).withColumn("stage", stage).drop("latest")


def in_flight(events: DataFrame, job: str, batch: str, order: str, kind: str, ended: tuple[str, ...] = ("batch-completed", "batch-failed")) -> DataFrame:
    """(job, batch, since, current): batches started and not ended since; a job's first is its current one. A
    completed job has none."""
    x = events.where(F.col(kind).isin("batch-started", *ended)).groupBy(job, batch)
    x = x.agg(F.max(F.when(F.col(kind) == "batch-started", F.col(order))).alias("since"), F.max(F.when(F.col(kind) != "batch-started", F.col(order))).alias("ended"))
    x = x.where("since IS NOT NULL AND (ended IS NULL OR ended < since)").drop("ended")
    over = events.where(F.col(kind).isin("completed", "failed")).groupBy(job).agg(F.max(order).alias("over"))
    x = x.join(over, job, "left").where("over IS NULL OR over < since").drop("over")
    return x.withColumn("current", F.row_number().over(Window.partitionBy(job).orderBy("since", batch)) == 1)


def failed_batches(events: DataFrame, job: str, batch: str, order: str, kind: str) -> DataFrame:
    """(job, batch, at): the first failure of each batch since the job was last completed."""
    over = events.where(F.col(kind) == "completed").groupBy(job).agg(F.max(order).alias("over"))
    x = events.where(F.col(kind) == "batch-failed").join(over, job, "left").where(F.col("over").isNull() | (F.col("over") < F.col(order)))
    return x.groupBy(job, batch).agg(F.min(order).alias("at"))


def by_activity(jobs: DataFrame, active: str, job: str, most: int | None = None) -> DataFrame:
    """Jobs, the last active first."""
    x = jobs.orderBy(F.desc(active), F.desc(job))
    return x if most is None else x.limit(most)


def public(jobs: DataFrame) -> DataFrame:
    """What may be shown: no paths, and of a key only whether there is one."""
    key = [(F.coalesce(t.strip(F.col("api_key")), F.lit("")) != "").alias("has_api_key")] if "api_key" in jobs.columns else []
    return jobs.select(*[c for c in jobs.columns if c not in PRIVATE], *key)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """A page of rows (from 1); beyond the last one, the last. Sorting is up to the page's end only."""
    pages = max(1, -(-rows.count() // size))
    at = (min(max(number, 1), pages) - 1) * size
    return rows.orderBy(*order).offset(at).limit(size)


def stem(filename: Column) -> Column:
    name = F.element_at(F.split(filename, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def title(manual: Column, generated: Column, filename: Column, language: Column) -> Column:
    """A book's title: the one given, or generated, or else made from the file's name and the language."""
    chinese = F.lower(language).rlike("chinese|zh") | F.contains(language, F.lit("中文"))
    base = F.coalesce(F.nullif(stem(filename), F.lit("")), F.lit("Translated book"))
    made = F.when(chinese, F.concat(base, F.lit("（简体中文版）"))).otherwise(F.concat(base, F.lit(" ("), language, F.lit(")")))
    return F.coalesce(F.nullif(t.strip(manual), F.lit("")), F.nullif(t.strip(generated), F.lit("")), made)


#: Codes of languages by what their names hold.
LANGUAGES = (("chinese|中文", "zh"), ("japanese|日", "ja"), ("korean|韩", "ko"), ("english|英", "en"), ("french|法", "fr"), ("german|德", "de"), ("spanish|西", "es"))


def language_code(name: Column) -> Column:
    low = F.lower(t.strip(F.coalesce(name, F.lit(""))))
    out = F.when(low.isin("zh", "zh-cn"), "zh")
    for pattern, code in LANGUAGES:
        out = out.when(low.rlike(pattern), code)
    return out.when(F.length(low) >= 2, F.substring(low, 1, 2)).otherwise("zh")
