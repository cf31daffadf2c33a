"""References of pages and packages held against the files and anchors there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t


def resolved(base: Column, href: Column) -> Column:
    """The path a relative reference names from a file: dots resolved, the fragment left out; empty for a
    pure fragment."""
    clean = F.regexp_replace(href, "#.*$", "")
    parts = F.split(F.concat(F.regexp_replace(base, "[^/]*$", ""), clean), "/")

    def step(acc: Column, p: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(p.isin("", "."), acc).when(p == "..", up).otherwise(F.array_append(acc, p))

    return F.when(clean == "", "").otherwise(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def srcset(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), lambda x: F.split_part(t.strip(x), F.lit(" "), F.lit(1))), lambda x: x != "")


def broken(links: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """(file, value, why) of internal references (file, value) whose file (file) or anchor (file, id) is
    missing."""
    x = links.where(~t.is_external(F.col("value")) | F.startswith("value", F.lit("#")))
    x = x.withColumn("target", F.coalesce(F.nullif(resolved(F.col("file"), F.col("value")), F.lit("")), "file"))
    x = x.withColumn("anchor", F.when(F.contains("value", F.lit("#")), F.regexp_replace("value", "^[^#]*#", "")).otherwise(""))
    there = files.select(F.col("file").alias("target")).distinct().withColumn("there", F.lit(True))
    known = ids.select(F.col("file").alias("target"), F.col("id").alias("anchor")).distinct().withColumn("known", F.lit(True))
    x = x.join(there, "target", "left").join(known, ["target", "anchor"], "left")
    why = F.when(F.col("there").isNull(), "file missing").when((F.col("anchor") != "") & F.col("known").isNull(), "anchor missing")
    return x.select("file", "value", why.alias("why")).where("why IS NOT NULL")
