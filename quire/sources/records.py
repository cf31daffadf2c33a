"""JSON Lines and JSON files: read with the place of what is wrong, written in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.folds import changes


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the non-blank lines of each file with their number from 1; lines end with LF, CR LF or CR. A file
    is read by as many tasks as it has splits: each numbers its lines from the split's start, and what earlier splits of
    the file hold is added. Only the splits are counted first, by an aggregate, so no file has to fit into a task."""
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    raw = spark.read.text(path).select(*place, "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, starts, count = None, None, 0
        for b in batches:
            if not (n := b.num_rows):
                continue
            new, at = changes(b.column(0), paths) | changes(b.column(1), starts), np.arange(n)
            first = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(first >= 0, at - first, at + count) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place), b.column(2)], ["path", "start", "line", "value"])
            paths, starts, count = b.column(0).slice(n - 1), b.column(1).slice(n - 1), int(place[-1])

    lines = raw.mapInArrow(number, "path string, start long, line long, value string").where(t.strip(F.col("value")) != "")
    # Files of one split need no counts: their only split starts at 0.
    counts = spark.read.text(path).where(F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).select(*place).groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))).where("before > 0").select("path", "start", "before")
    return lines.join(before, ["path", "start"], "left").select("path", (F.col("line") + F.coalesce("before", F.lit(0))).alias("line"), "value")


def parsed(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """lines with `row` (a struct of the schema) and `error` (path:line of a line that is no JSON object)."""
    kind = F.get(F.regexp_extract_all(F.col(value), F.lit(r"^\s*(.)"), F.lit(1)), F.lit(0))
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(value))).isNotNull() & (kind == "{"), F.lit(False))
    where = F.concat_ws(":", "path", F.col("line").cast("string"))
    return lines.withColumn("row", F.when(ok, F.from_json(value, schema))).withColumn("error", F.when(~ok, F.concat(where, F.lit(": no JSON object"))))


def read_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """The rows of JSON Lines files; with strict, a bad line ends the query with its path and number. A path that
    matches nothing gives no rows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if found is None or not len(found):
        return spark.createDataFrame([], schema)
    x = parsed(numbered_lines(spark, path), schema)
    if strict:
        x = x.withColumn("row", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("row")))
    return x.where(F.col("row").isNotNull()).select("row.*")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold a JSON array."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"array<struct<{schema}>>", {"mode": "FAILFAST"})).alias("x")).select("x.*")


def line(df: DataFrame) -> Column:
    """A row as compact JSON with nulls left out and characters as they are."""
    return F.to_json(F.struct(*[F.col(c) for c in df.columns]))


def write_ordered(df: DataFrame, path: str, group: str, order: list[Column], name: Column | None = None) -> None:
    """JSON Lines, a folder for each group, its rows in order in one file: groups are batches of bounded size."""
    out = df.withColumn("q_line", line(df)).withColumn("q_group", name if name is not None else F.col(group).cast("string"))
    at = {f"q_order{i}": o for i, o in enumerate(order)}
    out = out.withColumns(at).repartition("q_group").sortWithinPartitions("q_group", *at)
    out.select("q_line", "q_group").write.partitionBy("q_group").mode("errorifexists").text(path)
