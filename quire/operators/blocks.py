"""Texts cut into ordered blocks, and blocks described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t

PARAGRAPH = r"\n\s*\n"


def pieces(df: DataFrame, key: str, text: Column, delimiter: str) -> DataFrame:
    """(key, pos, piece): the non-blank pieces of each text, stripped, with their place from 1. Only pieces that begin or end
    with white space are gone through for it."""
    edged = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(t.WS)
    cut = F.filter(F.transform(F.split(text, delimiter), lambda x: F.when(edged(x), t.strip(x)).otherwise(x)), lambda x: x != "")
    return df.select(key, F.posexplode(cut).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long") + 1)


def numbered(df: DataFrame, key: str, order: list[Column], to: str = "seq") -> DataFrame:
    return df.withColumn(to, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def block_id(file: Column, seq: Column) -> Column:
    return F.format_string("%s::%04d", file, seq)
