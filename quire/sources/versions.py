"""Tables that change in place: rows by key in hash buckets, which are rewritten as a whole where a row of theirs changes.

A version is one small file that names, for each bucket, the folder that holds it; giving it its name is the commit, so a
writer that is lost before leaves the version before it as it was. A change reads the buckets of its keys, writes those in which
something differs to a new folder, and shares all others with the version before. Versions that are read no longer are
cleared away by `trimmed`. One writer works on a table at a time; a second one is refused if it comes later.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import hadoop

BUCKETS = 64


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{path}/versions") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What a version consists of (of the last, if not told): its number, how many buckets there are, and the folder of
    each that has rows."""
    have = versions(spark, path)
    if not have:
        return {"version": 0, "buckets": 0, "folders": {}}
    text = spark.read.text(f"{path}/versions/{version or have[-1]:08d}.json", wholetext=True).first()[0]
    return json.loads(text)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def current(spark: SparkSession, path: str, schema: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The rows of a version; of some buckets only, if told."""
    m = manifest(spark, path, version)
    folders = [f"{path}/data/{name}/bucket={b}" for b, name in m["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _committed(spark: SparkSession, path: str, m: dict) -> None:
    draft, fs = hadoop(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    name, _ = hadoop(spark, f"{path}/versions/{m['version']:08d}.json")
    fs.mkdirs(name.getParent())
    out = fs.create(draft)
    out.write(bytearray(json.dumps(m).encode()))
    out.close()
    if fs.exists(name) or not fs.rename(draft, name):
        fs.delete(draft, False)
        raise RuntimeError(f"version {m['version']} of {path} was written by another")


def changed(spark: SparkSession, path: str, schema: str, key: str, rows: DataFrame, same: Column, buckets: int = BUCKETS) -> int:
    """Puts rows (one a key) in the place of those with their keys; those that are the same as what is there (`same`: of the
    columns old.* and new.*) are left. Gives how many were put. Nothing to put makes no version."""
    before = manifest(spark, path)
    buckets = before["buckets"] or buckets
    x = rows.withColumn("bucket", bucket_of(key, buckets))
    touched = [r["bucket"] for r in x.select("bucket").distinct().collect()]  # as many as buckets at most
    old = current(spark, path, schema, before["version"] or None, touched)
    columns = old.columns
    here = F.col(f"old.{key}") == F.col(f"new.{key}")
    put = x.alias("new").join(old.alias("old"), here, "left").where(F.col(f"old.{key}").isNull() | ~same).select("new.*")
    folder = uuid.uuid4().hex
    staged = f"{path}/staged/{folder}"
    put.repartition("bucket").write.parquet(staged)  # what is put is fixed before it is counted and used twice
    put = spark.read.schema(x.schema).parquet(staged)
    counts = {r["bucket"]: r["count"] for r in put.groupBy("bucket").count().collect()}
    if counts:
        old = current(spark, path, schema, before["version"] or None, list(counts)).join(put.select(key), key, "left_anti").withColumn("bucket", bucket_of(key, buckets))
        old.select(*columns, "bucket").unionByName(put.select(*columns, "bucket")).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{folder}")
        _committed(spark, path, {"version": before["version"] + 1, "buckets": buckets, "folders": before["folders"] | {str(b): folder for b in counts}})
    p, fs = hadoop(spark, staged)
    fs.delete(p, True)
    return sum(counts.values())


def trimmed(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all versions but the last ones, and what none of these holds: also what lost writers have left."""
    have = versions(spark, path)
    held = {(b, name) for v in have[-keep:] for b, name in manifest(spark, path, v)["folders"].items()}
    gone = [f"{path}/versions/{v:08d}.json" for v in have[:-keep]] + [f"{path}/staged"]
    for name in _names(spark, f"{path}/data"):
        whole = [f"{path}/data/{name}"]
        if any(n == name for _, n in held):
            whole = [f"{path}/data/{name}/{b}" for b in _names(spark, f"{path}/data/{name}") if b.startswith("bucket=") and (b[7:], name) not in held]
        gone += whole
    for g in gone:
        p, fs = hadoop(spark, g)
        fs.delete(p, True)


def replaced(df: DataFrame, path: str) -> None:
    """df as JSON Lines in a folder, which is written beside the old one and then takes its place; so the old one stays
    whole until all is written, and may be what df is read from. Between two names being given there is no folder for a
    moment."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.json(f"{beside}.new")
    (p, fs), (new, _), (old, _) = hadoop(spark, path), hadoop(spark, f"{beside}.new"), hadoop(spark, f"{beside}.old")
    had = fs.exists(p)
    if had and not fs.rename(p, old):
        raise RuntimeError(f"{path} can't be renamed")
    if not fs.rename(new, p):
        raise RuntimeError(f"{beside}.new can't be renamed to {path}")
    if had:
        fs.delete(old, True)
