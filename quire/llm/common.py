"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local one is made only where the session names none
    and runs on this machine alone."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    sc = spark.sparkContext
    if (jd := sc._jsc.sc().getCheckpointDir()).isDefined():
        return jd.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, and is
    removed by `forgotten`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


#: Rows of an Arrow batch that Python functions get: whole texts are a few KB each.
BATCH_ROWS = 1000


def batched(spark: SparkSession) -> None:
    """Bounds Arrow batches, in the JVM and in Python workers, where the session leaves Spark's default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def released(*caches: dict) -> None:
    """Empties word tables and gives freed memory back to the system: workers stay alive between tasks."""
    import pyarrow as pa

    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator], *caches: dict) -> Callable[[Iterator], Iterator]:
    """A function for mapInPandas that releases its worker's memory when a task ends."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            released(*caches)

    return whole


def forgotten(*tables: DataFrame) -> None:
    """Removes written tables that nothing to come reads, before the driver ends."""
    for df in tables:
        if path := getattr(df, "_quire_path", None):
            jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(modulus: int, remainder: int) -> Column:
    """crc32 of doc_id as text, mod modulus, equals remainder; a null doc_id counts as the empty text."""
    return held_out_of("doc_id", modulus, remainder)


def held_out_of(name: str, modulus: int, remainder: int) -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, A-Z in lower case. bytes.lower and bytes.split know ASCII only,
    which is just what is asked for."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def sampled(df: DataFrame, most: int, *by: str) -> DataFrame:
    """Rows of df of which at most about `most` are left (all, if there are no more): those whose hash of the
    given columns falls below a share. It takes one count; nothing is sorted or gathered. The share aims four
    standard deviations below the bound."""
    n = df.count()
    if n <= most:
        return df
    share = max(1.0, most - 4 * most**0.5) / n
    return df.where(F.shiftrightunsigned(F.xxhash64(*by), 12).cast("double") / float(1 << 52) < share)
