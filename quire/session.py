"""Making the package known to executors, and tables in the folder that they share."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives executors this package through Spark's own file distribution, once per application, so that
    Python functions run where the package is not installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        path = Path(tempfile.mkdtemp(prefix="quire-")) / "quire.zip"
        path.write_bytes(blob.getvalue())
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark


#: Bounds of the batches of texts that Python functions get: rows, and bytes as Arrow holds them.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, where the session allows more: what a worker holds of whole pages or books
    then hangs neither on the input nor on how large these are, but for a single one."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        n, unit = re.fullmatch(r"(-?\d+)\s*([bkmgtp]?)b?", spark.conf.get(name).lower()).groups()
        if not 0 < int(n) << 10 * max(0, "bkmgtp".find(unit)) <= most:
            spark.conf.set(name, str(most))


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


def hadoop(spark: SparkSession, path: str) -> tuple:
    """A path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors, fixes what sampling or
    hashing by place has dealt out, and is removed by `forgotten`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, fs = hadoop(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def forgotten(*tables: DataFrame) -> None:
    """Removes written tables that nothing to come reads, before the driver ends."""
    for df in tables:
        if path := getattr(df, "_quire_path", None):
            p, fs = hadoop(df.sparkSession, path)
            fs.delete(p, True)
