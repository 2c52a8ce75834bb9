"""What the operators share: tables written between jobs, and names of inner columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inner columns start with this, so that columns of the caller do not clash with them.
INNER = "__g_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read from there: this cuts the lineage, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes a table of written() that no later step reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._gleaner_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def tidy(f):
    """f of an Arrow table, in a worker that holds no more memory than it uses."""

    def run(table):
        sparing()
        try:
            return f(table)
        finally:
            del table
            give_back()

    return run


def sparing() -> None:
    """From now on large arrays of this process go back to the system as soon as they are freed."""
    if put := getattr(ctypes.CDLL(None), "mallopt", None):
        put(-3, 1 << 20)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key_hash(*cols: Column, digits: int = 15) -> Column:
    """A long of 4 * digits bits from the MD5 of the columns, which SQL engines can repeat; null and '' differ."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, digits), 16, 10).cast("long")
