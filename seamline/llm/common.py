"""What the operators of this subpackage share: table access, the shared folder, written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir(). Where
    neither is set, one of our own if all runs on this machine; on a cluster executors could not see it, so that fails."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = given.get() if given.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="seamline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended: nothing is left to ask
        pass


def written(df: DataFrame, name: str, keep: bool = True, batch: int | None = None) -> DataFrame:
    """Cut the lineage: write df as parquet to the shared folder and read it back. The files go when the driver ends.
    batch: rows that go to Python at once, for this write only; fewer than usual where rows are long."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, batch):
        df.write.option("compression", "zstd").parquet(path)
    if keep:
        atexit.register(_drop_quietly, spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again.written_path = path
    return again


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Within it, what starts to run gives Python so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text):
    """Column: the lower-case words (runs of letters and digits) of a text; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
