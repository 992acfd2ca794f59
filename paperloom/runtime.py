"""Session helpers shared by every operator: table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a single Parquet file or a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a session without the setting gets one of its own, and only in local mode, where driver and executors share
    a disk; on a cluster the absence is an error instead of a silent machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@cache
def _scratch_root(shared: str, application: str) -> str:
    """The folder of this application's scratch below the shared folder; it is deleted when the driver ends."""
    root = f"{shared}/paperloom-{application}"

    def delete() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(lambda: suppressed(delete))
    return root


def suppressed(f) -> None:
    with contextlib.suppress(Exception):
        f()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, gone when the driver ends."""
    return f"{_scratch_root(shared_dir(spark), spark.sparkContext.applicationId)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bytes of values that a checked broadcast may hold.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its values have no more than `most` bytes; df should be cut, as it is read to be measured.

    Beyond, Spark joins it by a shuffle; the rows of a join are the same either way.
    """
    size = F.lit(16)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) if kind == "string" else F.lit(8))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if a small input has fewer: for work that costs far more than a row's way.

    An input that fills the cluster stays as it is read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= cores else df
