"""Reading inputs and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


#: Bytes of an Arrow batch, where the session keeps Spark's default of 64 MB: workers hold a few arrays per byte of a batch.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get(_BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset and the master is local, below a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local.setdefault("root", tempfile.mkdtemp(prefix="scholia-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read again: cuts the lineage, survives lost executors.

    The write's own shuffle files go as soon as it has ended, not when the driver's heap happens to fill."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether Spark will send df's rows to all tasks in a join, by the size of the files they stand in."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 < limit and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have (names don't differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

