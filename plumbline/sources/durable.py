"""Intermediate results that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of fixed-size rows is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
#: Rows that a partition of a gathered result should hold.
PART_ROWS = 2_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A folder of this machine stands in for it on a local master only, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def _ready(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the session's checkpoint folder, which all executors see; later plans start from it."""
    return _ready(df).checkpoint(eager=True)


def durable_columns(df: DataFrame) -> DataFrame:
    """durable, for many rows: kept as Parquet in the same folder, whose columns are read back far faster than the serialized rows of a checkpoint.
    Columns may be null afterwards; rows come in partitions by size."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/columns-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """durable, with tiny partitions read several at a time: each would else be a task and some files of its own in every shuffle that
    follows. For rows of ordinary size whose place in a partition means nothing."""
    counted = Observation()
    kept = _ready(df).observe(counted, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    parts = parts_of(counted.get["rows"])
    return kept.coalesce(parts) if 4 * parts <= kept.rdd.getNumPartitions() else kept


def parts_of(rows: int) -> int:
    """How many partitions so many rows need at least."""
    return max(1, -(-rows // PART_ROWS))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, where df (kept durably) has been counted to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
