"""Helpers that keep jobs safe at size: checked broadcasts, intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.settings import BROADCAST_BYTES


def broadcast_checked(df: DataFrame, row_bytes: int = 256, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its row count proves it small, else as it is.

    Counting stops at the limit, so the check is cheap for a large table too;
    without the hint Spark picks a shuffle join and adaptive execution splits
    its skewed partitions.
    """
    cap = max(1, limit // row_bytes)
    rows = df.limit(cap + 1).count()
    return F.broadcast(df) if rows <= cap else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="areaweave-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()


def through_table(df: DataFrame) -> DataFrame:
    """``df`` written once to a Parquet table in the shared folder and read back.

    Used where a result is read several times: it is computed once, later readers
    prune its columns, and losing an executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/areaweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compute_once(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Add or replace columns (SQL text or Column), each evaluated once per row.

    A plain ``withColumn`` may be copied by the optimizer into every filter and
    expression above it, which multiplies the work for long expressions.  As the
    output of a generator over one struct they are computed where they stand.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    values = {n: F.expr(v) if isinstance(v, str) else v for n, v in columns.items()}
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select(*kept, F.inline(F.array(row)))
