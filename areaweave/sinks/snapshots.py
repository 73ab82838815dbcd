"""Snapshot export: a run's files count only once its commit is in place.

Every run writes below its own id, ``data/<table>/run_id=…/lga_id=…``, and touches nothing that
another run wrote.  Its last step appends one commit file with a row for each of its areas.
Readers take, for each area, the run that committed last and nothing else, so a run that dies half way
changes nothing, and an area that now has no rows has none, whatever earlier runs left.  ``vacuum``
removes what no commit points to any more.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g

_COMMIT = "lga_id STRING, run_id STRING, committed_at STRING"


def new_run_id(moment: datetime | None = None) -> str:
    """A run id; later runs sort after earlier ones."""
    return (moment or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y%m%dT%H%M%S%f")


def stage(tables: dict[str, DataFrame], path: str, run_id: str) -> None:
    """Write tables with an ``lga_id``, whole, below the run's id; nobody reads them before the commit.

    Layers are written per layer and geometry category as well.
    """
    for name, df in tables.items():
        keys = ["run_id", "lga_id"] + [c for c in ("layer",) if c in df.columns]
        if name == "layers":
            df = df.withColumn("geom_category", F.expr(g.category("geom")))
            keys.append("geom_category")
        # Adaptive execution splits a folder that holds more than its share.
        placed = df.withColumn("run_id", F.lit(run_id)).hint("rebalance", *keys)
        placed.write.mode("append").partitionBy(*keys).parquet(f"{path}/data/{name}")


def commit(areas: DataFrame, path: str, run_id: str, moment: datetime | None = None) -> None:
    """Make the run the current one of its ``areas`` (lga_id): one file, so it is there or not."""
    at = (moment or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat()
    rows = areas.select("lga_id").distinct().select("lga_id", F.lit(run_id).alias("run_id"), F.lit(at).alias("committed_at"))
    rows.coalesce(1).write.mode("append").json(f"{path}/commits")


def current_runs(spark: SparkSession, path: str) -> DataFrame:
    """lga_id and run_id of the last commit of every area."""
    commits = spark.read.schema(_COMMIT).json(f"{path}/commits")
    last = F.max_by("run_id", F.struct("committed_at", "run_id")).alias("run_id")
    return commits.groupBy("lga_id").agg(last)


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table that the last committed run of each area wrote; other runs' folders are pruned."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/data/{name}")
    rows = rows.withColumn("run_id", F.col("run_id").cast("string"))
    return rows.join(current_runs(spark, path), ["lga_id", "run_id"], "left_semi").drop("run_id")


def vacuum(spark: SparkSession, path: str, before: str) -> list[str]:
    """Delete the folders of runs that started before the run id ``before`` and are current for no area.

    ``before`` keeps runs that are still writing.  Returns the ids that went.
    """
    kept = {row["run_id"] for row in current_runs(spark, path).select("run_id").distinct().collect()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = set()
    for table in fs.listStatus(root):
        for folder in fs.listStatus(table.getPath()):
            run_id = folder.getPath().getName().removeprefix("run_id=")
            if folder.isDirectory() and run_id < before and run_id not in kept:
                fs.delete(folder.getPath(), True)
                gone.add(run_id)
    return sorted(gone)
