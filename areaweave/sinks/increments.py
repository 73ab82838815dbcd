"""Elements that arrive over time: every micro-batch is recorded once, and the areas it touches are published.

The stream itself keeps no state.  A batch is matched with the boundaries and written below its
batch id, first the layer rows, then the ids of all that arrived, and last a mark that it is whole.
A batch that Spark delivers again after a failure replaces what its first try left, or is skipped if the mark
stands.  An element that arrives again in a later batch, elsewhere or under other tags, supersedes its
earlier version; within one batch all versions stay.  Elements without an id are never superseded.

``publish`` cleans the areas whose rows changed since the last time, from their rows of all batches, and
commits them as one snapshot (see read_snapshot).  Done again after a failure it gives the same.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from areaweave.functions import geometry as g
from areaweave.operators.clean import clean_layers
from areaweave.operators.layers import extract_features
from areaweave.operators.scale import through_table
from areaweave.sinks import snapshots

_ID = ["element_type", "osmid"]
_BATCH, _ARRIVALS = "batch_id BIGINT", "element_type STRING, osmid BIGINT, batch_id BIGINT"
_ROWS = (
    f"lga_id STRING, layer STRING, element_type STRING, osmid BIGINT, name STRING, geom {g.GEOMETRY_SQL}, "
    "target_srid INT, batch_id BIGINT"
)


def _batches(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The list of batch ids ``recorded`` or ``published``; made, empty, where there is none yet."""
    spark.createDataFrame([], _BATCH).write.mode("ignore").json(f"{path}/{name}")
    return spark.read.schema(_BATCH).json(f"{path}/{name}")


def _mark(spark: SparkSession, path: str, name: str, batch_id: int) -> None:
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id")).coalesce(1).write.mode("append").json(f"{path}/{name}")


def record_batch(elements: DataFrame, boundaries: DataFrame, path: str, batch_id: int, rules: dict | None = None) -> bool:
    """Record one batch of elements; False if it is recorded already."""
    spark = elements.sparkSession
    if _batches(spark, path, "recorded").where(F.col("batch_id") == batch_id).limit(1).count():
        return False
    rows = extract_features(elements, boundaries, rules)
    rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
    known = elements.where("element_type IS NOT NULL AND osmid IS NOT NULL").select(*_ID).distinct()
    known.write.mode("overwrite").parquet(f"{path}/arrivals/batch_id={batch_id}")
    _mark(spark, path, "recorded", batch_id)
    return True


def stream_layers(
    elements: DataFrame,
    boundaries: DataFrame,
    path: str,
    checkpoint: str,
    rules: dict | None = None,
    **trigger,
) -> StreamingQuery:
    """Record streaming ``elements`` (element_type, osmid BIGINT, tags, geom) batch by batch.

    ``trigger`` goes to Spark's trigger(), which by default takes what is there and ends.
    """

    def record(batch: DataFrame, batch_id: int) -> None:
        record_batch(batch, boundaries, path, batch_id, rules)

    writer = elements.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _recorded(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows of whole batches only."""
    return spark.read.schema(schema).parquet(f"{path}/{name}").join(_batches(spark, path, "recorded").distinct(), "batch_id", "left_semi")


def current_rows(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Raw layer rows of the latest version of every element, as of batch ``upto``."""
    seen = F.lit(True) if upto is None else F.col("batch_id") <= upto
    arrivals = _recorded(spark, path, "arrivals", _ARRIVALS).where(seen)
    latest = arrivals.groupBy(*_ID).agg(F.max("batch_id").alias("_last"))
    rows = _recorded(spark, path, "rows", _ROWS).where(seen).join(latest, _ID, "left")
    return rows.where("_last IS NULL OR _last = batch_id").drop("_last", "batch_id")


def touched_areas(spark: SparkSession, path: str, after: int, upto: int) -> DataFrame:
    """lga_id of areas that got rows in batches (after, upto], or lost some to a newer version."""
    fresh = F.col("batch_id").between(after + 1, upto)
    rows = _recorded(spark, path, "rows", _ROWS).where(F.col("batch_id") <= upto).select("lga_id", *_ID, "batch_id")
    arrived = _recorded(spark, path, "arrivals", _ARRIVALS).where(fresh).select(*_ID).distinct()
    lost = rows.where(~fresh).join(arrived, _ID, "left_semi")
    return rows.where(fresh).select("lga_id").unionByName(lost.select("lga_id")).distinct()


def publish(spark: SparkSession, path: str, boundaries: DataFrame, moment: datetime | None = None) -> str | None:
    """Commit the areas that recorded batches touched since the last time; the run id, or None without new batches.

    The first time all areas are committed, so that one without features has its empty layers.
    """
    upto = _batches(spark, path, "recorded").agg(F.max("batch_id")).head()[0]
    after = _batches(spark, path, "published").agg(F.max("batch_id")).head()[0]
    if upto is None or (after is not None and after >= upto):
        return None
    areas = boundaries.select("lga_id").distinct()
    if after is not None:
        areas = areas.join(touched_areas(spark, path, after, upto), "lga_id", "left_semi")
    areas = through_table(areas)
    cleaned = clean_layers(current_rows(spark, path, upto).join(areas, "lga_id", "left_semi"))
    run_id = snapshots.new_run_id(moment)
    snapshots.stage({"layers": cleaned.layers, "quarantined": cleaned.quarantined}, path, run_id)
    snapshots.commit(areas, path, run_id, moment)
    _mark(spark, path, "published", upto)
    return run_id
