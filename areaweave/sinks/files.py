"""Layer and run-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.sources.geojson import encode

_RUN_SCHEMA = (
    "lga_id STRING, lga_name STRING, state_name STRING, output_label STRING, timestamp_utc STRING, "
    "environment STRUCT<python_version: STRING, platform: STRING, package_versions: MAP<STRING, STRING>>, "
    "boundary_source STRING, target_crs STRING, tag_config STRING, rules_hash STRING, "
    "warnings ARRAY<STRING>, "
    "exported_layers MAP<STRING, STRUCT<geojson: STRING, parts: MAP<STRING, STRING>>>, "
    "skipped_layers ARRAY<STRING>, split_layers MAP<STRING, ARRAY<STRING>>, content_hash STRING"
)


def _write(df: DataFrame, keys: list[str], path: str, fmt: str) -> None:
    """Replace the folders of the areas at hand, and no others.

    The rebalance hint groups rows by folder, but lets adaptive execution split a
    folder that holds far more than its share instead of writing it in one task.
    """
    writer = df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
    writer.option("partitionOverwriteMode", "dynamic").format(fmt).save(path)


def write_geojson(layers: DataFrame, path: str) -> None:
    """One folder of newline-delimited features per area and layer.

    Coordinates stay projected; the srid is a property of every feature.
    """
    properties = F.to_json(
        F.struct("osmid", "name", "element_type", F.col("geom.srid").alias("srid")), {"ignoreNullFields": "false"}
    )
    feature = F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), F.expr(encode("geom")), F.lit("}")
    )
    _write(layers.select("lga_id", "layer", feature.alias("value")), ["lga_id", "layer"], f"{path}/geojson", "text")


def write_by_category(layers: DataFrame, path: str) -> None:
    """One Parquet folder per area, layer and geometry category."""
    split = layers.withColumn("geom_category", F.expr(g.category("geom")))
    _write(split, ["lga_id", "layer", "geom_category"], f"{path}/layers", "parquet")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest of the areas at hand, in place of their earlier one."""
    _write(manifest, ["lga_id"], f"{path}/manifest", "json")


_MANIFEST_SCHEMA = (
    "lga_id STRING, position INT, layer STRING, geom_category STRING, name STRING, geojson_path STRING, "
    "path STRING, n BIGINT, status STRING"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What the last run of each area exported and skipped."""
    return spark.read.schema(_MANIFEST_SCHEMA).json(f"{path}/manifest")


def write_left_out(rejected: DataFrame, quarantined: DataFrame, path: str) -> None:
    """Requests without a trusted boundary, and features that cleaning left out, with reasons."""
    rejected.write.mode("overwrite").json(f"{path}/rejected")
    shaped = quarantined.withColumn("geometry", F.expr(encode("geom"))).drop("geom")
    _write(shaped, ["lga_id"], f"{path}/quarantined", "json")


def write_runs(runs: DataFrame, path: str) -> None:
    """One JSON record per area, in place of its earlier one."""
    _write(runs, ["lga_id"], f"{path}/runs", "json")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of each area."""
    return spark.read.schema(_RUN_SCHEMA).json(f"{path}/runs")
