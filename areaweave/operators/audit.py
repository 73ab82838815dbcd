"""Manifest, warnings and run records."""

from __future__ import annotations

import hashlib
import json
import platform
import sys
from datetime import datetime, timezone
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.functions import text
from areaweave.functions.projection import epsg_label
from areaweave.operators.boundary import normalise_requests
from areaweave.operators.layers import areas_by_layers
from areaweave.settings import DEFAULT_RULES

_TRACKED_PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def rules_hash(rules: dict | None = None) -> str:
    """Identifies the rules of a run."""
    body = json.dumps(DEFAULT_RULES if rules is None else rules, sort_keys=True)
    return hashlib.md5(body.encode()).hexdigest()


def category_counts(layers: DataFrame) -> DataFrame:
    """Rows per area, layer and geometry category."""
    return layers.groupBy("lga_id", "layer", F.expr(g.category("geom")).alias("geom_category")).agg(
        F.count(F.lit(1)).alias("n")
    )


def layer_categories(counts: DataFrame) -> DataFrame:
    """Sorted categories of every layer, and whether it is split."""
    return counts.groupBy("lga_id", "layer").agg(
        F.sort_array(F.collect_set("geom_category")).alias("categories"),
        F.sum("n").alias("n"),
    ).withColumn("is_split", F.size("categories") > 1)


def skipped_layers(counts: DataFrame, boundaries: DataFrame, rules: dict | None = None) -> DataFrame:
    """Area and layer pairs without a row."""
    return areas_by_layers(boundaries, rules).join(counts, ["lga_id", "layer"], "left_anti")


def export_manifest(
    counts: DataFrame, boundaries: DataFrame, path: str, rules: dict | None = None
) -> DataFrame:
    """What is written where: one row per area, layer and category, and per skipped layer.

    A layer of one category is named after the layer, a split one also after the
    category.  ``counts`` is aggregated already, so the window holds a handful of
    rows per layer.
    """
    per_layer = Window.partitionBy("lga_id", "layer")
    sized = counts.withColumn("parts", F.count(F.lit(1)).over(per_layer))
    every = areas_by_layers(boundaries, rules).join(sized, ["lga_id", "layer"], "left")
    written = F.col("n").isNotNull()
    folder = F.concat(F.lit(f"{path}/geojson/lga_id="), "lga_id", F.lit("/layer="), "layer")
    part = F.concat(
        F.lit(f"{path}/layers/lga_id="), "lga_id", F.lit("/layer="), "layer", F.lit("/geom_category="), "geom_category"
    )
    return every.select(
        "lga_id",
        "position",
        "layer",
        "geom_category",
        F.when(F.col("parts") > 1, F.concat_ws("_", "layer", "geom_category")).otherwise(F.col("layer")).alias("name"),
        F.when(written, folder).alias("geojson_path"),
        F.when(written, part).alias("path"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(written, "exported").otherwise("skipped").alias("status"),
    )


def fold_warnings(boundaries: DataFrame, notes: DataFrame) -> DataFrame:
    """All warnings of an area: the boundary's first, then the layers' in rule order."""
    of_layers = notes.groupBy("lga_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "message"))), lambda s: s["message"]).alias("m")
    )
    of_boundary = F.array_compact(
        F.array(
            F.when(
                F.col("validation_warnings").isNotNull(),
                F.concat(F.lit("Boundary validation: "), "validation_warnings"),
            )
        )
    )
    none = F.array().cast("array<string>")
    return boundaries.join(of_layers, "lga_id", "left").select(
        "lga_id", F.concat(of_boundary, F.coalesce("m", none)).alias("warnings")
    )


def left_out_notes(outcomes: DataFrame, rules: dict | None = None) -> DataFrame:
    """One warning per area, layer and reason for features that cleaning left out."""
    positions = {layer: i for i, layer in enumerate(DEFAULT_RULES if rules is None else rules)}
    pairs = [F.lit(x) for item in positions.items() for x in item]
    position = F.element_at(F.create_map(*pairs), F.col("layer")) if pairs else F.lit(None).cast("int")
    lost = outcomes.where("outcome IN ('quarantined', 'emptied', 'null_geometry', 'empty_geometry')")
    message = F.format_string("Layer '%s': %d features left out (%s).", "layer", "n", "outcome")
    return lost.select(
        "lga_id", position.alias("position"), "layer", F.lit(False).alias("failed"), message.alias("message")
    )


def environment() -> Column:
    """Versions that matter for reproducing a run, as a struct literal."""
    versions = []
    for package in _TRACKED_PACKAGES:
        try:
            found = version(package)
        except PackageNotFoundError:
            found = "not installed"
        versions += [F.lit(package), F.lit(found)]
    return F.struct(
        F.lit(sys.version.split()[0]).alias("python_version"),
        F.lit(platform.platform()).alias("platform"),
        F.create_map(*versions).alias("package_versions"),
    )


def run_records(
    boundaries: DataFrame,
    manifest: DataFrame,
    warnings: DataFrame,
    rules: dict | None = None,
    timestamp: datetime | None = None,
) -> DataFrame:
    """One record per area: what was asked, found, written, skipped and split."""
    rules = DEFAULT_RULES if rules is None else rules
    entry = F.struct("position", "layer", "geom_category", "name", "geojson_path", "path", "status")
    gathered = manifest.groupBy("lga_id").agg(F.array_sort(F.collect_list(entry)).alias("rows"))

    exported = "filter(rows, r_ -> r_.status = 'exported')"
    layer_names = f"array_distinct(transform({exported}, r_ -> r_.layer))"
    of_layer = f"filter({exported}, q_ -> q_.layer = l_)"
    files = (
        f"named_struct('geojson', get({of_layer}, 0).geojson_path, "
        f"'parts', map_from_entries(transform({of_layer}, q_ -> struct(q_.geom_category, q_.path))))"
    )
    split = f"filter({layer_names}, l_ -> size({of_layer}) > 1)"
    moment = (timestamp or datetime.now(timezone.utc)).astimezone(timezone.utc).isoformat()
    return (
        boundaries.join(gathered, "lga_id", "left")
        .join(warnings, "lga_id", "left")
        .select(
            "lga_id",
            "lga_name",
            "state_name",
            text.output_label(F.col("lga_name")).alias("output_label"),
            F.lit(moment).alias("timestamp_utc"),
            environment().alias("environment"),
            "boundary_source",
            F.expr(epsg_label("target_srid")).alias("target_crs"),
            F.lit(json.dumps(rules)).alias("tag_config"),
            F.lit(rules_hash(rules)).alias("rules_hash"),
            "warnings",
            F.expr(f"map_from_entries(transform({layer_names}, l_ -> struct(l_, {files})))").alias("exported_layers"),
            F.expr("transform(filter(rows, r_ -> r_.status = 'skipped'), r_ -> r_.layer)").alias("skipped_layers"),
            F.expr(
                f"map_from_entries(transform({split}, l_ -> "
                f"struct(l_, sort_array(transform({of_layer}, q_ -> q_.geom_category)))))"
            ).alias("split_layers"),
        )
    )


def pending_requests(requests: DataFrame, runs: DataFrame, rules: dict | None = None) -> DataFrame:
    """Requested areas without a finished run under the same rules."""
    done = runs.where(F.col("rules_hash") == rules_hash(rules)).select("lga_id").distinct()
    return normalise_requests(requests).join(done, "lga_id", "left_anti")
