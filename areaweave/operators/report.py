"""Summaries over finished layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.functions import text
from areaweave.functions.projection import epsg_label, to_wgs84
from areaweave.operators.layers import areas_by_layers
from areaweave.operators.scale import compute_once
from areaweave.settings import DEFAULT_RULES, DRAW_ORDER, TOOLTIP_FIELDS


def layer_report(layers: DataFrame, boundaries: DataFrame | None = None, rules: dict | None = None) -> DataFrame:
    """Feature count and reference system of every layer of every area.

    With ``boundaries`` the layers without a feature are in it as well: n 0, no reference system.
    """
    found = (
        layers.groupBy("lga_id", "layer", F.col("geom.srid").alias("srid"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("lga_id", "layer", F.expr(epsg_label("srid")).alias("crs"), "n")
    )
    if boundaries is None:
        return found
    every = areas_by_layers(boundaries, rules).drop("position")
    return every.join(found, ["lga_id", "layer"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def compare_lgas(layers: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row per area, one count column per layer; null where a layer is absent."""
    names = list(DEFAULT_RULES if rules is None else rules)
    return layers.groupBy("lga_id").pivot("layer", names).agg(F.count(F.lit(1)))


def layer_extent(layers: DataFrame, rules: dict | None = None) -> DataFrame:
    """Bounds of every layer; ``frames`` marks the one a map starts from.

    That is the roads layer, or without roads the first one in rule order.
    """
    names = list(DEFAULT_RULES if rules is None else rules)
    order = F.expr(f"array_position(array({', '.join(repr(n) for n in names)}), layer)")
    vs = g.vertices("geom")
    sides = {
        side: f"array_{side[:3]}(transform({vs}, v_ -> v_.{side[3]}))" for side in ("minx", "miny", "maxx", "maxy")
    }
    bounds = compute_once(layers.select("lga_id", "layer", "geom"), **sides).drop("geom")
    extent = bounds.groupBy("lga_id", "layer").agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )
    rank = F.when(F.col("layer") == "roads", 0).otherwise(order)
    # The window holds one row per layer of an area.
    place = F.row_number().over(Window.partitionBy("lga_id").orderBy(rank))
    return extent.withColumn("title", text.title(F.col("layer"))).withColumn("frames", place == 1)


def preview_feed(layers: DataFrame, check: bool = True) -> DataFrame:
    """The known layers in WGS84, with draw order and the fields to show.

    ``check`` raises if nothing is left to show.
    """
    known = layers.where(F.col("layer").isin(*DRAW_ORDER))
    if check and known.isEmpty():
        raise ValueError("there is no non-empty layer to preview")
    order = F.expr(f"array_position(array({', '.join(repr(n) for n in DRAW_ORDER)}), layer) - 1")
    shown = F.lit(None).cast("array<string>")
    for layer, fields in TOOLTIP_FIELDS.items():
        shown = F.when(F.col("layer") == layer, F.array(*map(F.lit, fields))).otherwise(shown)
    placed = compute_once(known, geom=to_wgs84("geom")).withColumn("fields", shown)
    return placed.select(
        "lga_id",
        "layer",
        order.cast("int").alias("draw_order"),
        "osmid",
        F.when(F.array_contains("fields", "name"), F.col("name")).alias("name"),
        "geom",
    )


def redact_tokens(df: DataFrame, column: str) -> DataFrame:
    """Removes access tokens from a text column and adds whether there was any."""
    return df.withColumn("had_token", text.holds_token(F.col(column))).withColumn(
        column, text.redacted(F.col(column))
    )
