"""Boundaries x tag rules x elements -> layers, for all areas in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.operators.rules import (
    LayerExtractionError,
    any_layer,
    layer_array,
    split_rules,
    tag_reader,
)
from areaweave.operators.spatial import BOX_COLUMNS, spatial_join
from areaweave.settings import DEFAULT_RULES, EMPTY_LAYER


@dataclass(frozen=True)
class Extraction:
    """Raw layer rows, and the notes about layers without any."""

    features: DataFrame
    warnings: DataFrame


def extract_features(elements: DataFrame, boundaries: DataFrame, rules: dict | None = None, **join) -> DataFrame:
    """Raw layer rows: one per area, layer and intersecting element.

    The tag filter runs first and the layers are fanned out last, so an element
    of two layers is tested against the boundaries once.  Works on a streaming
    ``elements`` too: nothing in it keeps state.
    """
    good, _ = split_rules(rules)
    tag = tag_reader(elements)
    tagged = elements.where(any_layer(tag, good)).select(
        "element_type",
        "osmid",
        F.element_at("tags", "name").alias("name"),
        "geom",
        layer_array(tag, good).alias("layers"),
        *[c for c in BOX_COLUMNS if c in elements.columns],
    )
    inside = spatial_join(tagged, boundaries.select("lga_id", "target_srid", "geom"), **join)
    return inside.select(
        "lga_id", F.explode("layers").alias("layer"), "element_type", "osmid", "name", "geom", "target_srid"
    )


def areas_by_layers(boundaries: DataFrame, rules: dict | None = None) -> DataFrame:
    """Every area with every layer, in rule order."""
    names = DEFAULT_RULES if rules is None else rules
    listed = F.array(*[F.lit(name) for name in names])
    return boundaries.select("lga_id", F.posexplode(listed).alias("position", "layer"))


def layer_counts(features: DataFrame, boundaries: DataFrame, rules: dict | None = None) -> DataFrame:
    """Feature count of every area and layer, 0 included."""
    counts = features.groupBy("lga_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    return (
        areas_by_layers(boundaries, rules)
        .join(counts, ["lga_id", "layer"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    )


def layer_notes(counts: DataFrame, rules: dict | None = None) -> DataFrame:
    """One note per area and layer that is empty or could not be extracted."""
    _, problems = split_rules(rules)
    cases = F.lit(None).cast("string")
    for layer, problem in problems.items():
        failed = F.lit(f"Layer '{layer}' failed to extract: {problem}")
        cases = F.when(F.col("layer") == layer, failed).otherwise(cases)
    empty = F.concat(F.lit("Layer '"), "layer", F.lit(f"' {EMPTY_LAYER} in this area."))
    noted = counts.withColumn("failed", cases.isNotNull()).withColumn(
        "message", F.coalesce(cases, F.when(F.col("n") == 0, empty))
    )
    return noted.where(F.col("message").isNotNull()).select("lga_id", "position", "layer", "failed", "message")


def first_failure(notes: DataFrame) -> DataFrame:
    """The first failed layer of every area, in rule order."""
    return notes.where("failed").groupBy("lga_id").agg(F.min_by("message", "position").alias("message"))


def check_strict(rules: dict | None) -> None:
    """Raise for the first layer that cannot be extracted; an empty one is fine."""
    _, problems = split_rules(rules)
    for layer, problem in problems.items():
        raise LayerExtractionError(f"Layer '{layer}' failed to extract: {problem}")


def extract_layers(
    elements: DataFrame, boundaries: DataFrame, rules: dict | None = None, strict: bool = False, **join
) -> Extraction:
    """All layers of all areas; a layer with a bad rule becomes a note, or raises if ``strict``."""
    if strict:
        check_strict(rules)
    features = extract_features(elements, boundaries, rules, **join)
    return Extraction(features, layer_notes(layer_counts(features, boundaries, rules), rules))

