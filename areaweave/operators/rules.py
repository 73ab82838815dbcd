"""Tag rules: which layers an element belongs to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.settings import DEFAULT_RULES

RULE_SCHEMA = "position INT, layer STRING, key STRING, any_value BOOLEAN, vals ARRAY<STRING>"


class LayerExtractionError(Exception):
    """A layer could not be extracted at all (finding nothing is not an error)."""


def rule_problem(selectors: object) -> str | None:
    """Why a layer's selectors cannot be used, or None."""
    if not isinstance(selectors, dict) or not selectors:
        return "selectors must be a non-empty mapping of tag key to value"
    for key, wanted in selectors.items():
        texts = wanted if isinstance(wanted, (list, tuple)) else [wanted]
        if wanted is not True and not (texts and all(isinstance(t, str) for t in texts)):
            return f"tag '{key}' must be True, a text or a list of texts"
    return None


def split_rules(rules: dict | None) -> tuple[dict, dict[str, str]]:
    """Usable rules, and the reason for every layer that has none."""
    rules = DEFAULT_RULES if rules is None else rules
    problems = {layer: p for layer, s in rules.items() if (p := rule_problem(s))}
    return {layer: s for layer, s in rules.items() if layer not in problems}, problems


def rules_frame(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """The rules as a table, one row per layer and tag key."""
    good, _ = split_rules(rules)
    rows = [
        (position, layer, key, wanted is True, _texts(wanted))
        for position, (layer, selectors) in enumerate(good.items())
        for key, wanted in selectors.items()
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _texts(wanted: object) -> list[str]:
    return [] if wanted is True else [wanted] if isinstance(wanted, str) else list(wanted)


def tag_reader(df: DataFrame) -> Callable[[str], Column]:
    """Reads a tag from its own column where the table has one, else from the map.

    Filters on a column of its own reach the Parquet scan; map lookups do not.
    """
    own = set(df.columns)
    return lambda key: F.col(f"tag_{key}") if f"tag_{key}" in own else F.element_at("tags", key)


def tag_matches(value: Column, wanted: object) -> Column:
    if wanted is True:
        return value.isNotNull()
    texts = _texts(wanted)
    return value == texts[0] if len(texts) == 1 else value.isin(*texts)


def layer_predicate(tag: Callable[[str], Column], selectors: dict) -> Column:
    """Keys within a layer are alternatives."""
    found = None
    for key, wanted in selectors.items():
        match = tag_matches(tag(key), wanted)
        found = match if found is None else found | match
    return found


def any_layer(tag: Callable[[str], Column], rules: dict) -> Column:
    found = F.lit(False)
    for selectors in rules.values():
        found = found | layer_predicate(tag, selectors)
    return found


def layer_array(tag: Callable[[str], Column], rules: dict) -> Column:
    """Every layer the element belongs to, in rule order."""
    hits = [F.when(layer_predicate(tag, s), F.lit(layer)) for layer, s in rules.items()]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def assign_layers(elements: DataFrame, rules: dict | None = None) -> DataFrame:
    """One row per element and layer; elements of no layer disappear.

    The rules are part of the expression, so this is a filter and a projection:
    nothing is joined and nothing is shuffled.
    """
    good, _ = split_rules(rules)
    tag = tag_reader(elements)
    return elements.where(any_layer(tag, good)).withColumn("layer", F.explode(layer_array(tag, good)))
