"""Raw layers -> repaired, de-duplicated, projected layers of one fixed schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, NumericType, StringType

from areaweave.functions import geometry as g
from areaweave.functions.projection import to_utm
from areaweave.operators.numbering import number_rows
from areaweave.operators.scale import broadcast_checked, compute_once, through_table
from areaweave.settings import FALLBACK_SRID, POINT_LAYERS

LAYER_COLUMNS = ["lga_id", "layer", "element_type", "osmid", "name", "geom"]


@dataclass(frozen=True)
class Cleaned:
    """``layers`` in the fixed schema, and ``quarantined``: rows left out, with a reason.

    Reasons: self_crossing (edges cross and are not guessed at) and emptied (repair left
    nothing).  ``audit`` counts rows of each area and layer by what became of them, and
    ``notes`` has a message for each area whose zone is the fallback.
    """

    layers: DataFrame
    quarantined: DataFrame
    audit: DataFrame
    notes: DataFrame


def drop_unusable(layers: DataFrame) -> DataFrame:
    """Without null and empty geometries."""
    return layers.where(g.usable("geom"))


def validity(layers: DataFrame) -> DataFrame:
    """Adds structure_ok and self_crossing."""
    return compute_once(layers, structure_ok=g.structure_ok("geom"), self_crossing=g.self_crossing("geom"))


def repair(layers: DataFrame) -> DataFrame:
    """Adds repair_status (valid, repaired, emptied, quarantined) and repairs geom.

    Only invalid geometries are changed.  Crossing edges are not resolved: such
    rows keep their geometry and are marked quarantined.
    """
    checked = compute_once(layers, _ok=g.structure_ok("geom"))
    mended = compute_once(checked, geom=f"CASE WHEN _ok THEN geom ELSE {g.structural_repair('geom')} END")
    status = (
        f"CASE WHEN NOT {g.usable('geom')} THEN 'emptied' WHEN {g.self_crossing('geom')} THEN 'quarantined' "
        "WHEN _ok THEN 'valid' ELSE 'repaired' END"
    )
    return compute_once(mended, repair_status=status).drop("_ok")


#: Columns of this library whose names contain "id" without being one.
_NOT_IDS = {"lga_id", "target_srid"}


def standardise_ids(layers: DataFrame) -> DataFrame:
    """Makes sure there is an ``osmid``.

    An ``osmid`` column stays.  Else it is the first number among the columns whose name contains
    "id", of whatever type, in their order; ``osmid_text`` keeps the first text among them that is no
    number.  Without such a column rows are numbered from 0 within area and layer, in the order
    of their geometry and remaining columns.
    """
    if "osmid" in layers.columns:
        return layers
    keys = [c for c in ("lga_id", "layer") if c in layers.columns]
    others = [c for c in layers.columns if c not in keys]
    flat = (NumericType, StringType, BooleanType)
    sources = [c for c in others if "id" in c.lower() and c not in _NOT_IDS and isinstance(layers.schema[c].dataType, flat)]
    if sources:
        texts = [F.trim(F.col(c).cast("string")) for c in sources]
        numbers = [t.try_cast("bigint") for t in texts]
        odd = [F.when(n.isNull(), t) for n, t in zip(numbers, texts, strict=True)]
        return layers.withColumn("osmid", F.coalesce(*numbers)).withColumn("osmid_text", F.coalesce(*odd))
    order = ["geom"] + [c for c in others if c not in ("geom", "tags")]
    return number_rows(layers.drop("tags"), keys, order, "osmid")


def standardise_names(layers: DataFrame) -> DataFrame:
    """Makes sure there is a ``name``: from the tags where there are any, else null."""
    if "name" in layers.columns:
        return layers
    name = F.element_at("tags", "name") if "tags" in layers.columns else F.lit(None).cast("string")
    return layers.withColumn("name", name)


def dedupe_geometry(layers: DataFrame, keys: tuple[str, ...] = ("lga_id", "layer")) -> DataFrame:
    """One row per identical geometry within ``keys``: the lowest (element_type, osmid).

    An aggregate rather than a window: copies are merged before the shuffle, so a
    geometry repeated very often costs one row per task.  The hash in front makes
    the sort compare a number first; the geometry itself decides.
    """
    rest = [c for c in layers.columns if c not in (*keys, "geom", "element_type", "osmid")]
    # Maps have no order, so they follow their row without deciding about it.
    maps = {f.name for f in layers.schema if isinstance(f.dataType, MapType)}
    order = F.struct("element_type", "osmid", *[c for c in rest if c not in maps])
    first = F.min_by(F.struct("element_type", "osmid", *rest), order).alias("first")
    kept = layers.groupBy(*keys, F.xxhash64("geom").alias("_hash"), "geom").agg(
        first, F.count(F.lit(1)).alias("copies")
    )
    return kept.select(*keys, "first.*", "geom", "copies")


def project(layers: DataFrame) -> DataFrame:
    """Geometry in the zone ``target_srid``; without srid it is taken as WGS84."""
    return compute_once(layers, geom=to_utm("geom", "target_srid"))


def collapse_facilities(layers: DataFrame) -> DataFrame:
    """Outlines in the point layers become their centroid."""
    names = ", ".join(f"'{name}'" for name in POINT_LAYERS)
    return compute_once(
        layers, geom=f"CASE WHEN layer IN ({names}) THEN {g.collapse_area('geom')} ELSE geom END"
    )


def _outcomes(repaired: DataFrame, final: DataFrame) -> DataFrame:
    """(lga_id, layer, outcome, n): every row that came in is counted under one outcome."""
    keys = [c for c in ("lga_id", "layer") if c in repaired.columns]
    count = F.count(F.lit(1)).alias("n")
    status = repaired.groupBy(*keys, F.col("repair_status").alias("outcome")).agg(count)
    kept = final.groupBy(*keys).agg(count).withColumn("outcome", F.lit("kept"))
    sound = status.where("outcome IN ('valid', 'repaired')").groupBy(*keys).agg(F.sum("n").alias("_in"))
    copies = sound.join(kept.drop("outcome"), keys, "left").select(
        *keys, F.lit("duplicate").alias("outcome"), (F.col("_in") - F.coalesce("n", F.lit(0))).alias("n")
    )
    out = status.where("outcome NOT IN ('valid', 'repaired')").unionByName(kept).unionByName(copies)
    return out.where("n > 0").select(*keys, "outcome", "n")


def fallback_notes(layers: DataFrame) -> DataFrame:
    """lga_id and message for every area with rows that no zone is known for."""
    message = f"No boundary tells the zone of this area; EPSG:{FALLBACK_SRID} is used."
    return layers.where("target_srid IS NULL").select("lga_id").distinct().withColumn("message", F.lit(message))


def clean_layers(layers: DataFrame, boundaries: DataFrame | None = None) -> Cleaned:
    """Clean all layers of all areas.

    The zone comes from a ``target_srid`` column (extract_layers adds it), else
    from ``boundaries``, else it is the fallback.  The order of the steps is part
    of the contract: null and empty, repair, id, name, de-duplication, projection,
    collapse, schema.
    """
    if boundaries is not None:
        zones = broadcast_checked(boundaries.select("lga_id", "target_srid"))
        layers = layers.drop("target_srid").join(zones, "lga_id", "left")
    elif "target_srid" not in layers.columns:
        layers = layers.withColumn("target_srid", F.lit(None).cast("int"))
    notes = fallback_notes(layers)
    layers = layers.withColumn("target_srid", F.coalesce("target_srid", F.lit(FALLBACK_SRID)))
    if "element_type" not in layers.columns:
        layers = layers.withColumn("element_type", F.lit(None).cast("string"))

    # Read three times: what goes on, what is left out, and the counts.
    judged = through_table(repair(layers.where(g.usable("geom"))))
    absent = F.when(F.col("geom").isNull(), "null_geometry").otherwise("empty_geometry")
    unusable = layers.where(f"NOT {g.usable('geom')}").withColumn("repair_status", absent)
    keys = [c for c in ("lga_id", "layer") if c in layers.columns]
    sound = judged.where("repair_status IN ('valid', 'repaired')").drop("repair_status")
    ready = standardise_names(standardise_ids(sound)).select(*LAYER_COLUMNS, "target_srid")
    unique = dedupe_geometry(ready).drop("copies")
    final = collapse_facilities(project(unique)).select(*LAYER_COLUMNS)
    every = judged.select(*keys, "repair_status").unionByName(unusable.select(*keys, "repair_status"))
    left_out = judged.where("repair_status IN ('quarantined', 'emptied')").withColumn(
        "reason", F.when(F.col("repair_status") == "emptied", "emptied").otherwise("self_crossing")
    )
    return Cleaned(final, left_out.drop("repair_status", "target_srid"), _outcomes(every, unique), notes)
