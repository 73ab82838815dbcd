"""The registered queries: every operator on the derived map tables.

Results are whole numbers and text only (millimetres, 1e-7 degree), so they can be
compared bit by bit with another engine.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.functions import text
from areaweave.functions.projection import epsg_label, to_utm, to_wgs84, utm_srid
from areaweave.operators import audit, boundary, clean, layers, report
from areaweave.operators.dissolve import dissolved
from areaweave.operators.reuse import content_fingerprints, pending_areas
from areaweave.operators.rules import assign_layers, layer_array, rules_frame, tag_matches, tag_reader
from areaweave.operators.scale import compute_once, shared_folder, through_table
from areaweave.operators.spatial import spatial_join
from areaweave.plans import fixtures as fx
from areaweave.plans.pipeline import export_layers, extract_lgas
from areaweave.settings import DEFAULT_RULES
from areaweave.sinks import files, increments, snapshots
from areaweave.sources import elements as el
from areaweave.sources import ledger
from areaweave.sources.geojson import encode, read_layers, read_manual

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BAD_RULES = {**DEFAULT_RULES, "markets": {"amenity": "marketplace"}, "broken": {"amenity": 5}, "worse": {}}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def whole(value: str, scale: int) -> str:
    return f"floor({value} * {scale}D + 0.5D)"


def vertex_rows(df: DataFrame, scale: int, *keep: str) -> DataFrame:
    """One row per vertex, as whole numbers."""
    flat = df.select(
        *keep, F.col("geom.gtype").alias("gtype"), F.expr(f"posexplode({g.vertices('geom')})").alias("i", "v")
    )
    return flat.select(
        *keep, "gtype", "i", F.expr(whole("v.x", scale)).alias("x"), F.expr(whole("v.y", scale)).alias("y")
    )


def areas(spark: SparkSession, d: str) -> DataFrame:
    """The 25 places with a usable outline, keyed by k."""
    return fx.boundaries(spark, d).select("k", F.col("k").cast("string").alias("lga_id"), "geom")


def accepted(spark: SparkSession, d: str) -> DataFrame:
    """The places that pass the checks, as extract_layers expects them."""
    places = fx.boundaries(spark, d).withColumn("boundary_source", F.lit("places"))
    judged = boundary.hard_checks(places).where("reason_code IS NULL")
    found = judged.select(
        text.lga_id(F.col("lga_name"), F.col("state_name")).alias("lga_id"),
        "lga_name",
        "state_name",
        "geom",
        "target_srid",
        F.col("boundary_source"),
        text.name_notes(F.col("display_name"), F.lit("Lga x"), F.col("state_name")).alias("validation_warnings"),
    )
    return through_table(found)


def cleaned(spark: SparkSession, d: str, found: DataFrame | None = None) -> clean.Cleaned:
    found = accepted(spark, d) if found is None else found
    return clean.clean_layers(layers.extract_features(fx.features(spark, d), found))


# --- tag rules ---------------------------------------------------------------


@query
def layer_counts_by_lga(spark, d):
    found = accepted(spark, d)
    counts = layers.layer_counts(layers.extract_features(fx.features(spark, d), found), found)
    return counts.join(found.select("lga_id", "lga_name", "state_name"), "lga_id").select(
        "lga_name", "state_name", "layer", "n"
    )


@query
def fx_features(spark, d):
    tags = [F.element_at("tags", k).alias(k) for k in ("highway", "building", "waterway", "natural", "landuse")]
    box = compute_once(fx.features(spark, d), b=g.fixed_bounds("geom"))
    return box.select(
        "element_type",
        "osmid",
        *tags,
        F.element_at("tags", "amenity").alias("amenity"),
        F.col("geom.gtype").alias("gtype"),
        F.size(F.expr(g.vertices("geom"))).alias("n_vertices"),
        "b.x0",
        "b.y0",
        "b.x1",
        "b.y1",
    )


@query
def rule_membership(spark, d):
    """Elements joined with the rules as a table; same result as layer_fanout."""
    rules = rules_frame(spark)
    tags = fx.features(spark, d).select("element_type", "osmid", F.explode("tags").alias("key", "value"))
    exact = rules.where("NOT any_value").select("layer", "key", F.explode("vals").alias("value"))
    wild = rules.where("any_value").select("layer", "key")
    by_value = tags.join(F.broadcast(exact), ["key", "value"]).select("element_type", "osmid", "layer")
    by_key = tags.join(F.broadcast(wild), "key").select("element_type", "osmid", "layer")
    return by_value.union(by_key).distinct()


def _tagged(spark, d, key, wanted):
    found = fx.features(spark, d).where(tag_matches(F.element_at("tags", key), wanted))
    return found.select("element_type", "osmid")


@query
def tag_any(spark, d):
    return _tagged(spark, d, "highway", True)


@query
def tag_equals(spark, d):
    return _tagged(spark, d, "amenity", "school")


@query
def tag_in(spark, d):
    return _tagged(spark, d, "amenity", ["hospital", "clinic", "pharmacy"])


@query
def layer_fanout(spark, d):
    return assign_layers(fx.features(spark, d)).select("element_type", "osmid", "layer")


@query
def unmatched_features(spark, d):
    features = fx.features(spark, d).select("element_type", "osmid", "tags")
    empty = F.size(layer_array(tag_reader(features), DEFAULT_RULES)) == 0
    return features.where(empty).select("element_type", "osmid")


@query
def multi_layer_features(spark, d):
    features = fx.features(spark, d).select("element_type", "osmid", "tags")
    listed = features.withColumn("layers", layer_array(tag_reader(features), DEFAULT_RULES))
    return listed.where(F.size("layers") > 1).select(
        "element_type", "osmid", F.array_join("layers", ",").alias("layers")
    )


# --- zones, projection, measures ---------------------------------------------


@query
def utm_zone(spark, d):
    world = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("osmid"),
        F.expr("((o_orderkey * 7919) % 360001 - 180000) / 1000D").alias("lon"),
        F.expr("((o_orderkey * 104729) % 180001 - 90000) / 1000D").alias("lat"),
    )
    return world.select(
        "osmid", F.expr(epsg_label(utm_srid("lon", "lat"))).alias("crs"), F.expr(utm_srid("lon")).alias("north_srid")
    )


def _zoned_points(spark, d):
    at = g.first_vertex("geom")
    zoned = compute_once(fx.points(spark, d), srid=utm_srid(f"{at}.x", f"{at}.y"))
    return compute_once(zoned, geom=to_utm("geom", "srid"))


@query
def utm_forward_mm(spark, d):
    return vertex_rows(_zoned_points(spark, d), 1000, "osmid", "srid").drop("gtype", "i")


@query
def utm_inverse_1e7(spark, d):
    back = compute_once(_zoned_points(spark, d), geom=to_wgs84("geom"))
    return vertex_rows(back, 10_000_000, "osmid", "srid").drop("gtype", "i")


def _shapes(spark, d):
    drawn = fx.lines(spark, d).unionByName(fx.polygons(spark, d)).where(g.usable("geom"))
    first = g.first_vertex("geom")
    return compute_once(drawn, srid=utm_srid(f"{first}.x", f"{first}.y"))


@query
def ring_area_km2(spark, d):
    flat = compute_once(_shapes(spark, d), geom=to_utm("geom", "srid"))
    return flat.select("element_type", "osmid", "geom.gtype", F.expr(whole(g.area("geom"), 10_000)).alias("area_cm2"))


@query
def centroid_deg(spark, d):
    at = compute_once(_shapes(spark, d), at=g.centroid("geom"))
    return at.select(
        "osmid",
        "geom.gtype",
        F.expr(whole("at.x", 10_000_000)).alias("lon"),
        F.expr(whole("at.y", 10_000_000)).alias("lat"),
    )


@query
def centroid_utm(spark, d):
    """Metric centroids; crossing outlines are quarantined before this step."""
    sound = _shapes(spark, d).where(f"NOT {g.self_crossing('geom')}")
    flat = compute_once(sound, geom=to_utm("geom", "srid"))
    at = compute_once(flat, at=g.centroid("geom"))
    return at.select(
        "osmid", "geom.gtype", F.expr(whole("at.x", 1000)).alias("x"), F.expr(whole("at.y", 1000)).alias("y")
    )


@query
def geom_category(spark, d):
    return fx.features(spark, d).where("geom IS NOT NULL").select(
        "element_type", "osmid", F.expr(g.category("geom")).alias("category")
    )


@query
def dissolved_centroid(spark, d):
    """Area and centroid of outlines that overlap, each place counted once."""
    found = dissolved(fx.overlapping_outlines(spark, d), "r")
    return found.select(
        "r",
        F.expr(whole("area", 1_000_000)).alias("area_millideg2"),
        F.expr(whole("x", 1_000_000)).alias("x"),
        F.expr(whole("y", 1_000_000)).alias("y"),
    )


# --- boundary resolution -----------------------------------------------------


@query
def request_batch(spark, d):
    return boundary.normalise_requests(fx.requests(spark, d)).select("lga_id", "lga_name", "state_name")


@query
def lookup_join(spark, d):
    found = boundary.look_up(boundary.normalise_requests(fx.requests(spark, d)), fx.gazetteer(spark, d))
    return found.where("place IS NOT NULL").select(
        "lga_name", "state_name", "position", "matches", "place.display_name"
    )


@query
def lookup_ambiguous(spark, d):
    found = boundary.look_up(boundary.normalise_requests(fx.requests(spark, d)), fx.gazetteer(spark, d))
    return found.where("ambiguous").select("lga_name", "state_name", "matches")


@query
def lookup_rejects(spark, d):
    resolved = boundary.resolve_boundaries(fx.requests(spark, d), fx.gazetteer(spark, d))
    return resolved.rejected.select("lga_name", "state_name", "reason_code")


@query
def boundary_soft_notes(spark, d):
    resolved = boundary.resolve_boundaries(fx.requests(spark, d), fx.gazetteer(spark, d))
    return resolved.accepted.select(
        "lga_id",
        "lga_name",
        "state_name",
        "target_srid",
        "area_m2",
        "ambiguous",
        "boundary_source",
        "validation_warnings",
    )


@query
def boundary_hard_checks(spark, d):
    judged = boundary.hard_checks(fx.gazetteer(spark, d).withColumn("boundary_source", F.lit("places")))
    return judged.select(
        "k",
        "reason_code",
        "target_srid",
        F.expr(whole("centroid.x", 10_000_000)).alias("lon"),
        F.expr(whole("centroid.y", 10_000_000)).alias("lat"),
        F.expr(whole("area_km2", 1_000_000)).alias("area_m2"),
    )


@query
def target_crs(spark, d):
    return fx.gazetteer(spark, d).select("k", F.expr(epsg_label(boundary.target_srid("geom"))).alias("crs"))


# --- spatial join ------------------------------------------------------------


@query
def pip_join(spark, d):
    return spatial_join(fx.points(spark, d), areas(spark, d)).select("k", "osmid")


@query
def line_intersects_join(spark, d):
    return spatial_join(fx.lines(spark, d), areas(spark, d)).select("k", "osmid")


@query
def polygon_intersects_join(spark, d):
    return spatial_join(fx.polygons(spark, d), areas(spark, d)).select("k", "osmid")


def _by_place(spark, d, features, **join):
    """Features per place of the gazetteer, where both sides grow with the data."""
    places = fx.gazetteer(spark, d).select("k", F.col("k").cast("string").alias("lga_id"), "geom")
    found = spatial_join(features.select("osmid", "geom"), places, totals={"osmid_sum": "osmid"}, **join)
    return found.groupBy("k").agg(F.sum("n").alias("n"), F.sum("osmid_sum").alias("osmid_sum"))


@query
def pip_bucketed_equals_brute(spark, d):
    """Points per place of the gazetteer, where both sides grow with the data."""
    return _by_place(spark, d, fx.points(spark, d))


@query
def pip_shuffled(spark, d):
    """The same where nothing may be broadcast, so the join shuffles by cell."""
    return _by_place(spark, d, fx.points(spark, d), broadcast_bytes=0)


@query
def line_join_shuffled(spark, d):
    return spatial_join(fx.lines(spark, d), areas(spark, d), broadcast_bytes=0).select("k", "osmid")


@query
def polygon_join_shuffled(spark, d):
    return spatial_join(fx.polygons(spark, d), areas(spark, d), broadcast_bytes=0).select("k", "osmid")


@query
def line_join_places(spark, d):
    return _by_place(spark, d, fx.lines(spark, d), broadcast_bytes=0)


@query
def polygon_join_places(spark, d):
    return _by_place(spark, d, fx.polygons(spark, d), broadcast_bytes=0)


@query
def wide_join_places(spark, d):
    """Features wider than a cell, of which edges meet edges in cells; nothing is broadcast."""
    return _by_place(spark, d, fx.wide_features(spark, d), broadcast_bytes=0)


# --- cleaning ----------------------------------------------------------------


@query
def drop_null_empty(spark, d):
    return clean.drop_unusable(fx.polygons(spark, d)).select("osmid", "geom.gtype")


@query
def validity_flags(spark, d):
    shaped = fx.polygons(spark, d).where(g.usable("geom")).select("element_type", "osmid", "geom")
    both = shaped.unionByName(fx.broken_polygons(spark, d).withColumn("element_type", F.lit("broken")))
    return clean.validity(both).select("element_type", "osmid", "structure_ok", "self_crossing")


@query
def structural_repair(spark, d):
    mended = clean.repair(fx.broken_polygons(spark, d))
    corners = F.expr(f"posexplode_outer({g.vertices('geom')})").alias("i", "v")
    return mended.select("osmid", "repair_status", corners).select(
        "osmid",
        "repair_status",
        "i",
        F.expr(whole("v.x", 10_000_000)).alias("x"),
        F.expr(whole("v.y", 10_000_000)).alias("y"),
    )


@query
def id_fallback(spark, d):
    tagged = assign_layers(clean.drop_unusable(fx.polygons(spark, d)))
    numbered = clean.standardise_ids(tagged.select("layer", "geom"))
    box = compute_once(numbered, b=g.fixed_bounds("geom"))
    return box.select("layer", "osmid", "b.x0", "b.y0", "b.x1")


@query
def id_any_type(spark, d):
    """Ids from columns of other types: the first number among them, and text that is none."""
    base = fx.polygons(spark, d).selectExpr(
        "osmid AS n",
        "IF(osmid % 2 = 0, 'yes', 'no') AS bridge",
        "CASE CAST(osmid % 3 AS INT) WHEN 0 THEN CAST(osmid AS STRING) WHEN 1 THEN concat('w', osmid) ELSE concat(' ', osmid, ' ') END AS id",
    )
    return clean.standardise_ids(base).select("n", "osmid", "osmid_text")


@query
def names_from_tags(spark, d):
    tagged = fx.polygons(spark, d).withColumn(
        "tags", F.expr("IF(osmid % 3 = 0, map_concat(tags, map('name', concat('N', osmid))), tags)")
    )
    return clean.standardise_names(tagged).select("osmid", "name")


@query
def assumed_wgs84(spark, d):
    """Geometries without a reference system are longitude and latitude; others keep theirs."""
    srid = "CAST(CASE WHEN osmid % 3 = 0 THEN 32631 WHEN osmid % 3 = 1 THEN 4326 END AS INT)"
    bare = fx.polygons(spark, d).withColumn(
        "geom", F.expr(f"CASE WHEN geom IS NOT NULL THEN named_struct('gtype', geom.gtype, 'srid', {srid}, 'parts', geom.parts) END")
    )
    return bare.select("osmid", F.expr(f"({g.assume_wgs84('geom')}).srid").alias("srid"))


@query
def fallback_zone_notes(spark, d):
    """Areas of which some features have no zone, and the zone that these get."""
    outlines = fx.metric_outlines(spark, d).withColumn("lga_id", F.expr("concat('a', osmid % 5)"))
    gaps = outlines.withColumn("target_srid", F.expr("CASE WHEN osmid % 5 > 1 THEN target_srid END"))
    found = clean.clean_layers(gaps)
    zones = found.layers.groupBy("lga_id").agg(F.count_distinct("geom.srid").alias("zones"), F.min("geom.srid").alias("first"))
    return found.notes.join(zones, "lga_id").select("lga_id", "message", "zones", "first")


@query
def dedupe_geometry(spark, d):
    tagged = assign_layers(clean.drop_unusable(fx.features(spark, d))).drop("tags")
    kept = clean.dedupe_geometry(tagged, ("layer",))
    return kept.select("layer", "element_type", "osmid", "copies")


@query
def collapse_to_point(spark, d):
    tagged = assign_layers(fx.polygons(spark, d).where(f"NOT {g.self_crossing('geom')} AND {g.usable('geom')}"))
    first = g.first_vertex("geom")
    zoned = compute_once(tagged, target_srid=utm_srid(f"{first}.x", f"{first}.y"))
    return vertex_rows(clean.collapse_facilities(clean.project(zoned)), 1000, "layer", "osmid")


@query
def clean_layers_full(spark, d):
    return vertex_rows(cleaned(spark, d).layers, 1000, "lga_id", "layer", "element_type", "osmid")


@query
def quarantined_features(spark, d):
    return cleaned(spark, d).quarantined.select("lga_id", "layer", "element_type", "osmid", "reason")


@query
def cleaning_audit(spark, d):
    return clean.clean_layers(fx.mixed_outlines(spark, d)).audit


@query
def left_out_features(spark, d):
    left = clean.clean_layers(fx.mixed_outlines(spark, d)).quarantined
    return left.select("lga_id", "osmid", "reason")


@query
def clean_projected_layers(spark, d):
    done = clean.clean_layers(fx.metric_outlines(spark, d)).layers
    return vertex_rows(done.select("*", F.col("geom.srid").alias("srid")), 1000, "layer", "osmid", "srid")


# --- export and audit --------------------------------------------------------


def _counts(spark, d, found=None):
    return audit.category_counts(cleaned(spark, d, found).layers)


@query
def split_categories(spark, d):
    listed = audit.layer_categories(_counts(spark, d))
    return listed.select("lga_id", "layer", F.array_join("categories", ",").alias("categories"), "is_split", "n")


@query
def skipped_layers(spark, d):
    found = accepted(spark, d)
    return audit.skipped_layers(_counts(spark, d, found), found).select("lga_id", "layer", "position")


@query
def export_manifest(spark, d):
    found = accepted(spark, d)
    return audit.export_manifest(_counts(spark, d, found), found, "out").select(
        "lga_id", "layer", "geom_category", "name", "geojson_path", "path", "n", "status"
    )


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/areaweave-export-{uuid.uuid4().hex}"


@query
def export_round_trip(spark, d):
    """Layers written, written again without the roads, and read back: the roads are gone."""
    found, path = accepted(spark, d), _folder(spark)
    kept = through_table(cleaned(spark, d, found).layers)
    export_layers(kept, found, path)
    export_layers(kept.where("layer <> 'roads'"), found, path)
    back = read_layers(spark, f"{path}/geojson", files.read_manifest(spark, path))
    return back.groupBy("lga_id", "layer").agg(F.count(F.lit(1)).alias("n"))


@query
def snapshot_round_trip(spark, d):
    """A whole run, one that dies before its commit, and one without roads: what is read after each."""
    found, path = accepted(spark, d), _folder(spark)
    kept = through_table(cleaned(spark, d, found).layers)
    without = kept.where("layer <> 'roads'")

    def seen(step):
        back = snapshots.read_snapshot(spark, path, "layers")
        return through_table(back.groupBy("lga_id", "layer").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.lit(step)))

    snapshots.stage({"layers": kept}, path, "1")
    snapshots.commit(found, path, "1", datetime(2024, 1, 1, tzinfo=timezone.utc))
    first = seen(1)
    snapshots.stage({"layers": without.where("layer <> 'buildings'")}, path, "2")
    second = seen(2)
    snapshots.stage({"layers": without}, path, "3")
    snapshots.commit(found, path, "3", datetime(2024, 1, 2, tzinfo=timezone.utc))
    assert snapshots.vacuum(spark, path, "3") == ["1", "2"]
    return first.unionByName(second).unionByName(seen(3))


@query
def extract_lgas_written(spark, d):
    """The whole job with all its files, as they are read back: manifest rows and rejected requests."""
    path = _folder(spark)
    moment = datetime(2024, 1, 1, tzinfo=timezone.utc)
    extract_lgas(
        fx.boundary_requests(spark, d), fx.boundaries(spark, d), fx.features(spark, d), path, timestamp=moment, snapshot="1"
    )
    runs = snapshots.read_snapshot(spark, path, "runs").select("lga_id", "lga_name", "state_name")
    rows = snapshots.read_snapshot(spark, path, "layers").groupBy("lga_id", "layer", "geom_category").agg(F.count(F.lit(1)).alias("n"))
    manifest = snapshots.read_snapshot(spark, path, "manifest").where("status = 'exported'").drop("n")
    return manifest.join(rows, ["lga_id", "layer", "geom_category"]).join(runs, "lga_id").select(
        "lga_id", "lga_name", "state_name", "layer", "geom_category", "n", "status"
    )


@query
def boundary_files(spark, d):
    """Outlines of places written as files, one each, and read back in one scan; some hold no geometry."""
    path = _folder(spark)
    listed = fx.boundaries(spark, d).select(
        "k", F.expr("concat('{\"type\":\"FeatureCollection\",\"features\":[{\"type\":\"Feature\",\"properties\":{\"display_name\":\"P', k, "
        "'\"},\"geometry\":', coalesce(" + encode("geom") + ", 'null'), '}]}')").alias("value")
    )
    listed.write.partitionBy("k").text(path)
    spots = [f"{path}/k={k}" for k in (*range(25), 99)]
    found = read_manual(spark, spots)
    return found.select(
        F.regexp_extract("manual_path", r"/k=(\d+)/", 1).cast("int").alias("k"),
        "display_name",
        F.expr(f"CASE WHEN geom IS NOT NULL THEN {whole(g.area('geom'), 1_000_000)} END").alias("area_millideg2"),
        "problem",
    )


@query
def unreadable_inputs(spark, d):
    """Elements by layer folder, of which one layer's files are no Parquet and one is empty: files, rows and notes."""
    path = _folder(spark)
    kept = fx.points(spark, d).select("osmid", F.expr("CASE WHEN osmid % 8 IN (1, 2, 3, 5) THEN 'health_facilities' ELSE 'roads' END").alias("layer"))
    kept.write.partitionBy("layer").parquet(path)
    kept.selectExpr("CAST(osmid AS STRING) AS value").coalesce(1).write.text(f"{path}/layer=schools")
    kept.limit(0).select("osmid").coalesce(1).write.parquet(f"{path}/layer=landuse")
    known = through_table(ledger.read_ledger(spark, path, "osmid BIGINT"))
    by_layer = known.groupBy(F.regexp_extract("file", "/layer=([^/]+)/", 1).alias("layer")).agg(
        F.sum("n").alias("n"), F.max("problem").alias("problem")
    )
    return by_layer.join(ledger.input_notes(known).select("layer", "message"), "layer", "left")


@query
def runs_round_trip(spark, d):
    """Records written twice: one an area, the later one."""
    found, path = accepted(spark, d), _folder(spark)
    manifest = audit.export_manifest(_counts(spark, d, found), found, "out")
    none = found.select("lga_id", F.array().cast("array<string>").alias("warnings"))
    for year in (2023, 2024):
        moment = datetime(year, 1, 1, tzinfo=timezone.utc)
        files.write_runs(audit.run_records(found, manifest, none, timestamp=moment), path)
    runs = files.read_runs(spark, path)
    return runs.groupBy("lga_id", "timestamp_utc").agg(F.count(F.lit(1)).alias("n"))


def _notes(spark, d):
    found = accepted(spark, d)
    raw = layers.extract_features(fx.features(spark, d), found, BAD_RULES)
    return found, layers.layer_notes(layers.layer_counts(raw, found, BAD_RULES), BAD_RULES)


@query
def warning_fold(spark, d):
    folded = audit.fold_warnings(*_notes(spark, d))
    return folded.select("lga_id", F.array_join("warnings", " | ").alias("warnings"))


@query
def first_failure(spark, d):
    return layers.first_failure(_notes(spark, d)[1])


@query
def run_records(spark, d):
    found = accepted(spark, d)
    raw = through_table(layers.extract_features(fx.features(spark, d), found))
    notes = layers.layer_notes(layers.layer_counts(raw, found))
    counts = audit.category_counts(clean.clean_layers(raw).layers)
    manifest = audit.export_manifest(counts, found, "out")
    moment = datetime(2024, 1, 1, tzinfo=timezone.utc)
    runs = audit.run_records(found, manifest, audit.fold_warnings(found, notes), timestamp=moment)
    return runs.select(
        "lga_name",
        "state_name",
        "output_label",
        "timestamp_utc",
        "target_crs",
        F.size("warnings").alias("n_warnings"),
        F.array_join(F.map_keys("exported_layers"), ",").alias("exported"),
        F.array_join("skipped_layers", ",").alias("skipped"),
        F.array_join(
            F.expr("transform(map_entries(split_layers), e_ -> concat(e_.key, '=', array_join(e_.value, '+')))"), ","
        ).alias("split"),
    )


@query
def extract_lgas_full(spark, d):
    """The whole job from requests to manifest, without writing the outputs."""
    run = extract_lgas(
        fx.boundary_requests(spark, d), fx.boundaries(spark, d), fx.features(spark, d), "out", write=False
    )
    named = run.manifest.join(run.boundaries.select("lga_id", "lga_name", "state_name"), "lga_id")
    return named.select("lga_id", "lga_name", "state_name", "layer", "geom_category", "n", "status")


# --- reports -----------------------------------------------------------------


@query
def layer_report(spark, d):
    return report.layer_report(cleaned(spark, d).layers)


@query
def layer_report_full(spark, d):
    """The report with the layers that have no feature."""
    found = accepted(spark, d)
    return report.layer_report(cleaned(spark, d, found).layers, found)


@query
def compare_lgas_pivot(spark, d):
    return report.compare_lgas(cleaned(spark, d).layers)


@query
def layer_extent(spark, d):
    sides = [F.expr(whole(s, 1000)).alias(s) for s in ("minx", "miny", "maxx", "maxy")]
    return report.layer_extent(cleaned(spark, d).layers).select("lga_id", "layer", "title", "frames", *sides)


@query
def preview_feed(spark, d):
    feed = report.preview_feed(cleaned(spark, d).layers, check=False)
    return vertex_rows(feed, 10_000_000, "lga_id", "layer", "draw_order", "osmid")


@query
def run_reuse(spark, d):
    """Areas still to do when those of one market segment are finished."""
    done = fx.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.expr("concat('Lga ', CAST(c_custkey AS BIGINT) div 3)").alias("lga_name"),
        F.expr("concat('State ', c_custkey % 7)").alias("state_name"),
    )
    runs = done.select(
        text.lga_id(F.col("lga_name"), F.col("state_name")).alias("lga_id"),
        F.lit(audit.rules_hash()).alias("rules_hash"),
    )
    return audit.pending_requests(fx.requests(spark, d), runs).select("lga_name", "state_name")


@query
def run_reuse_by_content(spark, d):
    """Places to run again a day later; one in four has a record under other rules, one in five has none."""
    found = accepted(spark, d)
    runs = content_fingerprints(layers.extract_features(fx.points(spark, d), found), found).join(found, "lga_id").select(
        "lga_id",
        "content_hash",
        F.expr(f"CASE WHEN CAST(substr(lga_name, 5) AS INT) % 4 = 3 THEN 'other' ELSE '{audit.rules_hash()}' END").alias("rules_hash"),
    )
    known = runs.join(found.where("CAST(substr(lga_name, 5) AS INT) % 5 = 2"), "lga_id", "left_anti")
    later = content_fingerprints(layers.extract_features(fx.changed_points(spark, d), found), found)
    return pending_areas(later, known).join(found, "lga_id").select("lga_id", "lga_name", "state_name")


@query
def streamed_layers(spark, d):
    """Elements in three batches: a third elsewhere at first, a third delivered again, a batch tried again; published after each."""
    path, found = _folder(spark), accepted(spark, d)
    turn = F.expr("CAST(osmid % 3 AS INT)")
    elements = through_table(fx.features(spark, d))
    north = F.transform("geom.parts", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: v.withField("y", v["y"] + 0.3))))
    early = elements.where(turn == 1).withColumn("geom", F.col("geom").withField("parts", north))
    feeds = (elements.where(turn == 0).unionByName(early), elements.where(turn == 2), elements.where(turn > 0))
    for i, feed in enumerate(feeds):
        feed.write.mode("append").parquet(f"{path}/feed")
        arriving = spark.readStream.schema(elements.schema).parquet(f"{path}/feed")
        increments.stream_layers(arriving, found, path, f"{path}/progress").awaitTermination()
        assert not increments.record_batch(feed, found, path, i)
        assert increments.publish(spark, path, found) and increments.publish(spark, path, found) is None
    return vertex_rows(snapshots.read_snapshot(spark, path, "layers"), 1000, "lga_id", "layer", "element_type", "osmid")


@query
def redact_tokens(spark, d):
    done = report.redact_tokens(fx.texts(spark, d), "text")
    return done.select("doc_id", "had_token", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query
def redact_pages(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", "html")
    done = report.redact_tokens(pages, "html")
    return done.select("page_id", "had_token", F.md5("html").alias("html_md5"))


@query
def slug_and_title(spark, d):
    asked = fx.requests(spark, d).where(text.blank_to_null(F.col("lga_name")).isNotNull())
    return asked.groupBy("lga_name").agg(F.count(F.lit(1)).alias("n")).select(
        "lga_name",
        text.slug(F.col("lga_name")).alias("slug"),
        text.output_label(F.col("lga_name")).alias("output_label"),
        text.title(text.slug(F.col("lga_name"))).alias("title"),
        "n",
    )


# --- element assembly --------------------------------------------------------


@query
def way_assembly(spark, d):
    paths = el.way_paths(fx.way_nodes(spark, d), fx.nodes(spark, d))
    return paths.select("way_id", "missing", F.posexplode("path").alias("i", "v")).select(
        "way_id",
        "missing",
        "i",
        F.expr(whole("v.x", 10_000_000)).alias("x"),
        F.expr(whole("v.y", 10_000_000)).alias("y"),
    )


@query
def way_closed_to_polygon(spark, d):
    built, _ = el.assemble_ways(fx.ways(spark, d), fx.way_nodes(spark, d), fx.nodes(spark, d))
    return built.select("osmid", "geom.gtype", F.size(F.expr(g.vertices("geom"))).alias("n_vertices"))


@query
def relation_assembly(spark, d):
    built, rejects = el.assemble_relations(
        fx.relations(spark, d), fx.relation_members(spark, d), fx.relation_paths(spark, d)
    )
    good = built.select(
        F.col("osmid").alias("relation_id"),
        F.lit(None).cast("string").alias("reason"),
        F.size("geom.parts").alias("n_parts"),
        F.size(F.expr(g.rings("geom"))).alias("n_rings"),
        F.expr(whole(g.area("geom"), 1_000_000)).alias("area_millideg2"),
    )
    return good.unionByName(rejects.drop("way_id"), allowMissingColumns=True)


@query
def ring_stitching(spark, d):
    """Rings put together from open ways, vertex by vertex, and the relations that cannot be."""
    paths = el.way_paths(fx.open_ring_way_nodes(spark, d), fx.open_ring_nodes(spark, d))
    built, rejects = el.assemble_relations(fx.relations(spark, d), fx.open_ring_members(spark, d), paths)
    parts = built.select(F.col("osmid").alias("relation_id"), F.posexplode("geom.parts").alias("part", "rings"))
    spot = lambda v: F.concat_ws(" ", *[F.round(v[c] * 1000).cast("bigint").cast("string") for c in "xy"])
    drawn = parts.select("relation_id", "part", F.array_join(F.transform(F.get("rings", F.lit(0)), spot), ",").alias("ring"))
    return drawn.unionByName(rejects.drop("way_id"), allowMissingColumns=True)


@query
def node_points(spark, d):
    """Tagged nodes as points; every third has no tag."""
    spots = fx.nodes(spark, d).withColumn("tags", F.expr("IF(node_id % 3 = 0, map(), map('amenity', 'bench'))"))
    built = el.assemble_points(spots)
    return built.select("element_type", "osmid", *[F.expr(whole(f"({g.first_vertex('geom')}).{c}", 1000)).alias(c) for c in "xy"])


@query
def way_rejects(spark, d):
    ways, nodes = fx.ways(spark, d), fx.nodes(spark, d)
    return el.assemble_ways(ways, fx.ragged_way_nodes(spark, d), nodes)[1]


def _nested(spark, d):
    return el.assemble_relations(fx.relations(spark, d), fx.nested_members(spark, d), fx.nested_paths(spark, d))


@query
def relation_rejects(spark, d):
    return _nested(spark, d)[1]


@query
def relation_nesting(spark, d):
    """Each hole belongs to the smallest shell around it."""
    built = _nested(spark, d)[0].select("osmid", F.posexplode("geom.parts").alias("part", "rings"))
    west = F.transform("rings", lambda r: F.array_min(F.transform(r, lambda v: v["x"])))
    width = F.transform("rings", lambda r: F.array_max(F.transform(r, lambda v: v["x"])) - F.array_min(F.transform(r, lambda v: v["x"])))
    return built.select(
        F.col("osmid").alias("relation_id"),
        "part",
        F.array_join(F.transform(width, lambda w: F.round(w * 1000).cast("int").cast("string")), ",").alias("widths"),
        F.round(F.get(west, F.lit(0)) * 1000).cast("bigint").alias("west"),
    )
