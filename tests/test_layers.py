import pytest
from pyspark.sql import functions as F

from areaweave.operators import audit, layers, report
from areaweave.operators.clean import clean_layers, dedupe_geometry, standardise_ids
from areaweave.operators.numbering import number_rows
from areaweave.operators.rules import LayerExtractionError, assign_layers, rules_frame, split_rules
from areaweave.settings import DEFAULT_RULES
from tests.conftest import box, frame, line, point, polygon

ELEMENTS = "element_type STRING, osmid BIGINT, tags MAP<STRING, STRING>"
LAYERS = "lga_id STRING, layer STRING, element_type STRING, osmid BIGINT, name STRING"


@pytest.fixture(scope="module")
def areas(spark):
    rows = [
        ("west", "West", None, 32631, "places", None, polygon(box(5.15, 7.2, 5.25, 7.3))),
        ("mid", "Mid", "S", 32632, "places", "note", polygon(box(7.4, 9.0, 7.6, 9.1))),
    ]
    return frame(
        spark,
        rows,
        "lga_id STRING, lga_name STRING, state_name STRING, target_srid INT, boundary_source STRING, validation_warnings STRING",
    )


@pytest.fixture(scope="module")
def elements(spark):
    rows = [
        ("node", 1, {"amenity": "hospital", "name": "H"}, point(5.2, 7.25)),
        ("way", 2, {"amenity": "hospital", "building": "yes"}, polygon(box(5.2, 7.25, 5.201, 7.251))),
        ("way", 3, {"highway": "residential"}, line((5.2, 7.25), (5.21, 7.26))),
        ("node", 4, {"highway": "traffic_signals"}, point(5.205, 7.255)),
        ("node", 5, {"natural": "water"}, point(5.205, 7.256)),
        ("node", 6, {"natural": "tree"}, point(5.205, 7.257)),
        ("way", 7, {"highway": "primary"}, line((7.3, 9.05), (7.5, 9.05))),
        ("node", 8, {"highway": "stop"}, point(1.0, 1.0)),
    ]
    return frame(spark, rows, ELEMENTS)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tag_rules(spark, elements):
    got = pairs(assign_layers(elements), "osmid", "layer")
    assert got == [
        (1, "health_facilities"),
        (2, "buildings"),
        (2, "health_facilities"),
        (3, "roads"),
        (4, "roads"),
        (5, "waterways"),
        (7, "roads"),
        (8, "roads"),
    ]
    assert rules_frame(spark).count() == 7
    extended = {**DEFAULT_RULES, "trees": {"natural": "tree"}}
    assert (6, "trees") in pairs(assign_layers(elements, extended), "osmid", "layer")


def test_bad_rules_are_found():
    rules = {"a": {"k": 1}, "b": {}, "c": {"k": ["x", 2]}, "d": {"k": True}, "e": "x", "f": {"k": []}, "g": {"k": False}}
    good, bad = split_rules(rules)
    assert set(good) == {"d"} and set(bad) == {"a", "b", "c", "e", "f", "g"}


def test_extraction_and_notes(elements, areas):
    result = layers.extract_layers(elements, areas, {**DEFAULT_RULES, "odd": {"amenity": 5}})
    assert pairs(result.features, "lga_id", "layer", "osmid") == [
        ("mid", "roads", 7),
        ("west", "buildings", 2),
        ("west", "health_facilities", 1),
        ("west", "health_facilities", 2),
        ("west", "roads", 3),
        ("west", "roads", 4),
        ("west", "waterways", 5),
    ]
    notes = {(r["lga_id"], r["layer"]): (r["failed"], r["message"]) for r in result.warnings.collect()}
    assert notes["west", "schools"] == (False, "Layer 'schools' returned no features in this area.")
    assert notes["mid", "odd"][0] and "failed to extract" in notes["mid", "odd"][1]
    assert ("west", "roads") not in notes
    failures = layers.first_failure(result.warnings).collect()
    assert len(failures) == 2 and all("'odd'" in r["message"] for r in failures)
    folded = {r["lga_id"]: r["warnings"] for r in audit.fold_warnings(areas, result.warnings).collect()}
    assert folded["mid"][0] == "Boundary validation: note" and folded["mid"][-1].startswith("Layer 'odd'")
    assert folded["west"][0].startswith("Layer 'landuse'")


def test_strict_raises_on_failure_but_not_on_emptiness(elements, areas):
    with pytest.raises(LayerExtractionError, match="health"):
        layers.extract_layers(elements, areas, {"health": {"amenity": 5}, "roads": {"highway": True}}, strict=True)
    result = layers.extract_layers(elements, areas, strict=True)
    assert "schools" in {r["layer"] for r in result.warnings.collect()}


def raw(spark):
    rows = [
        ("west", "health_facilities", "node", 1, "H", point(5.2, 7.25)),
        ("west", "health_facilities", "node", 2, None, point(5.21, 7.26)),
        ("west", "roads", "way", 3, None, line((5.2, 7.25), (5.21, 7.26))),
    ]
    return frame(spark, rows, LAYERS)


def test_clean_defaults_to_the_fallback_zone(spark):
    got = clean_layers(raw(spark)).layers
    assert got.columns == ["lga_id", "layer", "element_type", "osmid", "name", "geom"]
    rows = got.collect()
    assert len(rows) == 3 and {r["geom"]["srid"] for r in rows} == {32631}


def test_zone_follows_the_boundary_not_the_data(spark, areas):
    moved = raw(spark).withColumn("lga_id", F.lit("mid"))
    assert {r["geom"]["srid"] for r in clean_layers(moved, areas).layers.collect()} == {32632}


def test_clean_repairs_dedupes_and_collapses(spark):
    square = box(5.2, 7.25, 5.21, 7.26)
    rows = [
        ("a", "schools", "way", 9, None, polygon(square)),
        ("a", "schools", "way", 4, "kept", polygon(square)),
        ("a", "schools", "relation", 1, None, polygon(square)),
        ("a", "buildings", "way", 9, None, polygon(square)),
        ("b", "schools", "way", 9, None, polygon(square)),
        ("a", "roads", "node", 1, None, None),
        ("a", "roads", "node", 2, None, ("Point", 4326, [])),
        ("a", "roads", "way", 3, None, line((5.2, 7.2), (5.2, 7.2))),
        ("a", "landuse", "way", 5, None, polygon([[[(5.2, 7.25), (5.21, 7.25), (5.2, 7.26), (5.21, 7.26), (5.2, 7.25)]]])),
    ]
    result = clean_layers(frame(spark, rows, LAYERS))
    got = {(r["lga_id"], r["layer"], r["element_type"], r["osmid"]): r for r in result.layers.collect()}
    assert set(got) == {("a", "schools", "relation", 1), ("a", "buildings", "way", 9), ("b", "schools", "way", 9)}
    assert got["a", "schools", "relation", 1]["geom"]["gtype"] == "Point"
    assert got["a", "buildings", "way", 9]["geom"]["gtype"] == "Polygon"
    assert pairs(result.quarantined, "layer", "osmid", "reason") == [
        ("landuse", 5, "self_crossing"),
        ("roads", 3, "emptied"),
    ]
    assert pairs(result.audit, "lga_id", "layer", "outcome", "n") == [
        ("a", "buildings", "kept", 1),
        ("a", "landuse", "quarantined", 1),
        ("a", "roads", "emptied", 1),
        ("a", "roads", "empty_geometry", 1),
        ("a", "roads", "null_geometry", 1),
        ("a", "schools", "duplicate", 2),
        ("a", "schools", "kept", 1),
        ("b", "schools", "kept", 1),
    ]


def test_dedupe_compares_the_whole_geometry(spark):
    rows = [
        ("a", "roads", "way", i, None, line((5.2, 7.2), (5.3, 7.3 + (i % 3) / 1e12))) for i in range(30)
    ]
    kept = dedupe_geometry(frame(spark, rows, LAYERS))
    assert pairs(kept, "osmid", "copies") == [(0, 10), (1, 10), (2, 10)]


def test_missing_ids(spark):
    rows = [("x", "a", point(float(i % 4), 0.0)) for i in range(9)]
    df = frame(spark, rows, "lga_id STRING, layer STRING")
    numbered = standardise_ids(df)
    assert sorted(r["osmid"] for r in numbered.collect()) == list(range(9))
    assert [r["geom"]["parts"][0][0][0]["x"] for r in numbered.orderBy("osmid").collect()] == sorted(i % 4 for i in range(9))
    assert {r["osmid"] for r in standardise_ids(df.withColumn("id", F.lit(7))).collect()} == {7}
    quirk = df.withColumn("bridge", F.lit(3)).withColumn("id", F.lit(7))
    assert {r["osmid"] for r in standardise_ids(quirk).collect()} == {3}


def test_projected_outlines_are_cleaned(spark):
    """Sizes whose products in 1e-7 of a unit would overflow, and an extent beyond the millimetre grid."""
    rows = [
        ("a", "landuse", "way", i, None, polygon(box(500_000.0, 800_000.0, 500_000.0 + side, 800_000.0 + side), 32631))
        for i, side in enumerate((20.0, 1_000.0, 90_000.0, 9_000_000.0))
    ]
    done = clean_layers(frame(spark, rows, LAYERS))
    assert {r["osmid"] for r in done.layers.collect()} == {0, 1, 2, 3} and done.quarantined.count() == 0
    again = clean_layers(done.layers)
    assert {r["osmid"] for r in again.layers.collect()} == {0, 1, 2, 3}


def test_dedupe_takes_maps_along(spark):
    rows = [("a", "roads", "way", i, None, line((5.2, 7.2), (5.3, 7.3))) for i in (4, 2, 9)]
    tagged = frame(spark, rows, LAYERS).withColumn("tags", F.create_map(F.lit("id"), F.col("osmid").cast("string")))
    kept = dedupe_geometry(tagged).collect()
    assert [(r["osmid"], r["tags"], r["copies"]) for r in kept] == [(2, {"id": "2"}, 3)]


@pytest.mark.parametrize("limit", [100_000, 40])
def test_numbering_of_crowded_groups(spark, monkeypatch, limit):
    monkeypatch.setattr("areaweave.operators.numbering._COPIES_PER_TASK", limit)
    df = spark.range(0, 1000).selectExpr("CAST(id % 3 AS INT) AS g", "CASE WHEN id % 2 = 0 THEN 5 ELSE id END AS v")
    rows = number_rows(df.repartition(5), ["g"], ["v"], "n").collect()
    assert len(rows) == 1000
    for group in range(3):
        mine = sorted((r["n"], r["v"]) for r in rows if r["g"] == group)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for _, v in mine)


def test_reports(spark, elements, areas):
    cleaned = clean_layers(layers.extract_features(elements, areas)).layers
    assert ("west", "roads", "EPSG:32631", 2) in pairs(report.layer_report(cleaned), "lga_id", "layer", "crs", "n")
    pivot = {r["lga_id"]: r for r in report.compare_lgas(cleaned).collect()}
    assert pivot["west"]["health_facilities"] == 2 and pivot["mid"]["buildings"] is None
    frames = {(r["lga_id"], r["layer"]): r for r in report.layer_extent(cleaned).collect()}
    assert frames["west", "roads"]["frames"] and not frames["west", "buildings"]["frames"]
    assert frames["west", "health_facilities"]["title"] == "Health Facilities"
    no_roads = report.layer_extent(cleaned.where("layer <> 'roads'")).where("frames").collect()
    assert [r["layer"] for r in no_roads] == ["buildings"]
    feed = report.preview_feed(cleaned)
    spot = feed.where("osmid = 4").head()
    assert spot["draw_order"] == 2 and spot["name"] is None and spot["geom"]["srid"] == 4326
    x, y = spot["geom"]["parts"][0][0][0]
    assert (x, y) == pytest.approx((5.205, 7.255), abs=1e-9)
    assert feed.where("osmid = 1").head()["name"] == "H"
    with pytest.raises(ValueError, match="preview"):
        report.preview_feed(cleaned.where("layer = 'markets'"))


def test_redaction(spark):
    token = "pk.eyJ" + "abc-_9" + "." + "def"
    df = spark.createDataFrame([(1, f"a {token} b {token}"), (2, "<html><body>no token here</body></html>"), (3, None)], "i INT, t STRING")
    got = {r["i"]: (r["had_token"], r["t"]) for r in report.redact_tokens(df, "t").collect()}
    assert got == {1: (True, "a  b "), 2: (False, "<html><body>no token here</body></html>"), 3: (False, None)}
