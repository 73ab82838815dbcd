import json

import pytest
from pyspark.sql import functions as F

from areaweave.operators import boundary
from areaweave.operators.boundary import BoundaryResolutionError, resolve_boundaries
from areaweave.sources.geojson import read_boundary_files
from tests.conftest import box, frame, one, polygon

PLACES = "lga_name STRING, state_name STRING, display_name STRING, position BIGINT"


@pytest.fixture(scope="module")
def gazetteer(spark):
    good = polygon(box(5.15, 7.2, 5.25, 7.3))
    rows = [
        ("North", "West", "North, West, Nigeria", 1, good),
        ("North", "East", "North, East, Nigeria", 2, polygon(box(7.4, 9.0, 7.6, 9.1))),
        ("Paris", "West", "Paris, France", 3, polygon(box(2.0, 48.0, 2.2, 48.2))),
        ("Dot", "West", "Dot, West, Nigeria", 4, polygon(box(5.2, 7.25, 5.2001, 7.2501))),
        ("Huge", "West", "Huge, West, Nigeria", 5, polygon(box(3.0, 5.0, 14.0, 13.0))),
        ("Shore North", "Hills", "Some Other Place, Some Other State, Nigeria", 6, good),
        ("Silent", "West", None, 7, good),
        ("Nothing", "West", "Nothing, West, Nigeria", 8, None),
        ("Hollow", "West", "Hollow, West, Nigeria", 9, ("Polygon", 4326, [])),
    ]
    return frame(spark, rows, PLACES)


def resolve(spark, gazetteer, rows, **options):
    columns = "lga_name STRING, state_name STRING" + (", manual_path STRING" if len(rows[0]) == 3 else "")
    return resolve_boundaries(spark.createDataFrame(rows, columns), gazetteer, **options)


def test_plausible_boundary_is_accepted_without_notes(spark, gazetteer):
    got = resolve(spark, gazetteer, [(" North ", "West")]).accepted.collect()
    assert len(got) == 1
    row = got[0]
    assert (row["lga_name"], row["state_name"], row["target_srid"]) == ("North", "West", 32631)
    assert row["validation_warnings"] is None and row["ambiguous"] is False
    assert row["boundary_source"] == "osm_geocode:North, West, Nigeria"
    assert row["area_m2"] == pytest.approx(122.213e6, rel=1e-4)


def test_rejects_carry_code_and_phrase(spark, gazetteer):
    asked = [(n, "West") for n in ("Paris", "Dot", "Huge", "Nothing", "Hollow", "Nowhere")] + [("  ", "West")]
    result = resolve(spark, gazetteer, asked)
    got = {r["lga_name"]: (r["reason_code"], r["message"]) for r in result.rejected.collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "Paris": "outside",
        "Dot": "small",
        "Huge": "large",
        "Nothing": "empty",
        "Hollow": "empty",
        "Nowhere": "no_match",
        None: "blank_name",
    }
    assert "outside Nigeria" in got["Paris"][1]
    assert "implausibly small" in got["Dot"][1]
    assert "implausibly large" in got["Huge"][1]
    assert "manual boundary" in got["Nowhere"][1]
    assert result.accepted.count() == 0


def test_missing_state_is_ambiguous_and_takes_the_first(spark, gazetteer):
    got = resolve(spark, gazetteer, [("north", None), ("NORTH", ""), ("North", "East")]).accepted.collect()
    assert {(r["state_name"], r["ambiguous"], r["target_srid"]) for r in got} == {(None, True, 32631), ("East", False, 32632)}


def test_display_name_only_warns(spark, gazetteer):
    note = resolve(spark, gazetteer, [("Shore North", "Hills")]).accepted.head()["validation_warnings"]
    assert "Shore North" in note and "Hills" in note and "; " in note
    assert resolve(spark, gazetteer, [("Silent", "West")]).accepted.head()["validation_warnings"] is None


def test_strict_raises_for_a_bad_area(spark, gazetteer):
    with pytest.raises(BoundaryResolutionError, match="outside Nigeria"):
        resolve(spark, gazetteer, [("Paris", "West")], strict=True)
    assert resolve(spark, gazetteer, [("North", "West")], strict=True).accepted.count() == 1


@pytest.mark.parametrize(
    "area, lon, want",
    [(2.0, 5.0, None), (1.999999, 5.0, "small"), (10000.0, 5.0, None), (10000.000001, 5.0, "large")],
)
def test_area_range_ends_pass(spark, monkeypatch, area, lon, want):
    places = frame(spark, [("s", polygon(box(lon, 7.2, lon + 0.1, 7.3)))], "boundary_source STRING")
    monkeypatch.setattr(boundary.g, "area", lambda geom: f"{area}D * 1000000D")
    assert boundary.hard_checks(places).head()["reason_code"] == want


@pytest.mark.parametrize("lon, lat, want", [(2.5, 4.0, False), (15.0, 14.0, False), (2.499, 9.0, True), (9.0, 14.001, True)])
def test_country_box_is_inclusive(spark, lon, lat, want):
    # A box whose centroid is exactly (lon, lat).
    places = frame(spark, [("s", polygon(box(lon - 0.125, lat - 0.125, lon + 0.125, lat + 0.125)))], "boundary_source STRING")
    assert (boundary.hard_checks(places).head()["reason_code"] == "outside") is want


def test_target_zone_and_fallback(spark):
    rows = [
        (0, polygon(box(7.4, 9.0, 7.6, 9.1))),
        (1, polygon(box(5.15, 7.2, 5.25, 7.3))),
        (2, None),
        (3, ("Polygon", 4326, [])),
        (4, polygon(box(13.0, 11.0, 13.2, 11.2))),
    ]
    got = frame(spark, rows, "i INT").orderBy("i").select(F.expr(boundary.target_srid("geom")).alias("z")).collect()
    assert [r["z"] for r in got] == [32632, 32631, 32631, 32631, 32633]


def write(path, document):
    path.write_text(json.dumps(document))
    return str(path)


def geojson_box(*corners):
    return {"type": "Polygon", "coordinates": [[list(p) for p in box(*corners)[0][0]]]}


def test_manual_files(spark, gazetteer, tmp_path):
    feature = {"type": "Feature", "properties": {"display_name": "x", "n": 1}, "geometry": geojson_box(5.15, 7.2, 5.25, 7.3)}
    second = {"type": "Feature", "properties": {}, "geometry": geojson_box(2.0, 48.0, 2.2, 48.2)}
    null = {"type": "Feature", "properties": {}, "geometry": None}
    utm = {"type": "Polygon", "coordinates": [[[737000, 796000], [748000, 796000], [748000, 807000], [737000, 807000], [737000, 796000]]]}
    files = {
        "two": write(tmp_path / "two.geojson", {"type": "FeatureCollection", "features": [feature, second]}),
        "single": write(tmp_path / "single.geojson", feature),
        "bare": write(tmp_path / "bare.geojson", geojson_box(5.15, 7.2, 5.25, 7.3)),
        "projected": write(
            tmp_path / "projected.geojson",
            {
                "type": "FeatureCollection",
                "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::32631"}},
                "features": [{"type": "Feature", "properties": {}, "geometry": utm}],
            },
        ),
        "nulls": write(tmp_path / "nulls.geojson", {"type": "FeatureCollection", "features": [null, null]}),
        "none": write(tmp_path / "none.geojson", {"type": "FeatureCollection", "features": []}),
        "first null": write(tmp_path / "first_null.geojson", {"type": "FeatureCollection", "features": [null, feature]}),
        "paris": write(tmp_path / "paris.geojson", second),
    }
    manual = read_boundary_files(spark, list(files.values()))
    asked = [(f"{name} area", "Ondo", path) for name, path in files.items()] + [("North", "West", None), ("lost", "West", "/no/such/file")]
    result = resolve(spark, gazetteer, asked, manual=manual)
    accepted = {r["lga_name"]: r for r in result.accepted.collect()}
    assert set(accepted) == {"two area", "single area", "bare area", "projected area", "North"}
    assert accepted["two area"]["boundary_source"] == f"manual:{files['two']}"
    assert accepted["North"]["boundary_source"].startswith("osm_geocode:")
    for name in ("two area", "single area", "bare area"):
        assert accepted[name]["area_m2"] == pytest.approx(122.213e6, rel=1e-4)
    assert accepted["projected area"]["area_m2"] == pytest.approx(121e6, rel=1e-6)
    rejected = {r["lga_name"]: r["reason_code"] for r in result.rejected.collect()}
    assert rejected == {
        "nulls area": "no_geometry",
        "none area": "no_geometry",
        "first null area": "empty",
        "paris area": "outside",
        "lost": "no_file",
    }
    both = [("North", "West", None), ("north ", "West", files["projected"])]
    chosen = resolve(spark, gazetteer, both, manual=manual).accepted.collect()
    assert [r["boundary_source"] for r in chosen] == [f"manual:{files['projected']}"]
    only = read_boundary_files(spark, files["bare"])
    assert one(only, "problem") is None


def test_manual_paths_in_any_spelling(spark, gazetteer, tmp_path, monkeypatch):
    folder = tmp_path / "a b"
    folder.mkdir()
    path = write(folder / "c+d.geojson", geojson_box(5.15, 7.2, 5.25, 7.3))
    monkeypatch.chdir(folder)
    manual = read_boundary_files(spark, path)
    for given in (path, f"file://{path}", "c+d.geojson", "./c+d.geojson"):
        found = resolve(spark, gazetteer, [("x", "West", given)], manual=manual)
        assert [r["boundary_source"] for r in found.accepted.collect()] == [f"manual:{given}"], given


def test_all_outlines_of_a_file_choose_the_zone(spark, gazetteer, tmp_path):
    """The first outline lies in zone 31, the centroid of both in zone 32."""
    shapes = [geojson_box(5.8, 7.2, 5.9, 7.3), geojson_box(7.0, 7.0, 8.0, 8.0)]
    features = [{"type": "Feature", "properties": {}, "geometry": s} for s in shapes]
    path = write(tmp_path / "two.geojson", {"type": "FeatureCollection", "features": features})
    found = resolve(spark, gazetteer, [("x", "West", path)], manual=read_boundary_files(spark, path)).accepted.head()
    assert found["target_srid"] == 32632 and found["area_m2"] < 200e6
