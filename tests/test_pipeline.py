import json
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.operators import audit
from areaweave.operators.boundary import BoundaryResolutionError
from areaweave.operators.layers import extract_features
from areaweave.operators.rules import LayerExtractionError
from areaweave.operators.scale import broadcast_checked, shared_folder
from areaweave.operators.spatial import spatial_join
from areaweave.plans.pipeline import extract_lgas
from areaweave.sinks.files import read_runs, write_geojson
from areaweave.sources.elements import read_elements, write_elements
from areaweave.sources.geojson import read_layers
from tests.conftest import box, frame, line, point, polygon
from tests.test_layers import ELEMENTS


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = [
        ("West Area", "Ondo", "Elsewhere", 1, polygon(box(5.15, 7.2, 5.25, 7.3))),
        ("Mid Area", "Abuja", "Mid Area, Abuja", 2, polygon(box(7.4, 9.0, 7.6, 9.1))),
    ]
    return frame(spark, rows, "lga_name STRING, state_name STRING, display_name STRING, position BIGINT")


@pytest.fixture(scope="module")
def elements(spark):
    hole = [box(5.2, 7.2, 5.22, 7.22)[0][0], box(5.205, 7.205, 5.21, 7.21)[0][0]]
    rows = [
        ("node", 1, {"amenity": "hospital", "name": 'H "one"'}, point(5.2, 7.25)),
        ("way", 3, {"highway": "residential"}, line((5.2, 7.25), (5.21, 7.26))),
        ("node", 4, {"highway": "traffic_signals"}, point(5.205, 7.255)),
        ("way", 5, {"landuse": "farmland"}, polygon([hole])),
        ("relation", 6, {"landuse": "forest"}, polygon([hole, box(5.23, 7.23, 5.24, 7.24)[0]])),
        ("way", 7, {"highway": "primary"}, ("MultiLineString", 4326, [[[(7.5, 9.05), (7.51, 9.05)]], [[(7.5, 9.06), (7.51, 9.06)]]])),
        ("node", 8, {"highway": "stop"}, ("MultiPoint", 4326, [[[(7.5, 9.05)]], [[(7.51, 9.05)]]])),
        ("node", 9, {"shop": "kiosk"}, point(5.2, 7.25)),
    ]
    return frame(spark, rows, ELEMENTS)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "lga_name STRING, state_name STRING")


@pytest.fixture(scope="module")
def run(spark, gazetteer, elements, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out"))
    asked = requests(spark, ("West Area", "Ondo"), ("Mid Area", None), ("Nowhere", None), ("West Area ", "Ondo"))
    moment = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
    return path, extract_lgas(asked, gazetteer, elements, path, timestamp=moment)


def test_whole_job(spark, run):
    path, result = run
    assert result.boundaries.count() == 2
    assert [r["reason_code"] for r in result.rejected.collect()] == ["no_match"]
    rows = {(r["lga_id"], r["layer"], r["geom_category"]): r for r in result.manifest.collect()}
    ids = {r["lga_name"]: r["lga_id"] for r in result.boundaries.collect()}
    west, mid = ids["West Area"], ids["Mid Area"]
    assert rows[west, "roads", "line"]["name"] == "roads_line" and rows[west, "roads", "point"]["n"] == 1
    assert rows[west, "landuse", "polygon"]["name"] == "landuse" and rows[west, "landuse", "polygon"]["n"] == 2
    assert rows[west, "schools", None]["status"] == "skipped"
    for key, row in rows.items():
        if row["status"] == "exported":
            assert spark.read.parquet(row["path"]).count() == row["n"], key
            assert spark.read.text(row["geojson_path"]).count() >= row["n"], key
    assert rows[mid, "roads", "point"]["n"] == 1


def test_exported_layers_read_back_the_same(spark, run):
    path, result = run
    back = read_layers(spark, f"{path}/geojson")
    columns = ["lga_id", "layer", "element_type", "osmid", "name", "geom"]
    want = sorted(str(r) for r in result.layers.select(columns).collect())
    assert sorted(str(r) for r in back.select(columns).collect()) == want
    for row in spark.read.text(f"{path}/geojson").select("value").collect():
        feature = json.loads(row["value"])
        assert feature["type"] == "Feature" and feature["properties"]["srid"] in (32631, 32632)


def test_run_log(spark, run):
    path, result = run
    log = {r["lga_name"]: r for r in read_runs(spark, path).collect()}
    west = log["West Area"]
    assert west["target_crs"] == "EPSG:32631" and log["Mid Area"]["target_crs"] == "EPSG:32632"
    assert west["timestamp_utc"] == "2024-05-01T12:00:00+00:00"
    assert west["skipped_layers"] == ["buildings", "waterways", "schools"]
    assert west["split_layers"] == {"roads": ["line", "point"]}
    assert set(west["exported_layers"]) == {"roads", "landuse", "health_facilities"}
    assert set(west["exported_layers"]["roads"]["parts"]) == {"line", "point"}
    assert west["warnings"][0].startswith("Boundary validation: ") and "returned no features" in west["warnings"][1]
    assert west["environment"]["package_versions"]["pyspark"].startswith("4")
    assert json.loads(west["tag_config"])["schools"] == {"amenity": "school"}
    pending = audit.pending_requests(requests(spark, ("west area", "Ondo"), ("Other", None)), read_runs(spark, path))
    assert [r["lga_name"] for r in pending.collect()] == ["Other"]
    other = audit.pending_requests(requests(spark, ("West Area", "Ondo")), read_runs(spark, path), {"roads": {"highway": True}})
    assert other.count() == 1


def test_finished_areas_are_left_out(spark, run, gazetteer, elements):
    path, _ = run
    asked = requests(spark, ("West Area", "Ondo"), ("Mid Area", "Abuja"))
    again = extract_lgas(asked, gazetteer, elements, write=False, finished=read_runs(spark, path))
    assert [r["state_name"] for r in again.boundaries.collect()] == ["Abuja"]


def test_rerun_replaces_only_its_own_areas(spark, run, tmp_path):
    _, result = run
    path = str(tmp_path)
    write_geojson(result.layers, path)
    one_area = result.layers.where("layer = 'roads'").orderBy("lga_id").limit(1)
    write_geojson(one_area, path)
    back = read_layers(spark, f"{path}/geojson")
    key = one_area.head()
    assert back.where((F.col("lga_id") == key["lga_id"]) & (F.col("layer") == "roads")).count() == 1
    others = result.layers.where((F.col("lga_id") != key["lga_id"]) | (F.col("layer") != "roads")).count()
    assert back.count() == others + 1


def test_strict_raises_before_anything_is_written(spark, gazetteer, elements, tmp_path):
    path = tmp_path / "out"
    asked = requests(spark, ("West Area", "Ondo"))
    with pytest.raises(LayerExtractionError, match="health"):
        extract_lgas(asked, gazetteer, elements, str(path), rules={"health": {"amenity": 1}}, strict=True)
    with pytest.raises(BoundaryResolutionError, match="Nowhere"):
        extract_lgas(requests(spark, ("Nowhere", None)), gazetteer, elements, str(path), strict=True)
    assert not path.exists()
    run = extract_lgas(asked, gazetteer, elements, rules={"health": {"amenity": 1}, "roads": {"highway": True}}, write=False)
    assert any("failed to extract" in w for w in run.warnings.head()["warnings"])
    assert {(r["layer"], r["status"]) for r in run.manifest.collect()} == {("health", "skipped"), ("roads", "exported")}


def test_scan_pushes_tags_and_extent_down(spark, elements, tmp_path):
    write_elements(elements, str(tmp_path / "elements"))
    found = read_elements(spark, str(tmp_path / "elements"), extent=(50_000_000, 70_000_000, 53_000_000, 73_000_000))
    assert {r["osmid"] for r in found.select("osmid").collect()} == {1, 3, 4, 5, 6}
    text = plan_of(found.select("osmid"))
    pushed = next(l for l in text.splitlines() if "PushedFilters" in l)
    for part in ("IsNotNull(tag_highway)", "EqualTo(tag_amenity,school)", "LessThanOrEqual(box_x0", "GreaterThanOrEqual(box_y1"):
        assert part in pushed
    schema = next(l for l in text.splitlines() if "ReadSchema" in l)
    assert "geom" not in schema and "map<" not in schema


def test_stored_boxes_give_the_same_join(spark, elements, run, tmp_path):
    _, result = run
    write_elements(elements, str(tmp_path / "elements"))
    stored = extract_features(read_elements(spark, str(tmp_path / "elements")), result.boundaries)
    assert stored.columns == ["lga_id", "layer", "element_type", "osmid", "name", "geom", "target_srid"]
    scan = next(l for l in plan_of(stored).splitlines() if "PushedFilters" in l and "box_x0" in l)
    assert "LessThanOrEqual(box_x0,76000000)" in scan and "GreaterThanOrEqual(box_x1,51500000)" in scan
    direct = extract_features(elements, result.boundaries)
    keys = ["lga_id", "layer", "element_type", "osmid"]
    assert sorted(map(tuple, stored.select(keys).collect())) == sorted(map(tuple, direct.select(keys).collect()))


def test_plans_have_no_cross_join_and_no_python(spark, elements, run, no_auto_broadcast):
    _, result = run
    small = extract_features(elements.repartition(3), result.boundaries)
    large = spatial_join(elements, result.boundaries.select("lga_id", "geom"), broadcast_bytes=0)
    for df in (small, large, result.layers, result.manifest, result.rejected):
        text = plan_of(df)
        for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
            assert bad not in text
    # Broadcast path: the only exchange of features is the repartition asked for here.
    assert plan_of(small).count("\n(") > 0 and "hashpartitioning" not in plan_of(small)
    assert "hashpartitioning" in plan_of(large)


def test_dedupe_combines_before_its_shuffle(spark, elements):
    from areaweave.operators.clean import dedupe_geometry
    from areaweave.operators.rules import assign_layers

    text = plan_of(dedupe_geometry(assign_layers(elements).drop("tags"), ("layer",)))
    assert text.count("partial_min") >= 1


def test_broadcast_needs_a_proven_size(spark):
    small, big = spark.range(10), spark.range(100_000)
    assert "broadcast" in broadcast_checked(small)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in broadcast_checked(big, row_bytes=1024, limit=1024 * 1024)._jdf.queryExecution().analyzed().toString().lower()


def test_shared_folder_comes_from_the_session(spark):
    def session(folder, master, checkpoint_dir=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint_dir)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    assert shared_folder(session("/shared/x", "yarn")) == "/shared/x"
    assert shared_folder(session(None, "yarn", "/set/by/hand")) == "/set/by/hand"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session(None, "yarn"))
    assert shared_folder(spark) == shared_folder(spark)


def test_extraction_runs_on_a_stream(spark, elements, run, tmp_path):
    _, result = run
    source = str(tmp_path / "in")
    elements.write.parquet(source)
    stream = spark.readStream.schema(elements.schema).parquet(source)
    found = extract_features(stream, result.boundaries).select("lga_id", "layer", "osmid")
    query = (
        found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    want = extract_features(elements, result.boundaries).select("lga_id", "layer", "osmid").collect()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, want))


def test_result_does_not_depend_on_partitioning(spark, gazetteer, elements):
    asked = requests(spark, ("West Area", "Ondo"), ("Mid Area", None))
    runs = [
        extract_lgas(asked.repartition(n), gazetteer.repartition(n), elements.repartition(n), write=False) for n in (1, 5)
    ]
    a, b = (sorted(str(r) for r in r.layers.collect()) for r in runs)
    assert a == b and len(a) == 7


def test_geometry_type_matches_the_declared_one(spark, run):
    _, result = run
    assert result.layers.schema["geom"].dataType.simpleString() == g.GEOMETRY_SQL


def test_what_is_left_out_is_written(spark, run):
    path, result = run
    assert [r["reason_code"] for r in spark.read.json(f"{path}/rejected").collect()] == ["no_match"]
    counted = result.outcomes.groupBy("outcome").sum("n").collect()
    assert {r[0] for r in counted} >= {"kept"}


def test_manual_files_are_read_by_the_job(spark, gazetteer, elements, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[5.15, 7.2], [5.25, 7.2], [5.25, 7.3], [5.15, 7.3], [5.15, 7.2]]]}
    path = tmp_path / "own area.geojson"
    path.write_text(json.dumps(shape))
    asked = spark.createDataFrame(
        [("Own", None, str(path)), ("Lost", None, "/no/such/file.geojson")], "lga_name STRING, state_name STRING, manual_path STRING"
    )
    result = extract_lgas(asked, gazetteer, elements, write=False)
    assert [r["boundary_source"] for r in result.boundaries.collect()] == [f"manual:{path}"]
    assert [r["reason_code"] for r in result.rejected.collect()] == ["no_file"]
