from pyspark.sql import functions as F

from areaweave.operators.reuse import content_fingerprints, pending_areas
from areaweave.operators.audit import rules_hash
from areaweave.plans.pipeline import extract_lgas
from areaweave.sinks import files, increments, snapshots
from tests.conftest import box, frame, line, point, polygon

ELEMENTS = "element_type STRING, osmid BIGINT, tags MAP<STRING, STRING>"
ROWS = "lga_id STRING, layer STRING, element_type STRING, osmid BIGINT, name STRING"


def areas(spark):
    rows = [("a", 32631, polygon([box(5.0, 7.0, 5.2, 7.2)[0]])), ("b", 32631, polygon([box(5.4, 7.0, 5.6, 7.2)[0]]))]
    return frame(spark, rows, "lga_id STRING, target_srid INT")


def nodes(spark, *rows):
    return frame(spark, [("node", i, {"amenity": tag}, point(x, y)) for i, tag, x, y in rows], ELEMENTS)


def seen(spark, path):
    return sorted((r["lga_id"], r["layer"], r["osmid"]) for r in snapshots.read_snapshot(spark, path, "layers").collect())


def test_a_later_version_supersedes_and_a_batch_counts_once(spark, tmp_path):
    path, places = f"{tmp_path}/out", areas(spark)
    first = nodes(spark, (1, "school", 5.1, 7.1), (2, "school", 5.5, 7.1), (3, "clinic", 5.5, 7.15))
    assert increments.record_batch(first, places, path, 0) and not increments.record_batch(first, places, path, 0)
    assert increments.publish(spark, path, places) and increments.publish(spark, path, places) is None
    assert seen(spark, path) == [("a", "schools", 1), ("b", "health_facilities", 3), ("b", "schools", 2)]

    # 1 moves to b, 2 leaves all areas, 4 has no layer; a is left empty.
    second = nodes(spark, (1, "school", 5.45, 7.1), (2, "school", 9.0, 9.0), (4, "bank", 5.1, 7.1))
    increments.record_batch(second, places, path, 1)
    assert sorted(r[0] for r in increments.touched_areas(spark, path, 0, 1).collect()) == ["a", "b"]
    increments.publish(spark, path, places)
    assert seen(spark, path) == [("b", "health_facilities", 3), ("b", "schools", 1)]

    # 3 changes its tag only; a is not touched.
    increments.record_batch(nodes(spark, (3, "school", 5.5, 7.15)), places, path, 2)
    assert [r[0] for r in increments.touched_areas(spark, path, 1, 2).collect()] == ["b"]
    increments.publish(spark, path, places)
    assert seen(spark, path) == [("b", "schools", 1), ("b", "schools", 3)]


def test_leftovers_of_a_batch_that_died_do_not_count(spark, tmp_path):
    path, places = f"{tmp_path}/out", areas(spark)
    increments.record_batch(nodes(spark, (1, "school", 5.1, 7.1)), places, path, 0)
    # Rows written, but no mark; then tried again with what the stream really holds.
    spark.read.parquet(f"{path}/rows/batch_id=0").write.parquet(f"{path}/rows/batch_id=1")
    assert increments.current_rows(spark, path).count() == 1
    assert increments.record_batch(nodes(spark, (5, "school", 5.5, 7.1)), places, path, 1)
    assert sorted(r["osmid"] for r in increments.current_rows(spark, path).collect()) == [1, 5]


def test_elements_without_id_and_empty_batches(spark, tmp_path):
    path, places = f"{tmp_path}/out", areas(spark)
    for i in (0, 1):
        increments.record_batch(nodes(spark, (None, "school", 5.1, 7.1 + i / 100)), places, path, i)
    increments.record_batch(nodes(spark, (7, "school", 5.1, 7.1)).limit(0), places, path, 2)
    assert increments.current_rows(spark, path).count() == 2
    increments.publish(spark, path, places)
    increments.record_batch(nodes(spark, (7, "school", 5.1, 7.1)).limit(0), places, path, 3)
    assert increments.publish(spark, path, places) and len(seen(spark, path)) == 2


def test_fingerprint_sees_what_matters_and_nothing_else(spark):
    places = areas(spark)
    cut = lambda *rings: ("MultiLineString", 4326, [[list(r)] for r in rings])
    pts = [(5.0, 7.0), (5.1, 7.1), (5.2, 7.0), (5.3, 7.1), (5.4, 7.2)]
    base = [("a", "roads", "way", 1, None, line(*pts[:3])), ("a", "roads", "way", 2, "x", cut(pts[:3], pts[3:]))]

    def of(rows, marks=()):
        return {r[0]: r[1] for r in content_fingerprints(frame(spark, rows, ROWS), places, marks).collect()}

    plain = of(base)
    assert set(plain) == {"a", "b"} and of(base[::-1]) == plain
    variants = [
        base[:1],
        base + base[:1],
        [base[0], ("a", "roads", "way", 2, None, base[1][-1])],
        [base[0], ("a", "roads", None, 2, "x", base[1][-1])],
        [base[0], ("a", "roads", "way", 2, "x", cut(pts[:2], pts[2:]))],
        [base[0], ("a", "landuse", *base[1][2:])],
    ]
    hashes = [of(rows)["a"] for rows in variants]
    assert len({plain["a"], *hashes}) == len(variants) + 1
    assert all(of(rows)["b"] == plain["b"] for rows in variants)
    assert of(base, ["a file is broken"])["b"] != plain["b"]
    moved = content_fingerprints(frame(spark, base, ROWS), places.withColumn("target_srid", F.lit(32632)))
    assert {r[0]: r[1] for r in moved.collect()}["b"] != plain["b"]


def test_pending_areas(spark):
    prints = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "lga_id STRING, content_hash STRING")
    runs = spark.createDataFrame(
        [("a", rules_hash(), "1"), ("b", rules_hash(), "9"), ("c", "other", "3")], "lga_id STRING, rules_hash STRING, content_hash STRING"
    )
    assert sorted(r[0] for r in pending_areas(prints, runs).collect()) == ["b", "c", "d"]
    assert pending_areas(prints, runs.drop("content_hash")).count() == 4
    assert pending_areas(prints, runs.limit(0)).count() == 4


def test_job_runs_again_only_where_something_changed(spark, tmp_path):
    path = f"{tmp_path}/out"
    wanted = spark.createDataFrame([("A", "S"), ("B", "S")], "lga_name STRING, state_name STRING")
    places = frame(
        spark,
        [("A", "S", "A, S, Nigeria", 0, polygon([box(5.0, 7.0, 5.2, 7.2)[0]])), ("B", "S", "B, S, Nigeria", 0, polygon([box(5.4, 7.0, 5.6, 7.2)[0]]))],
        "lga_name STRING, state_name STRING, display_name STRING, position INT",
    )
    before = nodes(spark, (1, "school", 5.1, 7.1), (2, "school", 5.5, 7.1))
    extract_lgas(wanted, places, before, path)
    after = before.unionByName(nodes(spark, (3, "clinic", 5.5, 7.15), (4, "school", 9.0, 9.0)))
    again = lambda elements: extract_lgas(
        wanted, places, elements, path, finished=files.read_runs(spark, path), by_content=True, write=False
    )
    assert again(before).runs.count() == 0
    changed = again(after)
    assert [r["lga_name"] for r in changed.runs.collect()] == ["B"]
    assert sorted(r["osmid"] for r in changed.layers.collect()) == [2, 3]
