import math

import pytest
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.functions.projection import epsg_label, to_utm, to_wgs84, utm_srid
from areaweave.operators import clean
from tests.conftest import box, frame, line, one, point, polygon

L_SHAPE = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]


def shape(spark, geom):
    return frame(spark, [(1, geom)], "id INT")


@pytest.mark.parametrize("turn", range(6))
@pytest.mark.parametrize("step", [1, -1])
def test_area_and_centroid_do_not_depend_on_start_or_direction(spark, turn, step):
    ring = L_SHAPE[:-1][turn:] + L_SHAPE[:-1][:turn]
    ring = ring[::step]
    df = shape(spark, polygon([[[(float(x), float(y)) for x, y in ring + ring[:1]]]]))
    assert one(df, g.area("geom")) == pytest.approx(12.0)
    at = one(df, g.centroid("geom"))
    assert (at["x"], at["y"]) == pytest.approx((5 / 3, 5 / 3))


def test_holes_and_parts_count(spark):
    shell, hole = box(0.0, 0.0, 4.0, 4.0)[0][0], box(1.0, 1.0, 2.0, 2.0)[0][0]
    other = box(10.0, 0.0, 12.0, 2.0)[0]
    df = shape(spark, polygon([[shell, hole], other]))
    assert one(df, g.area("geom")) == pytest.approx(16 - 1 + 4)
    at = one(df, g.centroid("geom"))
    assert at["x"] == pytest.approx((16 * 2 - 1 * 1.5 + 4 * 11) / 19)


def test_line_and_multipoint_centroids(spark):
    at = one(shape(spark, line((0.0, 0.0), (2.0, 0.0), (2.0, 6.0))), g.centroid("geom"))
    assert (at["x"], at["y"]) == pytest.approx((14 / 8, 18 / 8))
    at = one(shape(spark, ("MultiPoint", 4326, [[[(0.0, 0.0)]], [[(1.0, 3.0)]]])), g.centroid("geom"))
    assert (at["x"], at["y"]) == pytest.approx((0.5, 1.5))


def test_categories(spark):
    names = ["Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"]
    df = frame(spark, [(i, (n, 4326, [])) for i, n in enumerate(names)], "i INT")
    got = [r["v"] for r in df.orderBy("i").select(F.expr(g.category("geom")).alias("v")).collect()]
    assert got == ["point", "point", "line", "line", "polygon", "polygon", "other"]


def test_null_and_empty(spark):
    df = frame(spark, [(0, None), (1, ("Polygon", 4326, [])), (2, ("LineString", 4326, [[[]]])), (3, point(1.0, 1.0))], "i INT")
    got = [r["v"] for r in df.orderBy("i").select(F.expr(g.usable("geom")).alias("v")).collect()]
    assert got == [False, False, False, True]
    assert [r["i"] for r in clean.drop_unusable(df).collect()] == [3]


def test_known_zones(spark):
    # Four known places and both sides of a zone edge.
    rows = [(5.2, 7.25, 32631), (7.5, 9.05, 32632), (13.15, 11.85, 32633), (3.4, 6.5, 32631), (5.999, 0.0, 32631), (6.001, 0.0, 32632)]
    rows += [(-180.0, 0.0, 32601), (180.0, 0.0, 32660), (5.2, -0.1, 32731)]
    df = spark.createDataFrame(rows, "lon DOUBLE, lat DOUBLE, want INT")
    assert df.where(F.expr(f"{utm_srid('lon', 'lat')} <> want")).count() == 0
    assert one(df.limit(1), epsg_label("want")) == "EPSG:32631"


def test_utm_known_values(spark):
    df = frame(spark, [(32631, point(5.2, 7.25)), (32631, point(3.0, 0.0))], "z INT")
    got = df.select(F.expr(to_utm("geom", "z")).alias("u")).collect()
    (x, y), (x0, y0) = (r["u"]["parts"][0][0][0] for r in got)
    assert (x, y) == pytest.approx((742918.824, 801974.420), abs=1e-3)
    assert (x0, y0) == pytest.approx((500000.0, 0.0), abs=1e-6)


def test_meridian_arc_is_right(spark):
    # Distance from the equator to 45 degrees north on the central meridian.
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    steps = 200_000
    h = math.radians(45) / steps
    arc = sum(6378137 * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * h) ** 2) ** 1.5 * h for i in range(steps))
    df = frame(spark, [(32631, point(3.0, 45.0))], "z INT")
    assert one(df, to_utm("geom", "z"))["parts"][0][0][0]["y"] == pytest.approx(arc * 0.9996, abs=1e-3)


def test_forward_and_inverse_cancel_even_out_of_zone(spark):
    df = spark.range(0, 2000).selectExpr(
        "(id * 7919 % 12500 + 2500) / 1000D AS lon", "(id * 104729 % 20000 - 10000) / 1000D AS lat", "CAST(32631 + id % 3 AS INT) AS z"
    )
    there = df.select("lon", "lat", "z", F.expr(g.point("lon", "lat")).alias("p")).withColumn("u", F.expr(to_utm("p", "z")))
    back = there.withColumn("b", F.expr(to_wgs84("u"))).selectExpr("lon", "lat", f"{g.first_vertex('b')} AS v")
    assert back.where("abs(v.x - lon) > 1e-8 OR abs(v.y - lat) > 1e-8").count() == 0
    south = df.select(F.expr(g.point("lon", "-5D")).alias("p")).withColumn("u", F.expr(to_utm("p", "32731")))
    again = south.withColumn("b", F.expr(to_wgs84("u"))).selectExpr(f"{g.first_vertex('b')}.y AS y")
    assert again.where("abs(y + 5) > 1e-8").count() == 0


def test_projected_input_changes_zone_through_wgs84(spark):
    df = frame(spark, [(32632, point(5.2, 7.25))], "z INT")
    direct = df.select(F.expr(to_utm("geom", "z")).alias("u"))
    hop = df.select(F.expr(to_utm("geom", "32631")).alias("geom"), "z").select(F.expr(to_utm("geom", "z")).alias("u"))
    a, b = (d.head()["u"]["parts"][0][0][0] for d in (direct, hop))
    assert (a["x"], a["y"]) == pytest.approx((b["x"], b["y"]), abs=1e-6)


VALID = {
    "square": (polygon(box(0.0, 0.0, 1.0, 1.0)), True, False, "valid"),
    "square with repeated vertex": (polygon([[[(0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]), True, False, "valid"),
    "open ring": (polygon([[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]]), False, False, "repaired"),
    "bowtie": (polygon([[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]]]), True, True, "quarantined"),
    "flat": (polygon([[[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]]), False, True, "emptied"),
    "spike": (polygon([[[(0.0, 0.0), (2.0, 0.0), (3.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 0.0)]]]), True, True, "quarantined"),
    "touches itself": (
        polygon([[[(0.0, 0.0), (2.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0), (0.0, 0.0)]]]),
        True,
        True,
        "quarantined",
    ),
    "hole touching its shell": (
        polygon([[box(0.0, 0.0, 4.0, 4.0)[0][0], [(0.0, 2.0), (1.0, 1.0), (2.0, 2.0), (1.0, 3.0), (0.0, 2.0)]]]),
        True,
        False,
        "valid",
    ),
    "hole crossing its shell": (polygon([[box(0.0, 0.0, 4.0, 4.0)[0][0], box(3.0, 1.0, 5.0, 2.0)[0][0]]]), True, True, "quarantined"),
    "line": (line((0.0, 0.0), (1.0, 1.0)), True, False, "valid"),
    "line of one spot": (line((1.0, 1.0), (1.0, 1.0)), False, False, "emptied"),
    "point": (point(1.0, 1.0), True, False, "valid"),
}


def test_validity_and_repair(spark):
    names = list(VALID)
    df = frame(spark, [(n, VALID[n][0]) for n in names], "name STRING")
    flags = {r["name"]: (r["structure_ok"], r["self_crossing"]) for r in clean.validity(df).collect()}
    assert flags == {n: (VALID[n][1], VALID[n][2]) for n in names}
    mended = {r["name"]: r for r in clean.repair(df).collect()}
    assert {n: r["repair_status"] for n, r in mended.items()} == {n: VALID[n][3] for n in names}
    assert mended["square with repeated vertex"]["geom"]["parts"] == VALID["square with repeated vertex"][0][2]
    assert mended["open ring"]["geom"]["parts"][0][0][-1] == (0.0, 0.0)


def test_long_outline_is_swept(spark):
    n = 3000
    ring = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    crossed = ring[:]
    crossed[700], crossed[2100] = crossed[2100], crossed[700]
    df = frame(spark, [(0, polygon([[ring + ring[:1]]])), (1, polygon([[crossed + crossed[:1]]]))], "i INT")
    got = [r["v"] for r in df.orderBy("i").select(F.expr(g.self_crossing("geom")).alias("v")).collect()]
    assert got == [False, True]


def test_collapse_only_touches_areas(spark):
    df = frame(spark, [("a", polygon(box(0.0, 0.0, 2.0, 2.0), 32631)), ("b", line((0.0, 0.0), (1.0, 1.0)))], "k STRING")
    got = {r["k"]: r["v"] for r in df.select("k", F.expr(g.collapse_area("geom")).alias("v")).collect()}
    assert got["a"]["gtype"] == "Point" and got["a"]["srid"] == 32631
    assert got["a"]["parts"] == [[[(1.0, 1.0)]]]
    assert got["b"]["gtype"] == "LineString"
