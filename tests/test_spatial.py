import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from areaweave.operators import spatial, totals
from areaweave.operators.spatial import spatial_join
from tests.conftest import box, frame, line, point, polygon


def side(a, b, c):
    v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return (v > 0) - (v < 0)


def touch(a, b, c, d):
    spans = all(
        min(a[i], b[i]) <= max(c[i], d[i]) and min(c[i], d[i]) <= max(a[i], b[i]) for i in (0, 1)
    )
    return spans and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def edges(geom):
    return [(r[i], r[i + 1]) for part in geom for r in part for i in range(len(r) - 1)]


def inside(p, geom):
    odd = False
    for (ax, ay), (bx, by) in edges(geom):
        if side((ax, ay), (bx, by), p) == 0 and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
            return True
        if (ay > p[1]) != (by > p[1]):
            lhs, rhs = (p[1] - ay) * (bx - ax), (p[0] - ax) * (by - ay)
            odd ^= lhs > rhs if by > ay else lhs < rhs
    return odd


def intersects(kind, geom, area):
    if any(inside(part[0][0], area) for part in geom):
        return True
    if any(touch(*e, *f) for e in edges(geom) for f in edges(area)):
        return True
    return kind == "Polygon" and any(inside(part[0][0], geom) for part in area)


def star(rng, cx, cy, radius, corners):
    """A ring without crossings around (cx, cy), on whole millidegrees."""
    import math

    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    spots = [
        (cx + int(math.cos(t) * radius * rng.uniform(0.3, 1)), cy + int(math.sin(t) * radius * rng.uniform(0.3, 1)))
        for t in turns
    ]
    return spots + spots[:1]


def degrees(geom):
    return [[[(x / 1000.0, y / 1000.0) for x, y in ring] for ring in part] for part in geom]


def world(seed):
    rng = random.Random(seed)
    areas, features = [], []
    for i in range(12):
        cx, cy = rng.randrange(3000, 9000), rng.randrange(5000, 9000)
        geom = [[star(rng, cx, cy, rng.choice([60, 700, 2500]), rng.randrange(4, 30))]]
        if i % 4 == 1:  # a hole
            geom[0].append([(cx - 20, cy - 20), (cx + 20, cy - 20), (cx, cy + 20), (cx - 20, cy - 20)])
        if i % 4 == 2:  # a second part
            geom.append([star(rng, cx + 6000, cy, 300, 8)])
        areas.append((str(i), geom))
    for i in range(900):
        x, y = rng.randrange(1000, 16000), rng.randrange(3000, 11000)
        size = rng.choice([3, 40, 400, 4000])
        kind = ("Point", "LineString", "Polygon")[i % 3]
        if kind == "Point":
            geom = [[[(x, y)]]]
            if i % 9 == 0:  # exactly on a corner
                geom = [[[rng.choice(areas)[1][0][0][0]]]]
        elif kind == "LineString":
            geom = [[[(x + rng.randrange(-size, size + 1), y + rng.randrange(-size, size + 1)) for _ in range(4)]]]
        else:
            geom = [[star(rng, x, y, size, 6)]]
        features.append((i, kind, geom))
    return areas, features


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force_on_every_path(spark, seed, no_auto_broadcast):
    areas, features = world(seed)
    want = {(fid, aid) for fid, kind, geom in features for aid, area in areas if intersects(kind, geom, area)}
    assert len(want) > 300
    left = frame(spark, [(fid, (kind, 4326, degrees(geom))) for fid, kind, geom in features], "fid INT")
    right = frame(spark, [(aid, polygon(degrees(geom))) for aid, geom in areas], "lga_id STRING")
    variants = [
        {},
        {"cell_degrees": 0.05},
        {"cell_degrees": 3.0},
        {"broadcast_bytes": 0},
        {"broadcast_bytes": 0, "salts": 5},
    ]
    for options in variants:
        rows = [(r["fid"], r["lga_id"]) for r in spatial_join(left, right, **options).select("fid", "lga_id").collect()]
        assert len(rows) == len(set(rows)), options
        assert set(rows) == want, options
    spread = [(r["fid"], r["lga_id"]) for r in spatial_join(left.repartition(7), right.repartition(3)).collect()]
    assert sorted(spread) == sorted(want)


def test_feature_around_a_whole_boundary_and_inside_a_hole(spark):
    ring = polygon([[box(0.0, 0.0, 10.0, 10.0)[0][0], box(4.0, 4.0, 6.0, 6.0)[0][0]]])
    areas = frame(spark, [("tiny", polygon(box(1.0, 1.0, 1.1, 1.1))), ("ring", ring)], "lga_id STRING")
    features = frame(
        spark,
        [
            ("covers tiny", polygon(box(0.5, 0.5, 1.5, 1.5))),
            ("in the hole", polygon(box(4.5, 4.5, 5.5, 5.5))),
            ("around the hole edge", polygon(box(3.5, 3.5, 6.5, 6.5))),
            ("only a corner", point(10.0, 10.0)),
            ("far away", point(40.0, 40.0)),
        ],
        "name STRING",
    )
    got = {(r["name"], r["lga_id"]) for r in spatial_join(features, areas).collect()}
    assert got == {
        ("covers tiny", "tiny"),
        ("covers tiny", "ring"),
        ("around the hole edge", "ring"),
        ("only a corner", "ring"),
    }


def test_crowded_cell_and_copies_are_kept_whole(spark, no_auto_broadcast):
    same = spark.range(0, 3000).select(F.lit("x").alias("name"), F.expr("named_struct('gtype', 'Point', 'srid', 4326, 'parts', array(array(array(named_struct('x', 1.05D, 'y', 1.05D)))))").alias("geom"))
    areas = frame(spark, [("tiny", polygon(box(1.0, 1.0, 1.1, 1.1)))], "lga_id STRING")
    for options in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "salts": 4}):
        assert spatial_join(same, areas, **options).count() == 3000


def test_line_of_one_spot_counts_as_its_spot(spark):
    areas = frame(spark, [("a", polygon(box(0.0, 0.0, 1.0, 1.0)))], "lga_id STRING")
    features = frame(spark, [(1, line((0.5, 0.5), (0.5, 0.5))), (2, line((1.5, 0.5), (1.5, 0.5)))], "i INT")
    assert [r["i"] for r in spatial_join(features, areas).collect()] == [1]


def test_elements_are_stored_by_place(spark, tmp_path):
    """Two far-apart areas leave most files unread, and the join is that of the unstored table."""
    import glob

    import pyarrow.parquet as pq

    from areaweave.sources.elements import write_elements

    rows = [("node", i, point(3 + (i * 37 % 400) / 100, 5 + (i * 91 % 400) / 100)) for i in range(2000)]
    elements = frame(spark, rows, "element_type STRING, osmid BIGINT").withColumn(
        "tags", F.create_map(F.lit("highway"), F.lit("x"))
    )
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        write_elements(elements, str(tmp_path / "e"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    areas = frame(
        spark,
        [("low", polygon(box(3.0, 5.0, 3.2, 5.2))), ("high", polygon(box(6.7, 8.7, 6.9, 8.9)))],
        "lga_id STRING",
    )
    wanted = [(3.0, 5.0, 3.2, 5.2), (6.7, 8.7, 6.9, 8.9)]

    def read(file):
        t = pq.read_table(file, columns=["box_x0", "box_y0"]).to_pandas() / 1e7
        if not len(t):
            return False
        (x0, y0), (x1, y1) = t.min(), t.max()
        return any(x0 <= b[2] and x1 >= b[0] and y0 <= b[3] and y1 >= b[1] for b in wanted)

    stored = glob.glob(f"{tmp_path}/e/*.parquet")
    assert len(stored) >= 8 and sum(map(read, stored)) <= len(stored) // 2
    columns = ["lga_id", "osmid"]
    direct = sorted(map(tuple, spatial_join(elements, areas).select(columns).collect()))
    kept = spark.read.parquet(str(tmp_path / "e"))
    assert sorted(map(tuple, spatial_join(kept, areas).select(columns).collect())) == direct and direct


def test_building_the_index_reads_edges_in_proportion(spark):
    """An outline of 200,000 edges: every round holds each edge a few times, however many boxes there are."""
    n = 200_000
    turn = f"i_ * 2 * pi() / {n}"
    ring = f"transform(sequence(0, {n}), i_ -> named_struct('x', 5 + 3 * cos({turn}), 'y', 7 + 3 * sin({turn}) * (1 + 0.2 * sin(40 * {turn}))))"
    outline = spark.range(1).selectExpr("'a' AS lga_id", f"named_struct('gtype', 'Polygon', 'srid', 4326, 'parts', array(array({ring}))) AS geom")
    size = spatial._sizes(0.125)[0]
    prepared = spatial.prepare_boundaries(outline)
    rounds = spatial._measure(prepared, size).rounds
    nodes = spatial._roots(prepared, size)
    for k in range(rounds):
        nodes = spatial._divided(nodes, size)
        held = nodes.selectExpr("sum(size(_local))").head()[0]
        # Two kinds of blocks; the wider ones overlap by a cell, so an edge reaches up to four of the last
        # of them, and 25/16 on average of those before, which are four cells wide.
        assert held <= (3 if k + 1 < rounds else 6) * n
    blocks = spatial._block_index(prepared, size, rounds, 4)
    assert blocks.where("size(_local) = 0").count() > 100


def test_wide_features_never_carry_a_boundary(spark, no_auto_broadcast):
    areas = frame(spark, [("a", polygon(box(0.0, 0.0, 3.0, 3.0)))], "lga_id STRING")
    wide = frame(spark, [(1, line((-1.0, 1.0), (4.0, 1.2))), (2, polygon(box(-1.0, -1.0, 5.0, 5.0))), (3, line((4.0, 0.0), (4.0, 3.0)))], "fid INT")
    joined = spatial_join(wide, areas, broadcast_bytes=0)
    assert sorted(r["fid"] for r in joined.collect()) == [1, 2]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_whole" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}, {"cell_degrees": 3.0, "broadcast_bytes": 0}])
def test_totals_equal_brute_force(spark, options, monkeypatch):
    """Small groups deal every crowded cell; equal boundaries count each, null values do not."""
    monkeypatch.setattr("areaweave.operators.totals.GROUP_FEATURES", 40)
    monkeypatch.setattr("areaweave.operators.totals.GROUP_BLOCKS", 3)
    monkeypatch.setattr("areaweave.operators.totals._AT_ONCE", 500)
    areas, features = world(3)
    value = {fid: None if fid % 7 == 0 else (fid - 450) * 2**50 for fid, _, _ in features}
    left = frame(spark, [(fid, value[fid], (kind, 4326, degrees(geom))) for fid, kind, geom in features], "fid INT, v BIGINT")
    right = frame(spark, [(aid, polygon(degrees(geom))) for aid, geom in [*areas, areas[0]]], "lga_id STRING")
    added = spatial_join(left, right, totals={"s": "v"}, **options).groupBy("lga_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    want = []
    for aid, area in areas:
        met = [value[fid] for fid, kind, geom in features if intersects(kind, geom, area)]
        known, times = [v for v in met if v is not None], 2 if aid == "0" else 1
        if met:
            want.append((aid, times * len(met), times * sum(known) if known else None))
    assert sorted(map(tuple, added.collect())) == sorted(want)


def test_totals_move_no_pairs(spark):
    """200 features in 300 boundaries are 60,000 pairs; what the tests return has a row a boundary and cell at most."""
    areas = frame(spark, [(str(i), polygon(box(1.0, 1.0, 1.1, 1.1))) for i in range(300)], "lga_id STRING")
    dots = frame(spark, [(i, point(1.05, 1.05)) for i in range(200)], "fid INT")
    found = spatial_join(dots, areas, totals={"s": "fid"})
    assert found.count() <= 300 and found.selectExpr("sum(n)", "sum(s)").head()[:] == (60_000, 300 * 199 * 100)
    with pytest.raises(ValueError):
        spatial_join(dots.selectExpr("CAST(fid AS DOUBLE) AS fid", "geom"), areas, totals={"s": "fid"})


def shapes(geoms, closed):
    """Geometries (kind, parts) as the tables that totals.py works on."""
    parts = [[[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in degrees(geom)] for _, geom in geoms]
    rows = [{"gtype": kind, "srid": 4326, "parts": p} for (kind, _), p in zip(geoms, parts, strict=True)]
    kind = pa.struct([("gtype", pa.string()), ("srid", pa.int32()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])
    at, columns = totals._shape(pa.array(rows, kind), 1_250_000, closed)
    names = ["_size", "_x0", "_y0", "_x1", "_y1", "_own", "_spots", "_area"]
    return pa.Table.from_arrays([pa.array(at), *columns], ["id", *names])


@pytest.mark.parametrize("kind", ["Point", "LineString", "Polygon"])
@pytest.mark.parametrize("by_large", [True, False])
def test_exact_tests_grow_slower_than_pairs(kind, by_large, monkeypatch):
    """One tile: what is told pair by pair is a small part of the pairs, and both sides' totals are those of brute force."""
    rng = random.Random(5)
    areas = [("Polygon", [[star(rng, rng.randrange(-400, 900), rng.randrange(-400, 900), 600, rng.randrange(4, 9))]]) for _ in range(40)]
    features = []
    for _ in range(3000):
        x, y = rng.randrange(0, 500), rng.randrange(0, 500)
        if kind == "Point":
            features.append((kind, [[[(x, y)]]]))
        elif kind == "LineString":
            features.append((kind, [[[(x, y), (x + rng.randrange(5), y + rng.randrange(5)), (x + 4, y + rng.randrange(5))]]]))
        else:
            features.append((kind, [[[(x, y), (x + 3, y), (x + rng.randrange(4), y + 3), (x, y)]]]))
    small, told, tell = shapes(features, False), [], totals._hits
    large = next(t for t in totals._cut(shapes(areas, True), ["id"], 0, 1_250_000))
    large = large.take(pa.array(np.flatnonzero((large["_tx"].to_numpy() == 0) & (large["_ty"].to_numpy() == 0))))
    monkeypatch.setattr(totals, "_hits", lambda small, s, *more: told.append(len(s)) or tell(small, s, *more))
    smalls, known = totals._Smalls(small), totals._Larges(large, kind == "Polygon")
    weight = np.arange(large.num_rows) if not by_large else np.arange(small.num_rows)
    added = [np.zeros(large.num_rows if by_large else small.num_rows, np.int64) for _ in range(2)]
    for path in (False, True):
        members = np.flatnonzero(smalls.path == path)
        if len(members):
            totals._along(smalls, members, [np.ones_like(weight), weight], known, by_large, added)
    met = np.array([[intersects(k, geom, areas[i][1]) for k, geom in features] for i in large["id"].to_pylist()])
    met = met if by_large else met.T
    assert added[0].tolist() == met.sum(1).tolist() and added[1].tolist() == (met @ weight).tolist()
    assert 0 < sum(told) < met.size / 8


def test_places_are_cut_into_few_tiles(spark):
    """A place of two degrees had 545 blocks; what is cut grows with the tiles, and wholly covered ones have one edge."""
    places = totals.shapes_of(frame(spark, [("a", polygon(box(1.0, 1.0, 3.0, 3.0)))], "lga_id STRING"), spatial._sizes(0.125)[0])
    cut = totals._large(places, ["lga_id"], [0], spatial._sizes(0.125)[0], same=True)
    assert cut.count() <= 36 and cut.where("size(_own) = 1").count() >= 9


def test_wide_totals_bring_no_pairs_together(spark, monkeypatch):
    """Wide and small shapes, lines among them, are added up on both sides without a table of pairs."""
    monkeypatch.setattr(spatial, "_large_pairs", None)
    monkeypatch.setattr("areaweave.operators.totals.GROUP_PAIRS", 50)
    rng = random.Random(7)
    areas = [(i, [[star(rng, rng.randrange(3000, 9000), rng.randrange(5000, 9000), rng.choice([40, 300, 2500]), 7)]]) for i in range(60)]
    features = [(i, "Polygon", [[star(rng, rng.randrange(3000, 9000), rng.randrange(5000, 9000), rng.choice([200, 2000]), 6)]]) for i in range(60)]
    for i in range(60, 90):
        at = [(rng.randrange(2000, 10000), rng.randrange(4000, 10000)) for _ in range(4)]
        features.append((i, "LineString", [[at]]) if i % 3 else (i, "MultiPoint", [[[p]] for p in at]))
    left = frame(spark, [(i, (kind, 4326, degrees(geom))) for i, kind, geom in features], "fid INT")
    right = frame(spark, [(str(i), polygon(degrees(geom))) for i, geom in areas], "lga_id STRING")
    added = spatial_join(left, right, totals={"s": "fid"}).groupBy("lga_id").agg(F.sum("n"), F.sum("s"))
    want = {str(i): [fid for fid, kind, geom in features if intersects(kind, geom, area)] for i, area in areas}
    assert sorted(map(tuple, added.collect())) == sorted((i, len(met), sum(met)) for i, met in want.items() if met)
