import pytest

from areaweave.operators.scale import through_table
from areaweave.sources import elements as el, rings


def ways_frame(spark, ways):
    """way_id -> list of (node, x, y), as references and nodes."""
    refs = [(w, i, n) for w, stops in ways.items() for i, (n, _, _) in enumerate(stops)]
    nodes = {n: (n, float(x), float(y)) for stops in ways.values() for n, x, y in stops}
    return (
        spark.createDataFrame(refs, "way_id BIGINT, pos INT, node_id BIGINT"),
        spark.createDataFrame(list(nodes.values()), "node_id BIGINT, x DOUBLE, y DOUBLE"),
    )


def assembled(spark, ways, members, with_nodes=True):
    paths = el.way_paths(*ways_frame(spark, ways))
    if not with_nodes:
        paths = paths.drop("first_node", "last_node")
    ids = sorted({m[0] for m in members})
    relations = spark.createDataFrame([(i, {"landuse": "farm"}) for i in ids], "relation_id BIGINT, tags MAP<STRING,STRING>")
    frame = spark.createDataFrame(members, "relation_id BIGINT, pos INT, way_id BIGINT, role STRING")
    built, rejects = el.assemble_relations(relations, frame, paths)
    shapes = {
        r["osmid"]: [[[(v["x"], v["y"]) for v in ring] for ring in part] for part in r["geom"]["parts"]] for r in built.collect()
    }
    return shapes, sorted((r["relation_id"], r["way_id"], r["reason"]) for r in rejects.collect())


SQUARE = {
    1: [(1, 0, 0), (2, 10, 0), (3, 10, 10)],
    2: [(1, 0, 0), (4, 0, 10), (3, 10, 10)],
    3: [(5, 2, 2), (6, 4, 2)],
    4: [(7, 4, 4), (6, 4, 2)],
    5: [(7, 4, 4), (5, 2, 2)],
    6: [(8, 20, 20), (9, 21, 20), (10, 21, 21), (8, 20, 20)],
}


@pytest.mark.parametrize("with_nodes", [True, False])
def test_shell_and_hole_of_open_ways_beside_a_closed_way(spark, with_nodes):
    members = [(1, 0, 5, "inner"), (1, 1, 2, "outer"), (1, 2, 6, ""), (1, 3, 1, None), (1, 4, 3, "inner"), (1, 5, 4, "inner")]
    shapes, rejects = assembled(spark, SQUARE, members, with_nodes)
    shell = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]
    hole = [(4, 4), (2, 2), (4, 2), (4, 4)]
    assert shapes == {1: [[shell, hole], [[(20, 20), (21, 20), (21, 21), (20, 20)]]]} and rejects == []


def test_reasons(spark):
    ways = {
        **SQUARE,
        7: [(3, 10, 10), (20, 30, 30)],
        8: [(1, 0, 0), (3, 10, 10)],
        9: [(3, 10, 10), (1, 0, 0)],
        10: [(30, 7, 7), (31, 8, 8), (30, 7, 7)],
    }
    members = [
        (1, 0, 1, "outer"),  # one way of two
        (2, 0, 1, "outer"), (2, 1, 2, "outer"), (2, 2, 7, "outer"),  # a spur, so both reasons hold
        (3, 0, 1, "outer"), (3, 1, 2, "outer"), (3, 2, 8, "outer"), (3, 3, 9, "outer"),  # four ends at a node
        (4, 0, 8, "outer"), (4, 1, 9, "outer"),  # there and back
        (5, 0, 1, "outer"), (5, 1, 2, "inner"),  # the roles do not meet
        (6, 0, 10, "outer"),  # closed in itself, but flat
        (7, 0, 1, "inner"), (7, 1, 2, "inner"),
    ]
    shapes, rejects = assembled(spark, ways, members)
    assert shapes == {}
    assert [(i, why) for i, _, why in rejects] == [
        (1, "member_not_closed"), (2, "member_not_closed"), (3, "ring_branches"), (4, "ring_too_short"),
        (5, "member_not_closed"), (6, "ring_too_short"), (7, "no_outer"),
    ]


def test_a_ring_of_many_ways_takes_few_rounds(spark, monkeypatch):
    n = 700
    spots = [(i, float(i), float(i * i % 101)) for i in range(n)]
    ways = {}
    for i in range(n):
        stops = [spots[i], spots[(i + 1) % n]]
        ways[i] = stops[::-1] if i % 3 == 1 else stops
    rounds = []
    real = rings.through_table
    monkeypatch.setattr(rings, "through_table", lambda df: rounds.append(1) or real(df))
    shapes, rejects = assembled(spark, ways, [(1, (i * 11) % n, i, "outer") for i in range(n)])
    assert rejects == []
    assert shapes[1] == [[[(x, y) for _, x, y in spots] + [(0.0, 0.0)]]]
    assert len(rounds) <= 16  # about log2(700), and the tables before and after


def test_no_side_goes_through_the_driver(spark, monkeypatch):
    """Tables of ways look small by their packed files, so Spark would broadcast them in every round."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return through_table(df)

    monkeypatch.setattr(rings, "through_table", kept)
    shapes, rejects = assembled(spark, SQUARE, [(1, 0, 1, "outer"), (1, 1, 2, "outer"), (1, 2, 3, "inner"), (1, 3, 4, "inner"), (1, 4, 5, "inner")])
    assert len(shapes[1]) == 1 and rejects == []
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)
