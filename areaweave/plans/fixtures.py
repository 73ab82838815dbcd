"""Map tables derived from the given tables by exact integer rules (FIXTURES.md).

Coordinates are whole millidegrees until the geometry is built, so any other SQL
engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.operators.scale import compute_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str, name: str, key: str, alias: str) -> DataFrame:
    """The key column features are derived from.

    The given files hold one row group each, so a small one would leave all but
    one core idle; only then the bare keys are spread out.
    """
    column = table(spark, sf_dir, name).select(F.col(key).cast("bigint").alias(alias))
    slots = spark.sparkContext.defaultParallelism
    return column.repartition(slots) if column.rdd.getNumPartitions() < slots else column


def with_geom(df: DataFrame, geom: str, *keep: str) -> DataFrame:
    """Selects columns and builds the geometry, as if it were read from a table."""
    return compute_once(df, geom=geom).select(*keep, "geom")


def _vertices(*pairs: tuple[str, str]) -> str:
    """Millidegree expressions to a vertex array in degrees."""
    return f"array({', '.join(g.vertex(f'({x}) / 1000D', f'({y}) / 1000D') for x, y in pairs)})"


def _square(x: str, y: str, side: str) -> str:
    return _vertices(
        (x, y), (f"{x} + {side}", y), (f"{x} + {side}", f"{y} + {side}"), (x, f"{y} + {side}"), (x, y)
    )


_L_SHAPE = (
    ("x0", "y0"),
    ("x0 + w", "y0"),
    ("x0 + w", "y0 + h"),
    ("x0 + h", "y0 + h"),
    ("x0 + h", "y0 + w"),
    ("x0", "y0 + w"),
    ("x0", "y0"),
)


def _outline() -> str:
    """L-shape where k is a multiple of 3, else a square."""
    return f"CASE WHEN k % 3 = 0 THEN {_vertices(*_L_SHAPE)} ELSE {_square('x0', 'y0', 'w')} END"


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 places from ``nation``, as a gazetteer (position = k)."""
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    sized = (
        base.withColumn("lga_name", F.expr("concat('Lga ', k % 20)"))
        .withColumn("state_name", F.expr("concat('State ', k div 5)"))
        .withColumn("x0", F.expr("2600 + 2400 * (k % 5) - CASE WHEN k = 19 THEN 30000 ELSE 0 END"))
        .withColumn("y0", F.expr("4200 + 1900 * (k div 5)"))
        .withColumn("w", F.expr("CASE k WHEN 7 THEN 1 WHEN 13 THEN 2000 ELSE 800 END"))
        .withColumn("h", F.expr("w div 2"))
    )
    shown = F.expr(
        "CASE k WHEN 16 THEN 'Other Place, Other State, Nigeria' WHEN 17 THEN NULL "
        "ELSE concat(lga_name, ', ', state_name, ', Nigeria') END"
    )
    named = sized.withColumn("position", F.col("k").cast("bigint")).withColumn("display_name", shown)
    outline = f"CASE WHEN k <> 11 THEN {g.polygon(f'array({_outline()})')} END"
    return with_geom(named, outline, "k", "position", "lga_name", "state_name", "display_name")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One place per customer: many sizes, shared names, some bad geometries."""
    base = keys(spark, sf_dir, "customer", "c_custkey", "k")
    sized = (
        base.withColumn("lga_name", F.expr("concat('Lga ', k div 3)"))
        .withColumn("state_name", F.expr("concat('State ', k % 7)"))
        .withColumn("x0", F.expr("2600 + (k * 2411) % 12000 - CASE WHEN k % 19 = 0 THEN 30000 ELSE 0 END"))
        .withColumn("y0", F.expr("4100 + (k * 1907) % 9000"))
        .withColumn(
            "w", F.expr("CASE WHEN k % 17 = 3 THEN 2 WHEN k % 13 = 2 THEN 2000 ELSE 200 + (k * 37) % 500 END")
        )
        .withColumn("h", F.expr("w div 2"))
    )
    shown = F.expr(
        "CASE WHEN k % 16 = 5 THEN 'Other Place, Other State, Nigeria' WHEN k % 16 = 6 THEN NULL "
        "ELSE concat(lga_name, ', ', state_name, ', Nigeria') END"
    )
    named = sized.withColumn("position", F.col("k")).withColumn("display_name", shown)
    outline = f"CASE WHEN k % 11 <> 4 THEN {g.polygon(f'array({_outline()})')} END"
    return with_geom(named, outline, "k", "position", "lga_name", "state_name", "display_name")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order for its customer's place; repeats, blanks and misses included."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_custkey").cast("bigint").alias("k")
    )
    return o.select(
        F.expr(
            "CASE WHEN id % 101 = 7 THEN '   ' WHEN id % 97 = 9 THEN concat('Nowhere ', k) "
            "WHEN id % 6 = 1 THEN concat(' Lga ', k div 3, '  ') ELSE concat('Lga ', k div 3) END"
        ).alias("lga_name"),
        F.expr(
            "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN '' "
            "WHEN id % 6 = 2 THEN concat(' State ', k % 7) ELSE concat('State ', k % 7) END"
        ).alias("state_name"),
    )


def boundary_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per ``nation`` place, plus the awkward ones of FIXTURES.md B5."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    variants = F.expr(
        "concat(array(struct(concat('Lga ', k % 20) AS lga_name, concat('State ', k div 5) AS state_name)),"
        " CASE WHEN k IN (0, 1) THEN array(struct(concat('Lga ', k) AS lga_name, CAST(NULL AS STRING) AS state_name))"
        " WHEN k = 9 THEN array(struct('Lga 9' AS lga_name, '' AS state_name))"
        " WHEN k = 2 THEN array(struct('Nowhere' AS lga_name, 'State 0' AS state_name))"
        " WHEN k = 3 THEN array(struct('  ' AS lga_name, 'State 0' AS state_name))"
        " ELSE array() END)"
    )
    return n.select(F.inline(variants))


def _point_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = keys(spark, sf_dir, "orders", "o_orderkey", "osmid")
    tags = F.expr(
        "CASE CAST(osmid % 8 AS INT) WHEN 0 THEN map('highway', 'traffic_signals') "
        "WHEN 1 THEN map('amenity', 'hospital') WHEN 2 THEN map('amenity', 'clinic') "
        "WHEN 3 THEN map('amenity', 'pharmacy') WHEN 4 THEN map('amenity', 'school') "
        "WHEN 5 THEN map('building', 'yes', 'amenity', 'hospital') WHEN 6 THEN map('shop', 'kiosk') "
        "ELSE map('natural', 'water') END"
    )
    px, py = "2500 + (osmid * 7919) % 12500", "4000 + (osmid * 104729) % 10000"
    return base.select(
        F.lit("node").alias("element_type"), "osmid", tags.alias("tags"), F.expr(px).alias("px"), F.expr(py).alias("py")
    )


_SPOT = g.point("px / 1000D", "py / 1000D")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_geom(_point_base(spark, sf_dir), _SPOT, "element_type", "osmid", "tags")


def changed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points a day later: by column of places some are gone, moved, tagged anew so that layers differ,
    tagged anew so that none does, or there twice; south of 8 degrees only."""
    south = _point_base(spark, sf_dir).withColumn("col", F.expr("CASE WHEN py < 8000 THEN floor((px - 2600) / 2400) END"))
    tags = (
        "CASE WHEN col = 2 AND osmid % 8 = 4 THEN map('amenity', 'hospital') "
        "WHEN col = 3 AND osmid % 8 = 6 THEN map('shop', 'bakery') ELSE tags END"
    )
    kept = south.where("coalesce(col, -1) <> 0 OR osmid % 10 <> 0").withColumn("tags", F.expr(tags))
    moved = kept.withColumn("px", F.expr("CASE WHEN col = 1 AND osmid % 10 = 1 THEN px + 1 ELSE px END"))
    twice = moved.withColumn("n", F.expr("explode(CASE WHEN col = 4 AND osmid % 10 = 3 THEN array(1, 2) ELSE array(1) END)"))
    return with_geom(twice, _SPOT, "element_type", "osmid", "tags")


_LINE_TAGS = (
    "CASE CAST(osmid % 4 AS INT) WHEN 0 THEN map('highway', 'residential') "
    "WHEN 1 THEN map('waterway', 'stream') WHEN 2 THEN map('highway', 'primary') "
    "ELSE map('railway', 'rail') END"
)


def _line_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        keys(spark, sf_dir, "part", "p_partkey", "osmid")
        .withColumn("bx", F.expr("2500 + (osmid * 7919) % 12400"))
        .withColumn("bz", F.expr("4000 + (osmid * 4729) % 9900"))
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vertices(("bx", "bz"), ("bx + 40", "bz + 25"), ("bx + 80", "bz + 10"))
    tagged = _line_base(spark, sf_dir).select(
        F.lit("way").alias("element_type"), "osmid", F.expr(_LINE_TAGS).alias("tags"), "bx", "bz"
    )
    return with_geom(tagged, g.line(path), "element_type", "osmid", "tags")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (
        keys(spark, sf_dir, "customer", "c_custkey", "osmid")
        .withColumn("d", F.expr("CASE WHEN osmid % 40 = 39 THEN osmid - 1 ELSE osmid END"))
        .withColumn("bx", F.expr("2500 + (d * 7919) % 12400"))
        .withColumn("bz", F.expr("4000 + (d * 4729) % 9900"))
        .withColumn("s", F.expr("2 + d % 5"))
        .withColumn(
            "state",
            F.expr(
                "CASE WHEN osmid % 97 = 13 THEN 'null' WHEN osmid % 101 = 5 THEN 'empty' "
                "WHEN d % 50 = 7 THEN 'bowtie' ELSE 'ok' END"
            ),
        )
    )
    square = _square("bx", "bz", "s")
    bowtie = _vertices(("bx", "bz"), ("bx + s", "bz"), ("bx", "bz + s"), ("bx + s", "bz + s"), ("bx", "bz"))
    tags = F.expr(
        "CASE CAST(d % 6 AS INT) WHEN 0 THEN map('building', 'yes') WHEN 1 THEN map('landuse', 'farmland') "
        "WHEN 2 THEN map('amenity', 'school') WHEN 3 THEN map('amenity', 'hospital', 'building', 'yes') "
        "WHEN 4 THEN map('natural', 'water') ELSE map('amenity', 'bank') END"
    )
    geom = (
        f"CASE state WHEN 'ok' THEN {g.polygon(f'array({square})')} "
        f"WHEN 'bowtie' THEN {g.polygon(f'array({bowtie})')} "
        f"WHEN 'empty' THEN {g.geometry(repr('Polygon'), 'array()')} END"
    )
    tagged = base.withColumn("element_type", F.lit("way")).withColumn("tags", tags)
    return with_geom(tagged, geom, "element_type", "osmid", "tags")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        points(spark, sf_dir).unionByName(lines(spark, sf_dir)).unionByName(polygons(spark, sf_dir))
    )


def broken_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outline per supplier with a defect by turns: open ring, repeated vertex,
    flat hole, flat shell, crossing edges, or none."""
    base = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("osmid"))
        .withColumn("bx", F.expr("2500 + (osmid * 7919) % 12400"))
        .withColumn("bz", F.expr("4000 + (osmid * 4729) % 9900"))
        .withColumn("s", F.expr("2 + osmid % 5"))
    )
    square = _square("bx", "bz", "s")
    opened = _vertices(("bx", "bz"), ("bx + s", "bz"), ("bx + s", "bz + s"), ("bx", "bz + s"))
    repeated = _vertices(
        ("bx", "bz"), ("bx", "bz"), ("bx + s", "bz"), ("bx + s", "bz"), ("bx + s", "bz + s"), ("bx", "bz + s")
    )
    flat = _vertices(("bx", "bz"), ("bx + s", "bz"), ("bx + 1", "bz"), ("bx", "bz"))
    crossed = _vertices(("bx", "bz"), ("bx + s", "bz"), ("bx", "bz + s"), ("bx + s", "bz + s"), ("bx", "bz"))
    outline = (
        f"CASE CAST(osmid % 6 AS INT) WHEN 0 THEN array({opened}) WHEN 1 THEN array({repeated}) "
        f"WHEN 2 THEN array({square}, {flat}) WHEN 3 THEN array({flat}) WHEN 4 THEN array({crossed}) "
        f"ELSE array({square}) END"
    )
    return with_geom(base.withColumn("element_type", F.lit("way")), g.polygon(outline), "element_type", "osmid")


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node references of the lines; every seventh way returns to its first node."""
    refs = F.expr(
        "concat(transform(sequence(0, 2), p -> struct(p AS pos, osmid * 10 + p AS node_id)),"
        " CASE WHEN osmid % 7 = 0 THEN array(struct(3 AS pos, osmid * 10 AS node_id)) ELSE array() END)"
    )
    return (
        _line_base(spark, sf_dir)
        .select(F.col("osmid").alias("way_id"), F.explode(refs).alias("r"))
        .select("way_id", "r.pos", "r.node_id")
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = F.expr(
        "array(struct(osmid * 10 AS node_id, bx AS mx, bz AS my),"
        " struct(osmid * 10 + 1 AS node_id, bx + 40 AS mx, bz + 25 AS my),"
        " struct(osmid * 10 + 2 AS node_id, bx + 80 AS mx, bz + 10 AS my))"
    )
    return (
        _line_base(spark, sf_dir)
        .select(F.explode(spots).alias("n"))
        .select(
            "n.node_id", (F.col("n.mx") / F.lit(1000.0)).alias("x"), (F.col("n.my") / F.lit(1000.0)).alias("y")
        )
    )


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Way tags: those of the lines, and a building tag on every closed second one."""
    tags = F.expr(f"CASE WHEN osmid % 14 = 0 THEN map('building', 'yes') ELSE {_LINE_TAGS} END")
    return _line_base(spark, sf_dir).select(F.col("osmid").alias("way_id"), tags.alias("tags"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with a made-up token appended to every tenth."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.expr(
            "CASE WHEN doc_id % 10 = 0 THEN concat(text, ' pk.eyJ', doc_id, '.x', doc_id, ' end') ELSE text END"
        ).alias("text"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multipolygon relation per supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("relation_id"),
        F.expr("map('landuse', 'farmland')").alias("tags"),
    )


def relation_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shells and a hole each; by turns the second shell is missing or open, or
    the relation has no member at all."""
    members = F.expr(
        "CASE WHEN r % 7 = 3 THEN array() ELSE array("
        "struct(0 AS pos, r * 10 AS way_id, 'outer' AS role),"
        " struct(1 AS pos, r * 10 + 1 AS way_id, 'inner' AS role),"
        " struct(2 AS pos, r * 10 + 2 AS way_id, 'outer' AS role)) END"
    )
    return (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("r"))
        .select(F.col("r").alias("relation_id"), F.inline(members))
    )


def relation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member ways of those relations, as way_paths would give them."""
    base = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("r"))
        .withColumn("bx", F.expr("2500 + (r * 7919) % 12400"))
        .withColumn("bz", F.expr("4000 + (r * 4729) % 9900"))
    )
    first, hole, second = (
        _square("bx", "bz", "20"),
        _square("(bx + 5)", "(bz + 5)", "5"),
        _square("(bx + 40)", "bz", "10"),
    )
    ways_ = (
        f"array(struct(r * 10 AS way_id, {first} AS path), struct(r * 10 + 1 AS way_id, {hole} AS path),"
        f" struct(r * 10 + 2 AS way_id, CASE WHEN r % 5 = 2 THEN slice({second}, 1, 4) ELSE {second} END AS path))"
    )
    listed = f"CASE WHEN r % 5 = 1 THEN slice({ways_}, 1, 2) ELSE {ways_} END"
    return base.select(F.inline(F.expr(listed))).withColumn("missing", F.lit(0).cast("bigint"))


def ragged_way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references of ``way_nodes`` with gaps: some ways have none, some one to a node that is absent."""
    gap = F.when((F.col("way_id") % 13 == 5) & (F.col("pos") == 1), -F.col("way_id")).otherwise(F.col("node_id"))
    return way_nodes(spark, sf_dir).where("way_id % 11 <> 3").withColumn("node_id", gap)


def nested_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An island in a lake in an island for each supplier, a stray hole, and a label.

    The outermost shell has a blank role or none by turns.
    """
    members = F.expr(
        "array(struct(0 AS pos, r * 10 AS way_id, CASE WHEN r % 2 = 0 THEN '' END AS role),"
        " struct(1 AS pos, r * 10 + 1 AS way_id, 'inner' AS role),"
        " struct(2 AS pos, r * 10 + 2 AS way_id, 'outer' AS role),"
        " struct(3 AS pos, r * 10 + 3 AS way_id, 'inner' AS role),"
        " struct(4 AS pos, r * 10 + 4 AS way_id, 'inner' AS role),"
        " struct(5 AS pos, r * 10 + 5 AS way_id, 'label' AS role))"
    )
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("r"))
    return base.select(F.col("r").alias("relation_id"), F.inline(members))


def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member ways of ``nested_members``: squares of 40, 30, 20 and 10, and one outside all of them."""
    base = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("r"))
        .withColumn("bx", F.expr("2500 + (r * 7919) % 12400"))
        .withColumn("bz", F.expr("4000 + (r * 4729) % 9900"))
    )
    squares = [("0", "40"), ("5", "30"), ("10", "20"), ("15", "10"), ("60", "4")]
    paths = ", ".join(
        f"struct(r * 10 + {i} AS way_id, {_square(f'(bx + {at})', f'(bz + {at})', side)} AS path)"
        for i, (at, side) in enumerate(squares)
    )
    return base.select(F.inline(F.expr(f"array({paths})"))).withColumn("missing", F.lit(0).cast("bigint"))


def mixed_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broken polygons of three areas, every second one twice, and some null geometries."""
    once = broken_polygons(spark, sf_dir).select(
        F.expr("concat('a', osmid % 3)").alias("lga_id"), F.lit("landuse").alias("layer"), "element_type", "osmid", "geom"
    )
    again = once.where("osmid % 2 = 0").withColumn("osmid", F.col("osmid") + 1_000_000)
    none = once.where("osmid % 10 = 0").withColumn("geom", F.lit(None).cast(g.GEOMETRY))
    return once.unionByName(again).unionByName(none)


def metric_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square of 1 to 1.5 km for each supplier, in metres of two zones."""
    base = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("osmid"))
        .withColumn("e", F.expr("400000 + (osmid * 7919) % 200000"))
        .withColumn("n", F.expr("800000 + (osmid * 4729) % 200000"))
        .withColumn("s", F.expr("1000 + osmid % 500"))
        .withColumn("srid", F.expr("CAST(32631 + osmid % 2 AS INT)"))
    )
    pairs = (("e", "n"), ("e + s", "n"), ("e + s", "n + s"), ("e", "n + s"), ("e", "n"))
    ring = f"array({', '.join(g.vertex(x, y) for x, y in pairs)})"
    keyed = base.select(
        "*", F.lit("a").alias("lga_id"), F.lit("landuse").alias("layer"), F.lit("way").alias("element_type"),
        F.col("srid").alias("target_srid"),
    )
    return with_geom(keyed, g.polygon(f"array({ring})", "srid"), "lga_id", "layer", "element_type", "osmid", "target_srid")


def _open_ring_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier r: m, the open ways of its first ring, and i, one row a way, those of the second ring included."""
    sized = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("r"))
        .withColumn("m", F.expr("CASE WHEN (3 + r % 38) % 7 = 0 THEN 4 + r % 38 ELSE 3 + r % 38 END"))
        .withColumn("two", F.expr("r % 2 = 0 OR r % 11 = 6"))
    )
    return sized.withColumn("i", F.expr("explode(sequence(0L, m - 1 + IF(two, 2, 0)))"))


def open_ring_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of rings in up to 40 open ways, shuffled; by turns one is absent."""
    base = _open_ring_base(spark, sf_dir).where("NOT (r % 11 = 4 AND i = 1)")
    return base.selectExpr(
        "r AS relation_id", "CAST(CASE WHEN i < m THEN (i * 7 + r) % m ELSE i END AS INT) AS pos", "r * 100 + i AS way_id", "'outer' AS role"
    )


def open_ring_way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their node references: two ends with a node between them, a third of the ways drawn backwards.

    By turns the ring touches itself at a node, or the second ring lacks its middle nodes and is flat.
    """
    fork = "CASE WHEN r % 11 = 5 AND {0} = m div 2 THEN 0 ELSE {0} END"
    ends = f"array({fork.format('i')}, 500 + i, {fork.format('(i + 1) % m')})"
    drawn = f"CASE WHEN (r + i) % 3 = 0 THEN reverse({ends}) ELSE {ends} END"
    second = "CASE WHEN r % 11 = 6 THEN array(900L, 901L) ELSE array(900L, 902 + i - m, 901L) END"
    refs = _open_ring_base(spark, sf_dir).withColumn("refs", F.expr(f"CASE WHEN i < m THEN {drawn} ELSE {second} END"))
    return refs.select(
        F.expr("r * 100 + i").alias("way_id"), "r", F.posexplode("refs").alias("pos", "n")
    ).select("way_id", "pos", F.expr("r * 1000 + n").alias("node_id"))


def open_ring_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of those nodes, in millidegrees from a corner of each supplier's own."""
    numbered = (
        _open_ring_base(spark, sf_dir)
        .select("r", "m")
        .distinct()
        .withColumn("n", F.expr("explode(concat(sequence(0L, m - 1), sequence(500L, 499 + m), sequence(900L, 903L)))"))
    )
    x = "2500 + (r * 7919) % 12400 + CASE WHEN n < 500 THEN (n * 37) % 50 WHEN n < 900 THEN n - 440 ELSE 10 * (n - 900) END"
    y = "4000 + (r * 4729) % 9900 + CASE WHEN n < 500 THEN (n * n) % 53 WHEN n < 900 THEN n - 500 ELSE (n - 900) * (n - 900) END"
    return numbered.selectExpr("r * 1000 + n AS node_id", f"({x}) / 1000D AS x", f"({y}) / 1000D AS y")


_WIDE_U = (("x0", "y0"), ("x0 + 3000", "y0"), ("x0 + 3000", "y0 + 3000"), ("x0 + 2600", "y0 + 3000"), ("x0 + 2600", "y0 + 400"),
           ("x0 + 400", "y0 + 400"), ("x0 + 400", "y0 + 3000"), ("x0", "y0 + 3000"), ("x0", "y0"))
_WIDE_LINE = (("x0", "y0"), ("x0 + 3500", "y0 + 900"), ("x0 + 300", "y0 + 2500"))


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features much wider than a grid cell, one per supplier: squares, long lines and open frames by turns."""
    base = (
        keys(spark, sf_dir, "supplier", "s_suppkey", "osmid")
        .withColumn("x0", F.expr("2300 + (osmid * 7919) % 9000"))
        .withColumn("y0", F.expr("3900 + (osmid * 4729) % 7000"))
    )
    shape = (
        f"CASE CAST(osmid % 3 AS INT) WHEN 0 THEN {g.polygon('array(' + _square('x0', 'y0', '2500') + ')')} "
        f"WHEN 1 THEN {g.line(_vertices(*_WIDE_LINE))} ELSE {g.polygon('array(' + _vertices(*_WIDE_U) + ')')} END"
    )
    return with_geom(base, shape, "osmid")


def overlapping_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four outlines for each supplier: one with a hole, and others that overlap, nest in and touch it."""
    base = (
        table(spark, sf_dir, "supplier")
        .select(F.col("s_suppkey").cast("bigint").alias("r"))
        .withColumn("bx", F.expr("2500 + (r * 7919) % 12400"))
        .withColumn("bz", F.expr("4000 + (r * 4729) % 9900"))
        .withColumn("shift", F.expr("10 + r % 7"))
    )
    first = f"array({_square('bx', 'bz', '20')}, {_square('(bx + 6)', '(bz + 6)', '4')})"
    others = [f"array({_square(x, y, side)})" for x, y, side in (("(bx + shift)", "(bz + 5)", "20"), ("(bx + 2)", "(bz + 2)", "5"), ("(bx - 10)", "bz", "10"))]
    shapes = ", ".join(g.polygon(rings) for rings in (first, *others))
    return base.select("r", F.expr(f"explode(array({shapes}))").alias("geom"))
