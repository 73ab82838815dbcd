"""Map elements: the tagged element table, and its assembly from raw map data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.operators.rules import any_layer, split_rules, tag_reader
from areaweave.operators.scale import compute_once, through_table
from areaweave.operators.spatial import within_extent
from areaweave.settings import DEFAULT_RULES, FIXED_POINT
from areaweave.sources import rings

# Height of the bands in which elements are stored.
ROW_DEGREES = 0.25

# A closed way with one of these keys is an area, unless tagged area=no.
AREA_KEYS = ("building", "landuse", "amenity", "natural")


def rule_keys(rules: dict | None = None) -> list[str]:
    """Tag keys the rules look at, each once, in rule order."""
    good, _ = split_rules(rules)
    return list(dict.fromkeys(key for selectors in good.values() for key in selectors))


def write_elements(elements: DataFrame, path: str, keys: Iterable[str] | None = None) -> None:
    """Store elements with the queried tags and the bounding box as columns, ordered by place.

    Parquet keeps statistics for those, so a later scan skips row groups by tag
    and by area; neither works on a map or a nested geometry.  Files hold bands of
    ``ROW_DEGREES`` from west to east, so each row group's box is small.
    """
    keys = rule_keys(DEFAULT_RULES) if keys is None else list(keys)
    wide = compute_once(elements, box=g.fixed_bounds("geom"))
    wide = wide.select(
        *elements.columns,
        *[F.element_at("tags", key).alias(f"tag_{key}") for key in keys],
        *[F.col(f"box.{side}").alias(f"box_{side}") for side in ("x0", "y0", "x1", "y1")],
    )
    band = F.expr(f"box_y0 div {int(ROW_DEGREES * FIXED_POINT)}")
    ordered = wide.withColumn("_band", band).repartitionByRange("_band", "box_x0")
    placed = ordered.sortWithinPartitions("_band", "box_x0").drop("_band")
    placed.write.mode("overwrite").parquet(path)


def read_elements(
    spark: SparkSession,
    path: str,
    rules: dict | None = None,
    extent: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """Elements that match any rule, and may lie in ``extent`` (fixed point).

    Both conditions reach the Parquet scan when the table was written by
    ``write_elements``.
    """
    table = spark.read.parquet(path)
    good, _ = split_rules(rules)
    found = table.where(any_layer(tag_reader(table), good))
    return within_extent(found, extent)


def is_area_way(tags: Column) -> Column:
    tagged = F.lit(False)
    for key in AREA_KEYS:
        tagged = tagged | F.element_at(tags, key).isNotNull()
    explicit = F.element_at(tags, "area")
    return F.coalesce(explicit == "yes", F.lit(False)) | (tagged & F.coalesce(explicit != "no", F.lit(True)))


def assemble_points(nodes: DataFrame) -> DataFrame:
    """Tagged nodes (node_id, x, y, tags) as point elements."""
    return nodes.where(F.size("tags") > 0).select(
        F.lit("node").alias("element_type"),
        F.col("node_id").alias("osmid"),
        "tags",
        F.expr(g.point("x", "y")).alias("geom"),
    )


def way_paths(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vertex list of every way: (way_id, path, missing, first_node, last_node).

    ``way_nodes`` is (way_id, pos, node_id), ``nodes`` is (node_id, x, y).  Nodes
    absent from the extract are counted and left out of the path.  One way becomes one row by
    nature; everything else is an equi-join on the node id, whose skew adaptive
    execution splits.
    """
    placed = way_nodes.join(nodes.select("node_id", "x", "y"), "node_id", "left")
    stop = F.when(F.col("x").isNotNull(), F.struct("pos", F.expr(g.vertex("x", "y")).alias("v")))
    return placed.groupBy("way_id").agg(
        F.transform(F.array_sort(F.collect_list(stop)), lambda s: s["v"]).alias("path"),
        F.sum(F.when(F.col("x").isNull(), 1).otherwise(0)).cast("bigint").alias("missing"),
        F.min_by("node_id", "pos").alias("first_node"),
        F.max_by("node_id", "pos").alias("last_node"),
    )


_CLOSED_PATH = "(size(path) >= 4 AND get(path, 0) = element_at(path, -1))"


def assemble_ways(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways (way_id, tags) as line or polygon elements, and rejects (way_id, reason).

    Closed and area-tagged ways are polygons, all others lines.  A way without a
    reference, or with a node that the extract lacks, would be another shape than
    it is drawn; it is rejected as ``no_nodes`` or ``node_missing``.
    """
    built = ways.join(way_paths(way_nodes, nodes), "way_id", "left").withColumn("is_area", is_area_way(F.col("tags")))
    judged = built.withColumn(
        "reason", F.when(F.col("missing").isNull(), "no_nodes").when(F.col("missing") > 0, "node_missing")
    )
    shape = f"CASE WHEN is_area AND {_CLOSED_PATH} THEN {g.polygon('array(path)')} ELSE {g.line('path')} END"
    elements = compute_once(judged.where(F.col("reason").isNull()), geom=shape).select(
        F.lit("way").alias("element_type"), F.col("way_id").alias("osmid"), "tags", "geom"
    )
    return elements, judged.where(F.col("reason").isNotNull()).select("way_id", "reason")


def _owned_holes(shells: DataFrame, holes: DataFrame) -> DataFrame:
    """Holes (relation_id, pos, hole) with ``shell``, the smallest one that contains them, or null.

    Candidates come from an equi-join on the relation with the boxes compared in its
    condition, so neither a relation's rings nor its pairs of rings meet in one row; the exact
    test is whether the hole's first vertex that is not on the shell lies inside it.
    """
    edges = compute_once(shells, shell_edges=g.segments(g.fixed_path("path")), box=g.path_bounds("path"))
    sized = compute_once(edges, size=g.area(g.polygon("array(path)"))).select(
        "relation_id", F.col("pos").alias("shell"), "shell_edges", F.col("box").alias("outer_box"), "size"
    )
    placed = compute_once(holes, box=g.path_bounds("path"), spots=g.fixed_path("path"))
    inside = (
        (F.col("outer_box.x0") <= F.col("box.x0"))
        & (F.col("outer_box.y0") <= F.col("box.y0"))
        & (F.col("outer_box.x1") >= F.col("box.x1"))
        & (F.col("outer_box.y1") >= F.col("box.y1"))
    )
    near = placed.join(sized, (placed["relation_id"] == sized["relation_id"]) & inside).select(
        placed["relation_id"], "pos", "shell", "size", "spots", "shell_edges"
    )
    off = f"get(filter(spots, v_ -> NOT exists(shell_edges, e_ -> {g.on_edge('e_', 'v_.x', 'v_.y')})), 0)"
    crossed = f"size(filter(shell_edges, e_ -> {g.edge_is_crossed('e_', 'o_.x', 'o_.y')})) % 2 = 1"
    held = near.where(F.expr(g.let("o_", off, f"o_ IS NULL OR {crossed}")))
    owner = held.groupBy("relation_id", "pos").agg(F.min_by("shell", F.struct("size", "shell")).alias("shell"))
    return holes.join(owner, ["relation_id", "pos"], "left")


def assemble_relations(relations: DataFrame, members: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multipolygon relations as (elements, rejects).

    ``relations`` is (relation_id, tags), ``members`` is (relation_id, pos, way_id,
    role) and ``paths`` comes from ``way_paths``.  A member with a blank role or none
    is an outer one.  Open members of one role that meet end to end are one ring, which stands where
    its first member does (``rings.stitch``; where ``paths`` lacks the end nodes, ends meet at equal
    vertices).  Every outer ring is a shell, and an inner one a hole of the smallest shell that contains it.

    ``rejects`` has (relation_id, way_id, reason).  Without way_id the whole relation is
    rejected: no_members, member_missing, no_outer, member_not_closed (an open end),
    ring_branches (more than two ends at a node), ring_too_short.  With it the relation
    stands and that member, or the ring it begins, is left out: unknown_role, hole_without_shell.
    """
    role = F.coalesce(F.nullif(F.trim(F.lower("role")), F.lit("")), F.lit("outer"))
    if "first_node" not in paths.columns:
        paths = paths.withColumn("first_node", F.get("path", F.lit(0))).withColumn("last_node", F.element_at("path", -1))
    known_paths = paths.select("way_id", "path", "missing", "first_node", "last_node")
    placed = through_table(members.join(known_paths, "way_id", "left").withColumn("role", role))
    known = F.col("role").isin("outer", "inner")
    whole = F.col("path").isNotNull() & (F.coalesce("missing", F.lit(0)) == 0)
    ring = placed.groupBy("relation_id").agg(
        F.bool_and(~known | whole).alias("all_found"),
        F.bool_or(F.col("role") == "outer").alias("any_outer"),
    )
    reason = (
        F.when(F.col("all_found").isNull(), "no_members")
        .when(~F.col("all_found"), "member_missing")
        .when(~F.col("any_outer"), "no_outer")
    )
    told = relations.join(ring.hint("merge"), "relation_id", "left").withColumn("reason", reason)
    closed = F.coalesce(F.expr(_CLOSED_PATH), F.lit(False))
    usable = placed.where(known).join(told.where(F.col("reason").isNull()).select("relation_id").hint("merge"), "relation_id", "left_semi")
    stitched, unfit = rings.stitch(usable.where(~closed))
    judged = told.join(unfit.withColumnRenamed("reason", "_unfit").hint("merge"), "relation_id", "left")
    judged = through_table(judged.withColumn("reason", F.coalesce("reason", "_unfit")).select("relation_id", "tags", "reason"))
    sound = judged.where(F.col("reason").isNull()).select("relation_id", "tags")
    columns = ["relation_id", "role", "pos", "way_id", "path"]
    whole_rings = usable.where(closed).select(*columns).unionByName(stitched.select(*columns))
    whole_rings = whole_rings.join(sound.select("relation_id").hint("merge"), "relation_id", "left_semi")
    shells = whole_rings.where("role = 'outer'").select("relation_id", "pos", "path")
    holes = _owned_holes(shells, whole_rings.where("role = 'inner'").select("relation_id", "pos", "way_id", "path"))

    # A part is its shell (pos null, so first) and its holes in order.
    of_part = shells.select("relation_id", F.col("pos").alias("shell"), F.lit(None).cast("int").alias("pos"), "path")
    of_part = of_part.unionByName(
        holes.where("shell IS NOT NULL").select("relation_id", "shell", F.col("pos").cast("int").alias("pos"), "path")
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(-1)).alias("pos"), "path")))
    parts = of_part.groupBy("relation_id", "shell").agg(F.transform(ordered, lambda r: r["path"]).alias("part"))
    listed = F.array_sort(F.collect_list(F.struct("shell", "part")))
    shapes = parts.groupBy("relation_id").agg(F.transform(listed, lambda p: p["part"]).alias("parts"))
    elements = compute_once(sound.hint("merge").join(shapes, "relation_id"), geom=g.geometry("'MultiPolygon'", "parts")).select(
        F.lit("relation").alias("element_type"), F.col("relation_id").alias("osmid"), "tags", "geom"
    )
    whole_rejects = judged.where(F.col("reason").isNotNull()).select(
        "relation_id", F.lit(None).cast("bigint").alias("way_id"), "reason"
    )
    odd = placed.where(~known).select("relation_id", F.col("way_id").cast("bigint"), F.lit("unknown_role").alias("reason"))
    stray = holes.where("shell IS NULL").select(
        "relation_id", F.col("way_id").cast("bigint"), F.lit("hole_without_shell").alias("reason")
    )
    return elements, whole_rejects.unionByName(odd).unionByName(stray)
