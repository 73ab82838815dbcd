"""Area and centroid of the union of outlines, by trapezoids.

Between two neighbouring heights at which an edge begins, ends or crosses another, the edges of a
group do not touch: sorted from west to east they bound trapezoids.  With every ring turned so that
its inside lies to its left, a running sum over the edges counts how many outlines cover each
trapezoid; those covered at least once are the union, each counted once however many overlap.

Edges and heights of a group meet in bands of heights, about the square root of its edges in number, so
neither all pairs of its edges nor all its outlines are ever in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.operators.scale import compute_once, through_table


def _edges(shapes: DataFrame, key: str) -> DataFrame:
    """Edges that are not level, lower end first; turn is 1 where the inside begins to the east, -1 where it ends."""
    parts = shapes.where(g.is_area("geom")).select(F.col(key).alias("_key"), F.explode("geom.parts").alias("_part"))
    rings = parts.select("_key", F.posexplode("_part").alias("_nth", "_ring"))
    drawn = compute_once(rings, _segments=g.segments(g.closed("_ring")))
    twice = "aggregate(_segments, 0D, (a_, e_) -> a_ + (e_.x1 - _segments[0].x1) * (e_.y2 - _segments[0].y1) - (e_.x2 - _segments[0].x1) * (e_.y1 - _segments[0].y1))"
    turned = compute_once(drawn, _way=f"CASE WHEN ({twice} > 0) = (_nth = 0) THEN 1 ELSE -1 END")
    flat = turned.where("size(_segments) > 2").select("_key", "_way", F.explode("_segments").alias("e")).where("e.y1 <> e.y2")
    low, high = "IF(e.y1 < e.y2, {}1, {}2)", "IF(e.y1 < e.y2, {}2, {}1)"
    return flat.selectExpr(
        "_key",
        "IF(e.y1 > e.y2, _way, -_way) AS turn",
        *[f"{pick.format(f'e.{c}', f'e.{c}')} AS {c}{i}" for i, pick in ((1, low), (2, high)) for c in "xy"],
    )


def _at(y: str, e: str = "") -> str:
    """Where an edge is at a height; exact at its ends."""
    x1, y1, x2, y2 = (f"{e}{c}" for c in ("x1", "y1", "x2", "y2"))
    return f"CASE WHEN {y} = {y1} THEN {x1} WHEN {y} = {y2} THEN {x2} ELSE {x1} + ({x2} - {x1}) * ({y} - {y1}) / ({y2} - {y1}) END"


def _crossings(banded: DataFrame) -> DataFrame:
    """Heights at which two edges of a group cross, found in the first band that both reach."""
    one, two = (banded.select("_key", "_band", *[F.col(c).alias(f"{p}{c}") for c in ("_id", "_first", "x1", "y1", "x2", "y2")]) for p in ("a", "b"))
    pairs = one.join(two, ["_key", "_band"]).where(
        "a_id < b_id AND _band = greatest(a_first, b_first) AND ay1 < by2 AND by1 < ay2 "
        "AND least(ax1, ax2) <= greatest(bx1, bx2) AND least(bx1, bx2) <= greatest(ax1, ax2)"
    )
    # The distance between both changes its sign between the heights they share.
    shared = compute_once(pairs, _lo="greatest(ay1, by1)", _hi="least(ay2, by2)")
    apart = compute_once(shared, _dl=f"({_at('_lo', 'a')}) - ({_at('_lo', 'b')})", _dh=f"({_at('_hi', 'a')}) - ({_at('_hi', 'b')})")
    return apart.where("_dl * _dh < 0").selectExpr("_key", "_lo + (_hi - _lo) * _dl / (_dl - _dh) AS y")


def dissolved(shapes: DataFrame, key: str) -> DataFrame:
    """``key``, area, x and y (centroid) of the union of all polygons ``geom`` of each key.

    In the units of the coordinates.  Outlines may overlap, nest, touch and repeat; rings may run either
    way; a hole of one outline that another covers is covered.  Keys without an area are left out.
    """
    edges = _edges(shapes, key).withColumn("_id", F.monotonically_increasing_id())
    edges = through_table(edges)  # numbered once
    spread = edges.groupBy("_key").agg(
        F.min("y1").alias("_y0"), F.max("y2").alias("_y9"), F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_bands")
    )
    band = "least(_bands - 1, CAST(floor(({} - _y0) / (_y9 - _y0) * _bands) AS BIGINT))"
    placed = compute_once(edges.join(spread, "_key"), _first=band.format("y1"), _last=band.format("y2"))
    banded = placed.withColumn("_band", F.expr("explode(sequence(_first, _last))"))
    heights = edges.selectExpr("_key", "explode(array(y1, y2)) AS y").unionByName(_crossings(banded)).distinct()
    above = F.lead("y").over(Window.partitionBy("_key").orderBy("y")).alias("_top")
    slabs = heights.select("_key", F.col("y").alias("_low"), above).where("_top IS NOT NULL").join(spread, "_key")
    slabs = slabs.selectExpr("_key", "_low", "_top", f"{band.format('_low')} AS _band")
    through = banded.drop("_y0", "_y9", "_bands").join(slabs, ["_key", "_band"]).where("y1 <= _low AND y2 >= _top")
    sides = compute_once(through, _xl=_at("_low"), _xh=_at("_top"))
    row = Window.partitionBy("_key", "_low").orderBy(F.col("_xl") + F.col("_xh"), "_id")
    counted = sides.select(
        "_key", "_low", "_top", "_xl", "_xh",
        F.sum("turn").over(row.rowsBetween(Window.unboundedPreceding, 0)).alias("_cover"),
        F.lead("_xl").over(row).alias("_rl"), F.lead("_xh").over(row).alias("_rh"),
    )
    covered = compute_once(
        counted.where("_cover > 0 AND _rl IS NOT NULL"),
        h="_top - _low", w0="_rl - _xl", w1="_rh - _xh", c0="(_rl + _xl) / 2", c1="(_rh + _xh) / 2",
    )
    total = covered.groupBy("_key").agg(
        F.expr("sum(h * (w0 + w1) / 2)").alias("area"),
        F.expr("sum(h * (w0 * c0 + (w0 * (c1 - c0) + c0 * (w1 - w0)) / 2 + (w1 - w0) * (c1 - c0) / 3))").alias("_mx"),
        F.expr("sum(h * (w0 * _low + (w0 * h + _low * (w1 - w0)) / 2 + (w1 - w0) * h / 3))").alias("_my"),
    )
    return total.where("area > 0").selectExpr(f"_key AS `{key}`", "area", "_mx / area AS x", "_my / area AS y")
