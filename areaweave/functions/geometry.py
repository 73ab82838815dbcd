"""The geometry column and its measures, as Spark SQL fragments.

A geometry is ``struct<gtype, srid, parts>`` where ``parts`` nests
part -> ring -> vertex.  A point is one part with one ring of one vertex; ring 0
of a polygon part is its shell, the other rings are holes.

Every function takes SQL text (usually a column name) and returns SQL text for
``F.expr``; long formulas stay readable that way, and the whole expression is
handed to Spark in one piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import types as T

from areaweave.settings import EXACT_EXTENT, FIXED_POINT, GEOMETRY_CATEGORY, METRIC_POINT, WGS84

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(VERTEX)
PARTS = T.ArrayType(T.ArrayType(RING))
GEOMETRY = T.StructType(
    [
        T.StructField("gtype", T.StringType()),
        T.StructField("srid", T.IntegerType()),
        T.StructField("parts", PARTS),
    ]
)
VERTEX_SQL, PARTS_SQL, GEOMETRY_SQL = (t.simpleString() for t in (VERTEX, PARTS, GEOMETRY))


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"


# --- constructors ------------------------------------------------------------


def vertex(x: str, y: str) -> str:
    return f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def geometry(gtype: str, parts: str, srid: str | int = WGS84) -> str:
    """``gtype`` is SQL text too, so a literal type name needs its quotes."""
    return (
        f"CAST(named_struct('gtype', {gtype}, 'srid', CAST({srid} AS INT), "
        f"'parts', CAST({parts} AS {PARTS_SQL})) AS {GEOMETRY_SQL})"
    )


def point(x: str, y: str, srid: str | int = WGS84) -> str:
    return geometry("'Point'", f"array(array(array({vertex(x, y)})))", srid)


def line(path: str, srid: str | int = WGS84) -> str:
    return geometry("'LineString'", f"array(array({path}))", srid)


def polygon(rings_: str, srid: str | int = WGS84) -> str:
    return geometry("'Polygon'", f"array({rings_})", srid)


# --- type and emptiness ------------------------------------------------------


def category(geom: str) -> str:
    """point / line / polygon, or other for any other type name."""
    cases = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in GEOMETRY_CATEGORY.items())
    return f"CASE {geom}.gtype {cases} ELSE 'other' END"


def is_area(geom: str) -> str:
    return f"coalesce({geom}.gtype IN ('Polygon', 'MultiPolygon'), false)"


def rings(geom: str) -> str:
    return f"flatten({geom}.parts)"


def vertices(geom: str) -> str:
    return f"flatten(flatten({geom}.parts))"


def usable(geom: str) -> str:
    """Neither null nor without a single vertex."""
    return f"coalesce(exists({rings(geom)}, ring_ -> size(ring_) > 0), false)"


def is_empty(geom: str) -> str:
    """Not null, but without a single vertex."""
    return f"({geom} IS NOT NULL AND NOT {usable(geom)})"


def assume_wgs84(geom: str) -> str:
    return (
        f"CASE WHEN {geom} IS NOT NULL THEN named_struct('gtype', {geom}.gtype, "
        f"'srid', coalesce({geom}.srid, {WGS84}), 'parts', {geom}.parts) END"
    )


def first_vertex(geom: str) -> str:
    return f"get(get(get({geom}.parts, 0), 0), 0)"


# --- planar measures ---------------------------------------------------------


def closed(ring: str) -> str:
    """The ring with its first vertex repeated at the end, if it is not already."""
    return let(
        "c_",
        ring,
        "CASE WHEN size(c_) > 0 AND get(c_, 0) <> element_at(c_, -1) "
        "THEN concat(c_, slice(c_, 1, 1)) ELSE c_ END",
    )


def segments(path: str) -> str:
    """Each vertex paired with its successor."""
    return let(
        "p_",
        path,
        "transform(slice(p_, 2, greatest(size(p_) - 1, 0)), (v_, i_) -> named_struct("
        "'x1', get(p_, i_).x, 'y1', get(p_, i_).y, 'x2', v_.x, 'y2', v_.y))",
    )


def _moments(ring: str, origin: str) -> str:
    """Twice the signed area and six times the first moments, about ``origin``."""
    cross = (
        f"((s_.x1 - {origin}.x) * (s_.y2 - {origin}.y) - (s_.x2 - {origin}.x) * (s_.y1 - {origin}.y))"
    )
    terms = (
        f"transform({segments(closed(ring))}, s_ -> named_struct('a', {cross}, "
        f"'mx', (s_.x1 + s_.x2 - 2 * {origin}.x) * {cross}, 'my', (s_.y1 + s_.y2 - 2 * {origin}.y) * {cross}))"
    )
    return (
        f"aggregate({terms}, named_struct('a', 0D, 'mx', 0D, 'my', 0D), (t_, m_) -> "
        "named_struct('a', t_.a + m_.a, 'mx', t_.mx + m_.mx, 'my', t_.my + m_.my))"
    )


def _total(items: str, field: str) -> str:
    return f"aggregate({items}, 0D, (t_, m_) -> t_ + m_.{field})"


def _area_moments(geom: str, origin: str) -> str:
    """Moments of every ring, shells counted positive and holes negative."""
    sign = "CASE WHEN (q_.a >= 0) = (k_ = 0) THEN 1D ELSE -1D END"
    signed = f"named_struct('a', q_.a * {sign}, 'mx', q_.mx * {sign}, 'my', q_.my * {sign})"
    oriented = let("q_", _moments("r_", origin), signed)
    return f"flatten(transform({geom}.parts, part_ -> transform(part_, (r_, k_) -> {oriented})))"


def area(geom: str) -> str:
    """Planar area in squared coordinate units; 0 for points and lines."""
    measured = let("o_", first_vertex(geom), f"{_total(_area_moments(geom, 'o_'), 'a')} / 2D")
    return f"CASE WHEN {is_area(geom)} THEN {measured} WHEN {geom} IS NOT NULL THEN 0D END"


def _vertex_mean(geom: str) -> str:
    mean = vertex(f"{_total('vs_', 'x')} / size(vs_)", f"{_total('vs_', 'y')} / size(vs_)")
    return let("vs_", vertices(geom), mean)


def _length_centroid(geom: str) -> str:
    """Length-weighted midpoint of all segments, else the mean vertex."""
    length = "sqrt((s_.x2 - s_.x1) * (s_.x2 - s_.x1) + (s_.y2 - s_.y1) * (s_.y2 - s_.y1))"
    weighted = (
        f"transform(flatten(transform({rings(geom)}, path_ -> {segments('path_')})), s_ -> named_struct("
        f"'l', {length}, 'x', {length} * (s_.x1 + s_.x2) / 2, 'y', {length} * (s_.y1 + s_.y2) / 2))"
    )
    by_length = vertex(f"{_total('w_', 'x')} / l_", f"{_total('w_', 'y')} / l_")
    pick = f"CASE WHEN l_ > 0 THEN {by_length} ELSE {_vertex_mean(geom)} END"
    return let("w_", weighted, let("l_", _total("w_", "l"), pick))


def centroid(geom: str) -> str:
    """Centroid vertex in the coordinates at hand, by the highest dimension present."""
    by_area = vertex(f"o_.x + {_total('w_', 'mx')} / (a2_ * 3)", f"o_.y + {_total('w_', 'my')} / (a2_ * 3)")
    of_area = let(
        "o_",
        first_vertex(geom),
        let(
            "w_",
            _area_moments(geom, "o_"),
            let("a2_", _total("w_", "a"), f"CASE WHEN a2_ <> 0 THEN {by_area} END"),
        ),
    )
    return (
        f"CASE WHEN NOT {usable(geom)} THEN CAST(NULL AS {VERTEX_SQL}) "
        f"WHEN {geom}.gtype = 'Point' THEN {first_vertex(geom)} "
        f"WHEN {geom}.gtype = 'MultiPoint' THEN {_vertex_mean(geom)} "
        f"WHEN {is_area(geom)} THEN coalesce({of_area}, {_length_centroid(geom)}) "
        f"ELSE {_length_centroid(geom)} END"
    )


def collapse_area(geom: str) -> str:
    """Outlines become their centroid point; every other type is left alone."""
    as_point = let("at_", centroid(geom), point("at_.x", "at_.y", f"{geom}.srid"))
    return f"CASE WHEN {is_area(geom)} AND {usable(geom)} THEN {as_point} ELSE {geom} END"


# --- fixed-point coordinates for exact predicates ----------------------------


def fixed(value: str, scale: str = f"{FIXED_POINT}D") -> str:
    """Coordinates as a whole number, of 1e-7 degree unless told otherwise."""
    return f"floor({value} * {scale} + 0.5D)"


def fixed_path(path: str, scale: str = f"{FIXED_POINT}D") -> str:
    return f"transform({path}, f_ -> named_struct('x', {fixed('f_.x', scale)}, 'y', {fixed('f_.y', scale)}))"


def scale_of(geom: str) -> str:
    """Steps in a coordinate unit for exact tests: 1e-7 degree, or a millimetre in metric zones.

    Coarser for an extent whose products of differences would not fit a BIGINT.
    """
    unit = f"CASE WHEN coalesce({geom}.srid, {WGS84}) = {WGS84} THEN {FIXED_POINT}D ELSE {METRIC_POINT}D END"
    ranges = ", ".join(f"array_max(transform(vs_, v_ -> v_.{a})) - array_min(transform(vs_, v_ -> v_.{a}))" for a in "xy")
    extent = let("vs_", vertices(geom), f"greatest({ranges})")
    return let("ext_", extent, f"CASE WHEN ext_ * {unit} > {EXACT_EXTENT}D THEN {EXACT_EXTENT}D / ext_ ELSE {unit} END")


def path_bounds(path: str) -> str:
    """Bounding box of a path in fixed point, as struct<x0, y0, x1, y1>."""
    sides = ", ".join(
        f"'{a}{i}', {fixed(f'array_{pick}(transform({path}, b_ -> b_.{a}))')}"
        for i, pick in ((0, "min"), (1, "max"))
        for a in "xy"
    )
    return f"named_struct({sides})"


def fixed_edges(geom: str) -> str:
    """All segments in fixed point; polygon rings are closed first."""
    paths = (
        f"CASE WHEN {is_area(geom)} THEN transform({rings(geom)}, ring_ -> {closed('ring_')}) "
        f"ELSE {rings(geom)} END"
    )
    return f"flatten(transform({paths}, path_ -> {segments(fixed_path('path_'))}))"


def fixed_bounds(geom: str) -> str:
    """Bounding box in fixed point, as struct<x0, y0, x1, y1>."""

    def extreme(axis: str, pick: str) -> str:
        of_all = f"{pick}(transform({vertices(geom)}, b_ -> b_.{axis}))"
        return fixed(f"CASE WHEN {geom}.gtype = 'Point' THEN {first_vertex(geom)}.{axis} ELSE {of_all} END")

    return (
        f"named_struct('x0', {extreme('x', 'array_min')}, 'y0', {extreme('y', 'array_min')}, "
        f"'x1', {extreme('x', 'array_max')}, 'y1', {extreme('y', 'array_max')})"
    )


def part_anchors(geom: str) -> str:
    """One fixed-point vertex for every non-empty part."""
    heads = f"transform({geom}.parts, part_ -> get(get(part_, 0), 0))"
    return fixed_path(f"filter({heads}, head_ -> head_ IS NOT NULL)")


def turn(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str]) -> str:
    """Side of c relative to a->b: 1 left, -1 right, 0 on the line.

    The two products are compared, never subtracted: each fits a BIGINT, their
    difference might not.
    """
    (ax, ay), (bx, by), (cx, cy) = a, b, c
    left, right = f"({bx} - {ax}) * ({cy} - {ay})", f"({by} - {ay}) * ({cx} - {ax})"
    return f"CASE WHEN {left} > {right} THEN 1 WHEN {left} < {right} THEN -1 ELSE 0 END"


def ends(e: str) -> tuple[tuple[str, str], tuple[str, str]]:
    return (f"{e}.x1", f"{e}.y1"), (f"{e}.x2", f"{e}.y2")


def spans_overlap(a: str, b: str, axis: str) -> str:
    a1, a2, b1, b2 = f"{a}.{axis}1", f"{a}.{axis}2", f"{b}.{axis}1", f"{b}.{axis}2"
    return f"(least({a1}, {a2}) <= greatest({b1}, {b2}) AND least({b1}, {b2}) <= greatest({a1}, {a2}))"


def edges_touch(a: str, b: str) -> str:
    """Closed segments share at least one position."""
    (a1, a2), (b1, b2) = ends(a), ends(b)
    return (
        f"({spans_overlap(a, b, 'x')} AND {spans_overlap(a, b, 'y')} "
        f"AND ({turn(a1, a2, b1)}) * ({turn(a1, a2, b2)}) <= 0 "
        f"AND ({turn(b1, b2, a1)}) * ({turn(b1, b2, a2)}) <= 0)"
    )


def edge_is_crossed(e: str, px: str, py: str) -> str:
    """A ray from (px, py) to the east crosses the edge (half-open in y)."""
    dy = f"({e}.y2 - {e}.y1)"
    left, right = f"({py} - {e}.y1) * ({e}.x2 - {e}.x1)", f"({px} - {e}.x1) * {dy}"
    return (
        f"(({e}.y1 > {py}) <> ({e}.y2 > {py}) "
        f"AND CASE WHEN {dy} > 0 THEN {left} > {right} ELSE {left} < {right} END)"
    )


def on_edge(e: str, px: str, py: str) -> str:
    a, b = ends(e)
    return (
        f"({px} BETWEEN least({e}.x1, {e}.x2) AND greatest({e}.x1, {e}.x2) "
        f"AND {py} BETWEEN least({e}.y1, {e}.y2) AND greatest({e}.y1, {e}.y2) "
        f"AND ({turn(a, b, (px, py))}) = 0)"
    )


# --- validity and structural repair ------------------------------------------


def _ring_is_sound(ring: str, scale: str) -> str:
    """Closed, at least four vertices, and not all of them on one line."""
    bent = turn(("o_.x", "o_.y"), ("s_.x1", "s_.y1"), ("s_.x2", "s_.y2"))
    spread = let("w_", fixed_path("u_", scale), let("o_", "get(w_, 0)", f"exists({segments('w_')}, s_ -> ({bent}) <> 0)"))
    test = f"CASE WHEN size(u_) < 4 OR get(u_, 0) <> element_at(u_, -1) THEN false ELSE {spread} END"
    return f"coalesce({let('u_', ring, test)}, false)"


def structure_ok(geom: str) -> str:
    """Rings closed, at least four vertices, not flat; lines not degenerate."""
    sound = let("sc_", scale_of(geom), f"forall({rings(geom)}, ring_ -> {_ring_is_sound('ring_', 'sc_')})")
    return (
        f"CASE WHEN {geom}.gtype IN ('Point', 'MultiPoint') THEN true "
        f"WHEN {is_area(geom)} THEN {sound} "
        f"ELSE forall({rings(geom)}, path_ -> size(array_distinct(path_)) >= 2) END"
    )


def self_crossing(geom: str) -> str:
    """Some polygon edge crosses, folds back on, or touches one it may not.

    A sweep over edges ordered by their western end keeps only the edges that
    still overlap in x, so a long outline costs far less than all its pairs.
    """
    real = f"filter({segments(fixed_path(closed('ring_'), 'sc_'))}, z_ -> z_.x1 <> z_.x2 OR z_.y1 <> z_.y2)"
    listed = (
        "transform(es_, (e_, i_) -> named_struct('west', least(e_.x1, e_.x2), 'east', greatest(e_.x1, e_.x2), "
        "'ring', k_, 'i', i_, 'n', size(es_), 'x1', e_.x1, 'y1', e_.y1, 'x2', e_.x2, 'y2', e_.y2))"
    )
    edges = f"flatten(transform({rings(geom)}, (ring_, k_) -> {let('es_', real, listed)}))"

    (a1, a2), (b1, b2) = ends("a_"), ends("b_")
    turns = f"array({turn(a1, a2, b1)}, {turn(a1, a2, b2)}, {turn(b1, b2, a1)}, {turn(b1, b2, a2)})"
    neighbours = "(a_.ring = b_.ring AND pmod(a_.i - b_.i, a_.n) IN (1, a_.n - 1))"
    # Neighbours share one vertex; they conflict only when one folds back.
    opposed = (
        "CAST(a_.x2 - a_.x1 AS DOUBLE) * (b_.x2 - b_.x1) + CAST(a_.y2 - a_.y1 AS DOUBLE) * (b_.y2 - b_.y1) < 0"
    )
    conflict = let(
        "u_",
        turns,
        f"CASE WHEN {neighbours} THEN u_[0] = 0 AND u_[1] = 0 AND {opposed} "
        "WHEN a_.ring = b_.ring THEN u_[0] * u_[1] <= 0 AND u_[2] * u_[3] <= 0 "
        "ELSE u_[0] * u_[1] < 0 AND u_[2] * u_[3] < 0 END",
    )
    hit = f"exists(live_, a_ -> {spans_overlap('a_', 'b_', 'y')} AND {conflict})"
    step = let(
        "live_",
        "filter(t_.active, a_ -> a_.east >= b_.west)",
        f"named_struct('active', concat(live_, array(b_)), 'hit', t_.hit OR {hit})",
    )
    swept = let(
        "all_",
        f"sort_array({edges})",
        f"aggregate(all_, named_struct('active', slice(all_, 1, 0), 'hit', false), (t_, b_) -> {step}, t_ -> t_.hit)",
    )
    return f"CASE WHEN {is_area(geom)} THEN {let('sc_', scale_of(geom), swept)} ELSE false END"


def structural_repair(geom: str) -> str:
    """Close rings, drop repeated vertices and rings or paths without extent.

    A part that loses its shell loses its holes too.  The result may be empty.
    """

    def deduplicated(path: str) -> str:
        return let("d_", path, "filter(d_, (v_, i_) -> i_ = 0 OR v_ <> get(d_, i_ - 1))")

    part = let(
        "rs_",
        f"transform(part_, ring_ -> {deduplicated(closed('ring_'))})",
        f"CASE WHEN {_ring_is_sound('get(rs_, 0)', 'sc_')} THEN filter(rs_, ring_ -> {_ring_is_sound('ring_', 'sc_')}) "
        "ELSE slice(rs_, 1, 0) END",
    )
    areas = let("sc_", scale_of(geom), f"transform({geom}.parts, part_ -> {part})")
    paths = (
        f"transform({geom}.parts, part_ -> filter(transform(part_, path_ -> {deduplicated('path_')}), "
        "path_ -> size(array_distinct(path_)) >= 2))"
    )
    parts = f"filter(CASE WHEN {is_area(geom)} THEN {areas} ELSE {paths} END, part_ -> size(part_) > 0)"
    return f"named_struct('gtype', {geom}.gtype, 'srid', {geom}.srid, 'parts', {parts})"
