"""Distributed "feature intersects boundary" join.

Each feature gets exactly one grid key: the finest level whose cell is at least
as wide as its bounding box, and the cell of its lower-left corner.  It then lies
inside the block of two by two cells that starts there.  The boundary side lists,
for every block a boundary reaches, the boundary edges in that block and what is
needed to tell inside from outside there.  So

* the join is a plain equi-join on (level, cell x, cell y),
* a feature is never copied per cell, so no pair can appear twice and no
  de-duplication shuffle follows,
* the exact test runs inside one row with the few edges of one block, and
* a block wholly inside a boundary needs no test at all.

Telling inside from outside uses a ray to the east.  Boundary edges lying
entirely east of a block matter only by how often their y-span covers the ray;
along a chain of such edges everything but its two end points cancels, so only
those y values ("flips") are kept instead of the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.functions import geometry as g
from areaweave.operators.scale import compute_once, through_table
from areaweave.operators.totals import shapes_of, tile_totals
from areaweave.settings import BROADCAST_BYTES, CELL_DEGREES, FIXED_POINT, SALTS

# Each grid level is this much coarser than the one before.
_LEVEL_RATIO = 16
_POINT_LEVEL = -1

# Bounding box columns an element table may bring along (see write_elements).
BOX_COLUMNS = ("box_x0", "box_y0", "box_x1", "box_y1")

# Cells a block has on a side, by level: a point needs its own cell, another feature two by two.
_SPANS = {_POINT_LEVEL: 1, 0: 2}
# Children of a box of the index on each axis, and the round before which boxes are spread.
_FAN, _SPREAD_ROUND = 4, 2

# Rough size when broadcast of a row without its arrays, of an edge, of a flip, of a part's anchor.
_ROW_BYTES, _EDGE_BYTES, _FLIP_BYTES, _ANCHOR_BYTES = 200, 48, 16, 32
_BYTES_PER_TASK = 16 * 1024 * 1024
# Boxes that a scan may be asked for; beyond, it is asked for the one around all.
_SCAN_BOXES = 64


def _sizes(cell_degrees: float) -> list[int]:
    """Cell sides in fixed point, up to one that holds the whole world."""
    sizes = [max(1, int(cell_degrees * FIXED_POINT))]
    while sizes[-1] < 360 * FIXED_POINT:
        sizes.append(sizes[-1] * _LEVEL_RATIO)
    return sizes


def _with_grid_key(features: DataFrame, sizes: list[int]) -> DataFrame:
    extent = "greatest(_box.x1 - _box.x0, _box.y1 - _box.y0)"
    levels = " ".join(f"WHEN {extent} <= {size}L THEN {i}" for i, size in enumerate(sizes))
    sides = " ".join(f"WHEN {i} THEN {size}L" for i, size in enumerate(sizes) if i > 0)
    side = f"CASE _level {sides} ELSE {sizes[0]}L END"
    if set(BOX_COLUMNS) <= set(features.columns):
        sides_of_box = ", ".join(f"'{c[4:]}', {c}" for c in BOX_COLUMNS)
        boxed = features.withColumn("_box", F.expr(f"named_struct({sides_of_box})")).drop(*BOX_COLUMNS)
    else:
        boxed = compute_once(features, _box=g.fixed_bounds("geom"))
    levelled = compute_once(boxed, _level=f"CASE WHEN {extent} = 0 THEN {_POINT_LEVEL} {levels} END")
    return compute_once(levelled, _cx=f"floor(_box.x0 / {side})", _cy=f"floor(_box.y0 / {side})")


def _boundary_edges(geom: str) -> str:
    """Closed rings as fixed-point edges, each with the start of the edge before and the end of the one after it."""
    real = f"filter({g.segments(g.fixed_path(g.closed('ring_')))}, z_ -> z_.x1 <> z_.x2 OR z_.y1 <> z_.y2)"
    before = "get(es_, CASE WHEN n_ = 0 THEN size(es_) - 1 ELSE n_ - 1 END)"
    after = "get(es_, CASE WHEN n_ = size(es_) - 1 THEN 0 ELSE n_ + 1 END)"
    linked = (
        "transform(es_, (e_, n_) -> named_struct('x1', e_.x1, 'y1', e_.y1, 'x2', e_.x2, 'y2', e_.y2, "
        f"'px', {before}.x1, 'py', {before}.y1, 'nx', {after}.x2, 'ny', {after}.y2))"
    )
    return f"flatten(transform({g.rings(geom)}, ring_ -> {g.let('es_', real, linked)}))"


_PLAIN = "transform({}, e_ -> named_struct('x1', e_.x1, 'y1', e_.y1, 'x2', e_.x2, 'y2', e_.y2))"


def prepare_boundaries(boundaries: DataFrame) -> DataFrame:
    """Adds an identity, fixed-point box, edges and one anchor vertex per part."""
    return compute_once(
        boundaries.where(g.usable("geom")).withColumn("_bid", F.xxhash64(*boundaries.columns)),
        _edges=_boundary_edges("geom"),
        _anchors=g.part_anchors("geom"),
        _bbox=g.fixed_bounds("geom"),
    ).drop("geom")


def _cell_range(axis: str, size: str, span: str) -> tuple[str, str]:
    """First and last cell whose block reaches the boundary's box."""
    return (
        f"CAST(floor(_bbox.{axis}0 / {size}) AS BIGINT) - {span} + 1",
        f"CAST(floor(_bbox.{axis}1 / {size}) AS BIGINT)",
    )


@dataclass(frozen=True)
class _Measured:
    """Upper bound in bytes of the block index, rounds that building it takes, and the boundaries' common box."""

    index_bytes: int
    rounds: int
    extent: tuple[int, int, int, int] | None


def _measure(prepared: DataFrame, size: int, kinds: dict[int, int] = _SPANS) -> _Measured:
    counts, widest = [], []
    for span in kinds.values():
        (x0, x1), (y0, y1) = (_cell_range(axis, f"{size}L", f"{span}L") for axis in "xy")
        across, up = f"({x1} - ({x0}) + 1D)", f"({y1} - ({y0}) + 1D)"
        counts.append(f"{across} * {up}")
        widest += [across, up]
    # A block has at most a flip for each edge, and repeats all anchors.
    row = f"({_ROW_BYTES} + {_EDGE_BYTES + _FLIP_BYTES} * size(_edges) + {_ANCHOR_BYTES} * size(_anchors))"
    blocks, cells, *extent = prepared.selectExpr(
        f"coalesce(sum({row} * ({' + '.join(counts)})), 0D)",
        f"coalesce(max(greatest({', '.join(widest)})), 1D)",
        "min(_bbox.x0)",
        "min(_bbox.y0)",
        "max(_bbox.x1)",
        "max(_bbox.y1)",
    ).head()
    rounds = 0
    while _FAN**rounds < cells:
        rounds += 1
    return _Measured(int(blocks), rounds, None if extent[0] is None else tuple(extent))


def within_extent(features: DataFrame, *boxes: tuple[int, int, int, int] | None) -> DataFrame:
    """Features whose stored box meets one of ``boxes`` (fixed point); the filter reaches the scan."""
    if not boxes or None in boxes or not set(BOX_COLUMNS) <= set(features.columns):
        return features
    near = [f"(box_x0 <= {x1}L AND box_x1 >= {x0}L AND box_y0 <= {y1}L AND box_y1 >= {y0}L)" for x0, y0, x1, y1 in boxes]
    return features.where(" OR ".join(near))


def _scan_boxes(prepared: DataFrame, features: DataFrame, extent: tuple | None) -> list[tuple | None]:
    """The box of each boundary if they are few, so that far-apart ones do not read what lies between."""
    if not set(BOX_COLUMNS) <= set(features.columns):
        return []
    few = [tuple(row["_bbox"]) for row in prepared.select("_bbox").limit(_SCAN_BOXES + 1).collect()]
    return few if 0 < len(few) <= _SCAN_BOXES else [extent]


def _roots(prepared: DataFrame, size: int, kinds: dict[int, int] = _SPANS) -> DataFrame:
    """One tree for each boundary and kind of block: a square of cells around the boundary, with all its edges."""
    kinds = ", ".join(f"named_struct('level', {level}, 'span', {span}L)" for level, span in kinds.items())
    (x0, x1), (y0, y1) = (_cell_range(axis, f"{size}L", "_kind.span") for axis in "xy")
    widest = f"greatest({x1} - ({x0}), {y1} - ({y0})) + 1"
    trees = prepared.withColumn("_kind", F.expr(f"explode(array({kinds}))"))
    return compute_once(
        trees,
        _cx=x0,
        _cy=y0,
        _w=f"CAST(pow({_FAN}, ceil(log({_FAN}, {widest}) - 1e-9)) AS BIGINT)",
        _local="_edges",
        _flips="CAST(array() AS ARRAY<BIGINT>)",
        _base="0",
    ).drop("_edges")


def _divided(nodes: DataFrame, size: int) -> DataFrame:
    """The children of each node of the tree; nodes of one cell or without edges stay as they are.

    A child gets the edges of its parent that reach its box.  Those that lie wholly east of it in its
    rows leave behind the y values where they begin and end as a chain (see the module's head).
    """
    part = f"_w div {_FAN}"
    kid = f"named_struct('x', _cx + (n_ % {_FAN}) * ({part}), 'y', _cy + (n_ div {_FAN}) * ({part}), 'w', {part})"
    kids = f"transform(sequence(0, {_FAN * _FAN - 1}), n_ -> {kid})"
    own = "array(named_struct('x', _cx, 'y', _cy, 'w', _w))"
    grown = nodes.withColumn("_splits", F.expr("_w > 1 AND size(_local) > 0"))
    grown = grown.withColumn("_kid", F.expr(f"explode(CASE WHEN _splits THEN {kids} ELSE {own} END)"))
    placed = compute_once(
        grown,
        _xl=f"_kid.x * {size}L",
        _yl=f"_kid.y * {size}L",
        _xh=f"(_kid.x + _kid.w + _kind.span - 1) * {size}L - 1",
        _yh=f"(_kid.y + _kid.w + _kind.span - 1) * {size}L - 1",
        _end=f"(_cx + _w + _kind.span - 1) * {size}L - 1",
    )

    def passed(xa: str, ya: str, xb: str, yb: str) -> str:
        """Whether an edge is one of the parent's that lie east of the child in its rows."""
        rows = f"least({ya}, {yb}) <= _yh AND greatest({ya}, {yb}) >= _yl"
        return f"(least({xa}, {xb}) > _xh AND least({xa}, {xb}) <= _end AND {rows})"

    here = passed("e_.x1", "e_.y1", "e_.x2", "e_.y2")
    before, after = passed("e_.px", "e_.py", "e_.x1", "e_.y1"), passed("e_.x2", "e_.y2", "e_.nx", "e_.ny")
    ends = f"concat(CASE WHEN {before} THEN array() ELSE array(e_.y1) END, CASE WHEN {after} THEN array() ELSE array(e_.y2) END)"
    reached = (
        "filter(_local, e_ -> least(e_.y1, e_.y2) <= _yh AND greatest(e_.y1, e_.y2) >= _yl "
        "AND least(e_.x1, e_.x2) <= _xh AND greatest(e_.x1, e_.x2) >= _xl)"
    )
    turns = f"concat(_flips, flatten(transform(filter(_local, e_ -> {here}), e_ -> {ends})))"
    split = compute_once(
        placed,
        _turns=f"CASE WHEN _splits THEN {turns} ELSE _flips END",
        _reached=f"CASE WHEN _splits THEN {reached} ELSE _local END",
    )
    # A flip above the box counts for every ray in it, one below for none.
    reduced = compute_once(
        split,
        _base="CASE WHEN _splits THEN (_base + size(filter(_turns, y_ -> y_ > _yh))) % 2 ELSE _base END",
        _flips="CASE WHEN _splits THEN filter(_turns, y_ -> y_ > _yl AND y_ <= _yh) ELSE _flips END",
        _local="_reached",
        _cx="_kid.x",
        _cy="_kid.y",
        _w="_kid.w",
    )
    # Without edges a box is all inside or all outside.
    return reduced.where("size(_local) > 0 OR _base = 1").drop(
        "_splits", "_kid", "_xl", "_yl", "_xh", "_yh", "_end", "_turns", "_reached"
    )


def _block_index(prepared: DataFrame, size: int, rounds: int, tasks: int = 0, kinds: dict[int, int] = _SPANS) -> DataFrame:
    """One row per boundary and block it reaches, from a tree of boxes that is divided from the top.

    An edge is read only by the boxes it reaches and their parents, so the work grows with the edges
    times the depth, and boxes without edges are divided no further.  With ``tasks`` the boxes are spread
    over so many once, when each boundary has become some hundred of them.
    """
    nodes = _roots(prepared, size, kinds)
    for k in range(rounds):
        if tasks and k == min(_SPREAD_ROUND, rounds - 1):
            nodes = nodes.repartition(tasks)
        nodes = _divided(nodes, size)
    whole = nodes.withColumn("_cx", F.expr("explode(sequence(_cx, _cx + _w - 1))"))
    whole = whole.withColumn("_cy", F.expr("explode(sequence(_cy, _cy + _w - 1))"))
    return compute_once(whole, _local=_PLAIN.format("_local"), _level="_kind.level").drop("_kind", "_w")


def _coarse_index(prepared: DataFrame, sizes: list[int]) -> DataFrame:
    """Blocks of the coarser levels, each with its whole boundary: for streams, where pairs cannot be gathered."""
    levels = ", ".join(f"named_struct('level', {i}, 'size', {size}L)" for i, size in enumerate(sizes) if i)
    placed = prepared.withColumn("_lv", F.expr(f"explode(array({levels}))"))
    for column, axis in (("_cx", "x"), ("_cy", "y")):
        placed = placed.withColumn(column, F.expr(f"explode(sequence({', '.join(_cell_range(axis, '_lv.size', '2L'))}))"))
    whole = compute_once(placed, _local=_PLAIN.format("_edges"), _flips="CAST(array() AS ARRAY<BIGINT>)", _base="0", _level="_lv.level")
    return whole.drop("_edges", "_lv")


def _inside(px: str, py: str, edges: str, flips: str, base: str) -> str:
    flipped = f"size(filter({flips}, y_ -> y_ > {py}))" if flips else "0"
    crossed = f"size(filter({edges}, e_ -> {g.edge_is_crossed('e_', px, py)}))"
    on_any = f"exists({edges}, e_ -> {g.on_edge('e_', px, py)})"
    return f"({on_any} OR ({base} + {flipped} + {crossed}) % 2 = 1)"


def _touches() -> str:
    """Exact test of a candidate pair against the boundary edges at hand."""
    vertex_in = f"exists({g.part_anchors('geom')}, w_ -> {_inside('w_.x', 'w_.y', '_local', '_flips', '_base')})"
    near = (
        "filter(_local, e_ -> least(e_.x1, e_.x2) <= _box.x1 AND greatest(e_.x1, e_.x2) >= _box.x0 "
        "AND least(e_.y1, e_.y2) <= _box.y1 AND greatest(e_.y1, e_.y2) >= _box.y0)"
    )
    crosses = f"exists(near_, b_ -> exists(own_, a_ -> {g.edges_touch('a_', 'b_')}))"
    holds_part = f"{g.is_area('geom')} AND exists(_anchors, w_ -> {_inside('w_.x', 'w_.y', 'own_', '', '0')})"
    by_edges = g.let("own_", g.fixed_edges("geom"), f"{g.let('near_', near, crosses)} OR ({holds_part})")
    of_point = _inside("_box.x0", "_box.y0", "_local", "_flips", "_base")
    # A block without edges is all inside, so most pairs end at the first case.
    return f"CASE WHEN size(_local) = 0 THEN true WHEN _level = {_POINT_LEVEL} THEN {of_point} ELSE {vertex_in} OR {by_edges} END"


def _cells_of_edge(size: int) -> str:
    """Cells that the edge x1, y1, x2, y2 passes, row by row; now and then one beside it."""
    rows = f"sequence(CAST(floor(least(y1, y2) / {size}L) AS BIGINT), CAST(floor(greatest(y1, y2) / {size}L) AS BIGINT))"
    at = "x1 + CAST(x2 - x1 AS DOUBLE) * (yy_ - y1) / (y2 - y1)"
    low, high = f"greatest(least(y1, y2), r_ * {size}L)", f"least(greatest(y1, y2), (r_ + 1) * {size}L)"
    ends = f"CASE WHEN y1 = y2 THEN array(CAST(x1 AS DOUBLE), CAST(x2 AS DOUBLE)) ELSE transform(array({low}, {high}), yy_ -> {at}) END"
    first, last = (f"CAST(floor(({f}(s_) {sign} 1) / {size}L) AS BIGINT)" for f, sign in (("array_min", "-"), ("array_max", "+")))
    cells = f"transform(sequence({first}, {last}), c_ -> named_struct('_cx', c_, '_cy', r_))"
    return f"flatten(transform({rows}, r_ -> {g.let('s_', ends, cells)}))"


def _spots(df: DataFrame, size: int, *keep: str) -> DataFrame:
    """One row for each of ``_anchors``: x, y and its cell."""
    each = df.select(*keep, F.explode("_anchors").alias("_v")).select(*keep, "_v.x", "_v.y")
    return each.withColumn("_cx", F.expr(f"floor(x / {size}L)")).withColumn("_cy", F.expr(f"floor(y / {size}L)"))


def _large_pairs(large: DataFrame, prepared: DataFrame, index: DataFrame, size: int, limit: int, small: bool) -> DataFrame:
    """Pairs (_fid, _fid2, _bid) of features wider than a cell and boundaries that they meet.

    Neither side is in one row here.  Edges of the feature meet the boundary's edges in the cells
    they pass; if none touch, each part of either side is wholly inside or outside the other,
    so one vertex of it tells: the feature's in the boundary's blocks, the boundary's in the
    blocks of the feature, for which areas get an index of their own.
    """
    ids, pair, cell = ["_fid", "_fid2"], ["_fid", "_fid2", "_bid"], ["_cx", "_cy"]
    point_blocks = index.where(f"_level = {_POINT_LEVEL}").select("_bid", *cell, "_local", "_flips", "_base")
    point_blocks = F.broadcast(point_blocks) if small else point_blocks
    edges = large.select(*ids, F.inline(F.expr(g.fixed_edges("geom"))))
    edges = edges.select("*", F.inline(F.expr(_cells_of_edge(size))))
    touch = F.expr(f"exists(_local, b_ -> {g.edges_touch('e_', 'b_')})".replace("e_.", ""))
    crossing = edges.join(point_blocks.where("size(_local) > 0"), cell).where(touch).select(*pair)
    inside = F.expr(_inside("x", "y", "_local", "_flips", "_base"))
    held = _spots(large, size, *ids).join(point_blocks, cell).where(inside).select(*pair)
    # Areas of the features become boundaries, of which the vertices of the others are inside or not.
    areas = prepare_boundaries(large.where(g.is_area("geom")).select(*ids, "geom")).drop("_bid")
    kinds = {_POINT_LEVEL: _SPANS[_POINT_LEVEL]}
    measured = _measure(areas, size, kinds)
    tasks = max(1, measured.index_bytes // _BYTES_PER_TASK) if measured.index_bytes > limit else 0
    blocks = _block_index(areas, size, measured.rounds, int(tasks), kinds)
    holding = _spots(prepared, size, "_bid").join(blocks.select(*ids, *cell, "_local", "_flips", "_base"), cell).where(inside)
    return crossing.unionByName(held).unionByName(holding.select(*pair)).distinct()


def _wide(features: DataFrame, keyed: DataFrame) -> DataFrame:
    """Features wider than a cell, which are few; what they meet is told by cells, and then they are fetched once."""
    carried = [c for c in features.columns if c not in BOX_COLUMNS]
    wide = keyed.where("_level > 0").withColumn("_fid", F.xxhash64("geom")).withColumn("_fid2", F.xxhash64(F.lit(1), "geom"))
    return through_table(wide.select(*carried, "_fid", "_fid2", F.expr(g.part_anchors("geom")).alias("_anchors")))


def _totals(features: DataFrame, boundaries: DataFrame, cell: int, totals: dict[str, str], limit: int) -> DataFrame:
    """Boundary columns, ``n`` and the sums of ``totals``, several rows for a boundary."""
    places = shapes_of(boundaries.where(g.usable("geom")), cell)
    boxes = []
    if set(BOX_COLUMNS) <= set(features.columns):
        boxes = [tuple(row) for row in places.select("_x0", "_y0", "_x1", "_y1").limit(_SCAN_BOXES + 1).collect()]
        if not 0 < len(boxes) <= _SCAN_BOXES:
            extent = places.selectExpr("min(_x0)", "min(_y0)", "max(_x1)", "max(_y1)").head()
            boxes = [None if extent[0] is None else tuple(extent)]
    nearby = within_extent(features, *boxes).where(g.usable("geom"))
    return tile_totals(nearby, places, cell, totals, limit)


def _salts(spark: SparkSession) -> int:
    """No salts while adaptive execution splits skewed join partitions itself."""
    switches = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return 1 if all(spark.conf.get(s, "true").lower() == "true" for s in switches) else SALTS


def spatial_join(
    features: DataFrame,
    boundaries: DataFrame,
    cell_degrees: float = CELL_DEGREES,
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Features (WGS84 ``geom``) with the columns of each boundary they intersect.

    ``boundaries`` has ``lga_id``, ``geom`` and any columns to carry along, none of
    them named like a feature column.  Sharing an edge or a vertex counts.

    The boundary side is broadcast when its measured size allows, and then the
    features are neither shuffled nor sorted.  Otherwise the join shuffles by cell.
    A crowded cell is then split by adaptive execution, or, where the session has
    that turned off, by ``salts`` replicas of the index.  Streaming ``features`` keep no state, so
    there those wider than a cell are held against whole boundaries.

    With ``totals`` (result name -> integer column of the features) the pairs are added up
    where they are found: the result has the boundary columns, the number ``n`` of features and
    these sums, in several rows for a boundary, to be added up (see totals.py).  Both sides shuffle by tile then.
    """
    if totals is not None and features.isStreaming:
        raise ValueError("totals need features that end")
    sizes = _sizes(cell_degrees)
    if totals is not None:
        return _totals(features, boundaries, sizes[0], totals, broadcast_bytes)
    prepared = prepare_boundaries(boundaries)
    found = _measure(prepared, sizes[0])
    nearby = within_extent(features, *_scan_boxes(prepared, features, found.extent)).where(g.usable("geom"))
    keyed = _with_grid_key(nearby, sizes)
    index, index_bytes = _block_index(prepared, sizes[0], found.rounds), found.index_bytes
    if index_bytes > broadcast_bytes:
        # The bound counts every edge in every block; see what it really takes.
        # Boundaries often sit in one small file, so they are spread out.
        tasks = max(1, index_bytes // _BYTES_PER_TASK)
        index = through_table(_block_index(prepared.repartition(int(tasks), "lga_id"), sizes[0], found.rounds, int(tasks)))
        arrays = ((_EDGE_BYTES, "_local"), (_FLIP_BYTES, "_flips"), (_ANCHOR_BYTES, "_anchors"))
        row = f"{_ROW_BYTES}L + " + " + ".join(f"{b}L * greatest(coalesce(size({c}), 0), 0)" for b, c in arrays)
        index_bytes = index.selectExpr(f"coalesce(sum({row}), 0L)").head()[0]

    keys, small = ["_level", "_cx", "_cy"], keyed.where("_level <= 0")
    if features.isStreaming:
        small, index = keyed, index.unionByName(_coarse_index(prepared, sizes))
    blocks = index
    if index_bytes <= broadcast_bytes:
        blocks = F.broadcast(index)
    elif (salts := _salts(features.sparkSession) if salts is None else salts) > 1:
        salt = F.pmod(F.xxhash64("geom") + F.spark_partition_id(), F.lit(salts)).cast("int")
        small = small.withColumn("_salt", salt)
        blocks = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    pairs = small.join(blocks, keys).where(
        "_box.x0 <= _bbox.x1 AND _box.x1 >= _bbox.x0 AND _box.y0 <= _bbox.y1 AND _box.y1 >= _bbox.y0"
    )
    result = pairs.where(_touches())
    result = result.drop(*[c for c in result.columns if c.startswith("_")])

    if features.isStreaming:
        return result
    large = _wide(features, keyed)
    if not large.limit(1).count():
        return result
    met = _large_pairs(large, prepared, index, sizes[0], broadcast_bytes, index_bytes <= broadcast_bytes)
    of_boundary = prepared.drop("_edges", "_anchors", "_bbox")
    fetched = large.join(met, ["_fid", "_fid2"]).join(of_boundary, "_bid")
    return result.unionByName(fetched.select(*result.columns))
