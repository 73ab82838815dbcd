"""Totals of a spatial join: for each boundary the number of features it meets and sums over them.

Pairs grow with features times boundaries, totals only with the boundaries.  Of a feature and a boundary
the smaller one (by levels that double in size) has one home, the tile of its lower-left corner; the larger
one is cut into the tiles it reaches.  A tile gets the edges that reach it; those wholly east of it leave
behind only the heights between which they turn outside into inside, as upright edges beyond the tile.

Within a tile the small shapes stand in strips by their lower side, sorted by their left side.  The edges of a
large one that reach a strip cut it into stretches: what stands between two edges is wholly inside or outside,
and is added up at once, from running sums.  What may touch an edge is told exactly, pair by pair.  A
strip with many such pairs is halved first, so long edges cost few strips and little is tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaweave.operators.scale import broadcast_checked, through_table
from areaweave.settings import FIXED_POINT

# Most edges and shapes of a group, small ones and large ones; beyond, a tile is dealt to several groups.
GROUP_FEATURES, GROUP_BLOCKS = 1 << 18, 1 << 18
# So are tiles of more pairs than this and than their share, so that no task is left with most of the tests.
GROUP_PAIRS, _GROUPS = 1 << 25, 512
# Numbers in a temporary array of the tests.
_AT_ONCE = 1 << 18

# Finest cells in a tile on a side, most halvings of a strip, tests for each of its edges below which it is not halved.
_TILE_CELLS, _DEPTH, _FEW = 4, 12, 8
# Rows of a result batch, and of a task.
_OUT_ROWS, _TASK_ROWS = 10_000, 100_000

_TILE = ["_by_feature", "_lv", "_tx", "_ty"]
_GROUP = [*_TILE, "_f", "_b"]
_BOX = ("_x0", "_y0", "_x1", "_y1")
_EDGE, _SPOT = ("x1", "y1", "x2", "y2"), ("x", "y")
_SHAPE = "_size INT, _x0 BIGINT, _y0 BIGINT, _x1 BIGINT, _y1 BIGINT, _own ARRAY<STRUCT<x1: BIGINT, y1: BIGINT, x2: BIGINT, y2: BIGINT>>, _spots ARRAY<STRUCT<x: BIGINT, y: BIGINT>>, _area BOOLEAN"
_PLACE = "_lv INT, _tx BIGINT, _ty BIGINT, _own ARRAY<STRUCT<x1: BIGINT, y1: BIGINT, x2: BIGINT, y2: BIGINT>>, _spots ARRAY<STRUCT<x: BIGINT, y: BIGINT>>, _area BOOLEAN"


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of items whose sizes add up to at most ``most`` (or one item)."""
    a, total = 0, np.cumsum(sizes)
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _each(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from ``start``, ``count`` of them, for each row, and which row each belongs to."""
    stop = np.cumsum(count)
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(len(which)) + np.repeat(start - stop + count, count), which


def _lengths(column: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Ragged:
    """A column of arrays of structs: flat fields, and where each row's begin."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        self.count = _lengths(column)
        self.start = np.cumsum(self.count) - self.count
        self.fields = [p.to_numpy(zero_copy_only=False).astype(np.int64) for p in column.flatten().flatten()]
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``rows`` all its places in the fields, and which of ``rows`` each belongs to."""
        return _each(self.start[rows], self.count[rows])


def _lists(row: np.ndarray, n: int, fields: list[np.ndarray], names: tuple[str, ...]) -> pa.ListArray:
    """Structs of ``fields``, in the order of their ``row``, as one array for each of ``n`` rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(f) for f in fields], names))


# --- shapes in fixed point ----------------------------------------------------


def _shape(geom: pa.StructArray, cell: int, closed: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """The rows that have a box, and for these the columns of ``_SHAPE``.

    ``closed`` shapes are outlines whatever their type, and keep no edges without length.
    """
    n, gtype, parts = len(geom), geom.field("gtype"), geom.field("parts")
    area = np.ones(n, bool) if closed else pc.fill_null(pc.is_in(gtype, value_set=pa.array(["Polygon", "MultiPolygon"])), False).to_numpy(zero_copy_only=False)
    rings = parts.flatten()
    paths = rings.flatten()
    in_row, in_part, in_ring = _lengths(parts), _lengths(rings), _lengths(paths)
    part_row = np.repeat(np.arange(n), in_row)
    ring_row = np.repeat(part_row, in_part)
    ring = np.repeat(np.arange(len(in_ring)), in_ring)
    vertex_row, start = ring_row[ring], np.cumsum(in_ring) - in_ring
    at = [np.floor(v.to_numpy(zero_copy_only=False) * float(FIXED_POINT) + 0.5) for v in paths.flatten().flatten()]
    known = ~(np.isnan(at[0]) | np.isnan(at[1]))
    x, y = (np.where(known, v, 0).astype(np.int64) for v in at)
    if not closed:  # a point is its first vertex
        point = pc.fill_null(pc.equal(gtype, "Point"), False).to_numpy(zero_copy_only=False)[vertex_row]
        known[1:] &= ~(point[1:] & (vertex_row[1:] == vertex_row[:-1]))
    # Edges: each vertex and its successor, and from the last of a ring to its first.
    a = np.flatnonzero(ring[1:] == ring[:-1])
    last = (start + in_ring - 1)[(in_ring > 0) & area[ring_row]]
    first = start[(in_ring > 0) & area[ring_row]]
    open_ = (x[last] != x[first]) | (y[last] != y[first])
    a, b = np.concatenate([a, last[open_]]), np.concatenate([a + 1, first[open_]])
    keep = known[a] & known[b]
    if closed:
        keep &= (x[a] != x[b]) | (y[a] != y[b])
    a, b = a[keep], b[keep]
    order = np.argsort(vertex_row[a], kind="stable")
    a, b = a[order], b[order]
    # One vertex of each part.
    part = np.flatnonzero(in_part > 0)
    head = (np.cumsum(in_part) - in_part)[part]
    head = head[in_ring[head] > 0]
    spot = start[head]
    spot = spot[known[spot]]
    # Boxes.
    vx, vy, row = x[known], y[known], vertex_row[known]
    rows, begin = np.unique(row, return_index=True)
    if not len(rows):
        return rows, []
    box = [np.minimum.reduceat(vx, begin), np.minimum.reduceat(vy, begin), np.maximum.reduceat(vx, begin), np.maximum.reduceat(vy, begin)]
    extent = np.maximum(box[2] - box[0], box[3] - box[1])
    level = np.searchsorted(np.array([cell << k for k in range(40) if cell << k < 1 << 40], np.int64), extent).astype(np.int32)
    renumbered = np.zeros(n, np.int64)
    renumbered[rows] = np.arange(len(rows))
    own = _lists(renumbered[vertex_row[a]], len(rows), [x[a], y[a], x[b], y[b]], _EDGE)
    spots = _lists(renumbered[vertex_row[spot]], len(rows), [x[spot], y[spot]], _SPOT)
    return rows, [pa.array(level), *map(pa.array, box), own, spots, pa.array(area[rows])]


def _shapes(df: DataFrame, cell: int, closed: bool) -> DataFrame:
    """``geom`` as the columns of ``_SHAPE``, written once; the others stay."""
    kept = [c for c in df.columns if c != "geom"]
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in kept], *T.StructType.fromDDL(_SHAPE)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = _shape(batch.column("geom"), cell, closed)
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in kept), *columns], names)

    shapes = through_table(df.select(*kept, "geom").mapInArrow(run, schema))
    # A small table would leave all but one core idle.
    slots = df.sparkSession.sparkContext.defaultParallelism
    return shapes.repartition(slots) if shapes.rdd.getNumPartitions() < slots else shapes


# --- tiles --------------------------------------------------------------------


def _side(level: int, cell: int) -> int:
    """Side of the tiles for shapes of a level, which are up to ``cell << level`` wide."""
    return (_TILE_CELLS * cell) << max(0, level - 1)


def _turns(tile: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of height (tile, from, up to) that an odd number of the given ones covers."""
    tile, y = np.concatenate([tile, tile]), np.concatenate([low, high])
    order = np.lexsort((y, tile))
    tile, y = tile[order], y[order]
    new = np.flatnonzero(np.concatenate([[True], (tile[1:] != tile[:-1]) | (y[1:] != y[:-1])])) if len(y) else np.zeros(0, np.int64)
    odd = new[np.diff(np.append(new, len(y))) % 2 == 1]
    return tile[odd][::2], y[odd][::2], y[odd][1::2]


def _cut(table: pa.Table, kept: list[str], level: int, cell: int) -> Iterator[pa.Table]:
    """Shapes by the tiles of a level that they reach: their edges there, and upright ones for those east of it."""
    side, reach = _side(level, cell), cell << level
    x0, y0, x1, y1 = (table[c].to_numpy() for c in _BOX)
    own, spots = _Ragged(table["_own"]), _Ragged(table["_spots"])
    area = table["_area"].combine_chunks().to_numpy(zero_copy_only=False)
    columns, row = _each((x0 - reach) // side, x1 // side - (x0 - reach) // side + 1)
    tall = (y1 - y0) // side + 3
    for unit in _pieces((own.count[row] + spots.count[row]) * 2 + tall[row], _AT_ONCE):
        tx, of = columns[unit], row[unit]
        west, east = tx * side, (tx + 1) * side - 1 + reach
        e, u = own.of(of)
        ex1, ey1, ex2, ey2 = (v[e] for v in own.fields)
        left, right, low, high = np.minimum(ex1, ex2), np.maximum(ex1, ex2), np.minimum(ey1, ey2), np.maximum(ey1, ey2)
        beyond = left > east[u]
        reached = ~beyond & (right >= west[u])
        beyond &= area[of][u] & (low < high)

        def rows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The rows of tiles that the edges ``at`` reach, and the edge of each."""
            down = (low[at] - reach) // side
            ty, which = _each(down, high[at] // side - down + 1)
            return ty, at[which]

        ty, near = rows_of(np.flatnonzero(reached))
        far_ty, far = rows_of(np.flatnonzero(beyond))
        s, v = spots.of(of)
        sx, sy = (f[s] for f in spots.fields)
        here = np.flatnonzero((sx >= west[v]) & (sx <= east[v]))
        down = (sy[here] - reach) // side
        spot_ty, which = _each(down, sy[here] // side - down + 1)
        spot = here[which]
        # One number for each unit and row of tiles.
        base = min((int(t.min()) for t in (ty, far_ty, spot_ty) if len(t)), default=0)
        wide = max((int(t.max()) for t in (ty, far_ty, spot_ty) if len(t)), default=0) - base + 1
        near_at, far_at, spot_at = u[near] * wide + ty - base, u[far] * wide + far_ty - base, v[spot] * wide + spot_ty - base
        floor_ = far_ty * side
        turn_at, turn_low, turn_high = _turns(far_at, np.maximum(low[far], floor_), np.minimum(high[far], floor_ + side + reach))
        tiles = np.unique(np.concatenate([near_at, turn_at, spot_at]))
        if not len(tiles):
            continue
        # Upright edges stand so far east that no small shape reaches them.
        stand = east[turn_at // wide] + reach + 1
        where = np.searchsorted(tiles, np.concatenate([near_at, turn_at]))
        order = np.argsort(where, kind="stable")
        edges = [np.concatenate(p)[order] for p in ((ex1[near], stand), (ey1[near], turn_low), (ex2[near], stand), (ey2[near], turn_high))]
        spot_where = np.searchsorted(tiles, spot_at)
        spot_order = np.argsort(spot_where, kind="stable")
        spot = spot[spot_order]
        of_tile = tiles // wide
        columns_ = [
            pa.array(np.full(len(tiles), level, np.int32)),
            pa.array(tx[of_tile]),
            pa.array(tiles % wide + base),
            _lists(where[order], len(tiles), edges, _EDGE),
            _lists(spot_where[spot_order], len(tiles), [sx[spot], sy[spot]], _SPOT),
            pa.array(area[of][of_tile]),
        ]
        rows = pa.array(of[of_tile])
        yield pa.Table.from_arrays([*(table[c].take(rows) for c in kept), *columns_], [*kept, "_lv", "_tx", "_ty", "_own", "_spots", "_area"])


def _large(shapes: DataFrame, kept: list[str], levels: list[int], cell: int, same: bool) -> DataFrame:
    """Shapes cut for each of ``levels`` below their own, or up to it with ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            size = table["_size"].to_numpy()
            for level in levels:
                some = table.take(pa.array(np.flatnonzero(size >= level if same else size > level)))
                if some.num_rows:
                    for cut in _cut(some, kept, level, cell):
                        yield from cut.combine_chunks().to_batches()

    schema = T.StructType([*[T.StructField(c, shapes.schema[c].dataType) for c in kept], *T.StructType.fromDDL(_PLACE)])
    return shapes.mapInArrow(run, schema)


def _small(shapes: DataFrame, levels: list[int], cell: int) -> DataFrame:
    """Shapes of ``levels`` with the tile of their lower-left corner."""
    side = f"CASE _size {' '.join(f'WHEN {level} THEN {_side(level, cell)}L' for level in levels)} END" if levels else "NULL"
    at = [F.expr(f"CAST(floor({c} / ({side})) AS BIGINT)").alias(name) for c, name in (("_x0", "_tx"), ("_y0", "_ty"))]
    return shapes.where(F.col("_size").isin(levels)).select("*", F.col("_size").alias("_lv"), *at).drop("_size")


# --- tests within a tile --------------------------------------------------------


def _met(x1, y1, x2, y2, px, py) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ray from p to the east crosses the edge, and whether p is on it (see geometry.py)."""
    dy = y2 - y1
    left, right = (py - y1) * (x2 - x1), (px - x1) * dy
    crossed = ((y1 > py) != (y2 > py)) & np.where(dy > 0, left > right, left < right)
    on = (left == right) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2))
    return crossed, on & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))


def _turn(ax, ay, bx, by, cx, cy) -> np.ndarray:
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    return (left > right).astype(np.int8) - (left < right)


def _touch(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = a, b
    near = (np.minimum(ax1, ax2) <= np.maximum(bx1, bx2)) & (np.minimum(bx1, bx2) <= np.maximum(ax1, ax2))
    near &= (np.minimum(ay1, ay2) <= np.maximum(by1, by2)) & (np.minimum(by1, by2) <= np.maximum(ay1, ay2))
    at = np.flatnonzero(near)
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = [v[at] for v in a], [v[at] for v in b]
    apart = _turn(ax1, ay1, ax2, ay2, bx1, by1) * _turn(ax1, ay1, ax2, ay2, bx2, by2) > 0
    apart |= _turn(bx1, by1, bx2, by2, ax1, ay1) * _turn(bx1, by1, bx2, by2, ax2, ay2) > 0
    near[at[apart]] = False
    return near


def _inside(crossed: np.ndarray, on: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` spots are inside, by the tests of their edges."""
    held = np.bincount(which[crossed], minlength=n) % 2 == 1
    held[which[on]] = True
    return held


class _Lanes:
    """Columns to be added up without overflow: ones, then for each sum its numbers, halved if they are
    large, and whether they are known."""

    def __init__(self, table: pa.Table, sums: list[str]) -> None:
        self.values, self.plan = [np.ones(table.num_rows, np.int64)], []
        for s in sums:
            v, valid = pc.fill_null(table[s], 0).to_numpy(), table[s].is_valid().to_numpy()
            whole = not len(v) or int(np.abs(v.astype(np.float64)).max()) * len(v) < 1 << 62
            self.plan.append((len(self.values), whole, bool(valid.all())))
            self.values += [v] if whole else [v >> 32, v & 0xFFFFFFFF]
            self.values += [] if valid.all() else [valid.astype(np.int64)]

    def results(self, added: list[np.ndarray], rows: np.ndarray) -> list[pa.Array]:
        out = [pa.array(added[0][rows])]
        for at, whole, known in self.plan:
            have = added[0][rows] > 0 if known else added[at + (1 if whole else 2)][rows] > 0
            if whole:
                out.append(pa.array(added[at][rows], mask=~have))
            else:
                both = zip(added[at][rows].tolist(), added[at + 1][rows].tolist(), have.tolist(), strict=True)
                out.append(pa.array([(a << 32) + b if k else None for a, b, k in both], pa.int64()))
        return out


class _Smalls:
    def __init__(self, table: pa.Table) -> None:
        self.box = [table[c].to_numpy() for c in _BOX]
        self.own, self.spots = _Ragged(table["_own"]), _Ragged(table["_spots"])
        self.area = table["_area"].combine_chunks().to_numpy(zero_copy_only=False)
        # Whether the edges are one path, which then reaches all sides of its box; so is a spot.
        self.path = (self.own.count > 0) | (self.spots.count == 1)
        x1, y1, x2, y2 = self.own.fields
        torn = (self.own.row[1:] == self.own.row[:-1]) & ((x2[:-1] != x1[1:]) | (y2[:-1] != y1[1:]))
        self.path[self.own.row[1:][torn]] = False


class _Larges:
    """Edges of the large shapes, and behind them their vertices at hand as edges without length."""

    def __init__(self, table: pa.Table, spots_too: bool) -> None:
        own = _Ragged(table["_own"])
        self.n, self.area = table.num_rows, table["_area"].combine_chunks().to_numpy(zero_copy_only=False)
        self.edges, self.of, self.real = own.fields, own.row, np.ones(len(own.row), bool)
        if spots_too:
            spots = _Ragged(table["_spots"])
            both = np.concatenate([own.row, spots.row])
            order = np.argsort(both, kind="stable")
            x, y = spots.fields
            self.edges = [np.concatenate(p)[order] for p in zip(own.fields, (x, y, x, y), strict=True)]
            self.of, self.real = both[order], np.concatenate([self.real, np.zeros(len(x), bool)])[order]


def _passes(ex1, ey1, ex2, ey2, x0, y0, x1, y1) -> np.ndarray:
    """Whether an edge that reaches a box surely passes it from side to side, so that it meets any path between the others."""
    passes = np.zeros(len(x0), bool)
    for ax, ay, bx, by, ax0, ay0, ax1, ay1 in ((ex1, ey1, ex2, ey2, x0, y0, x1, y1), (ey1, ex1, ey2, ex2, y0, x0, y1, x1)):
        spans = (np.minimum(ay, by) <= ay0) & (np.maximum(ay, by) >= ay1)
        passes |= spans & (ax == bx)
        at = np.flatnonzero(spans & (ax != bx) & (ay != by))
        if len(at):
            rise = (bx - ax)[at] / (by - ay)[at]
            low, high = (ax[at] + (y[at] - ay[at]) * rise for y in (ay0, ay1))
            passes[at] |= (np.minimum(low, high) >= ax0[at] + 1) & (np.maximum(low, high) <= ax1[at] - 1)
    return passes


def _hits(
    small: _Smalls, s: np.ndarray, start: np.ndarray, near: np.ndarray, count: np.ndarray, edges: list[np.ndarray], real: np.ndarray, area: np.ndarray
) -> np.ndarray:
    """Whether shape ``s`` meets the large shape that has ``count`` of the ``edges`` from ``start``, ``near`` of them beside ``s``
    and the others east of it."""
    hit, drawn = np.zeros(len(s), bool), len(small.own.row) > 0
    if drawn:
        # Edges that reach the small one's box; most of them pass it.
        e, c = _each(start, near)
        box = [side[s][c] for side in small.box]
        mine = [v[e] for v in edges]
        ex1, ey1, ex2, ey2 = mine
        reach = np.flatnonzero(
            (np.minimum(ex1, ex2) <= box[2]) & (np.maximum(ex1, ex2) >= box[0]) & (np.minimum(ey1, ey2) <= box[3]) & (np.maximum(ey1, ey2) >= box[1])
        )
        e, c = e[reach], c[reach]
        sure = _passes(*(v[reach] for v in mine), *(v[reach] for v in box)) & real[e] & (small.path & (small.own.count > 0))[s[c]]
        hit[c[sure]] = True
    # One vertex of each part of the small one, in the large one.
    rest = np.flatnonzero(~hit & area)
    spot, k = small.spots.of(s[rest])
    k = rest[k]
    spot_e, which = _each(start[k], count[k])
    crossed, on = _met(*(v[spot_e] for v in edges), *(f[spot][which] for f in small.spots.fields))
    hit[k[_inside(crossed, on & real[spot_e], which, len(k))]] = True
    if not drawn:
        return hit
    # The edges near it, against its own.
    for crossing in (True, False):
        at = np.flatnonzero(~hit[c] & (real[e] if crossing else ~real[e] & small.area[s[c]]))
        for part in _pieces(small.own.count[s[c[at]]], _AT_ONCE):
            place, pair = small.own.of(s[c[at[part]]])
            mine, its = [v[place] for v in small.own.fields], [v[e[at[part]]][pair] for v in edges]
            if crossing:
                hit[c[at[part]][pair[_touch(mine, its)]]] = True
            else:  # a vertex of the large one that lies in the small one
                held = _inside(*_met(*mine, its[0], its[1]), pair, len(at[part]))
                hit[c[at[part]][held]] = True
    return hit


def _along(smalls: _Smalls, members: np.ndarray, values: list[np.ndarray], larges: _Larges, by_large: bool, added: list[np.ndarray]) -> None:
    """Adds up, for each large shape or else for each of ``members``, the ``values`` of the other side that it meets."""
    x0, y0, x1, y1 = (side[members] for side in smalls.box)
    n, low, left = len(members), int(y0.min()), int(x0.min())
    tall, wide, across, height = int((y1 - y0).max()), int((x1 - x0).max()), int(x0.max()) - left + 3, int(y0.max()) - low + 1
    depth, parts = 0, max(1, int(smalls.spots.count[members].max()))
    while depth < _DEPTH and height >> (depth + 1) >= max(tall >> 3, 1) and n >> (depth + 2):
        depth += 1
    finest = -(-height >> depth) if depth else height
    strip, by_x = (y0 - low) // finest, np.argsort(x0, kind="stable")

    across_end, by_end = int(x1.max()) - left + 3, np.argsort(x1, kind="stable")
    paths = bool(smalls.path[members].all() and (by_large or smalls.own.count[members].all()))

    def sorted_strips(by: np.ndarray, x: np.ndarray, across: int, d: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The members strip by strip in the order of ``x``, a key of that order, and their running sums, or room for them."""
        order = by[np.argsort((strip >> (depth - d))[by].astype(np.uint16), kind="stable")]
        key = (strip[order] >> (depth - d)) * across + x[order] - left + 1
        sums = [np.concatenate([[0], np.cumsum(v[members[order]])]) for v in values] if by_large else [np.zeros(n + 1, np.int64) for _ in values]
        return order, key, sums

    levels = []
    for d in range(depth + 1):
        starts, ending = sorted_strips(by_x, x0, across, d), sorted_strips(by_end, x1, across_end, d)
        levels.append((starts, ending, np.searchsorted(starts[1], np.arange((1 << d) + 1) * across)))

    all_x1, all_y1, all_x2, all_y2 = larges.edges
    ends = np.searchsorted(larges.of, np.arange(larges.n + 1))
    for piece in _pieces(np.diff(ends), max(1, _AT_ONCE // 4)):
        first, last = ends[piece.start], ends[piece.stop]
        edge, item = np.arange(first, last), larges.of[first:last] - piece.start
        shape, node = np.arange(piece.start, piece.stop), np.zeros(piece.stop - piece.start, np.int64)
        for d, ((order, key, sums), (order_end, key_end, sums_end), begin) in enumerate(levels):
            part = finest << (depth - d)
            # Edges that reach the strip, and what stands in it.
            ex1, ey1, ex2, ey2 = (v[edge] for v in larges.edges)
            floor_ = low + node[item] * part
            top = floor_ + part - 1 + tall
            down, up = np.minimum(ey1, ey2), np.maximum(ey1, ey2)
            keep = (down <= top) & (up >= floor_) & (begin[node] < begin[node + 1])[item]
            edge, item, floor_, top = edge[keep], item[keep], floor_[keep], top[keep]
            if not len(edge):
                break
            ex1, ey1, ex2, ey2, down, up = (v[keep] for v in (ex1, ey1, ex2, ey2, down, up))
            live = np.bincount(item, minlength=len(node)) > 0
            item, node, shape = (np.cumsum(live) - 1)[item], node[live], shape[live]
            # The part of an edge within the strip, and what may touch it.
            west, east = np.minimum(ex1, ex2), np.maximum(ex1, ex2)
            slant = np.flatnonzero((ex1 != ex2) & (ey1 != ey2) & ((down < floor_) | (up > top)))
            if len(slant):
                rise = ((ex2 - ex1)[slant] / (ey2 - ey1)[slant]).astype(np.float64)
                a, b = (ex1[slant] + (np.clip(y, down[slant], up[slant]) - ey1[slant]) * rise for y in (floor_[slant], top[slant]))
                west[slant] = np.maximum(west[slant], np.floor(np.minimum(a, b)).astype(np.int64) - 2)
                east[slant] = np.minimum(east[slant], np.ceil(np.maximum(a, b)).astype(np.int64) + 2)
            home = node[item] * across
            lo = np.searchsorted(key, home + np.clip(west - wide - left + 1, 0, across - 1), "left")
            hi = np.searchsorted(key, home + np.clip(east - left + 1, 0, across - 1), "right")
            by = np.lexsort((lo, item))
            edge, item, lo, hi = edge[by], item[by], lo[by], hi[by]
            turns = ((ey1 > floor_) != (ey2 > floor_))[by] & larges.area[shape[item]]
            # Stretches of what may touch some edge; between them everything is inside or everything outside.
            new = np.concatenate([[True], item[1:] != item[:-1]])
            furthest = np.maximum.accumulate(hi + item * (n + 1)) - item * (n + 1)
            split = np.concatenate([[True], lo[1:] > furthest[:-1]]) | new
            at = np.flatnonzero(split)
            until = furthest[np.append(at[1:], len(item)) - 1]
            begun = np.flatnonzero(new)
            count = np.diff(np.append(begun, len(item)))
            of, until_ = item[at], lo[at]
            # One edge that passes the whole strip: what ends before it is west of it, what begins before and ends
            # behind it meets it, and only what begins or ends where the edge leans to and fro must be told.
            beside, onward = np.diff(np.append(at, len(item))), (begun + count)[of] - at
            alone = (beside == 1) & (until > until_) & paths
            alone &= (larges.real[edge] & (down <= floor_)[by] & (up >= top)[by])[at]
            one = np.flatnonzero(alone)
            first_, home, home_end = by[at[one]], node[of[one]] * across, node[of[one]] * across_end
            met = np.searchsorted(key, home + np.clip(west[first_] - left + 1, 0, across - 1), "right")
            passed = np.searchsorted(key_end, home_end + np.clip(west[first_] - left + 1, 0, across_end - 1), "left")
            leaning = np.searchsorted(key_end, home_end + np.clip(east[first_] - left + 1, 0, across_end - 1), "left")
            until_[one] = met
            size = until - until_
            size[one] += leaning - passed
            tests = np.bincount(of, weights=size, minlength=len(node)).astype(np.int64)
            halved = (tests > _FEW * count) & (d < depth)
            # East of the gap before a stretch are the edges from its first on.
            total = np.concatenate([[0], np.cumsum(turns)])
            odd = (total[at + onward] - total[at]) & 1 == 1
            before = np.where(new[at], begin[node[of]], np.concatenate([[0], until[:-1]]))
            gap = np.flatnonzero(odd & (before < lo[at]) & ~halved[of])
            ready = ~halved[of[one]]
            one, met, passed, leaning, limit = one[ready], met[ready], passed[ready], leaning[ready], west[first_[ready]]
            west_in = odd[one]
            # (shape, from, up to) in the order of the beginnings, and of the ends to be taken off again.
            base = begin[node[of[one]]]
            runs = [(gap, before[gap], lo[at][gap]), (one, np.where(west_in, lo[at][one], base), met)]
            off = one[~west_in], base[~west_in], passed[~west_in]
            for j, v in enumerate(values):
                for whose, a, b in runs:
                    if by_large:
                        np.add.at(added[j], shape[of[whose]], sums[j][b] - sums[j][a])
                    else:
                        np.add.at(sums[j], a, v[shape[of[whose]]])
                        np.subtract.at(sums[j], b, v[shape[of[whose]]])
                whose, a, b = off
                if by_large:
                    np.subtract.at(added[j], shape[of[whose]], sums_end[j][b] - sums_end[j][a])
                else:
                    np.subtract.at(sums_end[j], a, v[shape[of[whose]]])
                    np.add.at(sums_end[j], b, v[shape[of[whose]]])
            # Exact tests, a long stretch in several goes.  What leans was taken for met.
            mine, real = [v[edge] for v in larges.edges], larges.real[edge]
            told = np.flatnonzero((until > until_) & ~halved[of])
            for stretch, from_, to, among, behind in ((told, until_[told], until[told], order, None), (one, passed, leaning, order_end, limit)):
                most = max(1, _AT_ONCE // 8 // parts)
                go, which = _each(np.zeros(len(stretch), np.int64), -(-(to - from_) // most))
                from_ = from_[which] + go * most
                size = np.minimum(to[which] - from_, most)
                for some in _pieces(size * onward[stretch[which]] * parts, _AT_ONCE):
                    rank, k = _each(from_[some], size[some])
                    owner, s = stretch[which[some]][k], among[rank]
                    if behind is not None:
                        known = x0[s] <= behind[which[some]][k]
                        owner, s = owner[known], s[known]
                    b = shape[of[owner]]
                    hit = _hits(smalls, members[s], at[owner], beside[owner], onward[owner], mine, real, larges.area[b])
                    if behind is not None:
                        hit = ~hit
                    s, b = s[hit], b[hit]
                    for j, v in enumerate(values):
                        at_, what = (b, v[members[s]]) if by_large else (members[s], v[b])
                        (np.add if behind is None else np.subtract).at(added[j], at_, what)
            # The halves of the others.
            edge, item = edge[halved[item]], item[halved[item]]
            if not len(edge):
                break
            kids = np.flatnonzero(halved)
            item = (np.cumsum(halved) - 1)[item]
            edge, item = np.concatenate([edge, edge]), np.concatenate([2 * item, 2 * item + 1])
            shape, node = np.repeat(shape[kids], 2), np.repeat(2 * node[kids], 2) + np.tile([0, 1], len(kids))
    if not by_large:
        for order, _, sums in (one for starts, ending, _ in levels for one in (starts, ending)):
            for k, counted in enumerate(sums):
                added[k][members[order]] += np.cumsum(counted)[:-1]


def _tested(carried: list[str], sums: list[str]):
    def group(small: pa.Table, large: pa.Table) -> pa.Table:
        by_large = small["_by_feature"][0].as_py()
        smalls = _Smalls(small)
        lanes, counted = _Lanes(small if by_large else large, sums), large if by_large else small
        added = [np.zeros(counted.num_rows, np.int64) for _ in lanes.values]
        # Shapes of like size stand in strips of their own, and so do those that are not one path.
        extent = np.maximum(smalls.box[2] - smalls.box[0], smalls.box[3] - smalls.box[1])
        size = 2 * np.ceil(np.log2(extent + 1.0) / 2).astype(np.int64) + smalls.path
        known = {}
        for k in np.unique(size).tolist():
            members = np.flatnonzero(size == k)
            spots_too = bool(smalls.area[members].any())
            if spots_too not in known:
                known[spots_too] = _Larges(large, spots_too)
            _along(smalls, members, lanes.values, known[spots_too], by_large, added)
        found = np.flatnonzero(added[0])
        out = counted.select(carried).take(pa.array(found))
        for name, column in zip(["n", *sums], lanes.results(added, found), strict=True):
            out = out.append_column(name, column)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come group by group, small shapes first; a group may go on in the next batch.
        key, held, out = None, [], []

        def done() -> None:
            rows = pa.Table.from_batches(held)
            n = pc.sum(rows["_is_small"]).as_py()
            if 0 < n < rows.num_rows:
                out.append(group(rows.slice(0, n), rows.slice(n)))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _GROUP])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if held and key != keys[:, a].tolist():
                    done()
                key = keys[:, a].tolist()
                held.append(batch.slice(a, b - a))
            if sum(t.num_rows for t in out) >= _OUT_ROWS:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out.clear()
        if held:
            done()
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


# --- the join ---------------------------------------------------------------------


def shapes_of(boundaries: DataFrame, cell: int) -> DataFrame:
    return _shapes(boundaries, cell, closed=True)


def tile_totals(features: DataFrame, places: DataFrame, cell: int, sums: dict[str, str], broadcast_bytes: int) -> DataFrame:
    """Rows of the boundary columns, ``n`` and ``sums``, several for a boundary, to be added up.

    ``places`` are boundaries as ``shapes_of`` writes them; ``cell`` is the side of the finest cell in fixed point.
    """
    for name, column in sums.items():
        if not isinstance(features.schema[column].dataType, T.IntegralType):
            raise ValueError(f"{name}: only whole numbers are added up, and {column} is not")
    carried = [c for c in places.columns if not c.startswith("_")]
    valued = features.select(*[F.col(column).cast("bigint").alias(f"_sum_{k}") for k, column in enumerate(sums.values())], "geom")
    values = [f"_sum_{k}" for k in range(len(sums))]
    shapes = _shapes(valued, cell, closed=False)
    sizes, place_sizes = ([r["_size"] for r in df.select("_size").distinct().collect()] for df in (shapes, places))

    # The smaller one of a pair has one home: the feature if both are of one level.
    levels = sorted(k for k in sizes if k <= max(place_sizes, default=-1))
    place_levels = sorted(k for k in place_sizes if k < max(sizes, default=-1))
    small = _small(shapes, levels, cell).withColumn("_by_feature", F.lit(True))
    large = through_table(_large(places, carried, levels, cell, same=True)).withColumn("_by_feature", F.lit(True))
    if place_levels:
        small = small.unionByName(_small(places, place_levels, cell).withColumn("_by_feature", F.lit(False)), allowMissingColumns=True)
        crossed = through_table(_large(shapes, values, place_levels, cell, same=False)).withColumn("_by_feature", F.lit(False))
        large = large.unionByName(crossed, allowMissingColumns=True)

    def weighed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*_TILE).agg(F.count(F.lit(1)).alias(f"_{name}_rows"), F.sum(F.expr("1 + size(_own)")).alias(f"_{name}_weight"))

    shape = through_table(weighed(small, "f").join(weighed(large, "b"), _TILE).withColumn("_pairs", F.expr("_f_rows * _b_rows")))
    pairs = shape.agg(F.sum("_pairs")).head()[0] or 0
    # Features narrower than the places are told in few tests, so only much larger tiles than others are dealt there.
    most = [max(GROUP_PAIRS, pairs // parts) for parts in (_GROUPS // 8, _GROUPS)]
    share = f"ceil(sqrt(_pairs / CASE WHEN _by_feature THEN {most[0]}D ELSE {most[1]}D END))"
    for count, weight, limit in (("_nf", "_f_weight", GROUP_FEATURES), ("_nb", "_b_weight", GROUP_BLOCKS)):
        shape = shape.withColumn(count, F.expr(f"greatest(ceil({weight} / {limit}), {share})"))
    # Most tiles are one group.
    crowded = shape.where("_nf * _nb > 1").select(*_TILE, "_nf", "_nb")
    rows, groups = shape.selectExpr("sum(_f_rows * _nb + _b_rows * _nf)", "sum(CASE WHEN _nf * _nb > 1 THEN _nf * _nb ELSE 0 END)").head()
    tasks = max(features.sparkSession.sparkContext.defaultParallelism, (rows or 0) // _TASK_ROWS, min(2 * (groups or 0), 4 * _GROUPS, pairs >> 22))
    deals = (groups or 0) > 0
    crowded = broadcast_checked(crowded, limit=broadcast_bytes)

    def deal(rows: DataFrame, mine: str, other: str, count: str, copies: str) -> DataFrame:
        if not deals:
            return rows.withColumn(mine, F.lit(0)).withColumn(other, F.lit(0))
        dealt = rows.withColumn("_turn", F.monotonically_increasing_id()).join(crowded, _TILE, "left").fillna(1, ["_nf", "_nb"])
        dealt = dealt.withColumn(mine, F.pmod(F.xxhash64("_turn"), F.col(count)).cast("int")).drop("_turn")
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies).cast("int") - 1))).drop("_nf", "_nb")

    small = deal(small, "_f", "_b", "_nf", "_nb").withColumn("_is_small", F.lit(True))
    large = deal(large, "_b", "_f", "_nb", "_nf").withColumn("_is_small", F.lit(False))
    groups = small.unionByName(large, allowMissingColumns=True)
    missing = [F.lit(None).cast(places.schema[c].dataType).alias(c) for c in carried if c not in groups.columns]
    groups = groups.select("*", *missing).repartition(int(tasks), *_GROUP).sortWithinPartitions(*_GROUP, F.desc("_is_small"))
    schema = T.StructType([*[T.StructField(c, places.schema[c].dataType) for c in carried], *[T.StructField(c, T.LongType()) for c in ("n", *values)]])
    tested = groups.mapInArrow(_tested(carried, values), schema)
    return tested.select(*carried, "n", *[F.col(v).alias(name) for v, name in zip(values, sums, strict=True)])
