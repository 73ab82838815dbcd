import math
import random

import pytest

from areaweave.operators.dissolve import dissolved
from tests.conftest import box, frame, line, polygon


def union(spark, *shapes):
    rows = dissolved(frame(spark, [("k", s) for s in shapes], "k STRING"), "k").collect()
    return [(r["area"], r["x"], r["y"]) for r in rows]


def test_overlap_nesting_touch_and_repeats_count_once(spark):
    whole = polygon(box(0.0, 0.0, 4.0, 4.0))
    inside, beside, far = polygon(box(1.0, 1.0, 2.0, 2.0)), polygon(box(4.0, 0.0, 6.0, 4.0)), polygon(box(10.0, 0.0, 11.0, 4.0))
    assert union(spark, whole, whole, inside) == [pytest.approx((16, 2, 2))]
    assert union(spark, whole, inside, beside) == [pytest.approx((24, 3, 2))]
    assert union(spark, whole, far) == [pytest.approx((20, (16 * 2 + 4 * 10.5) / 20, 2))]


def test_a_hole_is_no_area_unless_another_outline_covers_it(spark):
    ring, hole = box(0.0, 0.0, 4.0, 4.0)[0][0], box(1.0, 1.0, 3.0, 2.0)[0][0]
    for shell in (ring, ring[::-1]):
        for inner in (hole, hole[::-1]):
            assert union(spark, polygon([[shell, inner]])) == [pytest.approx((14, 2, (16 * 2 - 2 * 1.5) / 14))]
    assert union(spark, polygon([[ring, hole]]), polygon(box(1.0, 0.5, 3.0, 3.0))) == [pytest.approx((16, 2, 2))]


def test_edges_that_cross_between_their_ends(spark):
    def triangle(turn):
        spots = [(math.cos(turn + k * 2 * math.pi / 3), math.sin(turn + k * 2 * math.pi / 3)) for k in range(3)]
        return polygon([[spots + spots[:1]]])

    # Two triangles make a star of six points: 12 small triangles, of which each has 9.
    area = 9 * math.sqrt(3) / 12 * 4 / 3
    ((got, x, y),) = union(spark, triangle(0.3), triangle(0.3 + math.pi))
    assert got == pytest.approx(area) and (x, y) == pytest.approx((0, 0), abs=1e-9)


def test_many_outlines_equal_a_count_of_cells(spark):
    r = random.Random(4)
    boxes = [(x, y, x + r.randrange(1, 9), y + r.randrange(1, 9)) for x, y in ((r.randrange(40), r.randrange(40)) for _ in range(60))]
    cells = {(i, j) for a, b, c, d in boxes for i in range(a, c) for j in range(b, d)}
    want = (len(cells), sum(i + 0.5 for i, _ in cells) / len(cells), sum(j + 0.5 for _, j in cells) / len(cells))
    assert union(spark, *(polygon(box(*map(float, b))) for b in boxes)) == [pytest.approx(want)]


def test_lines_and_flat_outlines_have_no_area(spark):
    flat = polygon([[[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]])
    assert union(spark, line((0.0, 0.0), (1.0, 1.0)), flat) == []
