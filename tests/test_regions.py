"""Regions by tiles against a flood fill, and ranks of groups of any size."""

import numpy as np
import pytest

from glyphmill.functions import ranks
from glyphmill.operators import glyphs, regions


def flood(pixels):
    """Boxes of 8-connected regions, one pixel at a time."""
    left, out = set(pixels), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for q in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        ys, xs = zip(*own, strict=True)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own)))
    return sorted(out)


def spiral(n):
    """One line that winds through the whole square without touching itself."""
    ink, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    ink[0, 0] = True
    for _ in range(4 * n):
        moved = 0
        while 0 <= y + dy < n and 0 <= x + dx < n and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and ink[y + 2 * dy, x + 2 * dx]):
            y, x, moved = y + dy, x + dx, moved + 1
            ink[y, x] = True
        if moved < 2:
            break
        dy, dx = dx, -dy
    return {(int(a), int(b)) for a, b in zip(*np.nonzero(ink), strict=True)}


@pytest.mark.parametrize(("share", "tile"), [(0.35, 8), (0.5, 16), (0.2, 256)])
def test_large_images_are_cut_and_joined(spark, share, tile):
    rng = np.random.default_rng(tile)
    images = {1: {(int(a), int(b)) for a, b in zip(*np.nonzero(rng.random((60, 70)) < share), strict=True)}, 2: spiral(60), 3: {(-5, -9), (-4, -8), (7, 7)}}
    rows = [(i, y, x) for i, p in images.items() for y, x in p] + [(1, *next(iter(images[1])))] * 3 + [(3, None, 1), (None, 1, 1)]
    got = regions.regions(spark.createDataFrame(rows, "img_id int, y int, x int").repartition(4), tile).collect()
    for i, pixels in images.items():
        own = sorted((r.seq, r.x, r.y, r.w, r.h, r.area) for r in got if r.img_id == i)
        assert own == [(k, *box) for k, box in enumerate(flood(pixels))]
    assert {r.img_id for r in got} == {1, 2, 3}


def test_the_spiral_is_one_region():
    assert len(flood(spiral(60))) == 1 and len(spiral(60)) > 1_000


def test_small_images_equal_the_kernel_of_single_images(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(y), int(x)) for i in range(6) for y, x in zip(*np.nonzero(rng.random((40, 40)) < 0.3), strict=True)]
    ink = spark.createDataFrame(rows, "img_id long, y int, x int")
    assert sorted(map(tuple, regions.regions(ink).collect())) == sorted(map(tuple, glyphs.image_components(ink, 40, 40).collect()))
    assert regions.regions(ink.limit(0)).count() == 0


def test_ranks_within_groups_of_any_size(spark):
    rows = [("a" if k % 10 else None, k * 37 % 1_000, f"x{k}") for k in range(1_000)] + [("b", 5, "x")]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, v int, x string").repartition(3), ["g"], ["v"], "place", 7).collect()
    for group in ("a", "b", None):
        own = sorted(r[1] for r in rows if r[0] == group)
        assert [r.v for r in sorted((r for r in got if r.g == group), key=lambda r: r.place)] == own
        assert sorted(r.place for r in got if r.g == group) == list(range(1, len(own) + 1))
