"""Tree hash: the definition by plain code, one changed pixel, other sizes, empty input."""

import hashlib
import random
import struct

import pytest

from tessella.operators import tree_hash as H


def plain(grid, tile, fan):
    """Root and levels of a grid given as rows of ids."""
    h, w = len(grid), len(grid[0])
    digest = lambda kind, data: hashlib.sha256(bytes([kind]) + data).digest()
    level = []
    for ty in range(-(-h // tile)):
        for tx in range(-(-w // tile)):
            rows = [grid[y][tx * tile : (tx + 1) * tile] for y in range(ty * tile, min(h, (ty + 1) * tile))]
            level.append(digest(0, struct.pack("<II", tx, ty) + b"".join(struct.pack("<H", v) for r in rows for v in r)))
    levels = [level]
    while len(level) > 1:
        level = [digest(1, b"".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        levels.append(level)
    return "sha256-tree-1:" + digest(2, struct.pack("<III", w, h, tile) + level[0]).hex(), levels


def frame(spark, grids):
    rows = [(i, x, y, v) for i, g in grids.items() for y, r in enumerate(g) for x, v in enumerate(r)]
    random.Random(1).shuffle(rows)
    images = [(i, len(g[0]), len(g)) for i, g in grids.items()]
    return spark.createDataFrame(rows, "image_id long, x int, y int, label int"), spark.createDataFrame(images, "image_id long, width int, height int")


@pytest.mark.parametrize("tile,fan", [(4, 2), (5, 4), (64, 16)])
def test_hash_by_definition(spark, tile, fan):
    rng = random.Random(tile)
    grids = {i: [[rng.randrange(65536) for _ in range(w)] for _ in range(h)] for i, (w, h) in enumerate([(1, 1), (9, 4), (23, 31), (8, 8), (40, 3)])}
    labels, images = frame(spark, grids)
    nodes = H.tree(labels, images, tile, fan)
    got = {(r.image_id, r.level, r.node): bytes(r.digest) for r in nodes.collect()}
    want = {(i, lv, n): d for i, g in grids.items() for lv, level in enumerate(plain(g, tile, fan)[1]) for n, d in enumerate(level)}
    assert got == want
    assert {r.image_id: r.tree_hash for r in H.tree_hash(nodes, images, tile).collect()} == {i: plain(g, tile, fan)[0] for i, g in grids.items()}


def test_one_pixel_changes_its_path_only(spark):
    rng = random.Random(7)
    grid = [[rng.randrange(9) for _ in range(30)] for _ in range(22)]
    other = [list(r) for r in grid]
    other[13][21] += 1
    labels, images = frame(spark, {1: grid, 2: grid})
    hurt, _ = frame(spark, {1: other, 2: grid})
    a, b = H.tree(labels, images, 4, 2), H.tree(hurt, images, 4, 2)
    digests = lambda t: {(r.image_id, r.level, r.node): bytes(r.digest) for r in t.collect()}
    one, two = digests(a), digests(b)
    leaf = 13 // 4 * 8 + 21 // 4
    assert {k for k in one if one[k] != two[k]} == {(1, lv, leaf >> lv) for lv in range(7)}
    assert [tuple(r) for r in H.damaged_tiles(a, b, images, 4, 2).collect()] == [(1, 21 // 4, 13 // 4)]
    assert H.damaged_tiles(a, a, images, 4, 2).count() == 0


def test_a_lost_tile_is_damage_and_nothing_gives_nothing(spark):
    labels, images = frame(spark, {1: [[1] * 16] * 16})
    a, b = H.tree(labels, images, 4, 2), H.tree(labels.where("x < 12 or y < 12"), images, 4, 2)
    assert [tuple(r) for r in H.damaged_tiles(a, b, images, 4, 2).collect()] == [(1, 3, 3)]
    nothing = H.tree(labels.limit(0), images.limit(0))
    assert nothing.count() == 0 and H.tree_hash(nothing, images).count() == 0 and H.damaged_tiles(nothing, a, images).count() == 0
