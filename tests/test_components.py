import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators.components import component_runs, components, star_forest
from tessella.operators.intervals import overlap_join


def flood(grid):
    """Brute force: raster-order flood fill, component named by its first pixel."""
    h, w = grid.shape
    out = {}
    for y in range(h):
        for x in range(w):
            if grid[y, x] < 0 or (x, y) in out:
                continue
            stack, name = [(x, y)], (y << 32) | x
            out[(x, y)] = name
            while stack:
                cx, cy = stack.pop()
                for nx, ny in ((cx - 1, cy), (cx + 1, cy), (cx, cy - 1), (cx, cy + 1)):
                    if 0 <= nx < w and 0 <= ny < h and (nx, ny) not in out and grid[ny, nx] == grid[cy, cx]:
                        out[(nx, ny)] = name
                        stack.append((nx, ny))
    return out


@pytest.mark.parametrize("tile,merge", [(4, 8), (16, 8), (64, 8), (8, 2), (2, 2), (3, 3)])
def test_components_match_flood_fill(spark, tile, merge):
    rng = np.random.default_rng(tile)
    grids = {i: np.where(rng.random((20, 23)) < 0.4, -1, rng.integers(0, 2, (20, 23))) for i in range(3)}
    # One long snake, whose component crosses every tile.
    snake = np.full((21, 21), -1)
    snake[::2, :] = 0
    for k, y in enumerate(range(1, 21, 2)):
        snake[y, -1 if k % 2 == 0 else 0] = 0
    grids[9] = snake
    rows = [
        (i, x, y, None if g[y, x] < 0 else int(g[y, x]))
        for i, g in grids.items()
        for y in range(g.shape[0])
        for x in range(g.shape[1])
    ]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, c long")
    got = components(px, F.col("c"), tile=tile, merge=merge).toPandas()
    want = pd.DataFrame(
        [(i, x, y, n) for i, g in grids.items() for (x, y), n in flood(g).items()],
        columns=["image_id", "x", "y", "component"],
    )
    cols = ["image_id", "y", "x", "component"]
    a = got[cols].sort_values(cols).astype("int64").to_numpy()
    b = want[cols].sort_values(cols).astype("int64").to_numpy()
    assert a.shape == b.shape and (a == b).all()


def test_overlap_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    sides = []
    for name in "ab":
        start = rng.integers(-20, 200, 150)
        rows = [(int(k), int(s), int(s + n)) for k, s, n in zip(rng.integers(0, 3, 150), start, rng.integers(-2, 40, 150))]
        sides.append((rows, spark.createDataFrame(rows, f"k long, {name}0 long, {name}1 long")))
    (a, left), (b, right) = sides
    want = sorted((k, *p, *q) for k, *p in a for k2, *q in b if k == k2 and p[0] <= p[1] and q[0] <= q[1] and p[0] <= q[1] and q[0] <= p[1])
    for bucket in (1, 16, 1000):
        got = overlap_join(left, right, ["k"], ("a0", "a1"), ("b0", "b1"), bucket)
        assert sorted(tuple(r) for r in got.select("k", "a0", "a1", "b0", "b1").collect()) == want


def test_only_runs_are_moved(spark):
    """Of a plane of two halves only a run per row and tile goes on after the first shuffle."""
    px = spark.range(64 * 64).selectExpr("1L as image_id", "cast(id % 64 as int) as x", "cast(id div 64 as int) as y", "cast(id div 2048 as long) as c")
    runs = component_runs(px, F.col("c"), tile=16)
    assert runs.count() == 64 * 4 and {r.component for r in runs.collect()} == {0, 32 << 32}
    assert components(px, F.col("c"), tile=16).count() == 64 * 64
    assert component_runs(px.limit(0), F.col("c")).count() == 0


def test_star_forest(spark):
    rng = np.random.default_rng(2)
    edges = {(1, int(max(a, b)), int(min(a, b))) for a, b in rng.integers(0, 60, (45, 2)) if a != b}
    got = {r.u: r.v for r in star_forest(spark.createDataFrame(sorted(edges), "image_id long, u long, v long")).collect()}
    least = {n: n for e in edges for n in e[1:]}
    for _ in range(60):
        for _, u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    assert got == {n: m for n, m in least.items() if n != m}
