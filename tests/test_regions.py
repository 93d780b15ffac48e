import numpy as np
import pytest
from pyspark.sql import functions as F

from grids import dilate, grow_and_merge, pixel_rows, wave
from tessella.operators import labels as L
from tessella.operators import regions as R


def as_grid(rows, w, h, name="label"):
    out = -np.ones((h, w), dtype=int)
    for r in rows:
        out[r["y"], r["x"]] = -1 if r[name] is None else r[name]
    return out


def test_grow_and_merge_match_imperative_fill(spark):
    rng = np.random.default_rng(3)
    w, h, lines, seeds, want = 13, 11, {}, [], {}
    for i in range(12):
        line = rng.random((h, w)) < rng.choice([0.35, 0.55, 0.7])
        spots = sorted({(int(rng.integers(w)), int(rng.integers(h))) for _ in range(4)}, key=lambda p: (p[1], p[0]))
        lines[i] = line
        seeds += [(i, k, x, y) for k, (x, y) in enumerate(spots)]
        want[i] = grow_and_merge(line, spots, 4)
    px = spark.createDataFrame(pixel_rows(lines, bool), "image_id long, x int, y int, line boolean")
    seed_df = spark.createDataFrame(seeds, "image_id long, seed_id long, ax int, ay int")
    grown = R.grow(seed_df, px, tile=8)
    merged, kept = R.merge_fragments(grown["pixels"], min_area=4, tile=8)
    rows = merged.collect()
    keep = kept.collect()
    coll = grown["collisions"].collect()
    onl = grown["on_line"].collect()
    for i in lines:
        label, k, c, o = want[i]
        got = as_grid([r for r in rows if r["image_id"] == i], w, h)
        assert (got == label).all(), i
        mine = sorted([(r["area"], r["x"], r["y"]) for r in keep if r["image_id"] == i], key=lambda t: (-t[0], t[2], t[1]))
        assert mine == k
        assert sorted((r["owner"], r["seed_id"]) for r in coll if r["image_id"] == i) == sorted(c)
        assert sorted(r["seed_id"] for r in onl if r["image_id"] == i) == o


def test_thick_lines_take_rounds_of_tiles_not_of_pixels(spark, monkeypatch):
    """Lines of up to twenty pixels; the number of jobs is the same for thin and thick ones inside a tile."""
    rng = np.random.default_rng(8)

    def picture(thick, n):
        line = np.zeros((64, 64), bool)
        line[:, 20 : 20 + thick] = True
        line[30 : 30 + thick] = True
        for x, y in rng.integers(0, 62, (n, 2)):
            line[max(0, y - 1) : y + 3, max(0, x - 1) : x + 3] = True
            line[y : y + 1, x : x + 2] = False
        return line

    for tile in (16, 64):
        lines = {i: picture(t, n) for i, (t, n) in enumerate([(1, 5), (6, 8), (20, 12)])}
        free = {i: [(int(x), int(y)) for y, x in np.argwhere(~g)] for i, g in lines.items()}
        spots = {i: sorted({free[i][0], free[i][-1]}, key=lambda p: (p[1], p[0])) for i in lines}
        want = {i: grow_and_merge(lines[i], spots[i], 40)[0] for i in lines}
        px = spark.createDataFrame(pixel_rows(lines, bool), "image_id long, x int, y int, line boolean")
        seeds = spark.createDataFrame([(i, k, x, y) for i in lines for k, (x, y) in enumerate(spots[i])], "image_id long, seed_id long, ax int, ay int")
        merged, _ = R.merge_fragments(R.grow(seeds, px, tile)["pixels"], min_area=40, tile=tile)
        rows = merged.collect()
        for i in lines:
            assert (as_grid([r for r in rows if r["image_id"] == i], 64, 64) == want[i]).all(), (tile, i)

    def rounds(thick, tile):
        done = []
        monkeypatch.setattr(R, "materialize", lambda df, label, real=R.materialize: done.append(label) or real(df, label))
        line = np.zeros((64, 64), bool)
        line[:, 5 : 5 + thick] = True
        line[:, 40] = True
        px = spark.createDataFrame(pixel_rows({0: line}, bool), "image_id long, x int, y int, line boolean")
        seeds = spark.createDataFrame([(0, 0, 60, 3)], "image_id long, seed_id long, ax int, ay int")
        R.merge_fragments(R.grow(seeds, px, tile)["pixels"], min_area=100_000, tile=tile)[0].count()
        monkeypatch.undo()
        return done.count("found")

    assert rounds(20, 64) == rounds(1, 64) == 1
    assert rounds(20, 32) == rounds(1, 32)


def test_close_is_the_synchronous_wave(spark):
    rng = np.random.default_rng(5)
    grids = {i: np.where(rng.random((9, 12)) < 0.12, rng.integers(0, 6, (9, 12)), -1) for i in range(8)}
    grids[99] = -np.ones((3, 4), dtype=int)
    rows = pixel_rows({i: [[None if v < 0 else v for v in r] for r in g] for i, g in grids.items()})
    px = spark.createDataFrame(rows, "image_id long, x int, y int, label long")
    closed = L.close_labels(px)
    got = closed.collect()
    summary = {r["image_id"]: r for r in L.close_summary(closed).collect()}
    for i, g in grids.items():
        want, rounds = wave(g)
        mine = as_grid([r for r in got if r["image_id"] == i], g.shape[1], g.shape[0], "closed")
        assert (mine == want).all()
        assert summary[i]["rounds"] == rounds
        assert summary[i]["unassigned"] == (want < 0).sum()


@pytest.mark.parametrize(
    "ids,alpha,areas,want",
    [
        ([0, 9, 9, 9, 1], [0, 255, 255, 255, 0], {0: 10, 1: 20, 9: 999}, [0, 0, 0, 1, 1]),
        ([0, 9, 9, 9, 9, 1], [0, 255, 255, 255, 255, 0], {0: 10, 1: 20, 9: 999}, [0, 0, 0, 1, 1, 1]),
        ([0, 9, 9, 9, 9, 9, 9, 1], [0] + [255] * 6 + [0], {0: 10, 1: 20, 9: 999}, [0, 0, 0, 9, 9, 1, 1, 1]),
        ([5, 5, 5, 5], [0, 0, 0, 0], {5: 1}, [5, 5, 5, 5]),
        ([0, 9, 1], [0, 31, 0], {0: 1, 1: 1, 9: 1}, [0, 9, 1]),
    ],
)
def test_dilate_rows(spark, ids, alpha, areas, want):
    rows = [(0, x, 0, v, areas[v], a) for x, (v, a) in enumerate(zip(ids, alpha))]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, label long, master_area long, alpha int")
    for tile in (3, 64):
        got = {r["x"]: r["label"] for r in L.dilate_under_line(px, tile=tile).collect()}
        assert [got[x] for x in range(len(ids))] == want


def test_dilate_matches_snapshot_rounds_across_tiles(spark):
    rng = np.random.default_rng(11)
    ids = rng.integers(0, 5, (17, 19))
    alpha = np.where(rng.random((17, 19)) < 0.7, 255, 0)
    areas = {i: int(a) for i, a in enumerate([7, 3, 3, 9, 1])}
    rows = [
        (0, x, y, int(ids[y, x]), areas[int(ids[y, x])], int(alpha[y, x]))
        for y in range(17)
        for x in range(19)
    ]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, label long, master_area long, alpha int")
    got = as_grid(L.dilate_under_line(px, tile=4).collect(), 19, 17)
    assert (got == dilate(ids, alpha, areas)).all()


@pytest.mark.parametrize(
    "quad,areas,want",
    [
        ([0, 0, 0, 1], {0: 100, 1: 1}, 0),
        ([0, 0, 1, 1], {0: 10_000, 1: 40}, 1),
        ([1, 1, 0, 0], {0: 10_000, 1: 40}, 1),
        ([1, 1, 0, 0], {0: 40, 1: 40}, 0),
        ([0, 1, 2, 3], {0: 9, 1: 8, 2: 7, 3: 6}, 3),
    ],
)
def test_majority(spark, quad, areas, want):
    rows = [(0, k % 2, k // 2, v, areas[v], 2, 2) for k, v in enumerate(quad)]
    px = spark.createDataFrame(
        rows, "image_id long, x int, y int, label long, master_area long, width int, height int"
    )
    assert [r["label"] for r in L.majority(px).collect()] == [want]


def test_box_filter_rounds_half_up_and_drops_the_edge(spark):
    rows = [(0, x, y, v, 3, 3) for (x, y), v in {(0, 0): 0, (1, 0): 1, (0, 1): 2, (1, 1): 3, (2, 0): 9, (2, 2): 9}.items()]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, a int, width int, height int")
    assert [tuple(r) for r in L.box_downsample(px, ["a"], 2).collect()] == [(0, 0, 0, 2)]
    assert [tuple(r) for r in L.box_downsample_by(px, ["a"], F.lit(2)).collect()] == [(0, 0, 0, 2)]


def test_seed_description(spark):
    # A horseshoe whose centre of mass is outside it, a two-colour tie, and a see-through blob.
    cells = {(x, y): (9, 9, 9, 255) for x, y in [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (2, 2)]}
    cells |= {(5, 0): (2, 0, 0, 255), (6, 0): (1, 9, 9, 255)}
    cells |= {(9, 2): (7, 7, 7, 100)}
    rows = [(0, x, y, *cells.get((x, y), (0, 0, 0, 0))) for x in range(11) for y in range(4)]
    px = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")
    got = [
        (r["seed_id"], r["ax"], r["ay"], r["r"], r["g"], r["b"], r["solid_area"])
        for r in R.read_seeds(px, tile=4).orderBy("seed_id").collect()
    ]
    assert got == [(0, 1, 0, 9, 9, 9, 7), (1, 5, 0, 1, 9, 9, 2), (2, 9, 2, 0, 0, 0, 0)]
