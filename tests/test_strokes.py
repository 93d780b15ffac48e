import math

import pandas as pd
import pytest

from tessella.operators import strokes as K
from tessella.operators.presets import preset_rows

DT = 1.0 / 120.0


def slow_line():
    return [(20.0 + 2 * i, 50.0, i * DT, 0.0, 9.0) for i in range(60)]


def dwell():
    return [(200.0, 200.0, i * DT, 0.0, 8.15 if i % 2 == 0 else 7.85) for i in range(40)]


def fast_turn():
    turn, out = 250.0, []
    xs = [10.0 + 40 * i for i in range(7)] + [turn + 3.0] + [turn - 40.0 * i for i in range(1, 7)]
    ys = [100.0] * 7 + [103.0] + [106.0] * 6
    for i, (x, y) in enumerate(zip(xs, ys)):
        out.append((x, y, i * DT, 0.0, 11.0))
    return out


PATHS = {"slow_line": slow_line, "dwell": dwell, "fast_turn": fast_turn}


def run(path, brush, size=24.0, seed=24301, cuts=()):
    fold = K.StrokeFold(brush, size, seed)
    frame = pd.DataFrame(path, columns=["x", "y", "t", "pressure", "radius"])
    out, edges = [], [0, *cuts, len(frame)]
    for lo, hi in zip(edges, edges[1:]):
        out += fold.push(1, frame.iloc[lo:hi])
        fold = K.StrokeFold(brush, size, seed).load(fold.state())
    return out + fold.finish(1)


# Dabs of known strokes at diameter 24.
@pytest.mark.parametrize(
    "path,brush,dabs",
    [
        ("dwell", "soft_round", 1), ("dwell", "marker", 1), ("dwell", "crayon", 1), ("dwell", "airbrush", 1),
        ("dwell", "watercolor", 1), ("slow_line", "soft_round", 144), ("slow_line", "marker", 209),
        ("slow_line", "crayon", 23), ("slow_line", "watercolor", 146), ("fast_turn", "crayon", 87),
    ],
)
def test_dab_counts(path, brush, dabs):
    assert len(run(PATHS[path](), brush)) == dabs


# X, y, size, angle and alpha of the first, middle and last dab of known strokes.
KNOWN = [
    ("dwell", "airbrush", {0: (200.0000, 200.0000, 18.0000, 0.0000, 0.0520)}),
    ("dwell", "crayon", {0: (199.7453, 199.0021, 17.4000, 0.6057, 0.3481)}),
    ("dwell", "marker", {0: (200.0000, 200.0000, 18.6000, 0.0000, 0.9500)}),
    ("dwell", "soft_round", {0: (200.0000, 200.0000, 16.2000, 0.0000, 0.7000)}),
    ("dwell", "watercolor", {0: (200.0000, 200.0000, 16.8000, 0.0000, 0.1013)}),
    ("fast_turn", "crayon", {0: (9.7453, 99.0021, 17.4000, 0.6057, 0.3481), 43: (232.7794, 101.3120, 17.4000, 1.0152, 0.3481), 86: (43.0087, 106.6345, 17.4000, 1.6927, 0.3481)}),
    ("slow_line", "crayon", {0: (19.7453, 49.0021, 17.4000, 0.6057, 0.3481), 11: (75.5003, 50.2239, 17.4000, 1.6627, 0.3481), 22: (133.3269, 48.7275, 17.4000, -3.1035, 0.3481)}),
    ("slow_line", "marker", {0: (20.0000, 50.0000, 18.6000, 0.0000, 0.9500), 104: (78.0319, 50.0000, 18.6000, 0.0000, 0.9500), 208: (136.0638, 50.0000, 18.6000, 0.0000, 0.9500)}),
    ("slow_line", "soft_round", {0: (20.0000, 50.0000, 16.2000, 0.0000, 0.7000), 72: (78.3200, 50.0000, 16.2000, 0.0000, 0.7000), 143: (135.8298, 50.0000, 16.2000, 0.0000, 0.7000)}),
    ("slow_line", "watercolor", {0: (20.0000, 50.0000, 16.8000, 0.0000, 0.1013), 73: (78.5053, 50.0000, 16.0396, 0.0000, 0.1013), 145: (136.2578, 50.0000, 16.0436, 0.0000, 0.1013)}),
]


@pytest.mark.parametrize("path,brush,dabs", KNOWN)
def test_dab_values(path, brush, dabs):
    got = run(PATHS[path](), brush)
    for i, want in dabs.items():
        assert got[i][2:7] == pytest.approx(want, abs=1.5e-4)


def test_cuts_and_stored_state_do_not_change_the_dabs():
    for brush in preset_rows():
        whole = run(fast_turn(), brush)
        assert run(fast_turn(), brush, cuts=(1, 2, 3, 9)) == whole
        assert run(fast_turn(), brush, cuts=tuple(range(1, 14))) == whole


def test_jitter_moves_dabs_but_not_the_walk():
    still = dict(preset_rows()["crayon"], jitter_pos=0.0, jitter_angle=0.0)
    smooth = K.SmoothedInput()
    controls = [smooth.push(*s) for s in slow_line()]
    a, b = K.DabWalk(still, 24.0, 5), K.DabWalk(preset_rows()["crayon"], 24.0, 5)
    plain, shaken = a.push(controls) + a.finish(), b.push(controls) + b.finish()
    assert len(plain) == len(shaken) and any(p[0] != s[0] for p, s in zip(plain, shaken))
    assert [p[2] for p in plain] == [s[2] for s in shaken]


def test_bad_time_stamps_stay_finite():
    path = [(0.0, 0.0, 0.0, 0.5, 0.0), (9.0, 0.0, 0.0, 0.5, 0.0), (20.0, 3.0, -1.0, 0.5, 0.0), (30.0, 3.0, 0.1, 0.5, 0.0)]
    assert all(math.isfinite(v) for d in run(path, "airbrush") for v in d[2:])


def test_spark_folds_each_stroke_in_order(spark):
    rows = []
    for sid, (name, brush) in enumerate([("slow_line", "marker"), ("fast_turn", "crayon"), ("dwell", "airbrush")]):
        rows += [(sid, n, *s, False, brush, 24.0, 24301) for n, s in enumerate(PATHS[name]())]
        rows.append((sid, 10_000, 999.0, 999.0, 9.0, 1.0, 9.0, True, brush, 24.0, 24301))
    schema = "stroke_id long, seq long, x double, y double, t double, pressure double, radius double, predicted boolean, brush string, size double, seed long"
    got = K.generate_dabs(spark.createDataFrame(rows[::-1], schema)).groupBy("stroke_id").count().collect()
    assert {r["stroke_id"]: r["count"] for r in got} == {0: 209, 1: 87, 2: 1}


def test_log_gives_samples_back_within_the_stated_bounds(spark):
    import random

    from tessella.operators import documents as D

    rng = random.Random(4)
    rows, t = [], 0.0
    for stroke in range(3):
        for seq in range(40):
            t += rng.choice([0.0, 0.004, 0.0083, 0.9, 2.5])
            rows.append((stroke, seq, rng.uniform(-3000, 3000), rng.uniform(0, 2048), t, rng.random(), rng.uniform(0, 60), rng.uniform(-90, 90), rng.uniform(-90, 90)))
    df = spark.createDataFrame(rows, "stroke_id long, seq long, x double, y double, t double, pressure double, radius double, tilt_x double, tilt_y double")
    coded = D.delta_encode(D.quantize(df))
    assert coded.count() > len(rows)  # long pauses take filler rows
    got = {(r.stroke_id, r.seq): r for r in D.dequantize(D.delta_decode(coded)).collect()}
    first = {s: min(r[4] for r in rows if r[0] == s) for s in range(3)}
    assert len(got) == len(rows)
    for stroke, seq, x, y, at, pressure, radius, tx, ty in rows:
        r = got[stroke, seq]
        assert max(abs(r.x - x), abs(r.y - y), abs(r.radius - radius), abs(r.tilt_x - tx), abs(r.tilt_y - ty)) <= 0.5
        assert abs(r.pressure - pressure) <= 1 / 510 + 1e-12 and abs(r.t - (at - first[stroke])) <= 0.001 + 1e-9


def test_replays_of_fingers_keep_their_numbers(spark, tmp_path):
    """Strokes whose whole-pixel radii gave a tenth more or fewer dabs, or crayon dabs on other places."""
    from tessella.plans.document_queries import replayed_strokes

    users = [160, 370, 392, 510, 602, 680]
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where(f"user_id in ({str(users)[1:-1]})")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = replayed_strokes(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(u, True, True) for u in users]
