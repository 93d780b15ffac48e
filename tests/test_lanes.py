"""Strokes walked side by side give the dabs of each walked alone, to the last bit."""

import math
import random
import time

import numpy as np
import pandas as pd

from tessella.operators import strokes as K
from tessella.operators.presets import BRUSHES


def samples(strokes, n, seed=5):
    rng, rows = random.Random(seed), []
    for stroke in range(strokes):
        x, y, t = rng.uniform(0, 900), rng.uniform(0, 900), 0.0
        for seq in range(rng.choice([1, 2, 3, n // 2, n])):
            x, y, t = x + rng.choice([0.0, 0.01, 3.0, 25.0, -60.0]), y + rng.choice([0.0, 2.0, -20.0]), t + rng.choice([0.0, 0.008, 0.3])
            # No path: a point that is none is left out of the walk.
            at = math.inf if stroke % 17 == 3 and seq == 2 else x
            rows.append((stroke, seq, at, y, t, rng.choice([0.0, 0.3, 1.0, rng.random()]), rng.choice([0.0, 7.3]) if stroke % 2 else 0.0))
    frame = pd.DataFrame(rows, columns=["stroke_id", "seq", "x", "y", "t", "pressure", "radius"])
    return frame.assign(brush=[BRUSHES[s % 5] for s in frame.stroke_id], size=24.0, seed=frame.stroke_id + 7)


def alone(frame):
    rows = []
    for stroke, part in frame.groupby("stroke_id"):
        fold = K.StrokeFold(part.brush.iloc[0], 24.0, stroke + 7)
        rows += fold.push(stroke, part) + fold.finish(stroke)
    return pd.DataFrame(rows, columns=K.DAB_COLUMNS)


def test_side_by_side_equals_alone(monkeypatch):
    frame = samples(150, 40)
    want = alone(frame)
    for stretch, cut in ((1 << 20, len(frame)), (700, 97), (60, 41)):
        monkeypatch.setattr(K, "SIDE_BY_SIDE", stretch)
        frames = [frame.iloc[i : i + cut] for i in range(0, len(frame), cut)]
        got = pd.concat(list(K._dab_rows(frames))).sort_values(["stroke_id", "dab_no"], kind="stable", ignore_index=True)
        assert set(got.stroke_id) == set(want.stroke_id) and len(want) > 5000
        pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_many_strokes_are_no_loop_over_dabs():
    at = np.arange(24_000)
    frame = pd.DataFrame({"stroke_id": at // 40, "seq": at, "x": at * 37.0 % 90, "y": at * 61.0 % 70, "t": at / 10, "pressure": at % 7 / 7, "radius": 0.0})
    frame = frame.assign(brush="soft_round", size=24.0, seed=frame.stroke_id + 7)
    began = time.process_time()
    want = len(alone(frame))
    between = time.process_time()
    frames = list(K._dab_rows([frame]))
    assert sum(map(len, frames)) == want and max(map(len, frames)) < 80_000
    assert time.process_time() - between < (between - began) / 2


def test_a_long_stroke_among_many_is_walked_alone_at_the_end():
    long = samples(1, 10).iloc[:0]
    at = np.arange(3000)
    long = pd.DataFrame({"stroke_id": 500, "seq": at, "x": at * 37.0 % 160, "y": at * 61.0 % 120, "t": at / 10, "pressure": at % 7 / 7, "radius": 0.0})
    frame = pd.concat([samples(40, 6), long.assign(brush="marker", size=24.0, seed=507)], ignore_index=True)
    frames = list(K._dab_rows([frame]))
    got = pd.concat(frames).sort_values(["stroke_id", "dab_no"], kind="stable", ignore_index=True)
    assert got.equals(alone(frame)) and max(map(len, frames)) < 100_000
