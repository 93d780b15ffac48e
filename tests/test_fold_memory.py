"""A batch of samples far apart gives a hundred dabs for each; they are handed on bit by bit."""

import numpy as np
import pandas as pd

from tessella.operators import strokes as K
from tessella.operators.presets import preset_rows


def batch(n=3000):
    at = np.arange(n)
    return pd.DataFrame(
        {"stroke_id": at // 700, "seq": at, "x": at * 37.0 % 160, "y": at * 61.0 % 120, "t": at / 10, "pressure": at % 7 / 7, "radius": 0.0}
    ).assign(brush="marker", size=24.0, seed=7)


def test_frames_are_bounded_and_cuts_change_nothing():
    whole = batch()
    frames = list(K._dab_rows([whole]))
    got = pd.concat(frames, ignore_index=True)
    assert len(got) > 10 * len(whole)
    assert max(map(len, frames)) < len(got) / 4
    want = []
    for stroke, part in whole.groupby("stroke_id"):
        smooth, walk = K.SmoothedInput(), K.DabWalk(preset_rows()["marker"], 24.0, 7)
        dabs = walk.push(K.controls_of(part, smooth)) + walk.finish()
        want += [(stroke, n, *d) for n, d in enumerate(dabs)]
    pd.testing.assert_frame_equal(got, pd.DataFrame(want, columns=K.DAB_COLUMNS), check_exact=True)
    assert [len(f) for f in K._dab_rows([whole.iloc[:0]])] == [0]
