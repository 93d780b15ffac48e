"""Input samples to dabs: smoothing, pressure, speed, spline and arc-length resampling.

The recurrence is truly sequential: the smoothing cutoff depends on the filtered state and the
gap to the next dab on the size of the last one.  Spark partitions the strokes and sorts the
samples; every partition is then streamed through a fold whose state is a few dozen numbers per
stroke, so a stroke of any length runs in constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.chunked import attach_totals, fan_out, previous, seq_block
from tessella.operators.presets import preset_rows

# Fixed values of the stroke pipeline.
POSITION_FILTER = (1.0, 0.05, 1.0)  # min cutoff, beta, derivative cutoff
RADIUS_FILTER = (0.5, 0.0, 1.0)
RADIUS_SPAN = 4.0
SUBSTEPS = 32
MIN_STEP = 0.05
REFERENCE_SPEED = 2400.0
KNOT_FLOOR = 1e-4

#: Segments whose points are computed at once.
CURVES = 2_048

MASK32 = 0xFFFFFFFF
_U = np.arange(SUBSTEPS + 1, dtype=np.float32) / np.float32(SUBSTEPS)


def unit_clamp(v: float) -> float:
    return 0.0 if v < 0.0 else 1.0 if v > 1.0 else v


def _single(v: float) -> float:
    return float(np.float32(v))


def _gain(cutoff: float, dt: float) -> float:
    return dt / (dt + 1.0 / (2.0 * math.pi * cutoff))


class SmoothedInput:
    """One-Euro smoothing of position and radius, pressure baseline and speed of one stroke."""

    __slots__ = ("pos", "rad", "low", "high", "last_t", "speed", "x", "y")

    def __init__(self) -> None:
        self.pos = None  # x, y, dx, dy, t
        self.rad = None  # r, dr, t
        self.low = self.high = None
        self.last_t = None
        self.speed = 0.0
        self.x = self.y = 0.0

    def push(self, x: float, y: float, t: float, pressure: float, radius: float):
        """Smoothed ``x, y, pressure, speed`` for one real sample."""
        x, y, t = _single(x), _single(y), _single(t)
        fx, fy = self._position(x, y, t)
        if radius > 0.0:
            r = self._radius(radius, t)
            if self.low is None:
                self.low, self.high = r - RADIUS_SPAN / 2, r + RADIUS_SPAN / 2
            self.low, self.high = min(self.low, r), max(self.high, r)
            p = unit_clamp((r - self.low) / max(self.high - self.low, RADIUS_SPAN))
        else:
            p = unit_clamp(pressure)
        if self.last_t is None:
            speed = 0.0
        else:
            dt = t - self.last_t
            # A repeated or backward time stamp keeps the last speed.
            ok = dt > 0.0 and math.isfinite(dt)
            speed = math.hypot(fx - self.x, fy - self.y) / dt if ok else self.speed
        self.last_t, self.speed, self.x, self.y = t, speed, fx, fy
        return fx, fy, p, speed

    def _position(self, x: float, y: float, t: float):
        if self.pos is None:
            self.pos = (x, y, 0.0, 0.0, t)
            return x, y
        px, py, vx, vy, pt = self.pos
        dt = t - pt
        if dt <= 0.0:
            return px, py
        floor, beta, dcut = POSITION_FILTER
        k = _gain(dcut, dt)
        vx += ((x - px) / dt - vx) * k
        vy += ((y - py) / dt - vy) * k
        # One cutoff for both axes, from the length of the velocity.
        k = _gain(floor + beta * math.hypot(vx, vy), dt)
        px, py = _single(px + (x - px) * k), _single(py + (y - py) * k)
        self.pos = (px, py, vx, vy, t)
        return px, py

    def _radius(self, r: float, t: float):
        if self.rad is None:
            self.rad = (r, 0.0, t)
            return r
        pr, vr, pt = self.rad
        dt = t - pt
        if dt <= 0.0:
            return pr
        floor, beta, dcut = RADIUS_FILTER
        vr += ((r - pr) / dt - vr) * _gain(dcut, dt)
        pr += (r - pr) * _gain(floor + beta * abs(vr), dt)
        self.rad = (pr, vr, t)
        return pr

    def state(self) -> list:
        return [self.pos, self.rad, self.low, self.high, self.last_t, self.speed, self.x, self.y]

    def load(self, state: list) -> None:
        pos, rad, self.low, self.high, self.last_t, self.speed, self.x, self.y = state
        self.pos = None if pos is None else tuple(pos)
        self.rad = None if rad is None else tuple(rad)


def spline_points(pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centripetal Catmull-Rom of ``n`` segments at once.

    ``pts`` is ``(n, 4, 2)``; gives x and y, ``(n, SUBSTEPS + 1)`` each, from the second to the
    third control of every segment.
    """
    pts = np.asarray(pts, dtype=np.float32)
    legs = pts[:, 1:] - pts[:, :-1]
    gaps = np.sqrt(np.maximum(np.hypot(legs[..., 0], legs[..., 1]), np.float32(KNOT_FLOOR)))
    t = np.concatenate((np.zeros((len(pts), 1), np.float32), np.cumsum(gaps, axis=1, dtype=np.float32)), axis=1)
    tt = t[:, 1:2] + (t[:, 2:3] - t[:, 1:2]) * _U

    def blend(a, b, i, j):
        w = ((tt - t[:, i : i + 1]) / (t[:, j : j + 1] - t[:, i : i + 1]))[..., None]
        return a + (b - a) * w

    p = [pts[:, i : i + 1] for i in range(4)]
    a1, a2, a3 = (blend(p[i], p[i + 1], i, i + 1) for i in range(3))
    out = blend(blend(a1, a2, 0, 2), blend(a2, a3, 1, 3), 1, 2).astype(float)
    return out[..., 0], out[..., 1]


def curves(segments: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points of segments, the lengths between them and the length of each segment."""
    xs, ys = np.empty((len(segments), SUBSTEPS + 1)), np.empty((len(segments), SUBSTEPS + 1))
    for lo in range(0, len(segments), CURVES):
        part = segments[lo : lo + CURVES]
        xs[lo : lo + CURVES], ys[lo : lo + CURVES] = spline_points(np.array([[p[:2] for p in seg] for seg in part]))
    steps = np.hypot(np.diff(xs), np.diff(ys))
    return xs, ys, steps, steps.sum(axis=1)


class DabWalk:
    """Walks the spline of one stroke and places dabs; state carries over between samples."""

    __slots__ = ("preset", "size", "rng", "ctrl", "count", "acc", "gap", "jitter", "shape")

    def __init__(self, preset: dict, size: float, seed: int) -> None:
        self.preset, self.size = preset, size
        # What every dab asks of the preset.
        self.shape = (
            *(preset["velocity_to_size"], preset["size_min"], preset["size_max"] - preset["size_min"], preset["size_gamma"]),
            *(preset["flow"], preset["alpha_min"], preset["alpha_max"] - preset["alpha_min"], preset["alpha_gamma"], preset["spacing"]),
        )
        self.rng = (int(seed) | 1) & MASK32
        self.ctrl: list[tuple] = []  # the last three controls: x, y, pressure, speed
        self.count = 0
        self.acc = 0.0
        self.gap = MIN_STEP
        self.jitter = any(preset[k] for k in ("jitter_pos", "jitter_size", "jitter_angle"))

    def push(self, controls: list[tuple]) -> list[tuple]:
        """Dabs that became certain with these controls: the curve lags one sample behind.

        How the controls are cut into calls does not change the result.
        """
        out, segments = self.plan(controls)
        self._walk(segments, out)
        return out

    def plan(self, controls: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """The first dab, if it is among these controls, and the segments that became certain, not walked yet."""
        known = self.ctrl
        held = len(known)
        points = known + controls
        out = []
        segments = []
        for i in range(held, len(points)):
            if self.count == 0:
                out.append(self._emit(*points[i]))
            elif self.count >= 2:
                before = i - 3 if self.count > 2 else i - 2
                segments.append((points[before], points[i - 2], points[i - 1], points[i]))
            self.count += 1
        self.ctrl = points[-3:]
        return out, segments

    def finish(self) -> list[tuple]:
        out: list[tuple] = []
        self._walk(self.last_segment(), out)
        return out

    def last_segment(self) -> list[tuple]:
        """The last segment, whose fourth control repeats the end point."""
        c = self.ctrl
        return [(c[-2] if self.count == 2 else c[-3], c[-2], c[-1], c[-1])] if self.count >= 2 else []

    def _walk(self, segments: list[tuple], out: list[tuple]) -> None:
        if not segments:
            return
        xs, ys, steps, totals = curves(segments)
        self._segments(segments, xs, ys, steps, totals.tolist(), out)

    def _segments(self, segments: list[tuple], xs, ys, steps, totals: list[float], out: list[tuple]) -> None:
        for n, (_, b, c, _) in enumerate(segments):
            if not math.isfinite(totals[n]):
                continue
            if self.gap - self.acc > totals[n]:
                self.acc += totals[n]
                continue
            self._pieces(xs[n].tolist(), ys[n].tolist(), steps[n].tolist(), b, c, out)

    def _pieces(self, xs, ys, steps, b, c, out: list[tuple]) -> None:
        single, sqrt, emit, add = np.float32, math.sqrt, self._emit, out.append
        p0, p1, v0, v1 = b[2], c[2] - b[2], b[3], c[3] - b[3]
        acc = self.acc
        for k, length in enumerate(steps):
            if length <= 0.0:
                continue
            ahead = self.gap - acc
            if ahead > length:
                acc += length
                continue
            x, y, u = xs[k], ys[k], k / SUBSTEPS
            ex, ey, eu = xs[k + 1], ys[k + 1], (k + 1) / SUBSTEPS
            while length > 0.0 and ahead <= length:
                f = ahead / length
                # Positions are single precision, and the rest of the piece starts there.
                x, y, u = float(single(x + (ex - x) * f)), float(single(y + (ey - y) * f)), u + (eu - u) * f
                add(emit(x, y, p0 + p1 * u, v0 + v1 * u))
                acc, ahead = 0.0, self.gap
                length = sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y))
            acc += length
        self.acc = acc

    def _emit(self, x: float, y: float, pressure: float, speed: float) -> tuple:
        by_speed, size_min, size_span, size_gamma, flow, alpha_min, alpha_span, alpha_gamma, spacing = self.shape
        p = 0.0 if pressure < 0.0 else 1.0 if pressure > 1.0 else pressure
        v = speed / REFERENCE_SPEED
        taper = 1.0 - by_speed * (0.0 if v < 0.0 else 1.0 if v > 1.0 else v)
        size = self.size * (size_min + size_span * p**size_gamma) * taper
        alpha = flow * (alpha_min + alpha_span * p**alpha_gamma)
        alpha = 0.0 if alpha < 0.0 else 1.0 if alpha > 1.0 else alpha
        gap = spacing * size
        self.gap = MIN_STEP if MIN_STEP > gap else gap
        return self.jittered(x, y, size, alpha) if self.jitter else (x, y, size, 0.0, alpha)

    def jittered(self, x: float, y: float, size: float, alpha: float) -> tuple:
        q = self.preset
        # Four draws per dab, whatever the preset uses; the walk itself never sees the jitter.
        jx, jy, js, ja = self._draw(), self._draw(), self._draw(), self._draw()
        reach = q["jitter_pos"] * size
        return (
            x + jx * reach,
            y + jy * reach,
            size * (1.0 + q["jitter_size"] * js),
            q["jitter_angle"] * ja * math.pi + 0.0,
            alpha,
        )

    def _draw(self) -> float:
        """xorshift32 to [-1, 1) from the high 24 bits."""
        s = self.rng
        s ^= (s << 13) & MASK32
        s ^= s >> 17
        s ^= (s << 5) & MASK32
        self.rng = s
        return (s >> 8) / (1 << 24) * 2.0 - 1.0

    def state(self) -> list:
        return [self.rng, self.ctrl, self.count, self.acc, self.gap]

    def load(self, state: list) -> None:
        self.rng, ctrl, self.count, self.acc, self.gap = state
        self.ctrl = [tuple(c) for c in ctrl]


# --- many strokes side by side ---------------------------------------------------------------

#: Fewer strokes than this are walked one after the other. Dabs after which a frame is handed on.
MIN_LANES, LANE_ROWS = 16, 65_536


class Lanes:
    """Walks of many strokes, a dab of each at a time: the numbers are those of ``DabWalk``, to the last bit.

    A walk is sequential, but strokes do not see each other, so a step of all of them is a few array operations. Pieces of
    a stroke's segments follow each other in the arrays, so that a lane is a place in them. Jitter is left to the caller.
    """

    def __init__(self, walks: list[DabWalk], segments: list[list[tuple]]):
        self.walks = walks
        self.flat = [seg for own in segments for seg in own]
        self.xs, self.ys, self.steps, self.totals = curves(self.flat)
        b, c = (np.array([seg[i][2:] for seg in self.flat], float).reshape(-1, 2) for i in (1, 2))
        self.ramps = (b[:, 0], c[:, 0] - b[:, 0], b[:, 1], c[:, 1] - b[:, 1])  # pressure and speed at the begin, and their change
        ends = np.cumsum([len(own) for own in segments], dtype=np.int64)
        n = len(walks)
        self.lanes = [
            np.arange(n), (ends - [len(own) for own in segments]) * SUBSTEPS, ends * SUBSTEPS, np.zeros(n, bool),
            *(np.array([getattr(w, c) for w in walks], float) for c in ("acc", "gap", "size")),
            *np.zeros((11, n)),
            *(np.array([w.shape[i] for w in walks], float) for i in range(9)),
        ]

    def run(self) -> Iterator[list[np.ndarray]]:
        """Stroke (its place in the list), x, y, size and alpha of dabs, in the order of each stroke."""
        with np.errstate(all="ignore"):  # lanes without a dab are computed along
            yield from self._run()

    def _run(self) -> Iterator[list[np.ndarray]]:
        xs, ys, steps = self.xs.ravel(), self.ys.ravel(), self.steps.ravel()
        dabs: list[tuple] = []
        held = 0
        left = [int(i) for i in np.flatnonzero(self.lanes[1] < self.lanes[2])]
        self._keep(np.array(left, int))
        while left:
            # Place among all pieces and where the stroke's end; whether on a piece that holds a dab.
            ids, at, end, ready, acc, gap, width, x, y, u, ex, ey, eu, length, p0, p1, v0, v1 = self.lanes[:18]
            by_speed, size_min, size_span, size_gamma, flow, alpha_min, alpha_span, alpha_gamma, spacing = self.lanes[18:]
            bent = [(e, np.flatnonzero(e != 1.0)) for e in (size_gamma, alpha_gamma)]
            few, gone = len(ids) < MIN_LANES, None
            while gone is None:
                # Lanes that are not on a piece with a dab go one piece or some short segments on.
                need = ~ready
                begins = np.flatnonzero(need & (at % SUBSTEPS == 0))
                if len(begins):
                    out = few | self._begin(begins, at, end, acc, gap, (p0, p1, v0, v1))
                    if out.any():
                        gone = begins[out]
                        need[gone] = False
                piece = np.minimum(at, len(steps) - 1)
                step = steps[piece]
                need &= step > 0.0
                passes = gap - acc > step
                stops = need & ~passes
                passes &= need
                np.add(acc, step, out=acc, where=passes)
                here = np.flatnonzero(stops)
                at += ~(ready | stops)
                if gone is not None:
                    at[gone] -= 1
                if len(here):
                    seg, k = at[here] // SUBSTEPS, at[here] % SUBSTEPS
                    point = seg * (SUBSTEPS + 1) + k
                    x[here], y[here], u[here], ex[here], ey[here] = xs[point], ys[point], k / SUBSTEPS, xs[point + 1], ys[point + 1]
                    eu[here], length[here], ready[here] = (k + 1) / SUBSTEPS, step[here], True
                # A dab of every lane that has one on its piece.
                ahead = gap - acc
                fits = ready & (length > 0.0) & (ahead <= length)
                f = ahead / length
                np.copyto(x, (x + (ex - x) * f).astype(np.float32), where=fits)
                np.copyto(y, (y + (ey - y) * f).astype(np.float32), where=fits)
                np.copyto(u, u + (eu - u) * f, where=fits)
                p = np.minimum(np.maximum(p0 + p1 * u, 0.0), 1.0)
                thick, dark = (self._power(p, fits, *e) for e in bent)
                taper = 1.0 - by_speed * np.minimum(np.maximum((v0 + v1 * u) / REFERENCE_SPEED, 0.0), 1.0)
                size = width * (size_min + size_span * thick) * taper
                np.copyto(gap, np.maximum(spacing * size, MIN_STEP), where=fits)
                np.copyto(acc, 0.0, where=fits)
                dx, dy = ex - x, ey - y
                np.copyto(length, np.sqrt(dx * dx + dy * dy), where=fits)
                here = np.flatnonzero(fits)
                if len(here):
                    alpha = np.minimum(np.maximum(flow * (alpha_min + alpha_span * dark), 0.0), 1.0)
                    dabs.append((ids[here], x[here], y[here], size[here], alpha[here]))
                    held += len(here)
                leaves = ready & ~((length > 0.0) & (gap - acc <= length))
                np.add(acc, length, out=acc, where=leaves)
                at += leaves
                ready &= ~leaves
                if held >= LANE_ROWS:
                    yield [np.concatenate(c) for c in zip(*dabs)]
                    dabs, held = [], 0
            alone = self._leaving(gone)
            left = [i for i in range(len(ids)) if i not in set(gone.tolist())]
            self._keep(np.array(left, int))
            if alone and dabs:
                yield [np.concatenate(c) for c in zip(*dabs)]
                dabs, held = [], 0
            yield from self._rest(alone)
        if dabs:
            yield [np.concatenate(c) for c in zip(*dabs)]

    def _keep(self, left: np.ndarray) -> None:
        self.lanes = [v[left] for v in self.lanes]

    def _begin(self, begins: np.ndarray, at, end, acc, gap, ramps) -> np.ndarray:
        """Lanes that come to a segment skip short ones; gives those that have none left."""
        over = at[begins] >= end[begins]
        going = begins[~over]
        while len(going):
            seg = at[going] // SUBSTEPS
            total = self.totals[seg]
            broken = ~np.isfinite(total)
            skip = broken | (gap[going] - acc[going] > total)
            for now, ramp in zip(ramps, self.ramps):
                now[going] = ramp[seg]
            going, total = going[skip], np.where(broken, 0.0, total)[skip]
            acc[going] += total
            at[going] += SUBSTEPS
            going = going[at[going] < end[going]]
        return at[begins] >= end[begins]

    @staticmethod
    def _power(p: np.ndarray, fits: np.ndarray, exponent: np.ndarray, bent: np.ndarray) -> np.ndarray:
        """As the power of two numbers, which arrays of them need not give to the last bit."""
        bent = bent[fits[bent]]
        if not len(bent):
            return p
        out = p.copy()
        out[bent] = [v**e for v, e in zip(p[bent].tolist(), exponent[bent].tolist())]
        return out

    def _leaving(self, gone: np.ndarray) -> list[tuple]:
        """Gives walks their state back, and tells which segments are left to some."""
        ids, at, end, _, acc, gap = (v[gone].tolist() for v in self.lanes[:6])
        for i, a, g in zip(ids, acc, gap):
            self.walks[i].acc, self.walks[i].gap = a, g
        return [(i, lo // SUBSTEPS, hi // SUBSTEPS) for i, lo, hi in zip(ids, at, end) if lo < hi]

    def _rest(self, alone: list[tuple]) -> Iterator[list[np.ndarray]]:
        for i, first, end in alone:
            walk, jitter = self.walks[i], self.walks[i].jitter
            for lo in range(first, end, SLICE):
                own, rows = slice(lo, min(lo + SLICE, end)), []
                walk.jitter = False
                walk._segments(self.flat[own], self.xs[own], self.ys[own], self.steps[own], self.totals[own].tolist(), rows)
                walk.jitter = jitter
                if rows:
                    x, y, size, _, alpha = zip(*rows)
                    yield [np.full(len(rows), i), *(np.array(c) for c in (x, y, size, alpha))]


# --- streaming sorted partitions through a per-stroke fold ----------------------------------

_FOLD_IN = ("x", "y", "t", "pressure", "radius")
#: Samples that are folded at once, and rows after which they are handed on: a sample may give hundreds of dabs, a batch has 10,000.
SLICE, ROWS_OUT = 128, 8_192


def _per_stroke(
    frames: Iterable[pd.DataFrame], make: Callable, step: Callable, end: Callable
) -> Iterator[list[tuple]]:
    """Feeds consecutive rows of one stroke to its fold, slice by slice, and gives its rows in lists of bounded length.

    ``make`` sees the first row of a stroke, ``step`` every slice of it, ``end`` what is left.
    """
    key, fold = None, None
    for frame in frames:
        out: list[tuple] = []
        ids = frame["stroke_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        cuts = [at for lo, hi in zip(cuts, cuts[1:]) for at in range(lo, hi, SLICE)] + [len(ids)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = frame.iloc[lo:hi]
            if fold is None or ids[lo] != key:
                if fold is not None:
                    end(key, fold, out)
                key, fold = ids[lo], make(part.iloc[0])
            step(key, part, fold, out)
            if len(out) >= ROWS_OUT:
                yield out
                out = []
        yield out
    if fold is not None:
        out = []
        end(key, fold, out)
        yield out


def controls_of(part: pd.DataFrame, fold: SmoothedInput) -> list[tuple]:
    return [fold.push(*row) for row in zip(*(part[c].tolist() for c in _FOLD_IN))]


CONTROL_SCHEMA = "stroke_id long, seq long, x double, y double, t double, pressure double, speed double"


def _control_rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def step(key, part, fold, out):
        rows = zip(part["seq"].tolist(), part["t"].tolist(), controls_of(part, fold))
        out += [(key, seq, x, y, t, p, v) for seq, t, (x, y, p, v) in rows]

    names = ["stroke_id", "seq", "x", "y", "t", "pressure", "speed"]
    for rows in _per_stroke(frames, lambda row: SmoothedInput(), step, lambda *_: None):
        yield pd.DataFrame(rows, columns=names)


DAB_SCHEMA = "stroke_id long, dab_no long, x double, y double, size double, angle double, alpha double"
DAB_COLUMNS = ["stroke_id", "dab_no", "x", "y", "size", "angle", "alpha"]


class StrokeFold:
    """Smoothing and walk of one stroke, with a state that can be stored between calls."""

    def __init__(self, brush: str, size: float, seed: int) -> None:
        self.smooth = SmoothedInput()
        self.walk = DabWalk(preset_rows()[brush], float(size), int(seed))
        self.made = 0

    def number(self, key, dabs: list[tuple]) -> list[tuple]:
        first = self.made
        self.made += len(dabs)
        return [(key, first + i, *d) for i, d in enumerate(dabs)]

    def push(self, key, part: pd.DataFrame) -> list[tuple]:
        return self.number(key, self.walk.push(controls_of(part, self.smooth)))

    def finish(self, key) -> list[tuple]:
        return self.number(key, self.walk.finish())

    def state(self) -> list:
        return [self.smooth.state(), self.walk.state(), self.made]

    def load(self, state: list) -> "StrokeFold":
        smooth, walk, self.made = state
        self.smooth.load(smooth)
        self.walk.load(walk)
        return self


#: Samples whose strokes are walked side by side.
SIDE_BY_SIDE = 131_072


def _gathered(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, rows = [], 0
    for frame in frames:
        held, rows = [*held, frame], rows + len(frame)
        if rows >= SIDE_BY_SIDE:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _dab_frame(stroke: np.ndarray, columns: list) -> pd.DataFrame:
    kinds = (np.int64, np.int64, *[np.float64] * 5)
    return pd.DataFrame({name: np.asarray(c, kind) for name, c, kind in zip(DAB_COLUMNS, [stroke, *columns], kinds)})


def _dab_rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Dabs of sorted samples. Strokes of a stretch of samples are walked side by side, the last one may go on in the next."""
    key, fold = None, None
    for frame in _gathered(frames):
        ids = frame["stroke_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
        keys, folds, segments, first = [], [], [], []
        if len(ids) and fold is not None and ids[0] != key:  # ended with the samples before
            keys, folds, segments, first = [key], [fold], [fold.walk.last_segment()], [[]]
            fold = None
        for lo, hi in zip(cuts, cuts[1:]):
            part = frame.iloc[lo:hi]
            if fold is None or ids[lo] != key:
                row = part.iloc[0]
                key, fold = ids[lo], StrokeFold(row.brush, row["size"], row.seed)
            dabs, own = fold.walk.plan(controls_of(part, fold.smooth))
            if hi < len(ids):
                own += fold.walk.last_segment()
            keys, folds, segments, first = [*keys, key], [*folds, fold], [*segments, own], [*first, dabs]
        yield from _side_by_side(keys, folds, segments, first)
    if fold is not None:
        yield from _side_by_side([key], [fold], [fold.walk.last_segment()], [[]])


def _tuples(rows: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*rows)) if rows else [()] * len(DAB_COLUMNS)
    return _dab_frame(columns[0], columns[1:])


def _one_by_one(keys: list, folds: list[StrokeFold], segments: list[list], first: list[list[tuple]]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for key, fold, own, dabs in zip(keys, folds, segments, first):
        out += fold.number(key, dabs)
        for lo in range(0, len(own), SLICE):
            dabs = []
            fold.walk._walk(own[lo : lo + SLICE], dabs)
            out += fold.number(key, dabs)
            if len(out) >= ROWS_OUT:
                yield _tuples(out)
                out = []
    yield _tuples(out)


def _side_by_side(keys: list, folds: list[StrokeFold], segments: list[list], first: list[list[tuple]]) -> Iterator[pd.DataFrame]:
    if len(keys) < MIN_LANES:
        yield from _one_by_one(keys, folds, segments, first)
        return
    yield _tuples([row for key, fold, dabs in zip(keys, folds, first) for row in fold.number(key, dabs)])
    names, made = np.array(keys, np.int64), np.array([fold.made for fold in folds], np.int64)
    for lane, *columns in Lanes([fold.walk for fold in folds], segments).run():
        order = np.argsort(lane, kind="stable")
        lane = lane[order]
        new = np.flatnonzero(np.diff(lane, prepend=-1))
        counts = np.diff(new, append=len(lane))
        number = made[lane] + np.arange(len(lane)) - np.repeat(new, counts)
        made[lane[new]] += counts
        x, y, size, alpha = (c[order] for c in columns)
        angle = np.zeros(len(lane))
        for i, lo, n in zip(lane[new].tolist(), new.tolist(), counts.tolist()):
            if folds[i].walk.jitter:
                own = slice(lo, lo + n)
                moved = [folds[i].walk.jittered(*d) for d in zip(*(c[own].tolist() for c in (x, y, size, alpha)))]
                x[own], y[own], size[own], angle[own], _ = zip(*moved)
        yield _dab_frame(names[lane], [number, x, y, size, angle, alpha])
    for fold, n in zip(folds, made.tolist()):
        fold.made = n


def real_samples(samples: DataFrame) -> DataFrame:
    """Predicted samples never reach committed state."""
    return samples.where(~F.coalesce(F.col("predicted"), F.lit(False)))


def predicted_samples(samples: DataFrame) -> DataFrame:
    return samples.where(F.coalesce(F.col("predicted"), F.lit(False)))


def _sorted(samples: DataFrame, *extra: str) -> DataFrame:
    rows = real_samples(samples).select(
        "stroke_id", "seq", *[F.col(c).cast("double").alias(c) for c in _FOLD_IN], *extra
    )
    return fan_out(rows, "stroke_id").sortWithinPartitions("stroke_id", "seq")


def smooth(samples: DataFrame) -> DataFrame:
    """Filtered position, normalised pressure and speed per real sample."""
    return _sorted(samples).mapInPandas(_control_rows, CONTROL_SCHEMA)


def generate_dabs(samples: DataFrame) -> DataFrame:
    """Dabs of every stroke from its real samples.

    ``samples`` carries ``brush``, ``size`` (diameter) and ``seed`` on every row.  The tip of a
    dab is that of its brush.
    """
    return _sorted(samples, "brush", "size", "seed").mapInPandas(_dab_rows, DAB_SCHEMA)


# --- declarative parts ----------------------------------------------------------------------


def device_columns(force: Column, max_force: Column, radius: Column, is_pen: Column) -> dict[str, Column]:
    """Pressure and radius as recorded: a pen has radius 0, a device without force is a finger."""
    uses_force = is_pen & (max_force > 0)
    return {
        "pressure": F.when(uses_force, force / F.nullif(max_force, F.lit(0.0))).otherwise(F.lit(0.0)),
        "radius": F.when(uses_force, F.lit(0.0)).otherwise(radius),
    }


def relative_time(samples: DataFrame, time: str = "ts") -> DataFrame:
    """Seconds since the first sample of the stroke."""
    first = {"_t0": ("min", F.col(time))}
    return (
        attach_totals(samples, ["stroke_id"], seq_block("seq"), first)
        .withColumn("t", F.col(time) - F.col("_t0"))
        .drop("_t0")
    )


def raw_speed(samples: DataFrame) -> DataFrame:
    """Distance over time of consecutive recorded points; NULL where time did not advance."""
    rows = previous(samples, ["stroke_id"], seq_block("seq"), "seq", {"_px": "x", "_py": "y", "_pt": "t"})
    dt = F.col("t") - F.col("_pt")
    moved = F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))
    return rows.withColumn(
        "speed", F.when(F.col("_pt").isNull(), F.lit(0.0)).when(dt > 0, moved / dt)
    ).drop("_px", "_py", "_pt")


def stroke_bounds(dabs: DataFrame, *keys: str) -> DataFrame:
    """Box around the discs of the dabs; a stroke without dabs has no row."""
    half = F.col("size") / 2
    return dabs.groupBy(*(keys or ("stroke_id",))).agg(
        F.min(F.col("x") - half).alias("x0"),
        F.min(F.col("y") - half).alias("y0"),
        F.max(F.col("x") + half).alias("x1"),
        F.max(F.col("y") + half).alias("y1"),
        F.count(F.lit(1)).alias("dabs"),
    )
