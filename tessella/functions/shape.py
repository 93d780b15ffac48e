"""Easing, brush-tip shapes and canvas geometry, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.color import as_col

ROW_SHIFT = 32
ROW_MASK = (1 << ROW_SHIFT) - 1

# Fixed values of the brush tips.
TIP_SIZE = 256
HARD_EDGE = 0.10
GRAIN_FREQ = 14
GRAIN_CONTRAST = 2.2
GRAIN_SEED = 0x9E37
LATTICE_X, LATTICE_Y = 0x27D4EB2D, 0x165667B1
MIX_1, MIX_2 = 0x2C1B3C6D, 0x29745C85

MASK32 = 0xFFFFFFFF


def raster_key(x: str | Column, y: str | Column) -> Column:
    """One long per pixel whose order is raster order, whatever the image width."""
    return F.shiftleft(as_col(y).cast("long"), ROW_SHIFT).bitwiseOR(as_col(x).cast("long"))


def key_x(key: str | Column) -> Column:
    return as_col(key).bitwiseAND(F.lit(ROW_MASK)).cast("int")


def key_y(key: str | Column) -> Column:
    return F.shiftright(as_col(key), ROW_SHIFT).cast("int")


def clamp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    return F.least(F.greatest(v, lo), hi)


def ease_out(t: str | Column) -> Column:
    left = F.lit(1.0) - clamp(as_col(t), 0.0, 1.0)
    return F.lit(1.0) - left * left * left


def smoothstep(lo: float | Column, hi: float | Column, x: Column) -> Column:
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    t = clamp((x - lo) / (hi - lo), 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def mix(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def decimals(v: Column, digits: int) -> Column:
    """The double nearest to so many decimals by scaling and rounding half away from zero, as SQL engines on doubles do.

    ``round(v, digits)`` of Spark rounds the shortest decimal that gives ``v``, which differs at ties.
    """
    return F.round(v * F.lit(10.0**digits)) / F.lit(10.0**digits)


def fit_scale(cw: Column, ch: Column, sw: Column, sh: Column) -> Column:
    return F.least(sw / cw, sh / ch)


def to_canvas(screen: Column, screen_len: Column, canvas_len: Column, scale: Column) -> Column:
    """Screen pixel to canvas pixel on one axis of a centred, aspect-keeping fit."""
    return (screen - (screen_len - canvas_len * scale) / F.lit(2.0)) / scale


def on_canvas(x: Column, y: Column, w: Column, h: Column) -> Column:
    """False for NaN too: Spark orders NaN above every number, so it is tested first."""
    return (
        ~F.isnan(x) & ~F.isnan(y) & (x >= 0) & (x < w) & (y >= 0) & (y < h)
    )


def scissor(x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column) -> Column:
    """Outward-rounded ``struct<x,y,w,h>`` clamped to the canvas; NULL when empty or not finite."""
    inf = F.lit(float("inf"))
    finite = F.lit(True)
    for v in (x0, y0, x1, y1):
        finite = finite & ~F.isnan(v) & (F.abs(v) < inf)
    safe = [F.when(finite, v) for v in (x0, y0, x1, y1)]
    lo_x, lo_y = (clamp(F.floor(v).cast("double"), 0.0, n.cast("double")) for v, n in zip(safe[:2], (w, h)))
    hi_x, hi_y = (clamp(F.ceil(v).cast("double"), 0.0, n.cast("double")) for v, n in zip(safe[2:], (w, h)))
    box = F.struct(
        lo_x.cast("int").alias("x"),
        lo_y.cast("int").alias("y"),
        (hi_x - lo_x).cast("int").alias("w"),
        (hi_y - lo_y).cast("int").alias("h"),
    )
    return F.when(finite & (hi_x > lo_x) & (hi_y > lo_y), box)


def farthest_corner(ox: Column, oy: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Distance from a tap to the farthest corner of a box."""
    return F.greatest(*[F.hypot(cx - ox, cy - oy) for cx in (x, x + w) for cy in (y, y + h)])


def curve(p: Column, lo: Column, hi: Column, gamma: Column) -> Column:
    """Pressure response; pressure is clamped so that the power stays defined."""
    return lo + (hi - lo) * F.pow(clamp(p, 0.0, 1.0), gamma)


def soft_tip(d: Column) -> Column:
    return F.when(d >= 1.0, F.lit(0.0)).otherwise(F.lit(1.0) - d)


def hard_tip(d: Column) -> Column:
    return F.lit(1.0) - smoothstep(1.0 - HARD_EDGE, 1.0, d)


def lattice_value(ix: int, iy: int) -> float:
    """Hash of a grid point to [0, 1), exact in 24 bits."""
    h = (ix * LATTICE_X & MASK32) ^ (iy * LATTICE_Y & MASK32) ^ GRAIN_SEED
    h = (h ^ h >> 15) * MIX_1 & MASK32
    h = (h ^ h >> 12) * MIX_2 & MASK32
    return ((h ^ h >> 16) >> 8) / (1 << 24)


# A tip spans GRAIN_FREQ cells, so the grid has one point more along each axis.
LATTICE_SIDE = GRAIN_FREQ + 2
_LATTICE = [lattice_value(x, y) for y in range(LATTICE_SIDE) for x in range(LATTICE_SIDE)]


def lattice(ix: Column, iy: Column) -> Column:
    """Grid value by look-up in a constant array: the hash would be inlined many times over."""
    return F.element_at(F.lit(_LATTICE), (iy * LATTICE_SIDE + ix + 1).cast("int"))


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once per row; used twice in a plain expression it would be copied."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grain(tx: Column, ty: Column) -> Column:
    """Value noise at a texel of the tip texture, contrast stretched around one half."""
    step = F.lit(GRAIN_FREQ / TIP_SIZE)

    def cell(p: Column) -> Column:
        ix, iy = F.floor(p["x"]), F.floor(p["y"])
        return F.struct(
            ix.alias("ix"),
            iy.alias("iy"),
            smoothstep(0.0, 1.0, p["x"] - ix).alias("sx"),
            smoothstep(0.0, 1.0, p["y"] - iy).alias("sy"),
        )

    def noise(q: Column) -> Column:
        ix, iy = q["ix"], q["iy"]
        top = mix(lattice(ix, iy), lattice(ix + 1, iy), q["sx"])
        bottom = mix(lattice(ix, iy + 1), lattice(ix + 1, iy + 1), q["sx"])
        return mix(top, bottom, q["sy"])

    at = F.struct((tx * step).alias("x"), (ty * step).alias("y"))
    n = _let(at, lambda p: _let(cell(p), noise))
    return clamp((n - 0.5) * F.lit(GRAIN_CONTRAST) + 0.5, 0.0, 1.0)


def tip_coverage(tip: Column, u: Column, v: Column, d: Column | None = None) -> Column:
    """Coverage of a brush tip at local coordinates in [-1, 1]; 0 from distance 1 on.

    ``d`` is the distance from the middle where the caller knows it before the turn: turning rounds, and would put
    pixels on the rim, at exactly 1, a little inside.
    """
    d = F.hypot(u, v) if d is None else d
    half = TIP_SIZE / 2
    texel = [clamp((c + 1.0) * F.lit(half) - 0.5, 0.0, float(TIP_SIZE - 1)) for c in (u, v)]
    shape = (
        F.when(tip == "soft_round", soft_tip(d))
        .when(tip == "hard_round", hard_tip(d))
        .when(tip == "grain", F.when(d >= 1.0, F.lit(0.0)).otherwise(grain(*texel) * soft_tip(d)))
    )
    return F.when(d < 1.0, clamp(shape, 0.0, 1.0)).otherwise(F.lit(0.0))


def rounded(v: Column, places: int) -> Column:
    """``round`` of a number, to the last bit, which takes the digits of every number; here they are taken only near a tie."""
    scaled = v * 10**places
    apart = (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-6) & (F.abs(v) < 1e6)
    return F.when(apart, F.rint(scaled) / 10**places + 0.0).otherwise(F.round(v, places))
