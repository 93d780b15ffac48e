"""sRGB verdict of an image layer from its colour metadata columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# D50-adapted sRGB colorants, white points, and the PNG chunk values.
SRGB_COLORANTS = {
    "r": (0.436066, 0.222488, 0.013916),
    "g": (0.385147, 0.716873, 0.097076),
    "b": (0.143066, 0.060608, 0.714096),
}
D50 = (0.964203, 1.000000, 0.824905)
D65 = (0.950455, 1.000000, 1.089050)
SRGB_GAMMA = 0.45455
SRGB_XY = {
    "white": (0.3127, 0.3290),
    "red": (0.6400, 0.3300),
    "green": (0.3000, 0.6000),
    "blue": (0.1500, 0.0600),
}
COLORANT_TOLERANCE = 0.02
GAMMA_TOLERANCE = 0.02
XY_TOLERANCE = 0.01


def _delta(triple: Column, ref: tuple[float, ...]) -> Column:
    return F.greatest(*[F.abs(triple[i] - F.lit(v)) for i, v in enumerate(ref)])


def verdict(
    icc_r: Column,
    icc_g: Column,
    icc_b: Column,
    icc_white: Column,
    has_srgb_chunk: Column,
    gamma: Column,
    chroma: dict[str, Column],
) -> Column:
    """``struct<is_srgb, basis>``.

    The first signal that is present decides: profile colorants (three-element arrays, a
    missing one means the profile has none), the sRGB chunk, gamma with chromaticities
    (``chroma`` maps the names of SRGB_XY to two-element arrays); no signal at all passes.
    """
    icc_present = icc_r.isNotNull() & icc_g.isNotNull() & icc_b.isNotNull()
    worst = F.greatest(
        _delta(icc_r, SRGB_COLORANTS["r"]),
        _delta(icc_g, SRGB_COLORANTS["g"]),
        _delta(icc_b, SRGB_COLORANTS["b"]),
        F.coalesce(F.least(_delta(icc_white, D50), _delta(icc_white, D65)), F.lit(0.0)),
    )
    chunks_present = gamma.isNotNull()
    for c in chroma.values():
        chunks_present = chunks_present & c.isNotNull()
    xy = F.greatest(*[_delta(chroma[name], ref) for name, ref in SRGB_XY.items()])

    def said(ok: Column | bool, basis: str) -> Column:
        ok = F.lit(ok) if isinstance(ok, bool) else ok
        return F.struct(ok.alias("is_srgb"), F.lit(basis).alias("basis"))

    return (
        F.when(icc_present, said(worst <= COLORANT_TOLERANCE, "icc"))
        .when(F.coalesce(has_srgb_chunk, F.lit(False)), said(True, "srgb"))
        .when(
            chunks_present,
            said((F.abs(gamma - SRGB_GAMMA) <= GAMMA_TOLERANCE) & (xy <= XY_TOLERANCE), "gamma+chroma"),
        )
        .otherwise(said(True, "none"))
    )
