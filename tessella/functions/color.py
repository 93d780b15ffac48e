"""Colour arithmetic on 8-bit sRGB channels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_THRESHOLD = 128
WHITE = 255


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a: str | Column, b: int | Column) -> Column:
    """Truncating integer division."""
    return F.call_function("div", as_col(a), F.lit(b) if isinstance(b, int) else b)


def is_line(alpha: str | Column, threshold: int = LINE_THRESHOLD) -> Column:
    """A pixel is line when its alpha reaches the threshold (inclusive)."""
    return as_col(alpha) >= F.lit(threshold)


def over_white(channel: str | Column, alpha: str | Column) -> Column:
    """Straight-alpha channel over white paper, rounded in integers."""
    c, a = as_col(channel).cast("int"), as_col(alpha).cast("int")
    return idiv(c * a + F.lit(WHITE) * (F.lit(WHITE) - a) + F.lit(127), WHITE).cast("int")


def luma(r: str | Column, g: str | Column, b: str | Column) -> Column:
    """Rec. 709 luma, rounded half up and clamped to a byte."""
    y = F.lit(0.2126) * as_col(r) + F.lit(0.7152) * as_col(g) + F.lit(0.0722) * as_col(b)
    return F.least(F.greatest(F.round(y), F.lit(0.0)), F.lit(255.0)).cast("int")


def share_text(ratio: str | Column) -> Column:
    """A ratio from 0 to 1 with three decimals, its exact binary value rounded half to even, as C and Rust print it.

    Java rounds the shortest decimal that gives the number, half up. Twenty-six bits of the ratio times a thousand are exact
    in a double, and so is the rest times a thousand; so the sign of what is over a half is exact too.
    """
    ratio = as_col(ratio)
    high = F.floor(ratio * F.lit(2.0**26)) / F.lit(2.0**26)
    whole = F.floor(ratio * 1000)
    over = (high * 1000 - whole - 0.5) + (ratio - high) * 1000
    up = (over > 0) | ((over == 0) & (whole % 2 == 1))
    return F.format_string("%d.%03d", *[f(whole + up.cast("long")) for f in (lambda n: idiv(n, 1000), lambda n: n % 1000)])


def hex_color(r: str | Column, g: str | Column, b: str | Column) -> Column:
    return F.format_string(
        "#%02X%02X%02X", as_col(r).cast("int"), as_col(g).cast("int"), as_col(b).cast("int")
    )


def unit(channel: str | Column) -> Column:
    """Byte to [0, 1]; the encoded value is used as is, without linearisation."""
    return as_col(channel) / F.lit(255.0)


def multiply(*bytes_: Column) -> Column:
    """Multiply blend of byte channels, truncating after every factor."""
    out = bytes_[0].cast("int")
    for b in bytes_[1:]:
        out = idiv(out * b.cast("int"), WHITE).cast("int")
    return out
