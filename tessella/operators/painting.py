"""Dabs to coverage, coverage to paint, layers to pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import multiply, over_white, unit
from tessella.functions.shape import clamp, mix, tip_coverage
from tessella.operators.chunked import seq_block, spread_join
from tessella.operators.components import TILE
from tessella.operators.labels import box_downsample_by
from tessella.operators.regions import tile_id

THUMB_LONG_EDGE = 512
STROKE_BLOCK = 1024
#: Share of what is below an opaque stroke that counts as shown, in place of a logarithm of zero.
OPAQUE = 1e-300


# --- dabs on pixels -------------------------------------------------------------------------


def dab_pixels(dabs: DataFrame) -> DataFrame:
    """Pixels under every dab with their coverage (tip shape times dab alpha).

    A range join written as an expansion: each dab lists the pixels of its own box, clamped to
    the canvas (``width``, ``height`` on the row), so no pair is formed outside it.  Box corners
    outside the disc come with coverage 0, which changes neither the maximum nor the product; a
    filter here would copy the whole tip expression below the projection.
    """
    half = F.col("size") / 2
    usable = (half > 0) & ~F.isnan("size") & ~F.isnan("x") & ~F.isnan("y")

    def span(c: str, limit: str) -> Column:
        lo = F.greatest(F.floor(F.col(c) - half), F.lit(0))
        hi = F.least(F.floor(F.col(c) + half), F.col(limit).cast("long") - 1)
        return F.when(usable & (hi >= lo), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))

    cells = dabs.withColumn("px", F.explode(span("x", "width"))).withColumn("py", F.explode(span("y", "height")))
    dx, dy = F.col("px") + 0.5 - F.col("x"), F.col("py") + 0.5 - F.col("y")
    cos, sin = F.cos("angle"), F.sin("angle")
    local = cells.withColumns(
        {"_u": (dx * cos + dy * sin) / half, "_v": (dy * cos - dx * sin) / half, "_d": F.sqrt(dx * dx + dy * dy) / half}
    )
    return local.withColumn(
        "cover", tip_coverage(F.col("tip"), F.col("_u"), F.col("_v"), F.col("_d")) * F.col("alpha")
    ).drop("width", "height", "_u", "_v", "_d")


def stroke_coverage(cells: DataFrame, *keys: str) -> DataFrame:
    """Coverage per stroke and pixel: the strongest dab, or one minus the product when building up."""
    keys = keys or ("image_id", "stroke_id")
    grouped = cells.groupBy(
        *keys, F.col("px").cast("int").alias("x"), F.col("py").cast("int").alias("y")
    ).agg(
        F.max("cover").alias("_max"),
        F.product(F.lit(1.0) - F.col("cover")).alias("_rest"),
        F.first("build_up").alias("build_up"),
    )
    cover = F.when(F.col("build_up"), F.lit(1.0) - F.col("_rest")).otherwise(F.col("_max"))
    return grouped.where("_max > 0").select(*keys, "x", "y", cover.alias("cover"))


def region_mask(strict: Column, label: Column, active: Column) -> Column:
    """Strict strokes paint their own region only; loose ones paint everything."""
    return F.when(strict, label == active).otherwise(F.lit(True))


def commit(coverage: DataFrame, strokes: DataFrame, labels: DataFrame, tile: int = TILE) -> DataFrame:
    """Premultiplied paint ``image_id, x, y, r, g, b, a`` after all strokes, in stroke order.

    ``strokes`` holds ``image_id, stroke_id, order_no, r, g, b, opacity, strict, active`` with
    channels in [0, 1].  Painting over is associative, so the strokes of a pixel are folded in
    blocks of ``STROKE_BLOCK`` and the blocks after that: a pixel under very many strokes is
    not gathered at once.
    """
    keys = ["image_id", "stroke_id"]
    rows = spread_join(coverage, strokes, keys, tile_id(tile), "inner").join(labels, ["image_id", "x", "y"])
    a = F.col("cover") * F.col("opacity")
    laid = rows.where(region_mask(F.col("strict"), F.col("label"), F.col("active"))).select(
        "image_id",
        "x",
        "y",
        F.col("order_no"),
        (F.col("r") * a).alias("r"),
        (F.col("g") * a).alias("g"),
        (F.col("b") * a).alias("b"),
        a.alias("a"),
    )

    def fold(df: DataFrame, *keys: str) -> DataFrame:
        layers = F.array_sort(F.collect_list(F.struct((-F.col("order_no")).alias("last"), "r", "g", "b", "a", "left")))
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b", "a", "left")])
        over = F.aggregate(
            "layers",
            zero,
            lambda acc, s: F.struct(
                *[(acc[c] + s[c] * F.exp(acc["left"])).alias(c) for c in "rgba"], (acc["left"] + s["left"]).alias("left")
            ),
        )
        return df.groupBy(*keys).agg(layers.alias("layers")).select(*keys, over.alias("p")).select(*keys, "p.*")

    # What shows through is summed as a logarithm from the newest stroke down, so that sums round as those of the SQL do.
    clear = laid.withColumn("left", F.log(F.greatest(F.lit(1.0) - F.col("a"), F.lit(OPAQUE))))
    blocks = fold(clear.withColumn("block", seq_block("order_no", STROKE_BLOCK)), "image_id", "x", "y", "block")
    return fold(blocks.withColumnRenamed("block", "order_no"), "image_id", "x", "y").drop("left")


# --- layers ---------------------------------------------------------------------------------


def layers_over_white(px: DataFrame, *keep: str) -> DataFrame:
    return px.select("image_id", "x", "y", *keep, *[over_white(c, "a").alias(c) for c in "rgb"])


def reference_composite(
    labels: DataFrame, colors: DataFrame, line_white: DataFrame, shade_white: DataFrame | None, tile: int = TILE
) -> DataFrame:
    """Region colour times shade times line, in bytes; pixels without a region are white.

    ``colors`` holds ``image_id, label, r, g, b``.
    """
    base = spread_join(
        labels.withColumn("label", F.coalesce("label", F.lit(-1).cast("long"))),
        colors.select("image_id", "label", *[F.col(c).alias(f"_c{c}") for c in "rgb"]),
        ["image_id", "label"],
        tile_id(tile),
    )
    out = base.join(
        line_white.select("image_id", "x", "y", *[F.col(c).alias(f"_l{c}") for c in "rgb"]), ["image_id", "x", "y"]
    )
    if shade_white is not None:
        out = out.join(
            shade_white.select("image_id", "x", "y", *[F.col(c).alias(f"_s{c}") for c in "rgb"]),
            ["image_id", "x", "y"],
            "left",
        )

    def channel(c: str) -> Column:
        factors = [F.coalesce(F.col(f"_c{c}"), F.lit(255))]
        if shade_white is not None:
            factors.append(F.coalesce(F.col(f"_s{c}"), F.lit(255)))
        return multiply(*factors, F.col(f"_l{c}")).alias(c)

    return out.select("image_id", "x", "y", *[channel(c) for c in "rgb"])


def thumbnail(composite: DataFrame, images: DataFrame) -> DataFrame:
    """Box-downsampled composite whose long edge is 512 (``images``: image_id, width, height)."""
    sized = spread_join(composite, images.select("image_id", "width", "height"), ["image_id"], tile_id(), "inner")
    factor = F.greatest(
        F.call_function("div", F.greatest("width", "height"), F.lit(THUMB_LONG_EDGE)), F.lit(1).cast("long")
    )
    return box_downsample_by(sized, ["r", "g", "b"], factor)


def canvas_composite(stack: DataFrame) -> DataFrame:
    """Colour of a canvas pixel from its layers, as values in [0, 1].

    ``stack`` holds ``base_*`` (straight, ``base_a`` 0 when never filled), ``erase``, ``paint_*``
    (premultiplied), ``wet`` with ``brush_*`` and ``wet_mask``, ``shade_*`` and ``line_*``.
    """

    def channel(c: str) -> Column:
        v = mix(F.lit(1.0), F.col(f"base_{c}"), F.col("base_a"))
        v = mix(v, F.lit(1.0), F.col("erase"))
        v = F.col(f"paint_{c}") + v * (F.lit(1.0) - F.col("paint_a"))
        wet = F.col("wet") * F.col("brush_a") * F.col("wet_mask")
        v = F.col(f"brush_{c}") * wet + v * (F.lit(1.0) - wet)
        return (v * F.col(f"shade_{c}") * F.col(f"line_{c}")).alias(c)

    return stack.select("image_id", "x", "y", *[channel(c) for c in "rgb"])


def layer_stack(
    labels: DataFrame, fills: DataFrame, paint: DataFrame, line_white: DataFrame, tile: int = TILE
) -> DataFrame:
    """Joins the layers of ``canvas_composite``; absent layers take their neutral value."""
    base = spread_join(
        labels,
        fills.select("image_id", "label", *[unit(c).alias(f"base_{c}") for c in "rgb"], F.lit(1.0).alias("base_a")),
        ["image_id", "label"],
        tile_id(tile),
    )
    at = ["image_id", "x", "y"]
    out = base.join(paint.select(*at, *[F.col(c).alias(f"paint_{c}") for c in "rgba"]), at, "left").join(
        line_white.select(*at, *[unit(c).alias(f"line_{c}") for c in "rgb"]), at, "left"
    )
    zero = [f"base_{c}" for c in "rgba"] + [f"paint_{c}" for c in "rgba"]
    one = [f"line_{c}" for c in "rgb"]
    out = out.select(
        *at,
        "label",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zero],
        *[F.coalesce(c, F.lit(1.0)).alias(c) for c in one],
        *[F.lit(1.0).alias(f"shade_{c}") for c in "rgb"],
    )
    return out.select(
        "*",
        F.lit(0.0).alias("erase"),
        F.lit(0.0).alias("wet"),
        F.lit(1.0).alias("wet_mask"),
        *[F.lit(0.0).alias(f"brush_{c}") for c in "rgba"],
    )


def clear_erased(erase: DataFrame, labels: DataFrame, fills: DataFrame, tile: int = TILE) -> DataFrame:
    """Erase marks that survive the fills: a fill clears the marks of its own region only.

    ``erase`` holds ``image_id, x, y, seq, cover``; ``fills`` ``image_id, label, seq``.  A mark
    stays when it is newer than the last fill of the region it lies in.
    """
    last = fills.groupBy("image_id", "label").agg(F.max("seq").alias("_filled"))
    placed = erase.join(labels, ["image_id", "x", "y"])
    marked = spread_join(placed, last, ["image_id", "label"], tile_id(tile))
    return (
        marked.where(F.col("_filled").isNull() | (F.col("seq") > F.col("_filled")))
        .groupBy("image_id", "x", "y")
        .agg(F.max("cover").alias("cover"))
    )
