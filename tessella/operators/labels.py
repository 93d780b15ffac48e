"""Label planes: closing, downsampling, dilation, adjacency and preview classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.color import idiv
from tessella.operators.chunked import attach_totals
from tessella.operators.components import TILE
from tessella.operators.regions import tile_id

DILATE_ALPHA = 32
DILATE_ROUNDS = 2
MAX_LINE_GAP = 64

# Fixed values of the contrast colouring.
PREVIEW_COLORS = 24

_LABEL_BITS = 32
_FAR = 1 << 30


def close_labels(px: DataFrame) -> DataFrame:
    """Fill unassigned pixels with the nearest label in L1 distance, ties to the lowest id.

    The frame must be dense.  A synchronous 4-neighbour wave over the whole rectangle reaches a
    pixel after exactly its L1 distance to the nearest label, so two sweeps along the rows and
    two along the columns give the same map without any iteration.  Adds ``closed`` (NULL when
    the image has no label at all) and ``wave`` (the round that reached the pixel).
    Every window holds one row or one column of an image.
    """

    def pack(distance: Column, label: Column) -> Column:
        """Distance and label in one long: the minimum is nearest first, then lowest id."""
        return F.shiftleft(distance.cast("long"), _LABEL_BITS) + label.cast("long")

    def sweep(df: DataFrame, line: str, axis: str, dist: Column, label: Column) -> DataFrame:
        rows = W.partitionBy("image_id", line).rowsBetween(W.unboundedPreceding, 0)
        ahead = F.min(pack(dist - F.col(axis), label)).over(rows.orderBy(axis))
        back = F.min(pack(dist + F.col(axis), label)).over(rows.orderBy(F.desc(axis)))
        shift = F.shiftleft(F.col(axis).cast("long"), _LABEL_BITS)
        return df.withColumn("_near", F.least(ahead + shift, back - shift))

    mask = F.lit((1 << _LABEL_BITS) - 1)
    known = F.when(F.col("label").isNotNull(), F.lit(0))
    out = sweep(px, "y", "x", known, F.col("label"))
    dist = F.shiftright("_near", _LABEL_BITS)
    out = sweep(out, "x", "y", dist, F.col("_near").bitwiseAND(mask))
    return (
        out.withColumn("closed", F.col("_near").bitwiseAND(mask))
        .withColumn("wave", F.shiftright("_near", _LABEL_BITS).cast("int"))
        .drop("_near")
    )


def close_summary(closed: DataFrame) -> DataFrame:
    """Rounds the wave needed and pixels nothing reached, per image."""
    return closed.groupBy("image_id").agg(
        F.coalesce(F.max("wave"), F.lit(0)).alias("rounds"),
        F.count(F.when(F.col("closed").isNull(), 1)).alias("unassigned"),
    )


def with_area(px: DataFrame, tile: int = TILE, name: str = "master_area") -> DataFrame:
    """Whole-region area on every pixel row, salted by tile."""
    return attach_totals(px, ["image_id", "label"], tile_id(tile), {name: ("count", F.lit(1))})


# --- downsampling ---------------------------------------------------------------------------


def _block(factor: int) -> list[Column]:
    return [idiv("x", factor).cast("int").alias("x"), idiv("y", factor).cast("int").alias("y")]


def _whole_blocks(px: DataFrame, factor: int | Column) -> DataFrame:
    """Drop the edge remainder that fills no whole block (``width``/``height`` are columns)."""
    f = F.lit(factor) if isinstance(factor, int) else factor
    return px.where(
        (F.col("x") < idiv("width", f) * f) & (F.col("y") < idiv("height", f) * f)
    )


def box_downsample(px: DataFrame, channels: list[str], factor: int = 2) -> DataFrame:
    """Mean of every ``factor``-square block, rounded half up; partial blocks are dropped."""
    n = factor * factor
    return (
        _whole_blocks(px, factor)
        .groupBy("image_id", *_block(factor))
        .agg(*[idiv(F.sum(c) + n // 2, n).cast("int").alias(c) for c in channels])
    )


def box_downsample_by(px: DataFrame, channels: list[str], factor: Column) -> DataFrame:
    """As ``box_downsample`` with a factor per image, given by a column."""
    f = px.withColumn("_f", factor)
    f = _whole_blocks(f, F.col("_f"))
    n = F.col("_f") * F.col("_f")
    return (
        f.groupBy(
            "image_id",
            "_f",
            idiv("x", F.col("_f")).cast("int").alias("x"),
            idiv("y", F.col("_f")).cast("int").alias("y"),
        )
        .agg(*[F.sum(c).alias(c) for c in channels])
        .select(
            "image_id", "x", "y", *[idiv(F.col(c) + idiv(n, 2), n).cast("int").alias(c) for c in channels]
        )
    )


def majority(px: DataFrame) -> DataFrame:
    """Label with most votes in every 2 x 2 block; ties to the smaller master area, then id.

    ``px`` holds ``image_id, x, y, label, master_area, width, height``.
    """
    votes = (
        _whole_blocks(px, 2)
        .groupBy("image_id", *_block(2), "label")
        .agg(F.count(F.lit(1)).alias("votes"), F.max("master_area").alias("master_area"))
    )
    return votes.groupBy("image_id", "x", "y").agg(
        F.min(F.struct((-F.col("votes")).alias("o"), "master_area", "label")).alias("w")
    ).select("image_id", "x", "y", F.col("w.label").alias("label"), "w.master_area")


# --- dilation -------------------------------------------------------------------------------


def dilate_under_line(px: DataFrame, tile: int = TILE, rounds: int = DILATE_ROUNDS) -> DataFrame:
    """Move ownership below the line art, ``rounds`` pixels from each side.

    ``px`` holds ``image_id, x, y, label, master_area, alpha``.  Each round, an unresolved line
    pixel takes the resolved neighbour with the smallest (area, id), read from the previous
    round.  Tiles are copied with a halo of ``rounds`` pixels, so one shuffle by tile feeds all
    neighbour windows: their keys contain the tile, which the rows are already partitioned by.
    """
    tx, ty = idiv("x", tile), idiv("y", tile)

    def homes(c: str) -> Column:
        """Tiles along one axis that need this pixel."""
        at = F.col(c)
        return F.array_distinct(
            F.array(idiv(at, tile), idiv(F.greatest(at - rounds, F.lit(0)), tile), idiv(at + rounds, tile))
        )

    cells = (
        px.withColumn("_tx", F.explode(homes("x")))
        .withColumn("_ty", F.explode(homes("y")))
        .withColumn("_home", (F.col("_tx") == tx) & (F.col("_ty") == ty))
        .withColumn("_line", F.col("alpha") >= DILATE_ALPHA)
        .withColumn("_own", F.when(~F.col("_line"), F.struct("master_area", "label")))
        .repartition("image_id", "_tx", "_ty")
    )
    for _ in range(rounds):
        along_x = W.partitionBy("image_id", "_tx", "_ty", "y").orderBy("x")
        along_y = W.partitionBy("image_id", "_tx", "_ty", "x").orderBy("y")
        near = []
        for window, axis in ((along_x, "x"), (along_y, "y")):
            for step, shift in ((F.lag, -1), (F.lead, 1)):
                there = step(F.struct(F.col(axis).alias("at"), F.col("_own").alias("own"))).over(window)
                near.append(F.when(there["at"] == F.col(axis) + shift, there["own"]))
        cells = cells.select("*", *[c.alias(f"_n{i}") for i, c in enumerate(near)])
        cells = cells.withColumn(
            "_own", F.coalesce("_own", F.least(*[F.col(f"_n{i}") for i in range(4)]))
        ).drop(*[f"_n{i}" for i in range(4)])
    return cells.where("_home").select(
        "image_id", "x", "y", F.coalesce("_own.label", "label").alias("label")
    )


# --- adjacency and previews -----------------------------------------------------------------


def region_adjacency(px: DataFrame, max_gap: int = MAX_LINE_GAP) -> DataFrame:
    """Distinct region pairs ``a < b`` that face each other across at most ``max_gap`` pixels."""

    def facing(line: str, axis: str) -> DataFrame:
        before = W.partitionBy("image_id", line).orderBy(axis)
        seen = px.where("label is not null").select(
            "image_id", "label", F.col(axis).alias("at"),
            F.lag(F.struct("label", F.col(axis).alias("at"))).over(before).alias("p"),
        )
        return seen.where(
            (F.col("p.label") != F.col("label")) & (F.col("at") - F.col("p.at") <= max_gap)
        ).select(
            "image_id",
            F.least("label", "p.label").alias("a"),
            F.greatest("label", "p.label").alias("b"),
        )

    return facing("y", "x").unionByName(facing("x", "y")).distinct()


def preview_candidates() -> list[tuple[int, int, int]]:
    """The contrast colours: evenly spread hues with alternating value and saturation."""
    out = []
    for k in range(PREVIEW_COLORS):
        hue = (k * 360.0 / PREVIEW_COLORS + (k % 2) * 11.0) % 360.0
        value = 0.97 if k % 2 == 0 else 0.66
        sat = 0.55 if k % 3 == 0 else 0.90
        # Channel n of the standard closed form for HSV: v - v*s*max(0, min(t, 4-t, 1)).
        rgb = []
        for n in (5, 3, 1):
            t = (n + hue / 60.0) % 6.0
            rgb.append(int((value - value * sat * max(0.0, min(t, 4.0 - t, 1.0))) * 255.0 + 0.5))
        out.append(tuple(rgb))
    return out


def _color_regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy colouring in id order; rows come sorted by image and id, one row per edge.

    The state is one colour number per region of the current image, 65,535 at most.
    """
    colors = preview_candidates()
    gap = [[sum((p - q) ** 2 for p, q in zip(a, b)) for b in colors] for a in colors]
    image = region = None
    chosen: dict[int, int] = {}
    taken: set[int] = set()

    def close():
        if region is None:
            return []
        best = max(
            range(PREVIEW_COLORS),
            key=lambda k: (min((gap[k][t] for t in taken), default=1 << 40), -k),
        )
        chosen[region] = best
        return [(image, region, best, *colors[best])]

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.image_id != image or row.label != region:
                out += close()
                if row.image_id != image:
                    chosen = {}
                image, region, taken = row.image_id, row.label, set()
            if row.other >= 0:
                taken.add(chosen[row.other])
        yield pd.DataFrame(out, columns=["image_id", "label", "color", "r", "g", "b"]).astype("int64")
    yield pd.DataFrame(close(), columns=["image_id", "label", "color", "r", "g", "b"]).astype("int64")


def contrast_colors(regions: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Colour of every region, far from the colours of lower-numbered neighbours.

    ``regions`` holds ``image_id, label`` and must include every region named in ``adjacency``.
    """
    rows = (
        regions.select("image_id", "label", F.lit(-1).cast("long").alias("other"))
        .unionByName(adjacency.select("image_id", F.col("b").alias("label"), F.col("a").alias("other")))
    )
    return (
        rows.repartition("image_id")
        .sortWithinPartitions("image_id", "label", "other")
        .mapInPandas(_color_regions, "image_id long, label long, color long, r long, g long, b long")
    )


def preview_class() -> Column:
    """``line``, ``unclaimed`` or ``region`` for a pixel with ``line`` and ``label``."""
    return (
        F.when(F.col("line"), "line")
        .when(F.col("label").isNull(), "unclaimed")
        .otherwise("region")
    )
