"""Data-quality rules over whole libraries of artwork; each yields findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import luma, over_white, share_text
from tessella.functions.manifest import MAX_REGION_COUNT, aspect, is_category
from tessella.functions.shape import key_x, key_y, raster_key
from tessella.operators.findings import finding

# Fixed values of the rules.
MAX_LINE_RATIO = 0.35
MIN_REGION_AREA = 200
REGION_COUNT_MIN, REGION_COUNT_MAX = 8, 2000
SHADE_MIN_LUMA = 60
REQUIRED_LAYERS = ("lineart", "seeds")
LAYER_ORDER = ("lineart", "seeds", "shade")


def source_incomplete(images: DataFrame, layers: DataFrame) -> DataFrame:
    """``images`` is every folder seen, ``layers`` what it holds (``image_id, layer``)."""
    need = F.explode(F.array(*map(F.lit, REQUIRED_LAYERS)))
    missing = images.select("image_id", need.alias("layer")).join(
        layers.select("image_id", "layer"), ["image_id", "layer"], "left_anti"
    )
    listed = missing.groupBy("image_id").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("layer"))).alias("layers")
    )
    return finding(listed, "source-incomplete", metric=F.col("layers"))


def _first_layer(layers: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, LAYER_ORDER)), F.col("layer"))
    return layers.withColumn("_place", place)


def size_mismatch(layers: DataFrame) -> DataFrame:
    """Layers whose size differs from the first; ``image_id, layer, width, height``."""
    placed = _first_layer(layers)
    first = placed.groupBy("image_id").agg(F.min_by(F.struct("width", "height"), "_place").alias("first"))
    odd = placed.join(first, "image_id").where(F.struct("width", "height") != F.col("first"))
    listed = odd.groupBy("image_id").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("_place", "layer"))), lambda s: s["layer"])).alias("names")
    )
    return finding(listed, "size-mismatch", metric=F.col("names"))


def canvas_size(layers: DataFrame) -> DataFrame:
    first = _first_layer(layers).groupBy("image_id").agg(
        F.min_by(F.struct("width", "height"), "_place").alias("s")
    ).select("image_id", "s.width", "s.height")
    bad = first.where(aspect("width", "height").isNull())
    return finding(bad, "canvas-size", metric=F.format_string("%dx%d", "width", "height"))


def color_space(layers: DataFrame) -> DataFrame:
    """One finding per layer whose verdict is not sRGB (``is_srgb``, ``basis``)."""
    bad = _first_layer(layers).where(~F.col("is_srgb"))
    return finding(bad, "color-space", order=(F.col("_place"),), metric=F.concat_ws(" ", "layer", "basis"))


def meta_rules(meta: DataFrame) -> DataFrame:
    """``image_id, folder_id, id, category`` against the folder name and the vocabulary."""
    ids = finding(meta.where("not (id <=> folder_id)"), "meta-id-mismatch", metric=F.col("id"))
    cats = finding(meta.where(~is_category("category")), "meta-bad-category", metric=F.col("category"))
    return ids.unionByName(cats)


def line_coverage(ratios: DataFrame, limit: float = MAX_LINE_RATIO) -> DataFrame:
    return finding(
        ratios.where(F.col("line_ratio") > limit),
        "line-coverage",
        metric=share_text("line_ratio"),
    )


def seed_too_small(seeds: DataFrame, limit: int) -> DataFrame:
    small = seeds.where(F.col("solid_area") < limit)
    return finding(
        small, "seed-too-small", F.col("ax"), F.col("ay"), (F.col("seed_id"),), low=F.col("solid_area")
    )


def seed_on_line(on_line: DataFrame) -> DataFrame:
    return finding(on_line, "seed-on-line", F.col("x"), F.col("y"), (F.col("seed_id"),))


def seed_collision(collisions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Both anchors of every pair, in pairs; never clustered."""
    at = seeds.select("image_id", F.col("seed_id").alias("_who"), "ax", "ay")
    ends = collisions.select(
        "image_id",
        F.col("seed_id").alias("pair"),
        F.posexplode(F.array("owner", "seed_id")).alias("side", "_who"),
    ).join(at, ["image_id", "_who"])
    return finding(ends, "seed-collision", F.col("ax"), F.col("ay"), (F.col("pair"), F.col("side")))


def orphan_area(kept: DataFrame) -> DataFrame:
    return finding(
        kept,
        "orphan-area",
        F.col("x"),
        F.col("y"),
        (-F.col("area"), raster_key("x", "y")),
        F.col("area"),
    )


def shade_too_dark(shade_px: DataFrame) -> DataFrame:
    """Luma of the shade layer over white paper."""
    white = [over_white(c, "a") for c in "rgb"]
    lit = shade_px.select("image_id", "x", "y", luma(*white).alias("luma"))
    dark = lit.where(F.col("luma") < SHADE_MIN_LUMA)
    return finding(
        dark, "shade-too-dark", F.col("x"), F.col("y"), (raster_key("x", "y"),), low=F.col("luma")
    )


def vanished(master: DataFrame, output: DataFrame) -> DataFrame:
    """Regions of the master with no pixel left in the output."""
    return master.join(output.select("image_id", "label"), ["image_id", "label"], "left_anti")


def output_rules(master: DataFrame, output: DataFrame, pieces: DataFrame, split_at: DataFrame) -> DataFrame:
    """All rules of the output stage.

    ``master``/``output`` are region statistics before and after downsampling, ``pieces`` the
    number of pieces per output region, ``split_at`` the output statistics they are placed by.
    """
    lost = vanished(master, output)
    drift = finding(
        lost, "region-count-drift", key_x("first_pixel"), key_y("first_pixel"), (F.col("label"),)
    )
    counts = master.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    overflow = finding(counts.where(F.col("n") > MAX_REGION_COUNT), "region-count-overflow", metric=F.col("n"))
    rng = finding(
        counts.where((F.col("n") < REGION_COUNT_MIN) | (F.col("n") > REGION_COUNT_MAX)),
        "region-count-range",
        metric=F.col("n"),
    )
    small = output.where(F.col("area") < MIN_REGION_AREA)
    tiny = finding(
        small, "tiny-region", F.col("centroid.x"), F.col("centroid.y"), (F.col("label"),), low=F.col("area")
    )
    broken = pieces.where("pieces > 1").join(split_at, ["image_id", "label"])
    split = finding(broken, "region-split", F.col("centroid.x"), F.col("centroid.y"), (F.col("label"),))
    out = drift
    for part in (overflow, tiny, rng, split):
        out = out.unionByName(part)
    return out
