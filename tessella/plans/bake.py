"""The whole bake: from line art and seed dots of many images to packs and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import is_line
from tessella.functions.manifest import aspect
from tessella.operators import findings as N
from tessella.operators import labels as L
from tessella.operators import painting as P
from tessella.operators import quality as Q
from tessella.operators import regions as R
from tessella.operators import runs as U
from tessella.operators.chunked import spread_join
from tessella.operators.components import TILE
from tessella.plans.params import BakeParams
from tessella.session import materialize
from tessella.sources import packs

AT = ["image_id", "x", "y"]


@dataclass
class Bake:
    """Tables of a bake; those after the master gate hold passing images only."""

    seeds: DataFrame
    merged: DataFrame
    findings: DataFrame
    diagnostics: DataFrame
    ids: DataFrame
    line: DataFrame
    shade: DataFrame | None
    orphans: DataFrame
    regions: DataFrame
    runs: DataFrame
    thumbs: DataFrame
    packs: DataFrame


def bake(
    images: DataFrame,
    line_px: DataFrame,
    seed_px: DataFrame,
    shade_px: DataFrame | None = None,
    params: BakeParams = BakeParams(),
    source_findings: DataFrame | None = None,
    check_canvas: bool = True,
    gates: bool = True,
    tile: int = TILE,
    layers: DataFrame | None = None,
    meta: DataFrame | None = None,
) -> Bake:
    """Bakes all images at once.

    ``images`` holds ``image_id, id, category, width, height``; the pixel tables are dense RGBA.
    ``layers`` (``image_id, layer, width, height, is_srgb, basis``) and ``meta`` (``image_id, folder_id, id, category``)
    are what the folders hold. There are four gates: images without a required layer stop after the source rules,
    those whose layers differ in size after the geometry rules, those with any error so far after the master rules,
    and those with an output error get no pack; inside a stage every rule is reported. Each gate is a
    small written table that the next pixel scans are joined with, so that pixel tables written by ``write_pixels`` are
    read for the images that go on alone.  ``check_canvas=False`` admits other
    sizes and ``gates=False`` bakes on regardless, for test rasters.
    """
    early = []

    def going_on(going: DataFrame, found: DataFrame, *codes: str) -> DataFrame:
        return gate(going, found, *codes) if gates else going

    going = images
    if layers is not None:
        found = Q.source_incomplete(images, layers)
        if meta is not None:
            found = found.unionByName(Q.meta_rules(meta))
        early.append(materialize(found, "source_findings"))
        going = going_on(going, early[-1], "source-incomplete")
        here = of_images(layers, going)
        found = Q.size_mismatch(here).unionByName(Q.color_space(here))
        if check_canvas:
            found = found.unionByName(Q.canvas_size(here))
        early.append(materialize(found, "geometry_findings"))
        going = going_on(going, early[-1], "size-mismatch")
    line_px, seed_px = of_images(line_px, going), of_images(seed_px, going)
    shade_px = None if shade_px is None else of_images(shade_px, going)
    masked = line_px.select(*AT, is_line("a", params.line_threshold).alias("line"))
    ratio = R.line_ratio(masked, F.col("line"))
    seeds = materialize(R.read_seeds(seed_px, tile), "seeds")
    grown = R.grow(seeds, masked, tile)
    merged, kept = R.merge_fragments(grown["pixels"], params.min_orphan_area, tile)
    merged = materialize(merged, "merged")

    found = Q.line_coverage(ratio, params.max_line_ratio)
    parts = [
        Q.seed_too_small(seeds, params.min_seed_area),
        Q.seed_on_line(grown["on_line"]),
        Q.seed_collision(grown["collisions"], seeds),
        Q.orphan_area(kept),
    ]
    if source_findings is not None:
        parts.append(source_findings)
    parts += early
    if check_canvas and layers is None:
        parts.append(Q.canvas_size(images.select("image_id", F.lit("lineart").alias("layer"), "width", "height")))
    if shade_px is not None:
        parts.append(Q.shade_too_dark(shade_px))
    for p in parts:
        found = found.unionByName(p)
    found = materialize(found, "master_findings")
    going = going_on(going, found)
    line_px = of_images(line_px, going)
    shade_px = None if shade_px is None else of_images(shade_px, going)

    # The gate comes before the costly stages: only passing images are closed and halved.
    def of(px: DataFrame) -> DataFrame:
        """Pixels of the passing images with their size; one image may hold most of them."""
        return spread_join(px, going.select("image_id", "width", "height"), ["image_id"], R.tile_id(tile), "inner")

    open_px = of(merged)
    closed = L.close_labels(open_px).select(*AT, F.col("closed").alias("label"), "width", "height")
    closed = materialize(closed.where("label is not null"), "closed")
    with_area = L.with_area(closed, tile)
    line_layer = of(line_px)
    line_white = P.layers_over_white(line_layer, "width", "height")
    colors = seeds.select("image_id", F.col("seed_id").alias("label"), "r", "g", "b")
    shade_white = None if shade_px is None else P.layers_over_white(shade_px)
    thumbs = P.thumbnail(
        P.reference_composite(closed.drop("width", "height"), colors, line_white, shade_white, tile), going
    )
    alpha = L.box_downsample(line_layer, ["a"], 2).withColumnRenamed("a", "alpha")
    half = L.majority(with_area).join(alpha, AT)
    ids = materialize(L.dilate_under_line(half, tile), "ids")
    line_out = L.box_downsample(line_white, ["r", "g", "b"], 2)
    shade_out = None
    if shade_px is not None:
        shade_out = L.box_downsample(P.layers_over_white(of(shade_px), "width", "height"), ["r", "g", "b"], 2)

    master = R.region_stats(closed)
    output = materialize(R.region_stats(ids), "output_stats")
    pieces = R.pieces_per_region(ids, tile)
    found = found.unionByName(Q.output_rules(master, output, pieces, output))
    found = materialize(found, "findings")
    packable = going_on(going, found)

    regions = R.region_table(output, seeds).join(packable.select("image_id"), "image_id", "left_semi")
    runs = U.encode_runs(ids.join(packable.select("image_id"), "image_id", "left_semi"))
    runs = materialize(runs, "runs")
    made = _packs(packable, regions, runs, shade_px is not None)
    return Bake(
        seeds=seeds,
        merged=merged,
        findings=found,
        diagnostics=N.diagnostics(found),
        ids=ids,
        line=line_out,
        shade=shade_out,
        orphans=kept,
        regions=regions,
        runs=runs,
        thumbs=thumbs,
        packs=made,
    )


def write_pixels(px: DataFrame, path: str) -> None:
    """A pixel table with a folder per image, which scans of some images skip."""
    px.repartition("image_id").write.mode("overwrite").partitionBy("image_id").parquet(path)


def gate(images: DataFrame, found: DataFrame, *codes: str) -> DataFrame:
    """The images that go on, as a written table of one row per image with a filter on it."""
    stopped = N.stopped(found, *codes).withColumn("stopped", F.lit(1))
    marked = images.join(stopped, "image_id", "left").withColumn("stopped", F.coalesce("stopped", F.lit(0)))
    return materialize(marked, "gate").where("stopped = 0").drop("stopped")  # a comparison is what scans are pruned for


def of_images(rows: DataFrame, going: DataFrame) -> DataFrame:
    """Rows of the images that go on; scans of tables with a folder per image are pruned by it."""
    return rows.join(going.select("image_id"), "image_id", "left_semi")


def _packs(images: DataFrame, regions: DataFrame, runs: DataFrame, shaded: bool) -> DataFrame:
    """Manifest, region document and content hash per image."""
    documents = packs.region_documents(regions)
    sized = images.withColumn("width", F.expr("width div 2").cast("int")).withColumn("height", F.expr("height div 2").cast("int"))
    entries = documents.select(
        "image_id", F.lit(0).alias("entry"), F.lit("regions.json").alias("name"), F.lit(0).cast("long").alias("chunk_no"),
        F.encode("regions_json", "UTF-8").alias("data"),
    ).unionByName(
        U.run_bytes(runs, sized.selectExpr("image_id", "width * height as pixels")).select(
            "image_id", F.lit(1).alias("entry"), F.lit("regions.bin").alias("name"), "chunk_no", "data"
        )
    )
    counted = regions.groupBy("image_id").agg(F.count(F.lit(1)).alias("region_count"))
    rows = (
        sized.withColumn("aspect", aspect(F.col("width") * 2, F.col("height") * 2))
        .join(counted, "image_id")
        .join(R.palette(regions), "image_id")
        .join(U.content_hash(entries), "image_id")
        .withColumn("has_shade", F.lit(shaded))
    )
    return packs.manifests(rows).join(documents, "image_id")
