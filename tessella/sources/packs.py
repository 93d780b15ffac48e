"""Pack tables: region documents, manifests and integrity checks on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.manifest import SCHEMA_VERSION, difficulty, version_ok
from tessella.operators.runs import run_errors

REGION_SCHEMA = "array<struct<id:bigint,centroid:array<int>,area:bigint,bbox:array<int>,suggested_color:string>>"
MANIFEST_SCHEMA = (
    "schema_version string, id string, content_hash string, canvas_size array<int>, aspect string, "
    "region_count long, difficulty string, category string, has_shade boolean, palette array<string>"
)


def region_documents(regions: DataFrame) -> DataFrame:
    """One JSON array per image, by id: at most 65,535 regions in a row."""
    entry = F.struct(
        F.col("id").cast("long").alias("id"),
        F.array("centroid.x", "centroid.y").alias("centroid"),
        F.col("area").cast("long").alias("area"),
        F.array("bbox.x", "bbox.y", "bbox.w", "bbox.h").alias("bbox"),
        "suggested_color",
    )
    return regions.groupBy("image_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e)).alias("regions_json")
    )


def parse_regions(documents: DataFrame) -> DataFrame:
    """Region rows of ``image_id, regions_json``."""
    rows = documents.select("image_id", F.explode(F.from_json("regions_json", REGION_SCHEMA)).alias("r")).select(
        "image_id", "r.*"
    )
    c, b = F.col("centroid"), F.col("bbox")
    return rows.select(
        "image_id",
        "id",
        F.struct(c[0].alias("x"), c[1].alias("y")).alias("centroid"),
        "area",
        F.struct(b[0].alias("x"), b[1].alias("y"), b[2].alias("w"), b[3].alias("h")).alias("bbox"),
        "suggested_color",
    )


def manifests(packs: DataFrame) -> DataFrame:
    """Manifest JSON per image.

    ``packs`` holds ``image_id, id, content_hash, width, height, aspect, region_count, category,
    has_shade, palette``; width and height are those of the output.
    """
    doc = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.col("id"),
        F.col("content_hash"),
        F.array("width", "height").alias("canvas_size"),
        F.col("aspect"),
        F.col("region_count"),
        difficulty("region_count").alias("difficulty"),
        F.col("category"),
        F.col("has_shade"),
        F.col("palette"),
    )
    return packs.select("image_id", F.to_json(doc).alias("manifest_json"))


def parse_manifests(documents: DataFrame) -> DataFrame:
    return documents.select("image_id", F.from_json("manifest_json", MANIFEST_SCHEMA).alias("m")).select("image_id", "m.*")


def integrity(manifest: DataFrame, regions: DataFrame, runs: DataFrame, hashes: DataFrame) -> DataFrame:
    """What a reader rejects, per image, in the order it is noticed (NULL when sound).

    ``manifest`` comes from ``parse_manifests``, ``hashes`` holds the recomputed hash; the runs have to
    decode to the pixels of the manifest's canvas.
    """
    size = manifest.select("image_id", (F.col("canvas_size")[0].cast("long") * F.col("canvas_size")[1]).alias("pixels"))
    total = runs.groupBy("image_id").agg(F.sum("len").alias("_decoded"), F.max("id").alias("_max_id"))
    broken = run_errors(runs, size).withColumnRenamed("error", "_run_error")
    count = regions.groupBy("image_id").agg(F.count(F.lit(1)).alias("_rows"))
    joined = (
        manifest.join(size, "image_id")
        .join(total, "image_id", "left")
        .join(broken, "image_id", "left")
        .join(count, "image_id", "left")
        .join(hashes.select("image_id", F.col("content_hash").alias("_hash")), "image_id", "left")
    )
    error = (
        F.when(~version_ok("schema_version"), "schema-version")
        .when(~F.col("_hash").eqNullSafe(F.col("content_hash")), "content-hash")
        .when(F.col("_run_error").isNotNull(), F.col("_run_error"))
        .when(~F.col("_decoded").eqNullSafe(F.col("pixels")), "pixel-count")
        .when(F.coalesce("_rows", F.lit(0)) != F.col("region_count"), "region-rows")
        .when(F.col("_max_id") >= F.col("region_count"), "region-id")
    )
    return joined.select("image_id", error.alias("error"))
