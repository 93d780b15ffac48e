"""Report sinks: JSON lines, readable text, and the region attachment for rejected images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import hex_color
from tessella.operators.regions import region_stats


def reports(images: DataFrame, diags: DataFrame, seed_stats: DataFrame | None = None) -> DataFrame:
    """One row per image with its diagnostics in reading order, errors and warnings counted."""
    listed = diags.groupBy("image_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct("rank", "severity", "code", "stage", "message", "coords", "coord_total", "cluster_total")
            )
        ).alias("diagnostics"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    out = images.join(listed, "image_id", "left").withColumns(
        {"errors": F.coalesce("errors", F.lit(0)), "warnings": F.coalesce("warnings", F.lit(0))}
    )
    return out if seed_stats is None else out.join(seed_stats, "image_id", "left")


def report_text(rows: DataFrame) -> DataFrame:
    """Readable text of every report."""

    def coords(d):
        points = F.transform(
            d["coords"],
            lambda c: F.concat(
                F.format_string("(%d, %d)", c["x"], c["y"]),
                F.when(c["count"] > 1, F.concat(F.lit("x"), c["count"].cast("string"))).otherwise(""),
            ),
        )
        more = d["cluster_total"] - F.size(d["coords"])
        return F.when(
            F.size(d["coords"]) > 0,
            F.concat(
                F.lit("\n      "),
                F.format_string("%d places", d["cluster_total"]),
                F.when(d["coord_total"] > d["cluster_total"], F.format_string(" / %d px", d["coord_total"])).otherwise(""),
                F.lit(": "),
                F.concat_ws(" ", points),
                F.when(more > 0, F.format_string(", %d more", more)).otherwise(""),
            ),
        ).otherwise("")

    lines = F.transform(
        F.coalesce("diagnostics", F.array()),
        lambda d: F.concat(F.format_string("  %s [%s] %s: %s", d["severity"], d["code"], d["stage"], d["message"]), coords(d)),
    )
    return rows.select(
        "image_id",
        F.concat_ws(
            "\n", lines, F.format_string("  %d errors, %d warnings", F.col("errors"), F.col("warnings"))
        ).alias("text"),
    )


def write_reports(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def region_attachment(merged: DataFrame, seeds: DataFrame) -> DataFrame:
    """Regions at master size before closing, with their anchor; made for rejected images too.

    A seed whose flood never started has area 0.
    """
    stats = region_stats(merged.select("image_id", "x", "y", "label"))
    at = seeds.select(
        "image_id",
        F.col("seed_id").alias("label"),
        hex_color("r", "g", "b").alias("suggested_color"),
        F.col("ax").alias("anchor_x"),
        F.col("ay").alias("anchor_y"),
    )
    zero_box = F.struct(*[F.lit(0).alias(c) for c in "xywh"])
    zero_at = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    return at.join(stats.drop("first_pixel"), ["image_id", "label"], "left").select(
        "image_id",
        F.col("label").alias("id"),
        F.coalesce("area", F.lit(0)).alias("area"),
        F.coalesce("bbox", zero_box).alias("bbox"),
        F.coalesce("centroid", zero_at).alias("centroid"),
        "suggested_color",
        "anchor_x",
        "anchor_y",
    )


def rejection_documents(images: DataFrame, merged: DataFrame, seeds: DataFrame, orphans: DataFrame) -> DataFrame:
    """One JSON document per image at master size, before closing: its size, all regions, and the areas without a seed.

    ``images`` holds ``image_id, id, width, height``. An image has 65,535 regions at most; orphans are those that were not merged.
    """
    pair = lambda *c: F.array(*c)
    box = lambda b: F.array(*[F.col(f"{b}.{c}") for c in "xywh"])
    region = F.struct(
        "id", "area", box("bbox").alias("bbox"), pair("centroid.x", "centroid.y").alias("centroid"), "suggested_color",
        pair("anchor_x", "anchor_y").alias("seed_anchor"),
    )
    listed = region_attachment(merged, seeds).groupBy("image_id").agg(F.array_sort(F.collect_list(region)).alias("regions"))
    orphan = F.struct((-F.col("area")).alias("_o"), "y", "x", "area", box("bbox").alias("bbox"), pair("x", "y").alias("anchor"))
    lost = orphans.groupBy("image_id").agg(F.array_sort(F.collect_list(orphan)).alias("o")).select(
        "image_id", F.transform("o", lambda s: F.struct(s["area"].alias("area"), s["bbox"].alias("bbox"), s["anchor"].alias("anchor"))).alias("orphans")
    )
    none = lambda name, of: F.coalesce(name, F.array().cast(of))
    rows = images.join(listed, "image_id", "left").join(lost, "image_id", "left")
    doc = F.struct(
        "id",
        pair("width", "height").alias("master_size"),
        none("regions", listed.schema["regions"].dataType).alias("regions"),
        none("orphans", lost.schema["orphans"].dataType).alias("orphans"),
    )
    return rows.select("image_id", F.to_json(doc).alias("rejection_json"))
