"""Findings to diagnostics: vocabulary, coordinate clusters, ordering and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.color import idiv

MAX_COORDS = 16
CLUSTER_GRID = 128
OUTPUT_SCALE = 2

# Code, severity, stage, cluster grid, coordinate scale - in reading order, the
# most suspicious first.
RULES = [
    ("source-incomplete", "error", "master", 1, 1),
    ("size-mismatch", "error", "master", 1, 1),
    ("canvas-size", "error", "master", 1, 1),
    ("color-space", "error", "master", 1, 1),
    ("meta-id-mismatch", "error", "master", 1, 1),
    ("meta-bad-category", "error", "master", 1, 1),
    ("line-coverage", "warning", "master", 1, 1),
    ("seed-on-line", "error", "master", 1, 1),
    ("seed-too-small", "error", "master", 1, 1),
    ("seed-collision", "error", "master", 1, 1),
    ("orphan-area", "error", "master", 1, 1),
    ("shade-too-dark", "error", "master", CLUSTER_GRID, 1),
    ("region-count-overflow", "error", "output", 1, 1),
    ("region-count-drift", "error", "output", 1, 1),
    ("region-split", "warning", "output", CLUSTER_GRID, OUTPUT_SCALE),
    ("tiny-region", "warning", "output", CLUSTER_GRID, OUTPUT_SCALE),
    ("region-count-range", "warning", "output", 1, 1),
]
CODES = [r[0] for r in RULES]

MESSAGES = {
    "source-incomplete": "required layers are missing: %s",
    "size-mismatch": "layer size differs from the first layer: %s",
    "canvas-size": "canvas %s is neither 4096x4096 nor 3072x4096",
    "color-space": "colour profile is not sRGB: %s",
    "meta-id-mismatch": "metadata id differs from the folder name: %s",
    "meta-bad-category": "unknown category: %s",
    "line-coverage": "line pixels cover too much of the canvas: %s",
    "seed-on-line": "seeds stand on a line: %s",
    "seed-too-small": "seeds are too small, the smallest has %s solid pixels",
    "seed-collision": "seeds share one closed area, the line has a gap: %s",
    "orphan-area": "closed areas have no seed, the largest has %s pixels",
    "shade-too-dark": "shade is too dark, the darkest luma is %s",
    "region-count-overflow": "too many regions for 16-bit ids: %s",
    "region-count-drift": "regions vanish when downsampled: %s",
    "region-split": "regions fall into several pieces: %s",
    "tiny-region": "regions are tiny at output size, the smallest has %s pixels",
    "region-count-range": "region count is outside the suggested range: %s",
}


def rank(code: str | Column) -> Column:
    """Reading position of a code; unknown codes come last."""
    col = F.col(code) if isinstance(code, str) else code
    return F.coalesce(
        F.nullif(F.array_position(F.array(*map(F.lit, CODES)), col), F.lit(0)), F.lit(len(CODES) + 2)
    ) - 1


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "code string, severity string, stage string, grid int, scale int")


def finding(
    df: DataFrame,
    code: str,
    x: Column | None = None,
    y: Column | None = None,
    order: tuple[Column, ...] = (),
    metric: Column | None = None,
    low: Column | None = None,
) -> DataFrame:
    """Rows of one rule in the common form; ``order`` says which coordinate came first.

    The message shows the ``metric`` of the first finding, or the smallest ``low`` of all.
    """
    a, b = [*order, F.lit(0), F.lit(0)][:2]
    none = F.lit(None)
    return df.select(
        F.col("image_id").cast("long").alias("image_id"),
        F.lit(code).alias("code"),
        (none if x is None else x).cast("int").alias("x"),
        (none if y is None else y).cast("int").alias("y"),
        F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")).alias("arrival"),
        (none if metric is None else metric).cast("string").alias("metric"),
        (none if low is None else low).cast("long").alias("low"),
    )


def clusters(findings: DataFrame) -> DataFrame:
    """Coordinates of a rule grouped by grid cell; the first arrival stands for the cell."""
    rules = rule_table(findings.sparkSession)
    placed = findings.where("x is not null").join(F.broadcast(rules), "code")
    x, y = F.col("x") * F.col("scale"), F.col("y") * F.col("scale")
    return placed.groupBy(
        "image_id", "code", idiv(x, F.col("grid")).alias("cx"), idiv(y, F.col("grid")).alias("cy")
    ).agg(
        F.min(F.struct("arrival", x.alias("x"), y.alias("y"))).alias("first"),
        F.count(F.lit(1)).alias("count"),
    ).select("image_id", "code", "first.x", "first.y", "first.arrival", "count")


def top_clusters(cells: DataFrame, limit: int = MAX_COORDS) -> DataFrame:
    """Largest clusters first, ties in order of arrival.

    The rank limit is applied before the shuffle as well, so a rule with very many clusters
    sends no more than ``limit`` rows per task.
    """
    order = W.partitionBy("image_id", "code").orderBy(F.desc("count"), "arrival")
    return cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def diagnostics(findings: DataFrame) -> DataFrame:
    """One row per image and code, with clustered coordinates and totals."""
    rules = rule_table(findings.sparkSession)
    cells = clusters(findings)
    totals = cells.groupBy("image_id", "code").agg(
        F.sum("count").alias("coord_total"), F.count(F.lit(1)).alias("cluster_total")
    )
    kept = top_clusters(cells).groupBy("image_id", "code").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "x", "y", "count"))),
            lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["count"].alias("count")),
        ).alias("coords")
    )
    base = findings.groupBy("image_id", "code").agg(
        F.coalesce(F.min_by("metric", "arrival"), F.min("low").cast("string")).alias("metric"),
        F.count(F.lit(1)).alias("findings"),
    )
    text = F.lit(None).cast("string")
    for code, pattern in MESSAGES.items():
        value = F.coalesce(F.col("metric"), F.col("findings").cast("string"))
        text = F.when(F.col("code") == code, F.format_string(pattern, value)).otherwise(text)
    return (
        base.join(totals, ["image_id", "code"], "left")
        .join(kept, ["image_id", "code"], "left")
        .join(F.broadcast(rules.drop("grid", "scale")), "code")
        .select(
            "image_id",
            "severity",
            "code",
            "stage",
            text.alias("message"),
            F.coalesce("coords", F.array().cast("array<struct<x:int,y:int,count:bigint>>")).alias("coords"),
            F.coalesce("coord_total", F.lit(0)).alias("coord_total"),
            F.coalesce("cluster_total", F.lit(0)).alias("cluster_total"),
            rank("code").alias("rank"),
        )
    )


def severity_counts(diags: DataFrame) -> DataFrame:
    return diags.groupBy("image_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.bool_or(F.col("severity") == "error").alias("has_error"),
    )


def find_code(diags: DataFrame, code: str) -> DataFrame:
    return diags.where(F.col("code") == code)


def stopped(findings: DataFrame, *codes: str) -> DataFrame:
    """Images with an error finding (of the given codes, or of any)."""
    errors = codes or tuple(c for c, severity, *_ in RULES if severity == "error")
    return findings.where(F.col("code").isin(*errors)).select("image_id").distinct()


def passing(images: DataFrame, findings: DataFrame, *codes: str) -> DataFrame:
    """Images without an error finding (of the given codes, or of any)."""
    return images.join(stopped(findings, *codes), "image_id", "left_anti")
