"""Catalogue views: sections, chips, works, legal states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.gallery import is_impossible, matches

ENTITLEMENTS = ("free", "paid")
DOWNLOADS = ("notDownloaded", "downloading", "downloaded", "failed")
WORKS = (None, "inProgress", "shared")


def catalog(assets: DataFrame, works: DataFrame) -> DataFrame:
    """Every asset with its local work, if there is one."""
    return assets.join(works, "asset_id", "left")


def section_order(items: DataFrame) -> DataFrame:
    """Categories by first appearance; ``items`` holds ``pos, category``."""
    return items.groupBy("category").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("items"))


def explore(items: DataFrame, category: str | None = None, query: str = "") -> DataFrame:
    """Filtered items with the place of their section; chips come from the unfiltered list."""
    shown = items.where(matches(F.col("category"), F.col("title"), category, query))
    # One row per category, a fixed vocabulary of six in packs.
    order = section_order(shown).select("category", F.col("first_pos").alias("section_pos"))
    return shown.join(order, "category")


def my_works(items: DataFrame) -> DataFrame:
    """Started works, last edited first, never edited last."""
    return items.where(F.col("work").isNotNull()).orderBy(F.desc_nulls_last("last_edited"), "pos")


def recent_works(items: DataFrame, n: int = 2) -> DataFrame:
    return my_works(items).limit(n)


def legal_states(spark: SparkSession) -> DataFrame:
    """The 2 x 4 x 3 state combinations without the impossible ones."""
    rows = [(e, d, w) for e in ENTITLEMENTS for d in DOWNLOADS for w in WORKS]
    grid = spark.createDataFrame(rows, "entitlement string, download string, work string")
    return grid.where(~is_impossible("download", "work"))


def state_counts(items: DataFrame) -> DataFrame:
    """Every legal state with its number of items, 0 where none shows it."""
    state = ["entitlement", "download", "work"]
    counts = items.groupBy(*state).agg(F.count(F.lit(1)).alias("n_items")).alias("c")
    legal = legal_states(items.sparkSession).alias("l")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in state]
    return legal.join(counts, same, "left").select(
        *[F.col(f"l.{c}").alias(c) for c in state], F.coalesce("n_items", F.lit(0)).alias("n_items")
    )


def state_gaps(items: DataFrame) -> DataFrame:
    """Legal states no item shows (``missing``) and states that are not legal (``illegal``)."""
    legal = legal_states(items.sparkSession)
    seen = items.select("entitlement", "download", "work").distinct()
    return (
        legal.exceptAll(seen).withColumn("gap", F.lit("missing"))
        .unionByName(seen.exceptAll(legal).withColumn("gap", F.lit("illegal")))
    )
