"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import PRE, written

#: Tasks, at most, over which the rows of one key are spread in a join.
SPOTS = 1024


def spread_to(rows: DataFrame, table: DataFrame, key: str, other: str) -> DataFrame:
    """Joins a table of one row per ``key`` to rows of which one key may hold a large share.

    The table gets a copy for each key and spot, a spot being a share of the values of ``other``.
    """
    spot = f"{PRE}spot"
    dealt = rows.withColumn(spot, F.pmod(F.xxhash64(other), F.lit(SPOTS)))
    copies = dealt.select(key, spot).distinct().join(table, key)
    return dealt.join(copies, [key, spot]).drop(spot)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node of its component.

    Alternates the large-star and the small-star step: every node points to the smallest of its
    neighbours, first its larger, then its smaller ones. Each round is written to the shared folder. It
    ends when the links are stars: every node has one link, and no root has one itself.
    """
    x, y = F.col(a), F.col(b)
    links = written(
        links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links"
    )
    while not is_stars(links):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def is_stars(links: DataFrame) -> bool:
    ends = links.select("u", F.lit(1).alias("out")).union(links.select(F.col("v").alias("u"), F.lit(None)).distinct())
    both = ends.groupBy("u").agg(F.count("out").alias("n_out"), F.count("*").alias("n"))
    return both.where("n_out > 1 or (n_out = 1 and n > 1)").isEmpty()
