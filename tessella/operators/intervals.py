"""Joins of closed integer intervals that overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import idiv


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_range: tuple[str, str], right_range: tuple[str, str], bucket: int
) -> DataFrame:
    """Pairs with equal ``keys`` whose intervals share a number; all columns of both sides (names must differ).

    Every interval is dealt to the buckets of ``bucket`` numbers it touches, so the join is on equality and a hot
    key is spread over its buckets. A pair is reported in the bucket where the later of the two begins. Choose a bucket
    near the usual length: rows grow by the buckets an interval touches.
    """

    def dealt(df: DataFrame, ends: tuple[str, str]) -> DataFrame:
        first, last = (idiv(F.col(c).cast("long"), bucket) for c in ends)
        return df.where(F.col(ends[0]) <= F.col(ends[1])).withColumn("_bucket", F.explode(F.sequence(first, last)))

    (a0, a1), (b0, b1) = left_range, right_range
    pairs = dealt(left, left_range).join(dealt(right, right_range), [*keys, "_bucket"])
    begin = idiv(F.greatest(F.col(a0), F.col(b0)).cast("long"), bucket)
    return pairs.where((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & (begin == F.col("_bucket"))).drop("_bucket")
