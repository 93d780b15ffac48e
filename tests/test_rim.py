"""Pixels on the rim of a dab, and paint rounded as SQL does."""

from pyspark.sql import functions as F

from tessella.functions.shape import decimals
from tessella.operators import painting as P


def test_a_turned_tip_does_not_cover_its_rim(spark):
    # Middles of pixels at exactly one radius from the middle of the dab, for all sorts of angles.
    rows = [(n, 5.5, 5.5, float(size), n * 0.1, 1.0, tip) for n in range(60) for size in (4, 10) for tip in ("soft_round", "hard_round")]
    dabs = spark.createDataFrame(rows, "dab_no long, x double, y double, size double, angle double, alpha double, tip string")
    cells = P.dab_pixels(dabs.withColumn("width", F.lit(16)).withColumn("height", F.lit(16)))
    near = F.pow(F.col("px") + 0.5 - F.col("x"), 2) + F.pow(F.col("py") + 0.5 - F.col("y"), 2) < F.pow(F.col("size") / 2, 2)
    assert cells.where((F.col("cover") > 0) != near).count() == 0


def test_ties_round_as_doubles(spark):
    row = spark.range(1).select(*[decimals(F.lit(v), 4).alias(n) for n, v in (("a", 0.65065), ("b", 0.20804999999999998), ("c", -0.00005))])
    assert tuple(row.first()) == (0.6506, 0.2081, -0.0001)
