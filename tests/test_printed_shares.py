"""Shares are printed as C and Rust print them."""

from pyspark.sql import functions as F

from tessella.functions.color import share_text


def test_three_decimals_round_the_binary_value_half_to_even(spark):
    ratios = [0.0, 1.0, 0.3125, 0.3135, 0.9995, 0.9996, 0.0005, 0.0625, 0.1875, 0.5 + 2**-53, 1 / 3]
    ratios += [n / 2000 for n in range(1, 2000, 2)] + [n / 16 for n in range(16)]
    rows = spark.createDataFrame([(r,) for r in ratios], "ratio double")
    got = rows.select("ratio", share_text("ratio").alias("text")).collect()
    assert [(r.ratio, r.text) for r in got if r.text != f"{r.ratio:.3f}"] == []
