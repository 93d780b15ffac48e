"""Tables that are small in their files alone do not go through the driver."""

from pyspark.sql import functions as F

from tessella.operators.chunked import attach_totals, spread_join
from tessella.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_not_broadcast(spark):
    rows = spark.range(20_000).select(F.lit(0).alias("image_id"), F.col("id").alias("x"), F.lit(1).alias("y"), (F.col("id") % 5).alias("label"))
    free, names = materialize(rows, "free"), materialize(rows.select("image_id", "label").distinct(), "names")
    joined = [
        rows.join(free, ["image_id", "x", "y"]),
        free.join(rows.where("label = 1"), ["image_id", "x", "y"]),
        spread_join(free, names, ["image_id", "label"], F.col("y")),
        attach_totals(rows, ["image_id", "label"], F.col("y"), {"n": ("count", F.lit(1))}),
    ]
    for df in joined:
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
        assert df.count() in (4_000, 20_000)
