"""Long pauses: the log is many filler rows for a sample, of which none is shuffled."""

import re

from pyspark.sql import functions as F

from tessella.operators import documents as D
from tessella.plans.document_queries import delta_decoded, delta_encoded, dequantized_samples


def samples(spark):
    pauses = [0, 3, 255, 256, 510, 511, 5000, -40, 90_000, 7]
    at = F.element_at(F.array(*map(F.lit, [sum(pauses[: i + 1]) for i in range(10)])), (F.col("seq") % 10 + 1).cast("int"))
    rows = spark.range(60).selectExpr("id % 3 as stroke_id", "id div 3 as seq")
    t = (F.col("seq") / 10).cast("int") * 200 + at / 1000
    return rows.select("*", (F.col("seq") * 37 % 41).alias("x"), F.lit(5.0).alias("y"), t.alias("t"), (F.col("seq") / 20).alias("pressure"),
                       (F.col("seq") * 3.0).alias("radius"), F.lit(1.0).alias("tilt_x"), F.lit(-1.0).alias("tilt_y"))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_one_row_per_sample_holds_the_whole_log(spark):
    df = samples(spark)
    log = D.delta_encode(D.quantize(df))
    whole = D.encode_whole(D.quantize_whole(df))
    assert whole.count() == 60 and log.count() > 2000
    assert rows_of(D.log_rows(whole)) == rows_of(log)
    assert rows_of(D.decoded_rows(D.decode_whole(whole))) == rows_of(D.delta_decode(log))
    assert rows_of(D.dequantize_whole(D.decode_whole(whole))) == rows_of(D.dequantize(D.delta_decode(log)))


def test_no_filler_row_is_shuffled(spark):
    for query in (delta_encoded, delta_decoded, dequantized_samples):
        lines = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        explodes = [i for i, line in enumerate(lines) if "Generate explode" in line]
        above = lines[: max(explodes, default=0)]  # neither sorts nor joins
        assert not [line for line in above if re.search(r"Join|Window|Aggregate", line)], query
