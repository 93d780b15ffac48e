"""Chunk helpers on NULL keys and NULL orders, next to plain windows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import chunked as C
from tessella.operators import documents as D

ROWS = [(k, s, (s or 3) * 7 % 5) for k in (None, 1, 2) for s in (None, 0, 1, 2, 5, 6, 9)]


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_helpers_keep_null_rows(spark):
    df = spark.createDataFrame(ROWS, "k int, seq long, v long").repartition(3)
    block = C.seq_block("seq", 2)
    key, at = W.partitionBy("k"), W.partitionBy("k").orderBy("seq")
    up_to = at.rowsBetween(W.unboundedPreceding, 0)
    same(C.attach_totals(df, ["k"], block, {"t": ("sum", F.col("v"))}), df.withColumn("t", F.sum("v").over(key)))
    same(C.row_numbers(df, ["k"], block, [F.col("seq")], "n"), df.withColumn("n", (F.row_number().over(at) - 1).cast("long")))
    same(
        C.running(df, ["k"], block, [F.col("seq")], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}),
        df.withColumn("s", F.sum("v").over(up_to)).withColumn("m", F.max("v").over(up_to)),
    )
    same(C.previous(df, ["k"], block, "seq", {"p": "v"}), df.withColumn("p", F.lag("v").over(at)))


def test_spread_join_keeps_rows_with_a_null_chunk(spark):
    df = spark.createDataFrame(ROWS, "k int, seq long, v long")
    names = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    for how in ("left", "inner"):
        same(C.spread_join(df, names, ["k"], C.seq_block("seq", 2), how).select("k", "seq", "v", "name"), df.join(names, "k", how))


def test_fill_effects_keeps_null_documents_and_regions(spark):
    rows = [(1, 1, 4, 0, 0, 0), (None, 2, 4, 9, 0, 0), (1, 3, None, 9, 0, 0), (1, 4, 4, 9, 0, 0)]
    ops = spark.createDataFrame(rows, "doc_id long, seq long, region_id int, r int, g int, b int")
    assert D.fill_effects(ops).count() == 4


def test_ordered_equals_plain_windows(spark):
    df = spark.createDataFrame(ROWS, "k int, seq long, v long").repartition(3)
    key, at = W.partitionBy("k"), W.partitionBy("k").orderBy("seq")
    up_to = at.rowsBetween(W.unboundedPreceding, 0)
    step = F.col("v") - 2
    want = df.withColumn("n", (F.row_number().over(at) - 1).cast("long")).withColumn("s", F.sum(step).over(up_to))
    want = want.withColumn("low", F.min("s").over(up_to)).withColumn("p", F.lag("v").over(at))
    want = want.withColumn("s_end", F.sum(step).over(key)).withColumn("low_end", F.min("low").over(key)).withColumn("m", F.max("v").over(key))
    for rows in (1, 2, 100):
        got = C.ordered(
            df, ["k"], C.seq_block("seq", rows), ["seq"], number="n", sums={"s": step}, lows={"low": "s"}, before={"p": "v"}, totals={"m": ("max", F.col("v"))}
        )
        same(got, want)


def test_islands_equal_gaps_and_islands(spark):
    rows = [(k, s, None if s % 5 == 0 else (s * s // 7) % 3) for k in (None, 1, 2) for s in range(40) if (k or 0) != 2 or s % 3]
    df = spark.createDataFrame(rows, "k int, seq long, v long").repartition(3)
    at = W.partitionBy("k").orderBy("seq")
    new = F.coalesce(~F.lag(F.struct("v")).over(at).eqNullSafe(F.struct("v")), F.lit(True)).cast("long")
    want = df.withColumn("_new", new).withColumn("i", F.sum("_new").over(at.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    for size in (1, 3, 1000):
        same(C.islands(df, ["k"], C.seq_block("seq", size), ["seq"], "v", "i"), want)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_logs_read_their_tables_twice_at_most(spark, tmp_path):
    spark.range(100).selectExpr(
        "id % 3 as doc_id", "id as seq", "if(id % 4 = 0, 'undo', 'op') as kind", "cast(id as double) as ts", "id % 3 as user_id", "id as last_edited",
        "id % 2 = 0 as shared", "id as log_bytes", "id as other_bytes", "element_at(array('download', 'open', 'finish'), cast(id % 3 + 1 as int)) as step",
    ).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    assert scans(D.effective_log(t)) <= 2 and scans(D.keyframes(t, 20)) <= 2 and scans(D.backup_quota(t, 50)) <= 2 and scans(D.funnel(t)) == 1


def test_a_hot_user_in_the_funnel(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), rng.choice([*D.FUNNEL_STEPS, "other"]), float(rng.randrange(4) * 1800 + rng.randrange(3))) for _ in range(120)]
    rows += [(9, s, 5.0) for s in reversed(D.FUNNEL_STEPS)]
    df = spark.createDataFrame(rows, "user_id long, step string, ts double").repartition(4)
    want = [0] * len(D.FUNNEL_STEPS)
    for user in {u for u, *_ in rows}:
        at = float("-inf")
        for n, step in enumerate(D.FUNNEL_STEPS):
            later = [t for u, s, t in rows if u == user and s == step and t >= at]
            if not later:
                break
            at = min(later)
            want[n] += 1
    got = {r.step_no: r.users for r in D.funnel(df).collect()}
    assert [got[n] for n in range(len(want))] == want and want[-1] > 0
