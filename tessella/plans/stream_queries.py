"""Streaming twins of the batch queries, run over the given events to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.plans import views as V
from tessella.plans.registry import query, view
from tessella.session import materialize, scratch_dir
from tessella.streaming import documents as SD
from tessella.streaming import live as SL
from tessella.streaming import strokes as SS

_OPS = [
    "user_id as doc_id", "event_id as seq", "cast(event_id % 13 as int) as region_id",
    "cast(floor(value) as int) % 4 * 60 as r", "0 as g", "0 as b",
]


def raw_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return SD.read_files(spark, sf, schema, "events.parquet")


@query(
    "stream_palette",
    "select doc_id, region_id, arg_max(r, seq) as r, max(seq) as seq from ops group by doc_id, region_id",
)
def stream_palette(spark, sf):
    ops = raw_stream(spark, sf).where("event_type in ('click', 'view', 'purchase')").selectExpr(*_OPS)
    out = SD.run_to_table(SD.palette_updates(ops), "palette", "update", SD.write_batch)
    rows = spark.read.parquet(out)
    return rows.groupBy("doc_id", "region_id").agg(
        F.max_by("c.r", "seq").alias("r"), F.max("seq").alias("seq")
    )


@query(
    "stream_coverage",
    "select user_id as doc_id, event_id % 13 as region_id, sum(case when event_type = 'error' then -5 else event_id % 9 end)::bigint as covered from events group by 1, 2",
)
def stream_coverage(spark, sf):
    changes = raw_stream(spark, sf).selectExpr(
        "user_id as doc_id", "event_id % 13 as region_id", "event_id div 64 as tile",
        "case when event_type = 'error' then -5 else event_id % 9 end as delta",
    )
    out = SD.run_to_table(SD.coverage_deltas(changes), "coverage", "update", SD.write_batch)
    rows = spark.read.parquet(out)
    return rows.groupBy("doc_id", "region_id").agg(F.max_by("covered", "batch").alias("covered"))


@query("stream_dabs")
def stream_dabs(spark, sf):
    """Every user draws one stroke that begins and ends inside the input."""
    SS.use_state_store(spark)
    first_last = V.events(spark, sf).groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    events = (
        V.as_samples(V.events(spark, sf).join(first_last, "user_id"), "lo", "hi")
        .withColumn("kind", F.when(F.col("seq") == F.col("lo"), "begin").when(F.col("seq") == F.col("hi"), "end").otherwise("append"))
        .withColumn("predicted", F.col("predicted") & (F.col("kind") == "append"))
        .selectExpr(
            "stroke_id", "seq", "kind", "x", "y", "t", "cast(pressure as double) as pressure", "cast(radius as double) as radius",
            "predicted", "brush", "cast(size as double) as size", "seed",
        )
    )
    folder = f"{scratch_dir(spark)}/stroke-events-{uuid.uuid4().hex}"
    events.write.mode("overwrite").parquet(folder)
    # The result has three places, so the sink need not hold more.
    dabs = SS.thousandths(SS.stream_dabs(SD.read_files(spark, folder, events.schema), idle_ms=None).drop("angle"))
    out = SD.run_to_table(dabs, "dabs", by_batch=SS.compact_batch)
    return SS.of_thousandths(SS.committed(spark.read.parquet(out))).select("stroke_id", "dab_no", "x", "y", "size", "alpha")


@query(
    "predicted_overlay",
    """select stroke_id, hi % 3 = 0 as open, hi % 3 <> 0 as committed, true as newest_only from
    (select user_id as stroke_id, max(event_id) as hi, count(*) as n from events group by user_id) where n > 1""",
)
def predicted_overlay(spark, sf):
    """Strokes of which a third is still open at the end: ended ones are committed, the overlay has the last guess of open ones."""
    SS.use_state_store(spark)
    ends = V.events(spark, sf).groupBy("user_id").agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).where("lo < hi")
    rows = V.as_samples(V.events(spark, sf).join(ends, "user_id"), "lo", "hi")
    last = (F.col("seq") == F.col("hi")) & (F.col("hi") % 3 != 0)
    events = rows.withColumn("kind", F.when(F.col("seq") == F.col("lo"), "begin").when(last, "end").otherwise("append")).selectExpr(
        "stroke_id", "seq", "kind", "x", "y", "t", "cast(pressure as double) as pressure", "cast(radius as double) as radius",
        "(predicted or seq % 4 = 3) and kind = 'append' as predicted", "brush", "cast(size as double) as size", "seed",
    )
    base = f"{scratch_dir(spark)}/overlay-{uuid.uuid4().hex}"
    events = materialize(events, "overlay-events")  # joined once for its three parts
    n = events.agg(F.max("seq")).first()[0]
    for part in range(3):
        events.where(F.expr(f"seq * 3 div ({n} + 1) = {part}")).coalesce(1).write.mode("append").parquet(f"{base}/events")
    sinks, version = SS.run_to_sinks(SD.read_files(spark, f"{base}/events", events.schema, per_batch=1), f"{base}/out", compact=True)
    done = sinks.committed(spark).groupBy("stroke_id").agg(F.lit(True).alias("committed"))
    # A guess is newer than the stroke's real samples if it was made in the last batch the stroke was seen in.
    over = sinks.overlay(spark, version).groupBy("stroke_id").agg(F.count_distinct("epoch").alias("epochs"), F.count(F.lit(1)).alias("guesses"))
    strokes = ends.select(F.col("user_id").alias("stroke_id"), (F.col("hi") % 3 == 0).alias("open"))
    both = strokes.join(done, "stroke_id", "left").join(over, "stroke_id", "left")
    fine = F.col("guesses").isNull() | (F.col("open") & (F.col("epochs") == 1))
    return both.select("stroke_id", "open", F.coalesce("committed", F.lit(False)).alias("committed"), fine.alias("newest_only"))


# --- replays by event time -------------------------------------------------------------------

PARTS = 4
#: Milliseconds between two events of the replays, and the time of the first: a stream takes the epoch itself for late.
STEP_MS, START_MS = 20, 1_000_000


def replay(spark, events, processor, keys, label):
    """Streams ``events`` (with ``seq``) from files, a batch each, in which rows come again and out of order.

    The files are written one after the other: a part of the log, the second half of the part before once more, and of
    the next part every fifth row early. The last file moves the time on, so that all that waits is due.
    """
    n = events.agg(F.max("seq")).first()[0] or 0
    size = n // PARTS + 1
    at = F.timestamp_millis(F.col("seq") * STEP_MS + START_MS)
    rows = events.withColumn("at", at).withColumn("part", F.expr(f"cast(seq div {size} as int)"))
    folder = f"{scratch_dir(spark)}/replay-{uuid.uuid4().hex}"
    for part in range(PARTS):
        early = (F.col("part") == part + 1) & (F.col("seq") % 5 == 0)
        again = (F.col("part") == part - 1) & (F.col("seq") % size >= size // 2)
        mine = rows.where((F.col("part") == part) | early | again).drop("part")
        mine.coalesce(1).write.mode("append").parquet(folder)
    ends = {**dict.fromkeys(keys, F.lit(-1)), "seq": F.lit(n + 10_000_000)}
    last = rows.where(F.col("seq") == n).drop("part").withColumns({k: v.cast("long") for k, v in ends.items()}).withColumn("at", at)
    last.coalesce(1).write.mode("append").parquet(folder)
    SS.use_state_store(spark)
    stream = SD.read_files(spark, folder, rows.drop("part").schema, per_batch=1)
    out = SD.run_to_table(SL.by_event_time(stream, keys, processor, f"{3 * size * STEP_MS} milliseconds"), label, by_batch=SL.upsert_batch)
    return spark.read.parquet(out).where(F.col(keys[0]) >= 0)


@query(
    "stream_state_changes",
    """select doc_id, seq, r as color, colored from (select *, lag(r) over w as pr, lag(colored) over w as pc, row_number() over w as n from
    (select doc_id, seq, r, sum(first) over (partition by doc_id order by seq)::bigint as colored from
    (select *, (row_number() over (partition by doc_id, region_id order by seq) = 1)::int as first from ops))
    window w as (partition by doc_id order by seq)) where n = 1 or pr <> r or pc <> colored""",
)
def stream_state_changes(spark, sf):
    """On-change state of every document, from batches that repeat rows and bring some early."""
    ops = V.ops(spark, sf).selectExpr("doc_id", "seq", "cast(region_id as long) as region_id", "cast(r as long) as color")
    return SL.versions(replay(spark, ops, SL.StateChanges(), ["doc_id"], "changes")).select("doc_id", "seq", "color", "colored")


view(
    "hint_log",
    """select user_id as doc_id, event_id as seq, case when event_type = 'error' then 'undo' else 'fill' end as kind, event_id % 3 as region_id,
    row_number() over (partition by user_id order by event_id) as n, lead(event_id) over (partition by user_id order by event_id) as following from events""",
)
view(
    "hint_walk",
    """select doc_id, n, seq, following, case when kind = 'fill' then [region_id] else [] end as live from hint_log where n = 1
    union all select l.doc_id, l.n, l.seq, l.following, case when l.kind = 'fill' then list_append(w.live, l.region_id) else w.live[:len(w.live) - 1] end
    from hint_walk w join hint_log l on l.doc_id = w.doc_id and l.n = w.n + 1""",
)


@query(
    "stream_idle_hints",
    f"""select doc_id, seq, seq * {STEP_MS} + {START_MS} + 3000 as hint_ms from hint_walk where len(list_distinct(live)) = 3
    and (following is null or (following - seq) * {STEP_MS} > 3000)""",
)
def stream_idle_hints(spark, sf):
    """Three regions a document, errors are undos: hints three seconds after the last operation on a coloured document."""
    events = V.events(spark, sf).selectExpr(
        "user_id as doc_id", "event_id as seq", "case when event_type = 'error' then 'undo' else 'fill' end as kind",
        "event_id % 3 as region_id", "3L as total",
    )
    return replay(spark, events, SL.IdleHints(), ["doc_id"], "hints").select("doc_id", "seq", "hint_ms")


_DELTA = "case when event_type = 'error' then -5 else event_id % 9 - 2 end"


@query(
    "stream_progress",
    f"""select doc_id, region_id, flush_ms, sum(net) over (partition by doc_id, region_id order by flush_ms)::bigint as covered, dirty_tiles from
    (select doc_id, region_id, flush_ms, sum(net) as net, count(*) filter (net <> 0) as dirty_tiles from
    (select user_id % 7 as doc_id, user_id % 3 as region_id, event_id % 4 as tile, ((event_id * {STEP_MS} + {START_MS}) // 500 + 1) * 500 as flush_ms, sum({_DELTA}) as net
    from events group by all) group by all) qualify true""".replace(" qualify true", " where dirty_tiles > 0"),
)
def stream_progress(spark, sf):
    """Coverage by region, told at most once in 500 ms; negative changes take it back."""
    changes = V.events(spark, sf).selectExpr(
        "user_id % 7 as doc_id", "user_id % 3 as region_id", "event_id as seq", "event_id % 4 as tile", f"cast({_DELTA} as long) as delta"
    )
    out = replay(spark, changes, SL.Progress(), ["doc_id", "region_id"], "progress")
    return out.select("doc_id", "region_id", "flush_ms", "covered", "dirty_tiles")
