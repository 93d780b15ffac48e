"""Document state from operation logs: fills, progress, undo, keyframes, quotas, funnel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.color import idiv
from tessella.operators.chunked import (
    SEQ_BLOCK,
    attach_totals,
    ordered,
    previous,
    running,
    seq_block,
    spread_join,
)

# Fixed values.
COVERED_ALPHA = 0.5
COVERED_SHARE = 0.5
IDLE_SECONDS = 3.0
KEYFRAME_SECONDS = 30.0
UNDO_POOL_BYTES = 64 * 1024 * 1024
FUNNEL_HOUR = 3600
FUNNEL_STEPS = ("download", "open", "finish", "paywall", "trial", "convert")


# --- taps and fills -------------------------------------------------------------------------


def tap_regions(taps: DataFrame, labels: DataFrame) -> DataFrame:
    """Region under every tap; taps outside the canvas give nothing and are never clamped.

    ``taps`` holds ``image_id, x, y`` in canvas pixels. Labels are dense, so what is off the canvas meets no pixel.
    """
    # NaN counts as larger than any number, so the upper bound drops it too.
    inside = [F.col(c).cast("double").between(0, 2**31 - 1) for c in ("x", "y")]
    cells = taps.where(inside[0] & inside[1]).withColumn("px", F.floor("x").cast("int")).withColumn("py", F.floor("y").cast("int"))
    at = labels.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("label").alias("region_id"))
    return cells.join(at, ["image_id", "px", "py"])


def known_ops(ops: DataFrame, regions: DataFrame, on: Sequence[str] = ("doc_id", "region_id")) -> DataFrame:
    """Operations on regions that exist; an unknown region is ignored."""
    return ops.join(regions.select(*on).distinct(), list(on), "left_semi")


def fill_effects(ops: DataFrame) -> DataFrame:
    """Fills that change a colour, with the colour before (NULL when never filled).

    ``ops`` holds ``doc_id, seq, region_id, r, g, b``; a fill is always opaque, so the alpha of
    an operation plays no part.
    """
    rgb = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    rows = ops.select("doc_id", "seq", "region_id", rgb.cast("int").alias("color"))
    seen = previous(rows, ["doc_id", "region_id"], seq_block("seq"), "seq", {"prev_color": "color"})
    return seen.where(~F.col("prev_color").eqNullSafe(F.col("color")))


def effect_boxes(
    effects: DataFrame, regions: DataFrame, on: Sequence[str] = ("doc_id", "region_id")
) -> DataFrame:
    """Box of the region on every effect."""
    return spread_join(effects, regions.select(*on, "bbox"), on, seq_block("seq"), "inner")


def palette_state(ops: DataFrame) -> DataFrame:
    """Latest colour per document and region; a region never filled has no row."""
    return ops.groupBy("doc_id", "region_id").agg(
        F.max_by(F.struct("r", "g", "b"), "seq").alias("c"), F.max("seq").alias("seq")
    ).select("doc_id", "region_id", "c.r", "c.g", "c.b", "seq")


def progress(ops: DataFrame, totals: DataFrame) -> DataFrame:
    """Distinct regions filled over regions in all; ``totals`` holds ``doc_id, total``."""
    done = ops.groupBy("doc_id", "region_id").agg(F.lit(1).alias("one")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("colored")
    )
    return totals.join(done, "doc_id", "left").select(
        "doc_id", F.coalesce("colored", F.lit(0)).alias("colored"), "total"
    )


def progress_log(ops: DataFrame) -> DataFrame:
    """Coloured-region count after every operation that changed it."""
    first = ops.groupBy("doc_id", "region_id").agg(F.min("seq").alias("seq"))
    return running(first, ["doc_id"], seq_block("seq"), [F.col("seq")], {"colored": ("sum", F.lit(1))}).select(
        "doc_id", "seq", "colored"
    )


def on_change(states: DataFrame, keys: Sequence[str], seq: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row always counts."""
    packed = states.withColumn("_v", F.struct(F.col(value).alias("v")))
    seen = previous(packed, keys, seq_block(seq), seq, {"_before": "_v"})
    return seen.where(F.col("_before").isNull() | (F.col("_before") != F.col("_v"))).drop("_v", "_before")


# --- brush strokes per region, completion ---------------------------------------------------


def region_coverage(paint: DataFrame, labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of every region under paint with alpha above one half."""
    painted = (
        paint.where(F.col("a") > COVERED_ALPHA)
        .select("image_id", "x", "y")
        .join(labels, ["image_id", "x", "y"])
        .groupBy("image_id", "label")
        .agg(F.count(F.lit(1)).alias("covered"))
    )
    return regions.join(painted, ["image_id", "label"], "left").select(
        "image_id",
        "label",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (F.coalesce("covered", F.lit(0)) / F.col("area")).alias("share"),
    )


def completion(regions: DataFrame, fills: DataFrame, coverage: DataFrame, last: DataFrame) -> DataFrame:
    """Coloured regions per document and whether to suggest that the work is done.

    A region counts when it was filled or more than half of it is painted.  The hint needs all
    regions and more than three idle seconds; ``last`` holds ``doc_id, last_ts, now_ts``.
    """
    filled = fills.select("doc_id", "region_id").distinct().withColumn("filled", F.lit(True))
    state = (
        regions.select("doc_id", "region_id")
        .join(filled, ["doc_id", "region_id"], "left")
        .join(coverage.select("doc_id", "region_id", "share"), ["doc_id", "region_id"], "left")
        .withColumn(
            "done", F.coalesce("filled", F.lit(False)) | (F.coalesce("share", F.lit(0.0)) > COVERED_SHARE)
        )
    )
    counts = state.groupBy("doc_id").agg(
        F.count_if("done").alias("colored"), F.count(F.lit(1)).alias("total"), F.bool_and("done").alias("all_done")
    )
    return counts.join(last, "doc_id", "left").select(
        "doc_id",
        "colored",
        "total",
        (F.col("all_done") & F.coalesce(F.col("now_ts") - F.col("last_ts") > IDLE_SECONDS, F.lit(False))).alias("suggest"),
    )


def funnel(events: DataFrame, steps: Sequence[str] = FUNNEL_STEPS) -> DataFrame:
    """Users that reached every step in order; ``events`` holds ``user_id, step, ts`` (seconds).

    A step counts from the first time it happens at or after the step before it.  A user's events of one hour are folded
    to a vector that tells for every number of steps reached before it how many are reached after it; these
    vectors are applied in the order of the hours.  The events are read once.
    """
    number = F.array_position(F.array(*map(F.lit, steps)), F.col("step")).cast("int") - 1
    known = events.where(F.col("step").isin(*steps)).select(
        F.struct("user_id").alias("user"), F.floor(F.col("ts") / FUNNEL_HOUR).alias("hour"), F.struct("ts", number.alias("n")).alias("e")
    )
    start = F.array(*map(F.lit, range(len(steps) + 1)))
    fold = F.aggregate("events", start, lambda at, e: F.transform(at, lambda v: F.when(v == e["n"], v + 1).otherwise(v)))
    hours = known.groupBy("user", "hour").agg(F.array_sort(F.collect_set("e")).alias("events")).select("user", F.struct("hour", fold.alias("to")).alias("h"))
    reached = F.aggregate("hours", F.lit(0), lambda at, h: F.get(h["to"], at))
    users = hours.groupBy("user").agg(F.array_sort(F.collect_list("h")).alias("hours")).select(reached.alias("reached"))
    counts = users.agg(*[F.count_if(F.col("reached") > n).alias(f"_{n}") for n in range(len(steps))])
    rows = F.array(*[F.struct(F.lit(n).alias("step_no"), F.lit(step).alias("step"), F.col(f"_{n}").alias("users")) for n, step in enumerate(steps)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


# --- logs -----------------------------------------------------------------------------------


def effective_log(log: DataFrame) -> DataFrame:
    """Operations that survive undo: dead ones vanish, the next one overwrites the tail.

    ``log`` holds ``doc_id, seq, kind`` with kinds ``op``, ``undo`` and ``redo`` (a redo that had
    something to redo).  An undo on an empty log does nothing.  The log after every event has a
    length; an operation writes the slot at its length, and the last writer of a slot that is
    still inside the final length is what remains.
    """
    step = F.when(F.col("kind") == "undo", -1).otherwise(1)
    walked = ordered(log, ["doc_id"], seq_block("seq"), ["seq"], sums={"_sum": step}, lows={"_low": "_sum"})
    slot = F.col("_sum") - F.least("_low", F.lit(0))
    last = F.col("_sum_end") - F.least("_low_end", F.lit(0))
    written = walked.withColumn("slot", slot).where((F.col("kind") == "op") & (slot <= last))
    return written.groupBy("doc_id", "slot").agg(F.max("seq").alias("seq"))


def keyframes(ops: DataFrame, every_ops: int, every_seconds: float = KEYFRAME_SECONDS) -> DataFrame:
    """Operations after which a keyframe is due: every N operations or every 30 seconds.

    ``ops`` holds ``doc_id, seq, ts`` (seconds).  A time keyframe falls on the first operation of
    a new period since the start of the document.
    """
    seen = ordered(
        ops, ["doc_id"], seq_block("seq"), ["seq"], number="n", before={"_ts": "ts"}, totals={"_t0": ("min", F.col("ts"))}
    )
    period = lambda ts: F.floor((F.col(ts) - F.col("_t0")) / every_seconds)
    by_count = (F.col("n") + 1) % every_ops == 0
    by_time = F.coalesce(period("ts") > period("_ts"), F.lit(False))
    return seen.where(by_count | by_time).select(
        "doc_id", "seq", F.when(by_count, "ops").otherwise("time").alias("reason")
    )


def undo_pool(entries: DataFrame, limit: int = UNDO_POOL_BYTES, block: int = SEQ_BLOCK) -> DataFrame:
    """Undo entries that fit the pool, counted from the newest; the oldest go first.

    ``entries`` holds ``doc_id, seq, bytes``.
    """
    back = -F.col("seq")
    newest = running(
        entries, ["doc_id"], F.floor(back / block).cast("long"), [F.desc("seq")], {"_held": ("sum", F.col("bytes"))}
    )
    return newest.where(F.col("_held") <= limit).drop("_held")


def backup_quota(works: DataFrame, quota: int) -> DataFrame:
    """Marks works whose operation log is dropped to meet a user's quota, oldest shared first.

    ``works`` holds ``user_id, doc_id, last_edited, shared, log_bytes, other_bytes``.  Only logs
    of shared works are dropped, never documents.  A log goes while the total before it was
    dropped is above the quota; ``over`` tells what still exceeds it.
    """
    size = F.col("log_bytes") + F.col("other_bytes")
    own = F.when(F.col("shared"), F.col("log_bytes")).otherwise(F.lit(0))
    freed = ordered(
        works,
        ["user_id"],
        F.floor(F.col("last_edited") / SEQ_BLOCK).cast("long"),
        ["last_edited", "doc_id"],
        sums={"_freed": own},
        totals={"_all": ("sum", size)},
    )
    drop = F.col("shared") & (F.col("_all") - (F.col("_freed") - own) > quota)
    # Logs go until the rest fits, so something is over only if it is with all of them gone.
    return freed.select("user_id", "doc_id", drop.alias("drop_log"), (F.col("_all") - F.col("_freed_end") > quota).alias("over"))


# --- quantised strokes ----------------------------------------------------------------------


#: The most milliseconds in one row of the log.
MAX_DT = 255


def quantize_whole(samples: DataFrame, max_dt: int = MAX_DT) -> DataFrame:
    """One row per sample: what ``quantize`` gives, with ``parts`` log rows of which the last has ``last`` and all others ``dt`` milliseconds."""

    def fit(v: Column, lo: int, hi: int, to: str) -> Column:
        return F.least(F.greatest(F.round(v), F.lit(lo)), F.lit(hi)).cast(to)

    millis = samples.withColumn("_ms", F.round(F.col("t") * 1000).cast("long"))
    seen = previous(millis, ["stroke_id"], seq_block("seq"), "seq", {"_before": "_ms"})
    gap = F.greatest(F.coalesce(F.col("_ms") - F.col("_before"), F.lit(0)), F.lit(0))
    parts = F.greatest(idiv(gap + (max_dt - 1), max_dt), F.lit(1).cast("long"))
    wide = seen.withColumn("_gap", gap).withColumn("parts", parts)
    return wide.select(
        "stroke_id",
        "seq",
        "parts",
        fit(F.col("x"), -32768, 32767, "smallint").alias("qx"),
        fit(F.col("y"), -32768, 32767, "smallint").alias("qy"),
        F.least("_gap", F.lit(max_dt)).cast("smallint").alias("dt"),
        (F.col("_gap") - (F.col("parts") - 1) * max_dt).cast("smallint").alias("last"),
        fit(F.col("pressure") * 255, 0, 255, "smallint").alias("qp"),
        fit(F.col("radius"), 0, 255, "smallint").alias("qr"),
        fit(F.col("tilt_x"), -128, 127, "tinyint").alias("tx"),
        fit(F.col("tilt_y"), -128, 127, "tinyint").alias("ty"),
    )


def _parts(rows: DataFrame) -> DataFrame:
    """A row for every part of a sample."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts"))))


def quantize(samples: DataFrame, max_dt: int = MAX_DT) -> DataFrame:
    """16-bit positions, 8-bit time steps, pressure, radius and signed 8-bit tilt.

    ``samples`` holds ``stroke_id, seq, x, y, t, pressure, radius, tilt_x, tilt_y``.  A time step
    over ``max_dt`` milliseconds is carried by filler rows (``part`` below ``parts``).
    """
    dt = F.when(F.col("part") == F.col("parts"), F.col("last")).otherwise(F.col("dt"))
    return _parts(quantize_whole(samples, max_dt)).select(
        "stroke_id", "seq", "part", "parts", "qx", "qy", dt.alias("dt"), "qp", "qr", "tx", "ty"
    )


STEP_COLUMNS = ("qx", "qy", "dt", "qp", "qr", "tx", "ty")


def delta_encode(rows: DataFrame, cols: Sequence[str] = STEP_COLUMNS) -> DataFrame:
    """Differences to the row before in the stroke, filler rows included; the first row keeps its value."""
    placed = rows.withColumn("_at", F.struct("seq", "part"))
    seen = previous(placed, ["stroke_id"], seq_block("seq"), "_at", {f"_b_{c}": c for c in cols})
    return seen.select(
        "stroke_id", "seq", "part",
        *[(F.col(c).cast("int") - F.coalesce(F.col(f"_b_{c}").cast("int"), F.lit(0))).alias(f"d_{c}") for c in cols],
    )


def delta_decode(rows: DataFrame, cols: Sequence[str] = STEP_COLUMNS) -> DataFrame:
    summed = running(
        rows, ["stroke_id"], seq_block("seq"), [F.col("seq"), F.col("part")], {c: ("sum", F.col(f"d_{c}")) for c in cols}
    )
    return summed.select("stroke_id", "seq", "part", *[F.col(c).cast("int").alias(c) for c in cols])


def encode_whole(rows: DataFrame) -> DataFrame:
    """The log of ``quantize_whole`` with one row per sample, as filler rows repeat their sample but for the time step.

    The first log row of a sample has the steps ``d_*``, the last one besides ``d_last`` in time, those between have none.
    Long pauses are many log rows, so only these rows are shuffled, and ``log_rows`` makes the others at the end.
    """
    seen = previous(rows, ["stroke_id"], seq_block("seq"), "seq", {f"_b_{c}": "last" if c == "dt" else c for c in STEP_COLUMNS})
    return seen.select(
        "stroke_id", "seq", "parts",
        *[(F.col(c).cast("int") - F.coalesce(F.col(f"_b_{c}").cast("int"), F.lit(0))).alias(f"d_{c}") for c in STEP_COLUMNS],
        (F.col("last").cast("int") - F.col("dt").cast("int")).alias("d_last"),
    )


def log_rows(log: DataFrame) -> DataFrame:
    """All rows of the log, as ``delta_encode`` gives them."""
    first, last = F.col("part") == 1, F.when(F.col("part") == F.col("parts"), F.col("d_last")).otherwise(F.lit(0))
    step = {c: F.when(first, F.col(f"d_{c}")).otherwise(F.lit(0)) for c in STEP_COLUMNS}
    step["dt"] = step["dt"] + last
    return _parts(log).select("stroke_id", "seq", "part", *[v.alias(f"d_{c}") for c, v in step.items()])


def decode_whole(log: DataFrame) -> DataFrame:
    """One row per sample, as ``quantize_whole`` gives them, from ``encode_whole``."""
    steps = {c: F.col(f"d_{c}") + (F.col("d_last") if c == "dt" else F.lit(0)) for c in STEP_COLUMNS}
    sums = {c if c != "dt" else "last": ("sum", step) for c, step in steps.items()}
    summed = running(log, ["stroke_id"], seq_block("seq"), [F.col("seq")], sums)
    columns = {c: F.col(c) for c in sums} | {"dt": F.col("last") - F.col("d_last")}
    return summed.select("stroke_id", "seq", "parts", *[v.cast("int").alias(c) for c, v in columns.items()])


def decoded_rows(whole: DataFrame) -> DataFrame:
    """All log rows of decoded samples, as ``delta_decode`` gives them."""
    dt = F.when(F.col("part") == F.col("parts"), F.col("last")).otherwise(F.col("dt"))
    columns = [(dt if c == "dt" else F.col(c)).alias(c) for c in STEP_COLUMNS]
    return _parts(whole).select("stroke_id", "seq", "part", *columns)


def dequantize(rows: DataFrame) -> DataFrame:
    """Samples of decoded log rows: filler rows are folded into their sample, numbers get their units back.

    Gives ``stroke_id, seq, x, y, t, pressure, radius, tilt_x, tilt_y``. Positions, radius and tilt are off by half a unit at
    most where they fitted their range, pressure by 1/510; times are whole milliseconds from the first sample,
    off by one at most, where they did not go back.
    """
    return _with_units(
        rows.groupBy("stroke_id", "seq").agg(
            F.sum(F.col("dt").cast("long")).alias("_gap"),
            *[F.max_by(c, "part").alias(c) for c in ("qx", "qy", "qp", "qr", "tx", "ty")],
        )
    )


def dequantize_whole(whole: DataFrame) -> DataFrame:
    """The samples of ``decode_whole``, as ``dequantize`` gives them."""
    return _with_units(whole.withColumn("_gap", (F.col("parts") - 1) * F.col("dt") + F.col("last")))


def _with_units(whole: DataFrame) -> DataFrame:
    timed = running(whole, ["stroke_id"], seq_block("seq"), [F.col("seq")], {"_ms": ("sum", F.col("_gap"))})
    plain = {"x": "qx", "y": "qy", "radius": "qr", "tilt_x": "tx", "tilt_y": "ty"}
    return timed.select(
        "stroke_id",
        "seq",
        *[F.col(q).cast("double").alias(name) for name, q in plain.items()],
        (F.col("_ms") / 1000).alias("t"),
        (F.col("qp") / 255).alias("pressure"),
    )


# --- stroke sessions ------------------------------------------------------------------------


def session_strokes(events: DataFrame) -> DataFrame:
    """Committed samples of begin / append / end / cancel sequences per device.

    ``events`` holds ``device_id, seq, kind`` and sample columns.  A begin discards an open
    stroke, a sample without a begin is ignored, a cancelled or never ended stroke gives nothing.
    Adds ``stroke_no``; the begin event is the first sample.
    """
    opened = running(
        events, ["device_id"], seq_block("seq"), [F.col("seq")], {"stroke_no": ("sum", (F.col("kind") == "begin").cast("int"))}
    )
    closing = F.when(F.col("kind").isin("end", "cancel"), F.struct(F.col("seq").alias("at"), F.col("kind").alias("how")))
    known = attach_totals(
        opened.where("stroke_no > 0"), ["device_id", "stroke_no"], seq_block("seq"), {"_close": ("min", closing)}
    )
    return known.where(
        F.col("kind").isin("begin", "append") & (F.col("_close.how") == "end") & (F.col("seq") < F.col("_close.at"))
    ).drop("_close")
