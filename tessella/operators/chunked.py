"""Ordered and grouped statistics that do not gather a hot key in one task.

A plain window over ``keys`` pulls every row of a key into one task.  Here each key is cut
into chunks by a column that is monotone in the order and holds a bounded number of rows
(a block of 65,536 consecutive sequence numbers, a row of pixels, a tile).  The heavy work
happens per ``(keys, chunk)``; only one summary row per chunk is windowed over the whole key,
and the carry is joined back on ``(keys, chunk)``, the partitioning the rows already have.

``(keys, chunk)`` is one struct column, ``_spot``: structs are equal where their fields are, NULL fields
included, so rows with a NULL key or a NULL order form groups like any other and none is lost.

The summaries grow with the rows, so they are merged and never broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SEQ_BLOCK = 65_536

COMBINE = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum, "bool_or": F.bool_or}
PARTIAL = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "bool_or": F.bool_or}


def seq_block(seq: str | Column, rows: int = SEQ_BLOCK) -> Column:
    """Chunk of an integer sequence: unique numbers give at most ``rows`` rows per chunk."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(rows)).cast("long")


def _spots(df: DataFrame, keys: Sequence[str], chunk: Column) -> DataFrame:
    return df.withColumn("_spot", F.struct(*[F.col(k).alias(k) for k in keys], chunk.alias("_chunk")))


def _whole(keys: Sequence[str]):
    """Window over the summary rows of a whole key."""
    return W.partitionBy(*[F.col("_spot")[k] for k in keys])


def attach_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    aggs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Add whole-key aggregates to every row; ``aggs`` maps name to (kind, expression)."""
    rows = _spots(df, keys, chunk)
    parts = rows.groupBy("_spot").agg(
        *[PARTIAL[kind](expr).alias(f"_p_{name}") for name, (kind, expr) in aggs.items()]
    )
    totals = parts.select(
        "_spot", *[COMBINE[kind](f"_p_{name}").over(_whole(keys)).alias(name) for name, (kind, _) in aggs.items()]
    )
    return rows.join(totals.hint("merge"), "_spot").drop("_spot")


def row_numbers(
    df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """Zero-based position inside the key, in ``order`` (``chunk`` must be monotone in it)."""
    rows = _spots(df, keys, chunk)
    parts = rows.groupBy("_spot").agg(F.count(F.lit(1)).alias("_n"))
    before = _whole(keys).orderBy("_spot._chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = parts.select("_spot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_rn", F.row_number().over(W.partitionBy("_spot").orderBy(*order)))
    return (
        numbered.join(carry.hint("merge"), "_spot")
        .withColumn(name, (F.col("_base") + F.col("_rn") - 1).cast("long"))
        .drop("_spot", "_base", "_rn")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    specs: Mapping[str, tuple[str, Column]],
) -> DataFrame:
    """Running ``sum``/``min``/``max`` inside the key, current row included."""
    rows = _spots(df, keys, chunk)
    inside = W.partitionBy("_spot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = _whole(keys).orderBy("_spot._chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_spot").agg(
        *[PARTIAL[kind](expr).alias(f"_p_{name}") for name, (kind, expr) in specs.items()]
    )
    carry = parts.select(
        "_spot", *[COMBINE[kind](f"_p_{n}").over(before).alias(f"_c_{n}") for n, (kind, _) in specs.items()]
    )
    local = rows.select(
        "*", *[PARTIAL[kind](expr).over(inside).alias(f"_l_{n}") for n, (kind, expr) in specs.items()]
    )
    out = local.join(carry.hint("merge"), "_spot")
    for n, (kind, _) in specs.items():
        a, b = F.col(f"_c_{n}"), F.col(f"_l_{n}")
        if kind in ("sum", "count"):
            total = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        else:
            total = (F.least if kind == "min" else F.greatest)(a, b)
        out = out.withColumn(n, total)
    return out.drop("_spot", *[f"_{p}_{n}" for n in specs for p in "cl"])


def previous(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order_by: str,
    cols: Mapping[str, str],
) -> DataFrame:
    """``lag(1)`` of columns inside the key; ``cols`` maps output name to source column.

    Rows whose order is NULL come first, in their own chunk.
    """
    packed = F.struct(F.lit(True).alias("_some"), *[F.col(src).alias(out) for out, src in cols.items()])
    rows = _spots(df, keys, chunk).withColumn("_row", packed)
    last = rows.groupBy("_spot").agg(F.max_by("_row", F.struct(order_by)).alias("_last"))
    carry = last.select("_spot", F.lag("_last").over(_whole(keys).orderBy("_spot._chunk")).alias("_carry"))
    local = rows.withColumn("_prev", F.lag("_row").over(W.partitionBy("_spot").orderBy(order_by)))
    out = local.join(carry.hint("merge"), "_spot").withColumn("_prev", F.coalesce("_prev", "_carry"))
    return out.select(
        *df.columns, *[F.col(f"_prev.{name}").alias(name) for name in cols]
    )


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lows: Mapping[str, str] | None = None,
    before: Mapping[str, str] | None = None,
    totals: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Several statistics of one order in one pass, from one summary row per chunk.

    ``number``: zero-based position; ``sums``: running sums; ``lows``: least value so far of one of these sums, by the
    sum's name; ``before``: columns of the row before (NULL for the first); ``totals``: whole-key aggregates, and
    for every sum and low its value at the end of the key as ``<name>_end``. The input is read twice at most.
    """
    sums, lows, before, totals = sums or {}, lows or {}, before or {}, totals or {}
    rows = _spots(df, keys, chunk)
    inside = W.partitionBy("_spot").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.coalesce(F.sum(e).over(upto), F.lit(0)).alias(f"_l_{n}") for n, e in sums.items()])
    local = local.select("*", *[F.min(f"_l_{of}").over(upto).alias(f"_m_{n}") for n, of in lows.items()])
    packed = F.struct(F.lit(True).alias("_some"), *[F.col(src).alias(out) for out, src in before.items()])
    parts = local.groupBy("_spot").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by(packed, F.struct(*order)).alias("_last"),
        *[F.coalesce(F.sum(e), F.lit(0)).alias(f"_s_{n}") for n, e in sums.items()],
        *[F.min(f"_l_{of}").alias(f"_d_{n}") for n, of in lows.items()],
        *[PARTIAL[kind](e).alias(f"_p_{n}") for n, (kind, e) in totals.items()],
    )
    earlier = _whole(keys).orderBy("_spot._chunk").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("*", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    reach = {n: F.col(f"_b_{of}") + F.col(f"_d_{n}") for n, of in lows.items()}
    carry = parts.select(
        "_spot",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.lag("_last").over(_whole(keys).orderBy("_spot._chunk")).alias("_carry"),
        *[F.col(f"_b_{n}") for n in sums],
        *[F.sum(f"_s_{n}").over(_whole(keys)).alias(f"{n}_end") for n in sums],
        *[F.min(e).over(earlier).alias(f"_c_{n}") for n, e in reach.items()],
        *[F.min(e).over(_whole(keys)).alias(f"{n}_end") for n, e in reach.items()],
        *[COMBINE[kind](f"_p_{n}").over(_whole(keys)).alias(n) for n, (kind, _) in totals.items()],
    )
    local = local.withColumn("_prev", F.lag(packed).over(inside)).withColumn("_rn", F.row_number().over(inside))
    prev = F.coalesce("_prev", "_carry")
    return local.join(carry.hint("merge"), "_spot").select(
        *df.columns,
        *([(F.col("_base") + F.col("_rn") - 1).cast("long").alias(number)] if number else []),
        *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums],
        *[F.least(F.col(f"_c_{n}"), F.col(f"_b_{of}") + F.col(f"_m_{n}")).alias(n) for n, of in lows.items()],
        *[prev[out].alias(out) for out in before],
        *[F.col(f"{n}_end") for n in [*sums, *lows]],
        *totals,
    )


def islands(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Numbers the stretches of rows with one value (NULL is one), from 1, in one pass."""
    rows = _spots(df, keys, chunk)
    inside = W.partitionBy("_spot").orderBy(*order)
    packed = F.struct(F.col(value).alias("v"))
    opened = rows.withColumn("_prev", F.lag(packed).over(inside)).withColumn(
        "_new", (F.col("_prev").isNotNull() & ~F.col("_prev.v").eqNullSafe(F.col(value))).cast("long")
    )
    parts = opened.groupBy("_spot").agg(
        F.sum("_new").alias("_news"), F.min_by(packed, F.struct(*order)).alias("_first"), F.max_by(packed, F.struct(*order)).alias("_last")
    )
    whole = _whole(keys).orderBy("_spot._chunk")
    begins = parts.select("*", (~F.lag("_last").over(whole).eqNullSafe(F.col("_first"))).cast("long").alias("_begin"))
    earlier = whole.rowsBetween(W.unboundedPreceding, -1)
    carry = begins.select("_spot", (F.coalesce(F.sum(F.col("_news") + F.col("_begin")).over(earlier), F.lit(0)) + F.col("_begin")).alias("_base"))
    counted = opened.withColumn("_count", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return counted.join(carry.hint("merge"), "_spot").select(*df.columns, (F.col("_base") + F.col("_count")).alias(name))


def spread_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], chunk: Column, how: str = "left"
) -> DataFrame:
    """Join a per-key table to rows of which one key may hold a large share.

    The table is first given one copy per (key, chunk) that occurs, so that the rows of a hot
    key meet it in as many tasks as the key has chunks.  A NULL key meets nothing, as in any join;
    a NULL chunk is a chunk, as its hash is not NULL.
    """
    keys = list(keys)
    salted = rows.withColumn("_chunk", F.xxhash64(chunk))
    spots = salted.select(*keys, "_chunk").distinct().join(table.hint("merge"), keys)
    return salted.join(spots.hint("merge"), [*keys, "_chunk"], how).drop("_chunk")


def fan_out(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Hash partitioning that adaptive execution does not merge.

    Rows ahead of a Python stage are small in bytes and heavy in work: merged by size, they
    would end up in a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
