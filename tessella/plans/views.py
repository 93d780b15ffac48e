"""Rasters, logs and strokes derived from the given tables, in Spark and in SQL.

Every event becomes a pixel of a 16 x 16 image; the last image is filled up with blank pixels so
that no event is left out.  ``mosaic`` is the same data as one image 256 pixels wide: a single
key that holds all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.presets import BRUSHES
from tessella.plans.registry import view

SIDE = 16
TILE = 8  # four tiles per image, so that labels cross tile borders
MOSAIC_WIDTH = 256
MOSAIC_TILE = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


def padded(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    n = F.count(F.lit(1))
    missing = ev.agg(((F.lit(256) - n % 256) % 256).alias("m"), n.alias("n")).where("m > 0")
    blank = missing.select(F.explode(F.expr("sequence(n, n + m - 1)")).alias("event_id")).selectExpr(
        "event_id", "cast(0 as bigint) as user_id", "'view' as event_type", "cast(0 as double) as value"
    )
    return ev.unionByName(blank)


_ALPHA = (
    "case when ({x} % 5 = 4 or {y} % 5 = 4) and event_type <> 'signup' then 255 "
    "when event_type = 'error' then 64 else 0 end"
)


def px(spark: SparkSession, sf: str) -> DataFrame:
    """Line-art layer: a five-pixel grid with random gaps; alpha 64 is an anti-aliased fringe."""
    return padded(spark, sf).selectExpr(
        "event_id div 256 as image_id",
        "cast(event_id % 16 as int) as x",
        "cast((event_id div 16) % 16 as int) as y",
        "cast(user_id % 256 as int) as r",
        "cast(cast(floor(value * 100) as bigint) % 256 as int) as g",
        "cast(event_id % 251 as int) as b",
        _ALPHA.format(x="(event_id % 16)", y="((event_id div 16) % 16)") + " as a",
    )


def seed_px(spark: SparkSession, sf: str) -> DataFrame:
    """Seed layer: 2 x 2 dots of colour, some cells left without one."""
    return padded(spark, sf).selectExpr(
        "event_id div 256 as image_id",
        "cast(event_id % 16 as int) as x",
        "cast((event_id div 16) % 16 as int) as y",
        "cast(user_id % 4 * 60 as int) as r",
        "cast(user_id % 3 * 90 as int) as g",
        "0 as b",
        "case when (event_id % 16) % 5 in (1, 2) and ((event_id div 16) % 16) % 5 in (1, 2) and "
        "((event_id div 80) + (event_id % 16) div 5) % 4 <> 3 then 255 else 0 end as a",
    )


def mosaic(spark: SparkSession, sf: str) -> DataFrame:
    return padded(spark, sf).selectExpr(
        "cast(0 as bigint) as image_id",
        f"cast(event_id % {MOSAIC_WIDTH} as int) as x",
        f"cast(event_id div {MOSAIC_WIDTH} as int) as y",
        _ALPHA.format(x=f"(event_id % {MOSAIC_WIDTH})", y=f"(event_id div {MOSAIC_WIDTH})") + " as a",
    )


def labels_px(spark: SparkSession, sf: str) -> DataFrame:
    """A full label plane, 16 regions per image."""
    return px(spark, sf).selectExpr("image_id", "x", "y", "cast(x div 5 + 4 * (y div 5) as bigint) as label")


def holed_px(spark: SparkSession, sf: str) -> DataFrame:
    """The label plane before closing: lines are unassigned."""
    return px(spark, sf).selectExpr(
        "image_id", "x", "y", "case when a < 128 then cast(x div 5 + 4 * (y div 5) as bigint) end as label"
    )


def holed_mosaic(spark: SparkSession, sf: str) -> DataFrame:
    """One wide plane with few labels, so that the fill has to travel."""
    return mosaic(spark, sf).selectExpr(
        "image_id", "x", "y", "case when a = 64 then cast((x + y) % 13 as bigint) end as label"
    )


def with_size(df: DataFrame, width: int = SIDE, height: int = SIDE) -> DataFrame:
    return df.withColumn("width", F.lit(width)).withColumn("height", F.lit(height))


def images(spark: SparkSession, sf: str) -> DataFrame:
    return with_size(padded(spark, sf).selectExpr("event_id div 256 as image_id").distinct())


def ops(spark: SparkSession, sf: str) -> DataFrame:
    return (
        events(spark, sf)
        .where("event_type in ('click', 'view', 'purchase')")
        .selectExpr(
            "user_id as doc_id",
            "event_id as seq",
            "cast(event_id % 13 as int) as region_id",
            "cast(floor(value) as int) % 4 * 60 as r",
            "0 as g",
            "0 as b",
        )
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as pos",
        "cast(p_partkey as string) as asset_id",
        "p_name as title",
        "p_type as category",
        "p_size * 6 as region_count",
        "case when p_partkey % 3 = 0 then 'free' else 'paid' end as entitlement",
        "case p_partkey % 4 when 0 then 'notDownloaded' when 1 then 'downloading' "
        "when 2 then 'downloaded' else 'failed' end as download",
        "case when p_partkey % 4 = 0 or p_partkey % 5 = 0 then cast(null as string) "
        "when p_partkey % 5 < 3 then 'inProgress' else 'shared' end as work",
        "case when p_partkey % 4 = 0 or p_partkey % 5 = 0 then cast(null as bigint) "
        "else p_partkey * 7919 % 100003 end as last_edited",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """One stroke per user at about 120 Hz; even users are fingers, odd ones pens.

    The time stamp runs with the event number, so it needs no ordering over the table.
    """
    return as_samples(events(spark, sf))


def as_samples(events: DataFrame, *more: str) -> DataFrame:
    """The samples of events, with ``more`` columns of theirs; joins with events move less than joins with samples."""
    brush = "case user_id % 5 " + " ".join(f"when {i} then '{b}'" for i, b in enumerate(BRUSHES)) + " end"
    return events.selectExpr(
        "user_id as stroke_id",
        "event_id as seq",
        "cast(200 + user_id % 700 + (event_id div 120) % 160 + event_id % 7 as double) as x",
        "cast(200 + user_id * 31 % 700 + (event_id div 97) % 120 + event_id % 5 as double) as y",
        "cast(event_id as double) / 6000.0 as t",
        "case when user_id % 2 = 0 then 0.0 else value - floor(value) end as pressure",
        "case when user_id % 2 = 0 then 6.0 + cast(event_id % 40 as double) / 10 else 0.0 end as radius",
        "event_id % 17 = 0 as predicted",
        f"{brush} as brush",
        "24.0 as size",
        "user_id + 7 as seed",
        *more,
    )


# --- the same in SQL ------------------------------------------------------------------------

_SQL_ALPHA = _ALPHA.replace("div", "//")

view(
    "ev",
    "select event_id, user_id, event_type, value from events union all "
    "select unnest(range(n, n + (256 - n % 256) % 256)), 0, 'view', 0.0 from (select count(*) n from events)",
)
view(
    "px",
    f"""select event_id // 256 as image_id, cast(event_id % 16 as int) as x, cast((event_id // 16) % 16 as int) as y,
    cast(user_id % 256 as int) as r, cast(cast(floor(value * 100) as bigint) % 256 as int) as g,
    cast(event_id % 251 as int) as b, {_SQL_ALPHA.format(x='(event_id % 16)', y='((event_id // 16) % 16)')} as a from ev""",
)
view(
    "seed_px",
    """select event_id // 256 as image_id, cast(event_id % 16 as int) as x, cast((event_id // 16) % 16 as int) as y,
    cast(user_id % 4 * 60 as int) as r, cast(user_id % 3 * 90 as int) as g, 0 as b,
    case when (event_id % 16) % 5 in (1, 2) and ((event_id // 16) % 16) % 5 in (1, 2)
     and ((event_id // 80) + (event_id % 16) // 5) % 4 <> 3 then 255 else 0 end as a from ev""",
)
view(
    "mosaic",
    f"""select 0 as image_id, cast(event_id % 256 as int) as x, cast(event_id // 256 as int) as y,
    {_SQL_ALPHA.format(x='(event_id % 256)', y='(event_id // 256)')} as a from ev""",
)
view("labels_px", "select image_id, x, y, x // 5 + 4 * (y // 5) as label from px")
view("holed_px", "select image_id, x, y, case when a < 128 then x // 5 + 4 * (y // 5) end as label from px")
view("holed_mosaic", "select image_id, x, y, case when a = 64 then (x + y) % 13 end as label from mosaic")
view("images", "select distinct event_id // 256 as image_id, 16 as width, 16 as height from ev")
view(
    "ops",
    """select user_id as doc_id, event_id as seq, cast(event_id % 13 as int) as region_id,
    cast(floor(value) as int) % 4 * 60 as r, 0 as g, 0 as b from events
    where event_type in ('click', 'view', 'purchase')""",
)
view(
    "items",
    """select p_partkey as pos, cast(p_partkey as varchar) as asset_id, p_name as title, p_type as category,
    p_size * 6 as region_count, case when p_partkey % 3 = 0 then 'free' else 'paid' end as entitlement,
    case p_partkey % 4 when 0 then 'notDownloaded' when 1 then 'downloading' when 2 then 'downloaded' else 'failed' end as download,
    case when p_partkey % 4 = 0 or p_partkey % 5 = 0 then null when p_partkey % 5 < 3 then 'inProgress' else 'shared' end as work,
    case when p_partkey % 4 = 0 or p_partkey % 5 = 0 then null else p_partkey * 7919 % 100003 end as last_edited from part""",
)
view(
    "samples",
    """select user_id as stroke_id, event_id as seq,
    cast(200 + user_id % 700 + (event_id // 120) % 160 + event_id % 7 as double) as x,
    cast(200 + user_id * 31 % 700 + (event_id // 97) % 120 + event_id % 5 as double) as y,
    cast(event_id as double) / 6000.0 as t,
    case when user_id % 2 = 0 then 0.0 else value - floor(value) end as pressure,
    case when user_id % 2 = 0 then 6.0 + cast(event_id % 40 as double) / 10 else 0.0 end as radius,
    event_id % 17 = 0 as predicted,
    case user_id % 5 """
    + " ".join(f"when {i} then '{b}'" for i, b in enumerate(BRUSHES))
    + " end as brush, 24.0 as size, user_id + 7 as seed from events",
)
view("step4", "select * from (values (-1, 0), (1, 0), (0, -1), (0, 1)) v(dx, dy)")
