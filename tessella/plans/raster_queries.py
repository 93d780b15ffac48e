"""Regions, labels, runs and composites over the derived rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import color as C
from tessella.operators import labels as L
from tessella.operators import painting as P
from tessella.operators import regions as R
from tessella.operators import runs as U
from tessella.operators.components import components
from tessella.plans import raster_views  # noqa: F401
from tessella.plans import views as V
from tessella.plans.registry import query, view

ID = ["image_id", "x", "y"]


def flat(df, *keep):
    """Boxes and centroids as plain columns."""
    out = [*keep, "area"]
    box = [F.col(f"bbox.{c}").alias(f"b{c}") for c in "xywh"]
    return df.select(*out, *box, F.col("centroid.x").alias("cx"), F.col("centroid.y").alias("cy"))


_STATS = """count(*) as area, min(x) as bx, min(y) as by, max(x) - min(x) + 1 as bw, max(y) - min(y) + 1 as bh,
    sum(x)::bigint // count(*) as cx, sum(y)::bigint // count(*) as cy"""


def line_px(spark, sf):
    return V.px(spark, sf).select(*ID, C.is_line("a").alias("line"))


def grown_px(spark, sf):
    seeds = R.read_seeds(V.seed_px(spark, sf), V.TILE)
    return seeds, R.grow(seeds, line_px(spark, sf), V.TILE)


@query("line_ratio", "select image_id, round(avg((a >= 128)::int), 6) as line_ratio from px group by image_id")
def line_ratio(spark, sf):
    return R.line_ratio(V.px(spark, sf), C.is_line("a")).select("image_id", F.round("line_ratio", 6).alias("line_ratio"))


@query("region_stats", f"select image_id, label, {_STATS} from labels_px group by image_id, label")
def region_stats(spark, sf):
    return flat(R.region_stats(V.labels_px(spark, sf)), "image_id", "label")


@query(
    "region_first_pixel",
    "select image_id, label, count(*) as area, min(y * 4294967296 + x) as first_pixel from labels_px group by image_id, label",
)
def region_first_pixel(spark, sf):
    return R.region_stats(V.labels_px(spark, sf)).select("image_id", "label", "area", "first_pixel")


@query("mosaic_region_stats", f"select label, {_STATS} from holed_mosaic where label is not null group by label")
def mosaic_region_stats(spark, sf):
    """All rows in one image: partial aggregation keeps the hot key small."""
    return flat(R.region_stats(V.holed_mosaic(spark, sf)), "label")


@query(
    "region_palette",
    """select image_id, string_agg(hex, ',' order by area desc, id) as palette from
    (select image_id, hex, sum(area) as area, min(label) as id from
    (select image_id, label, count(*) as area, printf('#%02X%02X%02X', (label % 3 * 90)::int, (label % 4 * 60)::int, 0) as hex from labels_px group by all)
    group by all) group by image_id""",
)
def region_palette(spark, sf):
    stats = R.region_stats(V.labels_px(spark, sf)).select(
        "image_id", F.col("label").alias("id"), "area",
        C.hex_color(F.col("label") % 3 * 90, F.col("label") % 4 * 60, F.lit(0)).alias("suggested_color"),
    )
    return R.palette(stats).select("image_id", F.concat_ws(",", "palette").alias("palette"))


@query("free_components", "select image_id, x, y, component from free_parts")
def free_components(spark, sf):
    return components(V.px(spark, sf).where("a < 128"), F.lit(0), V.TILE).select(*ID, "component")


@query("seed_description", "select * from seeds")
def seed_description(spark, sf):
    return R.read_seeds(V.seed_px(spark, sf), V.TILE)


@query(
    "seed_on_line",
    "select s.image_id, s.seed_id from seeds s join px p on p.image_id = s.image_id and p.x = s.ax + 3 and p.y = s.ay where p.a >= 128",
)
def seed_on_line(spark, sf):
    """Seeds moved to the right, onto the grid lines."""
    seeds = R.read_seeds(V.seed_px(spark, sf), V.TILE).withColumn("ax", F.col("ax") + 3)
    return R.grow(seeds, line_px(spark, sf), V.TILE)["on_line"].select("image_id", "seed_id")


@query("grown_labels", "select image_id, x, y, line, component, label from grown")
def grown_labels(spark, sf):
    return grown_px(spark, sf)[1]["pixels"]


@query("seed_collisions", "select image_id, owner, seed_id from stand where seed_id > owner")
def seed_collisions(spark, sf):
    return grown_px(spark, sf)[1]["collisions"]


@query(
    "orphan_areas",
    """select image_id, component, count(*) as area, component % 4294967296 as x, component // 4294967296 as y, min(x) as bx, min(y) as by,
    max(x) - min(x) + 1 as bw, max(y) - min(y) + 1 as bh from grown where component is not null and label is null group by image_id, component""",
)
def orphan_areas(spark, sf):
    o = R.orphans(grown_px(spark, sf)[1]["pixels"])
    return o.select("image_id", "component", "area", "x", "y", *[F.col(f"bbox.{c}").alias(f"b{c}") for c in "xywh"])


@query(
    "orphan_order",
    """select image_id, component, row_number() over (partition by image_id order by area desc, component) as place from
    (select image_id, component, count(*) as area from grown where component is not null and label is null group by all)""",
)
def orphan_order(spark, sf):
    """Largest orphan first, then raster order."""
    from pyspark.sql import Window as W

    o = R.orphans(grown_px(spark, sf)[1]["pixels"])
    # One row per orphan: at most half the pixels of one image, and in practice a handful.
    order = W.partitionBy("image_id").orderBy(F.desc("area"), "y", "x")
    return o.select("image_id", "component", F.row_number().over(order).alias("place"))


@query(
    "merged_fragments",
    f"""select l.image_id, l.x, l.y, coalesce(l.label, s.label) as label from land l
    left join settle{raster_views.MERGE_ROUNDS - 1} s on s.image_id = l.image_id and s.f = l.f""",
)
def merged_fragments(spark, sf):
    """Fragments below 12 pixels join the nearest region."""
    merged, _ = R.merge_fragments(grown_px(spark, sf)[1]["pixels"], min_area=raster_views.MERGE_AREA, tile=V.TILE)
    return merged.select(*ID, "label")


@query("closed_labels", "select image_id, x, y, closed, wave from holed_closed")
def closed_labels(spark, sf):
    return L.close_labels(V.holed_px(spark, sf)).select(*ID, "closed", "wave")


@query("closed_mosaic", "select x, y, closed, wave from wide_closed")
def closed_mosaic(spark, sf):
    """One image that holds every row: each window is still one row or column of it."""
    return L.close_labels(V.holed_mosaic(spark, sf)).select("x", "y", "closed", "wave")


@query(
    "close_rounds",
    "select image_id, coalesce(max(wave), 0) as rounds, count(*) filter (closed is null) as unassigned from holed_closed group by image_id",
)
def close_rounds(spark, sf):
    return L.close_summary(L.close_labels(V.holed_px(spark, sf)))


@query(
    "box_downsample",
    """select image_id, x // 2 as x, y // 2 as y, (sum(r)::bigint + 2) // 4 as r, (sum(g)::bigint + 2) // 4 as g,
    (sum(b)::bigint + 2) // 4 as b, (sum(a)::bigint + 2) // 4 as a from px group by image_id, x // 2, y // 2""",
)
def box_downsample(spark, sf):
    return L.box_downsample(V.with_size(V.px(spark, sf)), ["r", "g", "b", "a"], 2)


@query(
    "box_downsample_odd",
    """select image_id, x // 3 as x, y // 3 as y, (sum(a)::bigint + 4) // 9 as a from px where x < 15 and y < 15 group by image_id, x // 3, y // 3""",
)
def box_downsample_odd(spark, sf):
    """A factor that does not divide the side: the edge remainder is dropped."""
    return L.box_downsample(V.with_size(V.px(spark, sf)), ["a"], 3)


@query(
    "majority_ids",
    """select image_id, x, y, min({'o': -n, 'a': area, 'l': label}).l as label from
    (select l.image_id, x // 2 as x, y // 2 as y, l.label, count(*) as n, any_value(m.area) as area from labels_px l
    join (select image_id, label, count(*) as area from labels_px group by all) m on m.image_id = l.image_id and m.label = l.label group by all) group by image_id, x, y""",
)
def majority_ids(spark, sf):
    return L.majority(V.with_size(L.with_area(V.labels_px(spark, sf), V.TILE))).select(*ID, "label")


@query("dilated_ids", "select image_id, x, y, label from dil2")
def dilated_ids(spark, sf):
    """Grow, close, halve, then move ownership below the line."""
    return _output_ids(spark, sf).select(*ID, "label")


def _output_ids(spark, sf):
    grown = grown_px(spark, sf)[1]["pixels"]
    closed = L.close_labels(grown).select(*ID, F.col("closed").alias("label")).where("label is not null")
    half = L.majority(V.with_size(L.with_area(closed, V.TILE)))
    alpha = L.box_downsample(V.with_size(V.px(spark, sf)), ["a"], 2).withColumnRenamed("a", "alpha")
    return L.dilate_under_line(half.join(alpha.hint("merge"), ID), V.TILE)


@query("output_region_stats", "select * from out_stats")
def output_region_stats(spark, sf):
    return flat(R.region_stats(_output_ids(spark, sf)), "image_id", "label")


@query(
    "region_pieces",
    "select image_id, cls as label, count(distinct component) as pieces from out_parts group by image_id, cls",
)
def region_pieces(spark, sf):
    return R.pieces_per_region(_output_ids(spark, sf), V.TILE)


@query(
    "full_cover",
    "select image_id, count(*) filter (area > 0) as regions, sum(area)::bigint as covered, sum(area) = 256 as full_cover from "
    "(select image_id, label, count(*) as area from labels_px group by all) group by image_id",
)
def full_cover(spark, sf):
    stats = R.region_stats(V.labels_px(spark, sf))
    return stats.groupBy("image_id").agg(
        F.count_if(F.col("area") > 0).alias("regions"),
        F.sum("area").alias("covered"),
        (F.sum("area") == V.SIDE * V.SIDE).alias("full_cover"),
    )


view(
    "adjacent",
    """select distinct image_id, least(l, p) as a, greatest(l, p) as b from (
    select image_id, label as l, lag(label) over w as p, x - lag(x) over w as gap from holed_px where label is not null window w as (partition by image_id, y order by x)
    union all select image_id, label, lag(label) over w, y - lag(y) over w from holed_px where label is not null window w as (partition by image_id, x order by y))
    where l <> p and gap <= 64""",
)


@query("region_adjacency", "select * from adjacent")
def region_adjacency(spark, sf):
    return L.region_adjacency(V.holed_px(spark, sf))


view("candidate", "select * from (values " + ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(L.preview_candidates())) + ") v(k, r, g, b)")
view("tint_regions", "select distinct image_id, label from holed_px where label is not null")
# Ids run from 0 to 15, so the colouring by id is fifteen steps after the first.
for _n in range(16):
    _before = f"tint{_n - 1}" if _n else "(select 0 as image_id, 0 as label, 0 as color where false)"
    view(
        f"tint{_n}",
        f"""select * from {_before} union all select image_id, {_n}, k from (select r.image_id, c.k, min(t.d) as far from
        (select image_id from tint_regions where label = {_n}) r cross join candidate c left join
        (select a.image_id, c.k, (c.r - q.r) * (c.r - q.r) + (c.g - q.g) * (c.g - q.g) + (c.b - q.b) * (c.b - q.b) as d
        from adjacent a join {_before} p on p.image_id = a.image_id and p.label = a.a join candidate q on q.k = p.color cross join candidate c where a.b = {_n}) t
        on t.image_id = r.image_id and t.k = c.k group by r.image_id, c.k)
        qualify row_number() over (partition by image_id order by far desc nulls first, k) = 1""",
    )


@query("contrast_colors", "select t.image_id, t.label, t.color, c.r, c.g, c.b from tint15 t join candidate c on c.k = t.color")
def contrast_colors(spark, sf):
    """Greedy colouring of the region graph, by id."""
    px = V.holed_px(spark, sf)
    regions = px.where("label is not null").select("image_id", "label").distinct()
    return L.contrast_colors(regions, L.region_adjacency(px))


@query(
    "preview_classes",
    "select image_id, case when line then 'line' when label is null then 'unclaimed' else 'region' end as kind, count(*) as pixels from grown group by 1, 2",
)
def preview_classes(spark, sf):
    grown = grown_px(spark, sf)[1]["pixels"]
    return grown.groupBy("image_id", L.preview_class().alias("kind")).agg(F.count(F.lit(1)).alias("pixels"))


# --- runs and bytes -------------------------------------------------------------------------


_RUNS_SQL = """select {key}, row_number() over ({part} order by start, part) - 1 as run_no,
    least(total - part * 65535, 65535)::int as len, label as id from (select {key}, start, total, label, unnest(range(0, (total - 1) // 65535 + 1)) as part from
    (select {key}, min(i) as start, count(*) as total, any_value(label) as label from
    (select {key}, i, label, i - row_number() over (partition by {key}, label order by i) as island from ({src})) group by {key}, label, island))"""


@query(
    "run_length_encode",
    _RUNS_SQL.format(key="image_id", part="partition by image_id", src="select image_id, y * 16 + x as i, label from labels_px"),
)
def run_length_encode(spark, sf):
    return U.encode_runs(V.labels_px(spark, sf))


_ONE = "select image_id, y * 256 + x as i, case when a = 64 then 1 else 0 end * (x // 250) as label from mosaic"


@query("long_runs", _RUNS_SQL.format(key="image_id", part="partition by image_id", src=_ONE))
def long_runs(spark, sf):
    """One image whose runs cross many rows."""
    px = V.mosaic(spark, sf).selectExpr("image_id", "x", "y", "cast(case when a = 64 then 1 else 0 end * (x div 250) as bigint) as label")
    return U.encode_runs(px)


@query("run_length_decode", "select image_id, x, y, label from labels_px")
def run_length_decode(spark, sf):
    return U.decode_runs(U.encode_runs(V.labels_px(spark, sf)), V.images(spark, sf))


_BAD = "case when user_id % 11 = 0 and event_id % 40 = 7 then 0 else 1 + user_id % 3 end"


@query(
    "run_errors",
    f"""select image_id, case when zero is not null and (over is null or zero <= over) then 'zero-run' when over is not null then 'too-long'
    when total < pixels then 'too-short' end as error from (select image_id, min(case when len = 0 then run_no end) as zero,
    min(case when stop > pixels then run_no end) as over, sum(len) as total, any_value(pixels) as pixels from
    (select image_id, run_no, len, sum(len) over (partition by image_id order by run_no) as stop, 440 + image_id % 5 * 40 as pixels from
    (select event_id // 256 as image_id, event_id % 256 as run_no, {_BAD} as len from ev)) group by image_id)""",
)
def run_errors(spark, sf):
    runs = V.padded(spark, sf).selectExpr(
        "event_id div 256 as image_id", "event_id % 256 as run_no", f"cast({_BAD} as int) as len", "0L as id"
    )
    images = V.images(spark, sf).selectExpr("image_id", "440 + image_id % 5 * 40 as pixels")
    return U.run_errors(runs, images)


@query(
    "run_bytes_errors",
    """select event_id as image_id, case event_id % 4 when 0 then 'bad-magic' when 1 then 'ragged-body'
    when 2 then case when user_id % 3 = 0 then null when user_id % 3 = 1 then 'too-short' else 'too-long' end else 'zero-run' end as error from events""",
)
def run_bytes_errors(spark, sf):
    """Binary blobs with every kind of damage."""
    two = "case user_id % 3 when 0 then '03000000' when 1 then '04000000' else '02000000' end"
    hexed = (
        "case event_id % 4 when 0 then '434C523203000000' when 1 then '434C5231030000000100' "
        f"when 2 then concat('434C5231', {two}, '01000500', '02000600') else concat('434C5231', '03000000', '00000500', '03000600') end"
    )
    blobs = V.events(spark, sf).selectExpr("event_id as image_id", f"unhex({hexed}) as data")
    return U.parse_run_bytes(blobs)[1]


@query(
    "id_map_bytes",
    "select image_id, y as chunk_no, string_agg(printf('%02X%02X', (label % 256)::int, (label // 256)::int), '' order by x) as data from labels_px group by image_id, y",
)
def id_map_bytes(spark, sf):
    return U.label_bytes(V.labels_px(spark, sf)).select("image_id", "chunk_no", F.hex("data").alias("data"))


def _le(n: str, size: int) -> str:
    return " || ".join(f"printf('%02x', (({n}) // {256 ** i} % 256)::int)" for i in range(size))


@query(
    "content_hash",
    f"""select image_id, 'sha256:' || sha256(unhex('{len(b'regions.bin'):02x}000000' || '{b'regions.bin'.hex()}' || {_le('length(bytes) // 2', 8)} || bytes
    || '{len(b'label.bin'):02x}000000' || '{b'label.bin'.hex()}' || {_le('length(ids) // 2', 8)} || ids)) as content_hash from
    (select image_id, '434c5231' || {_le('256', 4)} || string_agg({_le('len', 2)} || {_le('id', 2)}, '' order by run_no) as bytes from
    ({_RUNS_SQL.format(key='image_id', part='partition by image_id', src='select image_id, y * 16 + x as i, label from labels_px')}) group by image_id)
    join (select image_id, string_agg(printf('%02x%02x', (label % 256)::int, (label // 256)::int), '' order by y, x) as ids from labels_px group by image_id) using (image_id)""",
)
def content_hash(spark, sf):
    labels = V.labels_px(spark, sf)
    images = V.images(spark, sf).selectExpr("image_id", "width * height as pixels")
    packed = U.run_bytes(U.encode_runs(labels), images, block=8)
    entries = packed.select("image_id", F.lit(0).alias("entry"), F.lit("regions.bin").alias("name"), "chunk_no", "data").unionByName(
        U.label_bytes(labels).select("image_id", F.lit(1).alias("entry"), F.lit("label.bin").alias("name"), "chunk_no", "data")
    )
    return U.content_hash(entries)


# --- composites -----------------------------------------------------------------------------


@query(
    "reference_composite",
    """select p.image_id, p.x, p.y, (l.label % 3 * 90)::int * sr // 255 * ((p.r * p.a + 255 * (255 - p.a) + 127) // 255) // 255 as r,
    (l.label % 4 * 60)::int * sg // 255 * ((p.g * p.a + 255 * (255 - p.a) + 127) // 255) // 255 as g,
    200 * sb // 255 * ((p.b * p.a + 255 * (255 - p.a) + 127) // 255) // 255 as b from px p join labels_px l using (image_id, x, y)
    join (select image_id, x, y, (r * a + 255 * (255 - a) + 127) // 255 as sr, (g * a + 255 * (255 - a) + 127) // 255 as sg, (b * a + 255 * (255 - a) + 127) // 255 as sb from seed_px) s using (image_id, x, y)""",
)
def reference_composite(spark, sf):
    return _composite(spark, sf)


def _composite(spark, sf):
    labels = V.labels_px(spark, sf)
    colors = labels.select("image_id", "label").distinct().selectExpr(
        "image_id", "label", "cast(label % 3 * 90 as int) as r", "cast(label % 4 * 60 as int) as g", "200 as b"
    )
    line = P.layers_over_white(V.px(spark, sf))
    shade = P.layers_over_white(V.seed_px(spark, sf))
    return P.reference_composite(labels, colors, line, shade, V.TILE)


@query(
    "thumbnail",
    """select image_id, x // 2 as x, y // 2 as y, (sum(c)::bigint + 2) // 4 as c from
    (select image_id, x, y, 255 * ((r * a + 255 * (255 - a) + 127) // 255) // 255 as c from px) group by image_id, x // 2, y // 2""",
)
def thumbnail(spark, sf):
    """Images declared 1024 wide give a factor of two."""
    line = P.layers_over_white(V.px(spark, sf)).select(*ID, F.col("r").alias("r"), F.col("r").alias("g"), F.col("r").alias("b"))
    images = V.images(spark, sf).selectExpr("image_id", "1024 as width", "1024 as height")
    return P.thumbnail(line, images).select(*ID, F.col("r").alias("c"))


@query(
    "image_summary",
    """select l.image_id, round(avg((a >= 128)::int), 6) as line_ratio, avg((a >= 128)::int) > 0.35 as line_warning, count(distinct label) as regions,
    min(n) as smallest, bool_or(n < 200) as tiny_warning from px p join labels_px l using (image_id, x, y)
    join (select image_id, label, count(*) as n from labels_px group by all) s using (image_id, label) group by l.image_id""",
)
def image_summary(spark, sf):
    """Line share, regions and warnings per image."""
    ratio = R.line_ratio(V.px(spark, sf), C.is_line("a"))
    regions = R.region_stats(V.labels_px(spark, sf)).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("regions"), F.min("area").alias("smallest"), F.bool_or(F.col("area") < 200).alias("tiny_warning")
    )
    return ratio.join(regions, "image_id").select(
        "image_id", F.round("line_ratio", 6).alias("line_ratio"), (F.col("line_ratio") > 0.35).alias("line_warning"),
        "regions", "smallest", "tiny_warning",
    )

