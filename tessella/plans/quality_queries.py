"""Data-quality rules, reports and packs over the derived rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import findings as N
from tessella.operators import labels as L
from tessella.operators import quality as Q
from tessella.operators import regions as R
from tessella.operators import runs as U
from tessella.plans import raster_queries as RQ
from tessella.plans import views as V
from tessella.plans.bake import Bake, bake
from tessella.plans.params import BakeParams
from tessella.plans.registry import query, view
from tessella.sources import assets, packs, reports


def listed(found):
    return found.select("image_id", "code", "metric")


view("folders", "select distinct event_id // 256 as image_id from ev")
view(
    "layer_sizes",
    """select image_id, layer, case when layer = 'seeds' and image_id % 3 = 0 then 2048 else 3072 + (image_id % 2) * 1024 end as width,
    4096 as height, not (image_id % 4 = 0 and layer = 'lineart') and not (image_id % 6 = 0 and layer = 'shade') as is_srgb
    from folders, (values ('lineart'), ('seeds'), ('shade')) v(layer)
    where not (layer = 'lineart' and image_id % 5 = 0) and not (layer = 'seeds' and image_id % 7 = 0)""",
)


def folders(spark, sf):
    return V.images(spark, sf).select("image_id")


def layer_sizes(spark, sf):
    names = F.explode(F.array(*map(F.lit, Q.LAYER_ORDER)))
    return (
        folders(spark, sf)
        .select("image_id", names.alias("layer"))
        .where("not (layer = 'lineart' and image_id % 5 = 0) and not (layer = 'seeds' and image_id % 7 = 0)")
        .selectExpr(
            "image_id", "layer",
            "cast(case when layer = 'seeds' and image_id % 3 = 0 then 2048 else 3072 + (image_id % 2) * 1024 end as int) as width",
            "4096 as height",
            "not (image_id % 4 = 0 and layer = 'lineart') and not (image_id % 6 = 0 and layer = 'shade') as is_srgb",
            "'icc' as basis",
        )
    )


@query(
    "source_incomplete",
    """select image_id, 'source-incomplete' as code, string_agg(layer, ', ' order by layer) as metric from
    (select image_id, layer from folders, (values ('lineart'), ('seeds')) v(layer)) need where not exists
    (select 1 from layer_sizes h where h.image_id = need.image_id and h.layer = need.layer) group by image_id""",
)
def source_incomplete(spark, sf):
    return listed(Q.source_incomplete(folders(spark, sf), layer_sizes(spark, sf)))


view(
    "first_layer",
    "select image_id, arg_min(width, p) as w, arg_min(height, p) as h from (select *, list_position(['lineart', 'seeds', 'shade'], layer) as p from layer_sizes) group by image_id",
)


@query(
    "size_mismatch",
    """select image_id, 'size-mismatch' as code, string_agg(layer, ', ' order by list_position(['lineart', 'seeds', 'shade'], layer)) as metric
    from layer_sizes join first_layer using (image_id) where width <> w or height <> h group by image_id""",
)
def size_mismatch(spark, sf):
    return listed(Q.size_mismatch(layer_sizes(spark, sf)))


@query(
    "canvas_size",
    "select image_id, 'canvas-size' as code, w || 'x' || h as metric from first_layer where not (h = 4096 and w in (3072, 4096))",
)
def canvas_size(spark, sf):
    return listed(Q.canvas_size(layer_sizes(spark, sf)))


@query(
    "color_space",
    "select image_id, 'color-space' as code, layer || ' icc' as metric from layer_sizes where not is_srgb",
)
def color_space(spark, sf):
    return listed(Q.color_space(layer_sizes(spark, sf)))


_CAT = "case p_size % 5 when 0 then 'animal' when 1 then 'anime' else lower(p_type) end"


@query(
    "meta_rules",
    f"""select p_partkey as image_id, 'meta-id-mismatch' as code, p_name as metric from part where p_name <> replace(p_name, 'red', 'blue')
    union all select p_partkey, 'meta-bad-category', {_CAT} from part where {_CAT} not in ('anime', 'mandala', 'animal', 'botanical', 'scenery', 'cartoon')""",
)
def meta_rules(spark, sf):
    meta = V.table(spark, sf, "part").selectExpr(
        "p_partkey as image_id", "replace(p_name, 'red', 'blue') as folder_id", "p_name as id", f"{_CAT} as category"
    )
    return listed(Q.meta_rules(meta))


view("shares", "select image_id, avg((a >= 128)::int) as line_ratio from px group by image_id")


@query(
    "line_coverage",
    "select image_id, 'line-coverage' as code, printf('%.3f', line_ratio) as metric from shares where line_ratio > 0.3",
)
def line_coverage(spark, sf):
    return listed(Q.line_coverage(R.line_ratio(V.px(spark, sf), F.col("a") >= 128), 0.3))


@query(
    "shade_too_dark",
    """select image_id, count(*) as coord_total, min(luma) as darkest, min({'y': y, 'x': x}).x as x, min({'y': y, 'x': x}).y as y from
    (select image_id, x, y, round(0.2126::double * r + 0.7152::double * g + 0.0722::double * b)::int as luma from
    (select image_id, x, y, (r * a + 255 * (255 - a) + 127) // 255 as r, (g * a + 255 * (255 - a) + 127) // 255 as g, (b * a + 255 * (255 - a) + 127) // 255 as b from px))
    where luma < 60 group by image_id""",
)
def shade_too_dark(spark, sf):
    found = Q.shade_too_dark(V.px(spark, sf))
    low = found.groupBy("image_id").agg(F.min("low").cast("int").alias("darkest"))
    cells = N.clusters(found).select("image_id", F.col("count").alias("coord_total"), "x", "y")
    return cells.join(low, "image_id")


@query(
    "coordinate_clusters",
    """select image_id, count(*) as count, min({'y': y, 'x': x}).x as x, min({'y': y, 'x': x}).y as y from px where a = 64 group by image_id, x // 8, y // 8""",
)
def coordinate_clusters(spark, sf):
    """Stretched to 256 output pixels a side, an image has 2 x 2 cells of the 128-pixel grid."""
    found = N.finding(V.px(spark, sf).where("a = 64"), "tiny-region", F.col("x") * 8, F.col("y") * 8, (F.col("y"), F.col("x")))
    cells = N.clusters(found)
    return cells.select("image_id", "count", (F.col("x") / 16).cast("int").alias("x"), (F.col("y") / 16).cast("int").alias("y"))


@query(
    "top_clusters",
    """select image_id, x, y, count, rank from (select *, row_number() over (partition by image_id order by count desc, k) as rank from
    (select image_id, x % 5 as x, y as y, count(*) as count, min(y * 4294967296 + x) as k from px where a = 255 group by image_id, x % 5, y)) where rank <= 16""",
)
def top_clusters(spark, sf):
    """The sixteen largest of many clusters, ties by arrival."""
    found = N.finding(V.px(spark, sf).where("a = 255"), "seed-on-line", F.col("x") % 5, F.col("y"), (F.col("y"), F.col("x")))
    return N.top_clusters(N.clusters(found)).select("image_id", "x", "y", "count", "rank")


# --- the whole bake -------------------------------------------------------------------------

LOOSE = BakeParams(min_orphan_area=1)


_BAKED: dict[tuple, Bake] = {}


def baked(spark, sf):
    """Shared by the queries below: its tables are written once for a session and a state of the files it reads."""
    files = spark.read.parquet(f"{sf}/events.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count(F.lit(1)), F.sum("file_size"), F.max("file_modification_time")).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _BAKED:
        _BAKED.clear()
        _BAKED[key] = _bake_all(spark, sf)
    return _BAKED[key]


def _bake_all(spark, sf):
    images = V.images(spark, sf).selectExpr("image_id", "concat('art-', image_id) as id", "'animal' as category", "width", "height")
    return bake(
        images, V.px(spark, sf), V.seed_px(spark, sf), V.seed_px(spark, sf), LOOSE,
        check_canvas=False, gates=False, tile=V.TILE,
    )


view(
    "bake_codes",
    """select image_id, 'line-coverage' as code, 1 as n, 0 as coord_total, 0 as cluster_total from shares where line_ratio > 0.35
    union all select image_id, 'seed-too-small', count(*), count(*), count(*) from seeds where solid_area < 64 group by image_id
    union all select s.image_id, 'seed-on-line', count(*), count(*), count(*) from seeds s join px p on p.image_id = s.image_id and p.x = s.ax and p.y = s.ay where a >= 128 group by all
    union all select image_id, 'seed-collision', count(*), count(*), count(distinct who) from
      (select image_id, unnest([owner, seed_id]) as who from stand where seed_id > owner) group by image_id
    union all select image_id, 'orphan-area', count(distinct component), count(distinct component), count(distinct component) from grown where component is not null and label is null group by image_id
    union all select image_id, 'shade-too-dark', count(*), count(*), 1 from seed_px where a = 255 and round(0.2126::double * r + 0.7152::double * g + 0.0722::double * b) < 60 group by image_id
    union all select image_id, 'region-count-drift', count(*), count(*), count(*) from master m where not exists (select 1 from out_stats o where o.image_id = m.image_id and o.label = m.label) group by image_id
    union all select image_id, 'tiny-region', count(*), count(*), 1 from out_stats where area < 200 group by image_id
    union all select image_id, 'region-count-range', 1, 0, 0 from (select image_id, count(*) as c from master group by image_id) where c < 8 or c > 2000
    union all select image_id, 'region-split', count(*), count(*), 1 from (select image_id, cls, count(distinct component) as c from out_parts group by all) where c > 1 group by image_id""",
)

_RANK = "case code " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(N.CODES)) + " end"


@query("bake_diagnostics", f"select image_id, code, coord_total, cluster_total, {_RANK} as rank from bake_codes")
def bake_diagnostics(spark, sf):
    d = baked(spark, sf).diagnostics
    return d.select("image_id", "code", "coord_total", "cluster_total", "rank")


@query(
    "severity_counts",
    """select image_id, count(*) filter (e) as errors, count(*) filter (not e) as warnings, bool_or(e) as has_error from
    (select image_id, code not in ('line-coverage', 'tiny-region', 'region-count-range', 'region-split') as e from bake_codes) group by image_id""",
)
def severity_counts(spark, sf):
    return N.severity_counts(baked(spark, sf).diagnostics)


@query(
    "gated_images",
    """select image_id from folders where image_id not in (select image_id from bake_codes where code in
    ('seed-collision', 'region-count-drift'))""",
)
def gated_images(spark, sf):
    """Images that pass a gate on two of the error codes."""
    return N.passing(folders(spark, sf), baked(spark, sf).findings, "seed-collision", "region-count-drift")


@query(
    "bake_regions",
    """select o.image_id, o.label as id, o.area, bx, "by", bw, bh, cx, cy, printf('#%02X%02X%02X', r, g, b) as suggested_color from out_stats o join seeds s on s.image_id = o.image_id and s.seed_id = o.label""",
)
def bake_regions(spark, sf):
    r = baked(spark, sf).regions
    return RQ.flat(r, "image_id", "id", "suggested_color")


view(
    "regions_text",
    """select image_id, '[' || string_agg('{"id":' || o.label || ',"centroid":[' || cx || ',' || cy || '],"area":' || area || ',"bbox":[' || bx || ',' || "by" || ',' || bw || ',' || bh
    || '],"suggested_color":"' || printf('#%02X%02X%02X', r, g, b) || '"}', ',' order by o.label) || ']' as regions_json
    from out_stats o join seeds s using (image_id) where s.seed_id = o.label group by image_id""",
)


@query("region_documents", "select image_id, regions_json from regions_text")
def region_documents(spark, sf):
    return packs.region_documents(baked(spark, sf).regions)


@query(
    "pack_manifests",
    """select image_id, 'art-' || image_id as id, n as region_count, case when n <= 60 then 'easy' when n <= 200 then 'medium' else 'focused' end as difficulty, pal as palette from
    (select image_id, count(*) as n from out_stats group by image_id) join (select image_id, string_agg(hex, ',' order by area desc, label) as pal from
    (select o.image_id, printf('#%02X%02X%02X', r, g, b) as hex, sum(o.area) as area, min(o.label) as label from out_stats o join seeds s on s.image_id = o.image_id and s.seed_id = o.label group by all) group by image_id) using (image_id)""",
)
def pack_manifests(spark, sf):
    m = packs.parse_manifests(baked(spark, sf).packs)
    return m.select("image_id", "id", "region_count", "difficulty", F.concat_ws(",", "palette").alias("palette"))


@query(
    "parsed_regions",
    "select image_id, label as id, area, bx, cy from out_stats",
)
def parsed_regions(spark, sf):
    r = packs.parse_regions(packs.region_documents(baked(spark, sf).regions))
    return r.select("image_id", "id", "area", F.col("bbox.x").alias("bx"), F.col("centroid.y").alias("cy"))


view("specks", "select image_id, x, y, case when a = 64 then 100 + x + 16 * y else x // 5 + 4 * (y // 5) end as label from px")
view("speck_areas", "select image_id, label, count(*) as area, min(y * 4294967296 + x) as first_pixel from specks group by all")


@query(
    "vanished_regions",
    """select m.image_id, m.label, m.first_pixel from speck_areas m where not exists (select 1 from
    (select image_id, x, y, min({'o': -n, 'a': area, 'l': label}).l as label from
    (select s.image_id, x // 2 as x, y // 2 as y, s.label, count(*) as n, any_value(m.area) as area from specks s
    join speck_areas m on m.image_id = s.image_id and m.label = s.label group by all) group by image_id, x, y) o where o.image_id = m.image_id and o.label = m.label)""",
)
def vanished_regions(spark, sf):
    """One-pixel regions are voted out when the plane is halved."""
    labels = V.px(spark, sf).selectExpr(
        "image_id", "x", "y", "cast(case when a = 64 then 100 + x + 16 * y else x div 5 + 4 * (y div 5) end as bigint) as label"
    )
    half = L.majority(V.with_size(L.with_area(labels, V.TILE)))
    return Q.vanished(R.region_stats(labels), R.region_stats(half)).select("image_id", "label", "first_pixel")


@query(
    "rejection_attachment",
    """select s.image_id, s.seed_id as id, coalesce(n, 0) as area, s.ax as anchor_x, s.ay as anchor_y from seeds s
    left join (select image_id, label, count(*) as n from grown where label is not null group by all) g on g.image_id = s.image_id and g.label = s.seed_id""",
)
def rejection_attachment(spark, sf):
    b = baked(spark, sf)
    return reports.region_attachment(b.merged, b.seeds).select("image_id", "id", "area", "anchor_x", "anchor_y")


@query(
    "report_text",
    """select image_id, regexp_matches(t, 'x') as ok, lines from (select image_id, 'x' as t, count(*) + 1 + count(*) filter (cluster_total > 0) as lines from bake_codes group by image_id)""",
)
def report_text(spark, sf):
    """Lines of the readable report: one per rule, one per coordinate list, one total."""
    b = baked(spark, sf)
    text = reports.report_text(reports.reports(folders(spark, sf), b.diagnostics))
    return text.select("image_id", F.col("text").contains("errors").alias("ok"), F.size(F.split("text", "\n")).alias("lines"))


def _run_hash(spark, sf, runs):
    """Hash of the run-length bytes of each image."""
    images = V.images(spark, sf).selectExpr("image_id", "width * height as pixels")
    packed = U.run_bytes(runs, images, block=V.TILE)
    return U.content_hash(packed.select("image_id", F.lit(0).alias("entry"), F.lit("regions.bin").alias("name"), "chunk_no", "data"))


@query(
    "pack_integrity",
    """select image_id, case image_id % 8 when 0 then 'schema-version' when 1 then 'content-hash' when 2 then 'too-long' when 3 then 'region-rows'
    when 4 then 'region-id' when 5 then 'too-short' end as error from folders""",
)
def pack_integrity(spark, sf):
    """Packs with one kind of damage per image: in the version, in the runs after hashing, in the canvas, in the regions."""
    labels = V.labels_px(spark, sf)
    runs = U.encode_runs(labels)
    kind = F.col("image_id") % 8
    manifest = V.images(spark, sf).join(_run_hash(spark, sf, runs), "image_id").select(
        "image_id",
        F.when(kind == 0, "2.0").otherwise("1.0").alias("schema_version"),
        "content_hash",
        F.array(F.when(kind == 2, 15).when(kind == 5, 17).otherwise(16), F.lit(16)).alias("canvas_size"),
        F.when(kind == 4, 15).otherwise(16).cast("long").alias("region_count"),
    )
    regions = labels.select("image_id", F.col("label").alias("id")).distinct().where("not (image_id % 8 in (3, 4) and id = 7)")
    hit = (kind == 1) & (F.col("run_no") == 0)
    damaged = runs.withColumn("id", F.when(hit, F.col("id") + 1).otherwise(F.col("id")))
    return packs.integrity(manifest, regions, damaged, _run_hash(spark, sf, damaged))


@query(
    "expanded_channels",
    """select event_id, c0 as r, case when m in (0, 1) then c0 else c1 end as g, case when m in (0, 1) then c0 else c2 end as b,
    case m when 0 then 255 when 1 then c1 when 2 then 255 else c3 end as a from
    (select event_id, event_id % 4 as m, event_id % 256 as c0, event_id % 199 as c1, user_id % 256 as c2, event_id % 101 as c3 from events)""",
)
def expanded_channels(spark, sf):
    raw = V.events(spark, sf).selectExpr(
        "event_id", "case event_id % 4 when 0 then 'gray' when 1 then 'gray-alpha' when 2 then 'rgb' else 'rgba' end as mode",
        "event_id % 256 as c0", "event_id % 199 as c1", "user_id % 256 as c2", "event_id % 101 as c3",
    )
    return assets.expand_channels(raw, F.col("mode")).drop("mode")

