"""The bake with its four gates: images that stop at each of them and images that get a pack."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.functions import manifest
from tessella.operators import findings as N
from tessella.operators import quality as Q
from tessella.operators import regions as R
from tessella.plans import bake as B
from tessella.plans import quality_queries as QQ
from tessella.plans import raster_views  # noqa: F401
from tessella.plans import views as V
from tessella.plans.params import BakeParams
from tessella.plans.registry import query, variant, view
from tessella.session import scratch_dir
from tessella.sources import packs, reports

PARAMS = BakeParams(min_seed_area=1, min_orphan_area=1)

# Every third image is whole: a closed grid with a seed in each cell. Every ninth has a region of one pixel besides,
# which is outvoted when the plane is halved.
_WHOLE, _SPECK = "image_id % 3 = 2", "image_id % 9 = 8"
_RING = "(x = 6 and y in (5, 7) or y = 6 and x in (5, 7))"
_LINE = f"""case when {_WHOLE} then case when x % 5 = 4 or y % 5 = 4 or x = 15 or y = 15 or {_SPECK} and {_RING} then 255 else 0 end else a end"""
_DOT = f"""case when {_WHOLE} then case when x < 15 and y < 15 and x % 5 in (1, 2) and y % 5 in (1, 2) or {_SPECK} and x = 8 and y = 5 then 255 else 0 end else a end"""
variant(
    "staged_",
    {
        "px": f"select image_id, x, y, r, g, b, {_LINE} as a from px",
        "seed_px": f"select image_id, x, y, r, g, b, {_DOT} as a from seed_px",
    },
    ["out_stats", "out_parts", "seeds", "stand", "grown", "master", "px"],
)


def line_px(spark, sf):
    return V.px(spark, sf).withColumn("a", F.expr(_LINE).cast("int"))


def dot_px(spark, sf):
    return V.seed_px(spark, sf).withColumn("a", F.expr(_DOT).cast("int"))


def stored(px, name):
    """A pixel table with a folder per image in the shared folder."""
    path = f"{scratch_dir(px.sparkSession)}/{name}-{uuid.uuid4().hex}"
    B.write_pixels(px, path)
    return px.sparkSession.read.schema(px.schema).parquet(path)


def staged_bake(spark, sf):
    """All gates on; sizes and profiles are those the folders declare."""
    images = V.images(spark, sf).selectExpr("image_id", "concat('art-', image_id) as id", "'animal' as category", "width", "height")
    meta = images.selectExpr("image_id", "id as folder_id", "id", "case when image_id % 11 = 0 then 'other' else category end as category")
    return B.bake(
        images, stored(line_px(spark, sf), "line"), stored(dot_px(spark, sf), "dots"), None, PARAMS,
        tile=V.TILE, layers=QQ.layer_sizes(spark, sf), meta=meta,
    )


_ERRORS = ", ".join(f"'{c}'" for c, severity, *_ in N.RULES if severity == "error")
view(
    "staged_source",
    """select image_id, 'source-incomplete' as code, null::int as x, null::int as y, 0 as a, 0 as b, string_agg(layer, ', ' order by layer) as metric, null::bigint as low from
    (select image_id, layer from folders, (values ('lineart'), ('seeds')) v(layer)) need where not exists
    (select 1 from layer_sizes h where h.image_id = need.image_id and h.layer = need.layer) group by image_id
    union all select image_id, 'meta-bad-category', null, null, 0, 0, 'other', null from folders where image_id % 11 = 0""",
)
view("staged_first", "select image_id from folders where image_id not in (select image_id from staged_source where code = 'source-incomplete')")
view(
    "staged_geometry",
    """select image_id, 'size-mismatch' as code, null::int as x, null::int as y, 0 as a, 0 as b,
    string_agg(layer, ', ' order by list_position(['lineart', 'seeds', 'shade'], layer)) as metric, null::bigint as low
    from layer_sizes join first_layer using (image_id) join staged_first using (image_id) where width <> w or height <> h group by image_id
    union all select image_id, 'color-space', null, null, list_position(['lineart', 'seeds', 'shade'], layer), 0, layer || ' icc', null
    from layer_sizes join staged_first using (image_id) where not is_srgb
    union all select image_id, 'canvas-size', null, null, 0, 0, w || 'x' || h, null from first_layer join staged_first using (image_id) where not (h = 4096 and w in (3072, 4096))""",
)
view("staged_second", "select image_id from staged_first where image_id not in (select image_id from staged_geometry where code = 'size-mismatch')")
view(
    "staged_master_findings",
    """select * from (
    select image_id, 'line-coverage' as code, null::int as x, null::int as y, 0 as a, 0 as b, printf('%.3f', avg((a >= 128)::int)) as metric, null::bigint as low
    from staged_px group by image_id having avg((a >= 128)::int) > 0.35
    union all select s.image_id, 'seed-on-line', ax, ay, seed_id, 0, null, null from staged_seeds s join staged_px p on p.image_id = s.image_id and p.x = s.ax and p.y = s.ay where p.a >= 128
    union all select c.image_id, 'seed-collision', s.ax, s.ay, c.seed_id, side, null, null from
    (select image_id, seed_id, unnest([owner, seed_id]) as who, unnest([0, 1]) as side from staged_stand where seed_id > owner) c
    join staged_seeds s on s.image_id = c.image_id and s.seed_id = c.who
    union all select image_id, 'orphan-area', component % 4294967296, component // 4294967296, -count(*), component, count(*)::varchar, null
    from staged_grown where component is not null and label is null group by image_id, component) where image_id in (select image_id from staged_second)""",
)
view(
    "staged_third",
    f"""select image_id from staged_second where image_id not in (select image_id from
    (select image_id, code from staged_source union all select image_id, code from staged_geometry union all select image_id, code from staged_master_findings) where code in ({_ERRORS}))""",
)
view(
    "staged_output",
    """select * from (
    select image_id, 'region-count-drift' as code, first_pixel % 4294967296 as x, first_pixel // 4294967296 as y, label as a, 0 as b, null::varchar as metric, null::bigint as low from staged_master m
    where not exists (select 1 from staged_out_stats o where o.image_id = m.image_id and o.label = m.label)
    union all select image_id, 'tiny-region', cx, cy, label, 0, null, area from staged_out_stats where area < 200
    union all select image_id, 'region-count-range', null, null, 0, 0, count(*)::varchar, null from staged_master group by image_id having count(*) < 8 or count(*) > 2000
    union all select o.image_id, 'region-split', cx, cy, label, 0, null, null from staged_out_stats o join
    (select image_id, cls from staged_out_parts group by image_id, cls having count(distinct component) > 1) s on s.image_id = o.image_id and s.cls = o.label)
    where image_id in (select image_id from staged_third)""",
)
view(
    "staged_findings",
    "select * from staged_source union all select * from staged_geometry union all select * from staged_master_findings union all select * from staged_output",
)
view("rules", "select * from (values " + ", ".join(f"('{c}', '{s}', '{t}', {g}, {k})" for c, s, t, g, k in N.RULES) + ") v(code, severity, stage, grid, scale)")
view(
    "staged_cells",
    """select image_id, code, first.x as x, first.y as y, first.a as a, first.b as b, n from
    (select image_id, code, min({'a': a, 'b': b, 'x': x * scale, 'y': y * scale}) as first, count(*) as n from staged_findings join rules using (code)
    where x is not null group by image_id, code, x * scale // grid, y * scale // grid)""",
)
_MESSAGE = "case code " + " ".join(f"when '{c}' then printf('{m}', shown)" for c, m in N.MESSAGES.items()) + " end"


@query(
    "staged_diagnostics",
    f"""select image_id, severity, code, stage, {_MESSAGE} as message, coalesce(coords, '') as coords, coalesce(coord_total, 0) as coord_total, coalesce(cluster_total, 0) as cluster_total from
    (select image_id, code, coalesce(arg_min(metric, {{'a': a, 'b': b}}), min(low)::varchar, count(*)::varchar) as shown from staged_findings group by image_id, code)
    join rules using (code) left join (select image_id, code, sum(n)::bigint as coord_total, count(*) as cluster_total,
    string_agg(x || ':' || y || ':' || n, ' ' order by rank) filter (rank <= 16) as coords from
    (select *, row_number() over (partition by image_id, code order by n desc, a, b) as rank from staged_cells) group by image_id, code) using (image_id, code)""",
)
def staged_diagnostics(spark, sf):
    """Every finding of every stage an image reaches, with message, severity and places."""
    d = staged_bake(spark, sf).diagnostics
    coords = F.array_join(F.transform("coords", lambda c: F.concat_ws(":", *[c[k].cast("string") for k in ("x", "y", "count")])), " ")
    return d.select("image_id", "severity", "code", "stage", "message", coords.alias("coords"), "coord_total", "cluster_total")


@query(
    "staged_packs",
    f"""select image_id, count(*) as region_count, sum(area)::bigint as covered from staged_out_stats where image_id in (select image_id from staged_third)
    and image_id not in (select image_id from staged_output where code in ({_ERRORS})) group by image_id""",
)
def staged_packs(spark, sf):
    """Images that get through the last gate, by the documents in their packs."""
    made = staged_bake(spark, sf).packs
    rows = packs.parse_regions(made).groupBy("image_id").agg(F.sum("area").alias("covered"))
    return packs.parse_manifests(made).select("image_id", "region_count").join(rows, "image_id")


@query(
    "half_shade",
    """select image_id, x // 2 as x, y // 2 as y, (sum(r)::bigint + 2) // 4 as r, (sum(g)::bigint + 2) // 4 as g, (sum(b)::bigint + 2) // 4 as b from
    (select image_id, x, y, (r * a + 255 * (255 - a) + 127) // 255 as r, (g * a + 255 * (255 - a) + 127) // 255 as g, (b * a + 255 * (255 - a) + 127) // 255 as b from seed_px)
    group by image_id, x // 2, y // 2""",
)
def half_shade(spark, sf):
    return QQ.baked(spark, sf).shade.select("image_id", "x", "y", "r", "g", "b")


view(
    "attached",
    """select s.image_id, string_agg(printf('{"id":%d,"area":%d,"bbox":[%d,%d,%d,%d],"centroid":[%d,%d],"suggested_color":"#%02X%02X%02X","seed_anchor":[%d,%d]}',
    s.seed_id, coalesce(n, 0), coalesce(bx, 0), coalesce(g."by", 0), coalesce(bw, 0), coalesce(bh, 0), coalesce(cx, 0), coalesce(cy, 0), s.r, s.g, s.b, s.ax, s.ay), ',' order by s.seed_id) as regions
    from seeds s left join (select image_id, label, count(*) as n, min(x) as bx, min(y) as "by", max(x) - min(x) + 1 as bw, max(y) - min(y) + 1 as bh,
    sum(x)::bigint // count(*) as cx, sum(y)::bigint // count(*) as cy from grown where label is not null group by all) g on g.image_id = s.image_id and g.label = s.seed_id group by s.image_id""",
)
view(
    "attached_orphans",
    """select image_id, string_agg(printf('{"area":%d,"bbox":[%d,%d,%d,%d],"anchor":[%d,%d]}', n, bx, "by", bw, bh, (component % 4294967296)::int, (component // 4294967296)::int), ',' order by n desc, component) as orphans
    from (select image_id, component, count(*) as n, min(x) as bx, min(y) as "by", max(x) - min(x) + 1 as bw, max(y) - min(y) + 1 as bh from grown
    where component is not null and label is null group by all) group by image_id""",
)


@query(
    "rejection_documents",
    """select image_id, '{"id":"art-' || image_id || '","master_size":[16,16],"regions":[' || coalesce(regions, '') || '],"orphans":[' || coalesce(orphans, '') || ']}' as rejection_json
    from folders left join attached using (image_id) left join attached_orphans using (image_id)""",
)
def rejection_documents(spark, sf):
    """Regions and orphans at master size, for rejected images too."""
    b = QQ.baked(spark, sf)
    images = V.images(spark, sf).selectExpr("image_id", "concat('art-', image_id) as id", "width", "height")
    return reports.rejection_documents(images, b.merged, b.seeds, b.orphans)


_HURT = "(image_id + label) % 9"


@query(
    "region_contract",
    f"""select image_id, id, broken, count(*) as n from (select image_id, case when {_HURT} = 0 then -1 - label else label end as id,
    case {_HURT} when 0 then 'id' when 1 then 'area' when 2 then 'centroid' when 3 then 'bbox' when 4 then 'suggested_color' when 5 then 'area,bbox' else '' end as broken
    from (select distinct image_id, label from labels_px)) group by all""",
)
def region_contract(spark, sf):
    """The rules of the region rows, over documents in which every rule is broken somewhere."""
    k = F.expr(_HURT)
    rows = R.region_stats(V.labels_px(spark, sf)).select(
        "image_id",
        F.when(k == 0, -1 - F.col("label")).otherwise(F.col("label")).alias("id"),
        F.when(k == 2, F.struct(F.lit(-1).alias("x"), F.col("centroid.y").alias("y"))).otherwise(F.col("centroid")).alias("centroid"),
        F.when(k.isin(1, 5), F.lit(0)).otherwise(F.col("area")).alias("area"),
        F.when(k.isin(3, 5), F.struct(*[F.lit(-4).alias(c) for c in "xywh"])).otherwise(F.col("bbox")).alias("bbox"),
        F.when(k == 4, "#12345g").otherwise("#123456").alias("suggested_color"),
    )
    documents = packs.region_documents(rows)
    read = documents.select("image_id", F.explode(F.from_json("regions_json", packs.REGION_SCHEMA)).alias("r"))
    broken = F.concat_ws(",", manifest.region_violations(F.col("r")))
    return read.groupBy("image_id", "r.id", broken.alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "region_overflow",
    "select c_nationkey as image_id, 'region-count-overflow' as code, count(*)::varchar as metric from customer, range(1100) group by c_nationkey having count(*) > 65535",
)
def region_overflow(spark, sf):
    """Region tables of more than 65,535 rows: customers with 1,100 regions each, by nation."""
    labels = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("image_id"), "c_custkey", F.explode(F.sequence(F.lit(0), F.lit(1099))).alias("n"))
    stats = labels.select("image_id", (F.col("c_custkey") * 1100 + F.col("n")).alias("label"), F.lit(0).cast("long").alias("first_pixel"), F.lit(200).cast("long").alias("area"))
    none = stats.limit(0).select("image_id", "label", F.lit(2).alias("pieces"))
    placed = stats.withColumn("centroid", F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    found = Q.output_rules(stats, placed, none, placed)
    return QQ.listed(found.where("code = 'region-count-overflow'"))


view(
    "staged_places",
    """select image_id, code, sum(n)::bigint as coord_total, count(*) as cluster_total,
    string_agg('(' || x || ', ' || y || ')' || case when n > 1 then 'x' || n else '' end, ' ' order by rank) filter (rank <= 16) as points from
    (select *, row_number() over (partition by image_id, code order by n desc, a, b) as rank from staged_cells) group by image_id, code""",
)
_RANK = "case code " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(N.CODES)) + " end"


@query(
    "staged_reports",
    f"""select image_id, case when lines is null then '' else lines || chr(10) end || '  ' || coalesce(errors, 0) || ' errors, ' || coalesce(warnings, 0) || ' warnings' as text from folders left join
    (select image_id, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings,
    string_agg('  ' || severity || ' [' || code || '] ' || stage || ': ' || {_MESSAGE} || case when points is null then '' else
    chr(10) || '      ' || cluster_total || ' places' || case when coord_total > cluster_total then ' / ' || coord_total || ' px' else '' end || ': ' || points ||
    case when cluster_total > 16 then ', ' || (cluster_total - 16) || ' more' else '' end end, chr(10) order by {_RANK}) as lines from
    (select image_id, code, coalesce(arg_min(metric, {{'a': a, 'b': b}}), min(low)::varchar, count(*)::varchar) as shown from staged_findings group by image_id, code)
    join rules using (code) left join staged_places using (image_id, code) group by image_id) using (image_id)""",
)
def staged_reports(spark, sf):
    """The reports of all images, written as JSON, read back and put as text."""
    path = f"{scratch_dir(spark)}/reports-{uuid.uuid4().hex}"
    rows = reports.reports(QQ.folders(spark, sf), staged_bake(spark, sf).diagnostics)
    reports.write_reports(rows, path)
    return reports.report_text(spark.read.schema(rows.schema).json(path))
