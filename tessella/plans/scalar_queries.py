"""Projections, predicates and scalar functions over the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import color as C
from tessella.functions import colorspace, gallery, manifest
from tessella.functions import shape as S
from tessella.operators import findings, presets, strokes
from tessella.operators import gallery as G
from tessella.plans import views as V
from tessella.plans.params import BakeParams
from tessella.plans.registry import query

ID = ["image_id", "x", "y"]


@query("line_mask", "select image_id, x, y, a >= 128 as line from px")
def line_mask(spark, sf):
    return V.px(spark, sf).select(*ID, C.is_line("a").alias("line"))


@query(
    "over_white",
    "select image_id, x, y, (r * a + 255 * (255 - a) + 127) // 255 as r, (g * a + 255 * (255 - a) + 127) // 255 as g, "
    "(b * a + 255 * (255 - a) + 127) // 255 as b from px",
)
def over_white(spark, sf):
    return V.px(spark, sf).select(*ID, *[C.over_white(c, "a").alias(c) for c in "rgb"])


@query(
    "luma",
    "select image_id, x, y, cast(least(greatest(round(0.2126::double * r + 0.7152::double * g + 0.0722::double * b), 0), 255) as int) as luma from px",
)
def luma(spark, sf):
    return V.px(spark, sf).select(*ID, C.luma("r", "g", "b").alias("luma"))


@query("hex_color", "select image_id, x, y, printf('#%02X%02X%02X', r, g, b) as hex from px")
def hex_color(spark, sf):
    return V.px(spark, sf).select(*ID, C.hex_color("r", "g", "b").alias("hex"))


@query("unit_color", "select image_id, x, y, round(r / 255.0::double, 9) as r, round(g / 255.0::double, 9) as g from px")
def unit_color(spark, sf):
    return V.px(spark, sf).select(*ID, *[F.round(C.unit(c), 9).alias(c) for c in "rg"])


@query(
    "pixel_index",
    "select event_id, event_id % 16 as x, event_id // 16 as y, (event_id // 16) * 4294967296 + event_id % 16 as pix from ev",
)
def pixel_index(spark, sf):
    """Linear index to coordinates and to the width-independent raster key, and back."""
    ev = V.padded(spark, sf)
    at = ev.select("event_id", (F.col("event_id") % 16).alias("x"), C.idiv("event_id", 16).alias("y"))
    key = at.withColumn("pix", S.raster_key("x", "y"))
    return key.select(
        "event_id", S.key_x("pix").cast("long").alias("x"), S.key_y("pix").cast("long").alias("y"), "pix"
    )


@query(
    "canvas_aspect",
    """select o_orderkey, case when (o_orderkey % 3) = 0 then '1:1' when (o_orderkey % 3) = 1 then '3:4' end as aspect from orders""",
)
def canvas_aspect(spark, sf):
    o = V.table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "case o_orderkey % 3 when 0 then 4096 when 1 then 3072 else 2048 end as w",
        "4096 as h",
    )
    return o.select("o_orderkey", manifest.aspect("w", "h").alias("aspect"))


@query(
    "difficulty",
    "select asset_id, case when region_count <= 60 then 'easy' when region_count <= 200 then 'medium' else 'focused' end as difficulty from items",
)
def difficulty(spark, sf):
    return V.items(spark, sf).select("asset_id", manifest.difficulty("region_count").alias("difficulty"))


_CATS = "case p_partkey % 8 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(manifest.CATEGORIES)) + " when 6 then p_type end"


@query(
    "category_domain",
    f"select p_partkey, coalesce(c in ({', '.join(repr(c) for c in manifest.CATEGORIES)}), false) as ok from (select p_partkey, {_CATS} as c from part)",
)
def category_domain(spark, sf):
    return V.table(spark, sf, "part").selectExpr("p_partkey", f"{_CATS} as c").select(
        "p_partkey", manifest.is_category("c").alias("ok")
    )


_VERSION = (
    "case event_id % 6 when 0 then '1.' || user_id when 1 then user_id || '.0' when 2 then '1' when 3 then '1.0.0' "
    "when 4 then '1.x' else event_type end"
)


@query(
    "schema_version",
    f"select event_id, regexp_full_match(v, '[0-9]+\\.[0-9]+') and split_part(v, '.', 1) = '1' as ok from (select event_id, {_VERSION} as v from events)",
)
def schema_version(spark, sf):
    return V.events(spark, sf).selectExpr("event_id", f"{_VERSION} as v").select(
        "event_id", manifest.version_ok("v").alias("ok")
    )


_MANIFEST = (
    """'{"schema_version":"' || case when p_size % 7 = 0 then '1' else '1.0' end || '","id":"' || replace(p_name, ' ', case when p_size % 5 = 0 then '_' else '-' end) """
    """|| '","content_hash":"sha256:' || sha || '","canvas_size":[' || case when p_size % 6 = 0 then '0' else '2048' end || ',2048],"aspect":"' """
    """|| case when p_size % 11 = 0 then '4:3' else '1:1' end || '","region_count":' || (p_size * 6 - 20) || ',"difficulty":"' """
    """|| case when p_size % 9 = 0 then 'focus' else 'easy' end || '","category":"' || case when p_size % 4 = 0 then 'animal' else lower(p_type) end """
    """|| '","has_shade":true,"palette":["#00FF3C"' || case when p_size % 8 = 0 then ',"#00ff3c"' else '' end || ']' """
    """|| case when p_size % 10 = 0 then ',"notes":"x"' else '' end || '}'"""
)


@query(
    "manifest_contract",
    """select p_partkey, concat_ws(',', case when p_size % 10 = 0 then 'extra' end, case when p_size % 7 = 0 then 'schema_version' end,
    case when not regexp_full_match(replace(p_name, ' ', case when p_size % 5 = 0 then '_' else '-' end), '[a-z0-9]+(-[a-z0-9]+)*') then 'id' end,
    case when p_size % 6 = 0 then 'canvas_size' end, case when p_size % 11 = 0 then 'aspect' end,
    case when not (p_size * 6 - 20 between 1 and 65535) then 'region_count' end, case when p_size % 9 = 0 then 'difficulty' end,
    case when p_size % 4 <> 0 then 'category' end, case when p_size % 8 = 0 then 'palette' end) as broken from part""",
)
def manifest_contract(spark, sf):
    doc = V.table(spark, sf, "part").selectExpr("*", "sha2(p_name, 256) as sha").selectExpr("p_partkey", f"{_MANIFEST} as doc")
    return doc.select("p_partkey", F.concat_ws(",", manifest.manifest_violations("doc")).alias("broken"))


def _chrm(i):
    return f"array(0.3127D + ({i} * 0.004D), 0.3290D)"


@query(
    "srgb_verdict",
    """select event_id, case when k = 0 then abs(user_id % 10 * 0.011::double) <= 0.02 when k = 1 then true
    when k = 2 then abs(0.45455::double + user_id % 4 * 0.011::double - 0.45455::double) <= 0.02 and abs(0.3127::double + user_id % 5 * 0.004::double - 0.3127::double) <= 0.01
    else true end as is_srgb, case k when 0 then 'icc' when 1 then 'srgb' when 2 then 'gamma+chroma' else 'none' end as basis
    from (select event_id, user_id, event_id % 4 as k from events)""",
)
def srgb_verdict(spark, sf):
    k = "event_id % 4"
    meta = V.events(spark, sf).selectExpr(
        "event_id",
        f"case when {k} = 0 then array(0.436066D + user_id % 10 * 0.011D, 0.222488D, 0.013916D) end as r",
        f"case when {k} = 0 then array(0.385147D, 0.716873D, 0.097076D) end as g",
        f"case when {k} = 0 then array(0.143066D, 0.060608D, 0.714096D) end as b",
        f"case when {k} = 0 and user_id % 2 = 0 then array(0.950455D, 1D, 1.08905D) end as w",
        f"{k} = 1 as chunk",
        f"case when {k} = 2 then 0.45455D + user_id % 4 * 0.011D end as gamma",
        "array(0.3127D + user_id % 5 * 0.004D, 0.3290D) as white",
        "array(0.64D, 0.33D) as red",
        "array(0.30D, 0.60D) as green",
        "array(0.15D, 0.06D) as blue",
    )
    chroma = {n: F.col(n) for n in colorspace.SRGB_XY}
    v = colorspace.verdict(*[F.col(c) for c in ("r", "g", "b", "w", "chunk", "gamma")], chroma)
    return meta.select("event_id", v.alias("v")).select("event_id", "v.is_srgb", "v.basis")


@query(
    "pressure_curve",
    """select s.seq, round(0.35 + 0.65 * least(greatest(pressure * 1.5 - 0.2, 0), 1), 6) as soft,
    round(0.35 + 0.65 * pow(least(greatest(pressure * 1.5 - 0.2, 0), 1), 1.2), 6) as firm from samples s""",
)
def pressure_curve(spark, sf):
    p = F.col("pressure") * 1.5 - 0.2
    lo, hi = F.lit(0.35), F.lit(1.0)
    return V.samples(spark, sf).select(
        "seq",
        F.round(S.curve(p, lo, hi, F.lit(1.0)), 6).alias("soft"),
        F.round(S.curve(p, lo, hi, F.lit(1.2)), 6).alias("firm"),
    )


_PRESET_SQL = "(values " + ", ".join(
    f"('{r[0]}', '{r[1]}', {r[2]}::double, {r[15]}::double, {r[16]}::double, {str(r[17]).lower()})" for r in presets.PRESETS
) + ") p(brush, tip, spacing, flow, opacity, build_up)"


@query(
    "preset_lookup",
    f"select s.seq, s.brush, p.tip, p.spacing, p.flow, p.build_up from samples s join {_PRESET_SQL} on p.brush = s.brush",
)
def preset_lookup(spark, sf):
    s = V.samples(spark, sf).select("seq", "brush")
    return presets.with_preset(s).select("seq", "brush", "tip", "spacing", "flow", "build_up")


@query(
    "effective_opacity",
    f"select s.seq, case when s.seq % 3 = 0 then 0.5::double else p.opacity end as opacity from samples s join {_PRESET_SQL} on p.brush = s.brush",
)
def effective_opacity(spark, sf):
    s = V.samples(spark, sf).selectExpr("seq", "brush", "case when seq % 3 = 0 then 0.5D end as chosen")
    return presets.with_preset(s).select("seq", presets.effective_opacity("chosen").alias("opacity"))


@query(
    "canvas_fit",
    """select event_id, round(scale, 9) as scale, round((sx - (sw - 2048 * scale) / 2) / scale, 6) as cx,
    round((sy - (sh - 2048 * scale) / 2) / scale, 6) as cy from (select *, least(sw / 2048, sh / 2048) as scale from
    (select event_id, 300.0::double + user_id % 900 as sw, 600.0::double + user_id % 700 as sh, value::double * 20 as sx, value::double * 30 as sy from events))""",
)
def canvas_fit(spark, sf):
    e = V.events(spark, sf).selectExpr(
        "event_id", "300.0D + user_id % 900 as sw", "600.0D + user_id % 700 as sh", "value * 20 as sx", "value * 30 as sy"
    )
    c = F.lit(2048.0)
    e = e.withColumn("scale", S.fit_scale(c, c, F.col("sw"), F.col("sh")))
    return e.select(
        "event_id",
        F.round("scale", 9).alias("scale"),
        F.round(S.to_canvas(F.col("sx"), F.col("sw"), c, F.col("scale")), 6).alias("cx"),
        F.round(S.to_canvas(F.col("sy"), F.col("sh"), c, F.col("scale")), 6).alias("cy"),
    )


@query(
    "input_device",
    """select event_id, round(case when pen and top > 0 then value / top else 0 end, 9) as pressure,
    case when pen and top > 0 then 0 else 6.5 end::double as radius from
    (select event_id, value, event_type <> 'click' as pen, (user_id % 3 * 40)::double as top from events)""",
)
def input_device(spark, sf):
    e = V.events(spark, sf).selectExpr(
        "event_id", "value", "event_type <> 'click' as pen", "cast(user_id % 3 * 40 as double) as top", "6.5D as touch"
    )
    cols = strokes.device_columns(F.col("value"), F.col("top"), F.col("touch"), F.col("pen"))
    return e.select("event_id", F.round(cols["pressure"], 9).alias("pressure"), cols["radius"].alias("radius"))


@query(
    "stroke_time",
    "select seq, stroke_id, round(t - min(t) over (partition by stroke_id), 6) as rel from samples",
)
def stroke_time(spark, sf):
    s = V.samples(spark, sf).select("stroke_id", "seq", F.col("t").alias("ts"))
    return strokes.relative_time(s).select("seq", "stroke_id", F.round("t", 6).alias("rel"))


@query(
    "predicted_split",
    "select stroke_id, count(*) filter (not predicted) as committed, count(*) filter (predicted) as guessed from samples group by stroke_id",
)
def predicted_split(spark, sf):
    s = V.samples(spark, sf)
    real = strokes.real_samples(s).select("stroke_id", F.lit(1).alias("c"), F.lit(0).alias("g"))
    guess = strokes.predicted_samples(s).select("stroke_id", F.lit(0).alias("c"), F.lit(1).alias("g"))
    return real.unionByName(guess).groupBy("stroke_id").agg(F.sum("c").alias("committed"), F.sum("g").alias("guessed"))


@query(
    "scissor_box",
    """select event_id, case when fin and x1 > x0 and y1 > y0 then x0::int end as x, case when fin and x1 > x0 and y1 > y0 then y0::int end as y,
    case when fin and x1 > x0 and y1 > y0 then (x1 - x0)::int end as w, case when fin and x1 > x0 and y1 > y0 then (y1 - y0)::int end as h from
    (select event_id, fin, least(greatest(floor(cx - rad), 0), 64) as x0, least(greatest(floor(cy - rad), 0), 64) as y0,
     least(greatest(ceil(cx + rad), 0), 64) as x1, least(greatest(ceil(cy + rad), 0), 64) as y1 from
     (select event_id, event_type <> 'error' as fin, value - 20 as cx, user_id - 20.0::double as cy, value / 7 as rad from events))""",
)
def scissor_box(spark, sf):
    e = V.events(spark, sf).selectExpr(
        "event_id",
        "case when event_type = 'error' then (case when event_id % 2 = 0 then double('NaN') else double('Infinity') end) else value - 20 end as cx",
        "user_id - 20.0D as cy",
        "value / 7 as rad",
    )
    cx, cy, rad = F.col("cx"), F.col("cy"), F.col("rad")
    side = F.lit(64)
    box = S.scissor(cx - rad, cy - rad, cx + rad, cy + rad, side, side)
    return e.select("event_id", box.alias("s")).select("event_id", "s.x", "s.y", "s.w", "s.h")


@query(
    "farthest_corner",
    """select event_id, round(greatest(sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy)), sqrt((x + 5 - ox) * (x + 5 - ox) + (y - oy) * (y - oy)),
    sqrt((x - ox) * (x - ox) + (y + 9 - oy) * (y + 9 - oy)), sqrt((x + 5 - ox) * (x + 5 - ox) + (y + 9 - oy) * (y + 9 - oy))), 6) as reach
    from (select event_id, value::double as ox, (user_id % 16)::double as oy, (event_id % 16)::double as x, ((event_id // 16) % 16)::double as y from events)""",
)
def farthest_corner(spark, sf):
    e = V.events(spark, sf).selectExpr(
        "event_id", "value as ox", "double(user_id % 16) as oy", "double(event_id % 16) as x", "double((event_id div 16) % 16) as y"
    )
    reach = S.farthest_corner(*[F.col(c) for c in ("ox", "oy", "x", "y")], F.lit(5.0), F.lit(9.0))
    return e.select("event_id", F.round(reach, 6).alias("reach"))


@query(
    "easing",
    """select event_id, round(1 - pow(1 - least(greatest(t, 0), 1), 3), 6) as eased, round(s * s * (3 - 2 * s), 6) as smooth,
    round(10 + (t - 10) * (s * s * (3 - 2 * s)), 4) as mixed from (select event_id, t, least(greatest((t - 0.2) / 0.6, 0), 1) as s from
    (select event_id, value / 37 as t from events))""",
)
def easing(spark, sf):
    t = F.col("value") / 37
    smooth = S.smoothstep(0.2, 0.8, t)
    return V.events(spark, sf).select(
        "event_id",
        F.round(S.ease_out(t), 6).alias("eased"),
        F.round(smooth, 6).alias("smooth"),
        F.round(S.mix(F.lit(10.0), t, smooth), 4).alias("mixed"),
    )


def _mul(a: str, k: int) -> str:
    return f"(({a})::hugeint * {k} % 4294967296)::bigint"


def _lattice(ix: str, iy: str) -> str:
    h0 = f"xor(xor({_mul(ix, S.LATTICE_X)}, {_mul(iy, S.LATTICE_Y)}), {S.GRAIN_SEED})"
    return (
        f"(select (xor(h, h >> 16) >> 8)::double / 16777216 from (select {_mul('h', S.MIX_2)} as h from (select xor(h, h >> 12) as h from "
        f"(select {_mul('h', S.MIX_1)} as h from (select xor(h, h >> 15) as h from (select {h0} as h))))))"
    )


@query(
    "tip_shape",
    f"""select event_id, round(case when d >= 1 then 0 else 1 - d end, 6) as soft, round(1 - hs * hs * (3 - 2 * hs), 6) as hard,
    round(case when d >= 1 then 0 else least(greatest((n - 0.5) * 2.2 + 0.5, 0), 1) * (1 - d) end, 5) as grain from
    (select event_id, d, least(greatest((d - 0.9::double) / (1::double - 0.9::double), 0), 1) as hs, t + (bo - t) * sy as n from
    (select event_id, d, sy, l00 + (l10 - l00) * sx as t, l01 + (l11 - l01) * sx as bo from
    (select event_id, d, wx * wx * (3 - 2 * wx) as sx, wy * wy * (3 - 2 * wy) as sy, {_lattice('ix', 'iy')} as l00, {_lattice('ix + 1', 'iy')} as l10,
    {_lattice('ix', 'iy + 1')} as l01, {_lattice('ix + 1', 'iy + 1')} as l11 from
    (select event_id, d, floor(fx)::bigint as ix, floor(fy)::bigint as iy, fx - floor(fx) as wx, fy - floor(fy) as wy from
    (select event_id, sqrt(u * u + v * v) as d, ((u + 1) * 128 - 0.5) * 0.0546875::double as fx, ((v + 1) * 128 - 0.5) * 0.0546875::double as fy from
    (select event_id, (event_id % 256 + 0.5::double) / 128 - 1 as u, ((event_id // 256 * 7) % 256 + 0.5::double) / 128 - 1 as v from events))))))""",
)
def tip_shape(spark, sf):
    e = V.events(spark, sf).selectExpr(
        "event_id", "(event_id % 256 + 0.5D) / 128 - 1 as u", "((event_id div 256 * 7) % 256 + 0.5D) / 128 - 1 as v"
    )
    u, v = F.col("u"), F.col("v")
    return e.select(
        "event_id",
        F.round(S.tip_coverage(F.lit("soft_round"), u, v), 6).alias("soft"),
        F.round(S.tip_coverage(F.lit("hard_round"), u, v), 6).alias("hard"),
        F.round(S.tip_coverage(F.lit("grain"), u, v), 5).alias("grain"),
    )


@query(
    "locked_items",
    "select asset_id, entitlement = 'paid' and not (pos % 7 = 0) and work is null as locked from items",
)
def locked_items(spark, sf):
    return V.items(spark, sf).select(
        "asset_id", gallery.is_locked("entitlement", F.col("pos") % 7 == 0, "work").alias("locked")
    )


@query(
    "impossible_states",
    "select asset_id, download = 'notDownloaded' and w is not null as impossible from "
    "(select asset_id, download, case when pos % 9 = 0 then 'shared' else work end as w from items)",
)
def impossible_states(spark, sf):
    i = V.items(spark, sf).selectExpr("asset_id", "download", "case when pos % 9 = 0 then 'shared' else work end as w")
    return i.select("asset_id", gallery.is_impossible("download", "w").alias("impossible"))


@query(
    "catalogue_filter",
    "select asset_id, title from items where category = 'ECONOMY' and contains(lower(title), lower('RED'))",
)
def catalogue_filter(spark, sf):
    i = V.items(spark, sf)
    return i.where(gallery.matches(F.col("category"), F.col("title"), "ECONOMY", "RED")).select("asset_id", "title")


_CODE = "case event_id % 18 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(findings.CODES)) + " else event_type end"


@query(
    "suspicion_rank",
    "select event_id, case event_id % 18 "
    + " ".join(f"when {i} then {i}" for i in range(17))
    + " else 18 end as rank from events",
)
def suspicion_rank(spark, sf):
    return V.events(spark, sf).selectExpr("event_id", f"{_CODE} as code").select("event_id", findings.rank("code").alias("rank"))


@query(
    "parameter_override",
    "select image_id, count(*) filter (a >= 60) as line_pixels from px group by image_id",
)
def parameter_override(spark, sf):
    p = BakeParams().override("line_threshold", "60")
    return V.px(spark, sf).groupBy("image_id").agg(F.count_if(C.is_line("a", p.line_threshold)).alias("line_pixels"))


@query(
    "legal_state_grid",
    """select e as entitlement, d as download, w as work, coalesce(n, 0) as n_items from (values ('free'), ('paid')) a(e),
    (values ('notDownloaded'), ('downloading'), ('downloaded'), ('failed')) b(d), (values (null), ('inProgress'), ('shared')) c(w)
    left join (select entitlement, download, work, count(*) as n from items group by all) i
    on i.entitlement = e and i.download = d and i.work is not distinct from w
    where not (d = 'notDownloaded' and w is not null)""",
)
def legal_state_grid(spark, sf):
    """The 20 legal combinations with the number of items that show each."""
    return G.state_counts(V.items(spark, sf))
