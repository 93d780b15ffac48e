"""Samples, dabs and painting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.shape import decimals, rounded
from tessella.operators import painting as P
from tessella.operators import strokes as K
from tessella.plans import views as V
from tessella.plans.registry import query, view

view(
    "ordered_samples",
    """select *, row_number() over (partition by stroke_id order by seq) as n, x::float::double as fx, y::float::double as fy, t::float::double as ft
    from samples where not predicted""",
)


def _gain(cutoff: str, dt: str) -> str:
    return f"(({dt}) / (({dt}) + 1.0::double / (2.0::double * pi() * ({cutoff}))))"


# One row per sample and level: velocity estimate, filtered position, filtered radius.
view(
    "smooth_steps",
    f"""select stroke_id, seq, n, fx as px, fy as py, 0.0::double as vx, 0.0::double as vy, ft as pt, case when radius > 0 then radius end as pr from ordered_samples where n = 1
    union all select stroke_id, seq, n, (px + (fx - px) * {_gain('1.0::double + 0.05::double * sqrt(wx * wx + wy * wy)', 'dt')})::float::double,
    (py + (fy - py) * {_gain('1.0::double + 0.05::double * sqrt(wx * wx + wy * wy)', 'dt')})::float::double, wx, wy, ft,
    case when radius > 0 then pr + (radius - pr) * {_gain('0.5::double', 'dt')} else pr end from
    (select o.stroke_id, o.seq, o.n, o.fx, o.fy, o.ft, o.radius, p.px, p.py, p.pr, o.ft - p.pt as dt,
    p.vx + ((o.fx - p.px) / (o.ft - p.pt) - p.vx) * {_gain('1.0::double', 'o.ft - p.pt')} as wx,
    p.vy + ((o.fy - p.py) / (o.ft - p.pt) - p.vy) * {_gain('1.0::double', 'o.ft - p.pt')} as wy
    from smooth_steps p join ordered_samples o on o.stroke_id = p.stroke_id and o.n = p.n + 1)""",
)


@query(
    "smoothed_samples",
    """select seq, stroke_id, round(px, 2) as x, round(py, 2) as y, round(case when pr is null then least(greatest(pressure, 0), 1)
    else least(greatest((pr - lo) / greatest(hi - lo, 4), 0), 1) end, 4) as pressure,
    round(coalesce(sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy)) / (pt - qt), 0), 0) as speed from
    (select s.*, o.pressure, min(least(pr, r0 - 2)) over w as lo, max(greatest(pr, r0 + 2)) over w as hi, lag(px) over w as qx, lag(py) over w as qy, lag(pt) over w as qt from
    (select *, first_value(pr) over (partition by stroke_id order by n) as r0 from smooth_steps) s join ordered_samples o using (stroke_id, seq)
    window w as (partition by s.stroke_id order by s.n))""",
)
def smoothed_samples(spark, sf):
    """Filtered position, pressure from the radius baseline or the pen, and speed."""
    out = K.smooth(V.samples(spark, sf))
    return out.select(
        "seq", "stroke_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"),
        F.round("pressure", 4).alias("pressure"), F.round("speed", 0).alias("speed"),
    )


@query(
    "sample_speed",
    """select seq, stroke_id, round(case when p is null then 0 when t > p then sqrt((x - px) * (x - px) + (y - py) * (y - py)) / (t - p) end, 3) as speed from
    (select *, lag(x) over w as px, lag(y) over w as py, lag(t) over w as p from samples window w as (partition by stroke_id order by seq))""",
)
def sample_speed(spark, sf):
    return K.raw_speed(V.samples(spark, sf).select("stroke_id", "seq", "x", "y", "t")).select(
        "seq", "stroke_id", F.round("speed", 3).alias("speed")
    )


@query("stroke_dabs")
def stroke_dabs(spark, sf):
    """The whole pipeline from samples to dabs; checked against known strokes in the tests."""
    return K.generate_dabs(V.samples(spark, sf)).select(
        "stroke_id", "dab_no", *[rounded(F.col(c), 3).alias(c) for c in ("x", "y", "size", "angle", "alpha")]
    )


@query("dab_counts")
def dab_counts(spark, sf):
    return K.stroke_bounds(K.generate_dabs(V.samples(spark, sf))).select("stroke_id", "dabs")


# --- dabs on a 16 x 16 canvas ---------------------------------------------------------------

_DAB = """event_id div 256 as image_id, event_id div 64 as stroke_id, event_id as dab_no, (event_id * 37 % 160) / 10D as x,
    (event_id * 91 % 163) / 10D as y, 2D + event_id % 5 as size, event_id % 7 * 0.4D as angle, 0.2D + event_id % 8 * 0.1D as alpha,
    case when event_id div 64 % 2 = 0 then 'soft_round' else 'hard_round' end as tip, event_id div 64 % 3 = 0 as build_up"""

view("dabs", "select " + _DAB.replace(" div ", " // ").replace("0D", "0::double").replace("2D", "2::double").replace("0.4D", "0.4::double").replace("0.1D", "0.1::double") .replace("0.2D", "0.2::double") + " from events")
view(
    "dab_cells",
    """select *, case tip when 'soft_round' then 1 - d else 1 - s * s * (3 - 2 * s) end * alpha as cover from
    (select *, least(greatest((d - 0.9::double) / (1::double - 0.9::double), 0), 1) as s from
    (select *, sqrt((px + 0.5::double - x) * (px + 0.5::double - x) + (py + 0.5::double - y) * (py + 0.5::double - y)) / (size / 2) as d from
    (select *, unnest(range(greatest(floor(y - size / 2), 0)::bigint, least(floor(y + size / 2), 15)::bigint + 1)) as py from
    (select *, unnest(range(greatest(floor(x - size / 2), 0)::bigint, least(floor(x + size / 2), 15)::bigint + 1)) as px from dabs)))) where d < 1""",
)
view(
    "stroke_cells",
    """select image_id, stroke_id, px as x, py as y, case when any_value(build_up) then 1 - product(1 - cover) else max(cover) end as cover
    from dab_cells where cover > 0 group by image_id, stroke_id, px, py""",
)


def dabs(spark, sf):
    return V.with_size(V.events(spark, sf).selectExpr(*[c.strip() for c in _split(_DAB)]))


def _split(text):
    """Top-level commas only."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


@query(
    "stroke_bounds",
    """select stroke_id, round(min(x - size / 2), 6) as x0, round(min(y - size / 2), 6) as y0, round(max(x + size / 2), 6) as x1,
    round(max(y + size / 2), 6) as y1, count(*) as dabs from dabs group by stroke_id""",
)
def stroke_bounds(spark, sf):
    return K.stroke_bounds(dabs(spark, sf)).select("stroke_id", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "dabs")


@query(
    "dab_pixels",
    "select dab_no, count(*) as pixels, round(sum(cover), 4) as cover, round(sum(cover * px), 3) as cx, round(sum(cover * py), 3) as cy from dab_cells where cover > 1e-9 group by dab_no",
)
def dab_pixels(spark, sf):
    """Pixels under every dab, with total and first moments of the coverage."""
    c = F.col("cover")
    return P.dab_pixels(dabs(spark, sf)).groupBy("dab_no").agg(
        F.count_if(c > 1e-9).alias("pixels"), F.round(F.sum(c), 4).alias("cover"),
        F.round(F.sum(c * F.col("px")), 3).alias("cx"), F.round(F.sum(c * F.col("py")), 3).alias("cy"),
    )


@query("stroke_coverage", "select image_id, stroke_id, x, y, round(cover, 5) as cover from stroke_cells where cover > 0.001")
def stroke_coverage(spark, sf):
    cells = P.stroke_coverage(P.dab_pixels(dabs(spark, sf))).where("cover > 0.001")
    return cells.select("image_id", "stroke_id", "x", "y", decimals(F.col("cover"), 5).alias("cover"))


view(
    "laid",
    """select c.image_id, c.x, c.y, c.stroke_id, cover * (0.5::double + stroke_id % 3 * 0.2::double) as a, stroke_id % 5 * 0.2::double as r from stroke_cells c
    join labels_px l using (image_id, x, y) where stroke_id % 2 = 0 or l.label = stroke_id % 16""",
)
view(
    "painted",
    """select image_id, x, y, sum(r * a * exp(later)) as r, sum(a * exp(later)) as a from
    (select *, coalesce(sum(ln(greatest(1 - a, 1e-300))) over (partition by image_id, x, y order by stroke_id desc rows between unbounded preceding and 1 preceding), 0) as later from laid)
    group by image_id, x, y""",
)


def paint(spark, sf):
    cover = P.stroke_coverage(P.dab_pixels(dabs(spark, sf)))
    strokes = V.events(spark, sf).selectExpr("event_id div 256 as image_id", "event_id div 64 as stroke_id").distinct().selectExpr(
        "image_id", "stroke_id", "stroke_id as order_no", "stroke_id % 5 * 0.2D as r", "0D as g", "0D as b",
        "0.5D + stroke_id % 3 * 0.2D as opacity", "stroke_id % 2 = 1 as strict", "stroke_id % 16 as active",
    )
    return P.commit(cover, strokes, V.labels_px(spark, sf), V.TILE)


@query(
    "region_mask",
    "select image_id, x, y, label, image_id % 2 = 1 or label = 5 as painted from labels_px",
)
def region_mask(spark, sf):
    px = V.labels_px(spark, sf)
    mask = P.region_mask(F.col("image_id") % 2 == 0, F.col("label"), F.lit(5))
    return px.select("image_id", "x", "y", "label", mask.alias("painted"))


@query("committed_paint", "select image_id, x, y, round(r, 4) as r, round(a, 4) as a from painted")
def committed_paint(spark, sf):
    return paint(spark, sf).select("image_id", "x", "y", decimals(F.col("r"), 4).alias("r"), decimals(F.col("a"), 4).alias("a"))


@query(
    "canvas_composite",
    """select p.image_id, p.x, p.y, round(((case when l.label % 3 = 0 then 1 else (l.label % 3 * 90) / 255.0::double end) * (1 - coalesce(q.a, 0)) + coalesce(q.r, 0))
    * (((p.r * p.a + 255 * (255 - p.a) + 127) // 255) / 255.0::double), 4) as r from px p join labels_px l using (image_id, x, y) left join painted q using (image_id, x, y)""",
)
def canvas_composite(spark, sf):
    """Fills below, paint above, line art on top; every third region was never filled."""
    labels = V.labels_px(spark, sf)
    fills = labels.select("image_id", "label").distinct().where("label % 3 <> 0").selectExpr(
        "image_id", "label", "label % 3 * 90 as r", "0 as g", "0 as b"
    )
    stack = P.layer_stack(labels, fills, paint(spark, sf), P.layers_over_white(V.px(spark, sf)), V.TILE)
    return P.canvas_composite(stack).select("image_id", "x", "y", decimals(F.col("r"), 4).alias("r"))


@query(
    "cleared_erasures",
    """select e.image_id, e.x, e.y, max(e.b / 255.0::double) as cover from px e join labels_px l using (image_id, x, y)
    where not exists (select 1 from labels_px f where f.image_id = e.image_id and f.label = l.label and f.label % 4 = 1 and f.label * 20 >= e.b) group by all""",
)
def cleared_erasures(spark, sf):
    erase = V.px(spark, sf).selectExpr("image_id", "x", "y", "b as seq", "b / 255D as cover")
    labels = V.labels_px(spark, sf)
    fills = labels.where("label % 4 = 1").selectExpr("image_id", "label", "label * 20 as seq")
    return P.clear_erased(erase, labels, fills, V.TILE)
