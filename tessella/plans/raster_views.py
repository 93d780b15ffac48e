"""SQL blocks for components, seeds and label planes, used by the raster queries."""

from __future__ import annotations

from tessella.plans import views  # noqa: F401  (defines the blocks used below)
from tessella.plans.registry import view

PIX = "y * 4294967296 + x"


def component_views(name: str, cells: str) -> None:
    """4-connected components of ``cells`` (image_id, x, y, cls): walk from local first pixels."""
    view(f"{name}_cells", cells)
    view(
        f"{name}_starts",
        f"""select c.* from {name}_cells c left join {name}_cells l on l.image_id = c.image_id and l.x = c.x - 1 and l.y = c.y and l.cls = c.cls
        left join {name}_cells t on t.image_id = c.image_id and t.x = c.x and t.y = c.y - 1 and t.cls = c.cls
        where l.x is null and t.x is null""",
    )
    view(
        f"{name}_next",
        f"""select a.image_id, a.x, a.y, a.cls, b.x as nx, b.y as ny from
        (select c.*, c.x + s.dx as tx, c.y + s.dy as ty from {name}_cells c cross join step4 s) a
        join {name}_cells b on b.image_id = a.image_id and b.x = a.tx and b.y = a.ty and b.cls = a.cls""",
    )
    view(
        f"{name}_walk",
        f"""select image_id, x, y, cls, {PIX} as root from {name}_starts union
        select n.image_id, n.nx, n.ny, n.cls, w.root from {name}_walk w join {name}_next n
        on n.image_id = w.image_id and n.x = w.x and n.y = w.y and n.cls = w.cls""",
    )
    view(
        f"{name}_parts",
        f"select image_id, x, y, cls, min(root) as component from {name}_walk group by image_id, x, y, cls",
    )


component_views("free", "select image_id, x, y, 0 as cls from px where a < 128")
component_views("blob", "select image_id, x, y, 0 as cls from seed_px where a > 0")

view(
    "blob_mid",
    "select image_id, component, sum(x)::bigint // count(*) as cx, sum(y)::bigint // count(*) as cy from blob_parts group by all",
)
view(
    "blob_at",
    """select image_id, component, min({'d': (x - cx) * (x - cx) + (y - cy) * (y - cy), 'y': y, 'x': x}) as spot
    from blob_parts join blob_mid using (image_id, component) group by all""",
)
view(
    "blob_color",
    """select image_id, component, min({'o': -n, 'r': r, 'g': g, 'b': b}) as c, sum(n)::bigint as solid from
    (select image_id, component, r, g, b, count(*) as n from blob_parts join seed_px using (image_id, x, y) where a = 255 group by all) group by all""",
)
view(
    "seeds",
    """select image_id, row_number() over (partition by image_id order by spot.y, spot.x) - 1 as seed_id, spot.x as ax, spot.y as ay,
    coalesce(c.r, 0) as r, coalesce(c.g, 0) as g, coalesce(c.b, 0) as b, coalesce(solid, 0) as solid_area
    from blob_at left join blob_color using (image_id, component)""",
)
view(
    "stand",
    """select s.image_id, s.seed_id, f.component, min(s.seed_id) over (partition by s.image_id, f.component) as owner
    from seeds s join free_parts f on f.image_id = s.image_id and f.x = s.ax and f.y = s.ay""",
)
view(
    "grown",
    """select p.image_id, p.x, p.y, p.a >= 128 as line, f.component, s.owner as label from px p
    left join free_parts f using (image_id, x, y)
    left join (select distinct image_id, component, owner from stand) s on s.image_id = p.image_id and s.component = f.component""",
)


def nearest_view(name: str, source: str) -> None:
    """Nearest label in L1 distance, ties to the lowest id: two sweeps by row, two by column."""
    view(
        f"{name}_rows",
        f"""select image_id, x, y,
        min(case when label is not null then {{'d': -x, 'l': label}} end) over (partition by image_id, y order by x) as lo,
        min(case when label is not null then {{'d': x, 'l': label}} end) over (partition by image_id, y order by x desc) as hi from {source}""",
    )
    view(
        f"{name}_row",
        f"""select image_id, x, y, d, least(case when lo.d + x = d then lo.l end, case when hi.d - x = d then hi.l end) as l
        from (select *, least(lo.d + x, hi.d - x) as d from {name}_rows)""",
    )
    view(
        f"{name}_cols",
        f"""select image_id, x, y,
        min(case when d is not null then {{'d': d - y, 'l': l}} end) over (partition by image_id, x order by y) as lo,
        min(case when d is not null then {{'d': d + y, 'l': l}} end) over (partition by image_id, x order by y desc) as hi from {name}_row""",
    )
    view(
        f"{name}_closed",
        f"""select image_id, x, y, least(lo.d + y, hi.d - y) as wave,
        least(case when lo.d + y = least(lo.d + y, hi.d - y) then lo.l end, case when hi.d - y = least(lo.d + y, hi.d - y) then hi.l end) as closed
        from {name}_cols""",
    )


nearest_view("holed", "holed_px")
nearest_view("wide", "holed_mosaic")
nearest_view("full", "grown")

view("master", "select image_id, closed as label, count(*) as area, min(y * 4294967296 + x) as first_pixel from full_closed where closed is not null group by all")
view(
    "votes",
    """select c.image_id, c.x // 2 as x, c.y // 2 as y, c.closed as label, count(*) as n, any_value(m.area) as area
    from full_closed c join master m on m.image_id = c.image_id and m.label = c.closed group by all""",
)
view(
    "halved",
    """select v.image_id, v.x, v.y, min({'o': -n, 'a': area, 'l': label}).l as label, min({'o': -n, 'a': area, 'l': label}).a as area,
    any_value(q.alpha) as alpha from votes v join (select image_id, x // 2 as x, y // 2 as y, (sum(a)::bigint + 2) // 4 as alpha from px group by all) q
    using (image_id, x, y) group by all""",
)
view("dil0", "select image_id, x, y, label, area, alpha >= 32 as line, alpha < 32 as done from halved")
for _n in (1, 2):
    view(
        f"dil{_n}",
        f"""select p.image_id, p.x, p.y, coalesce(b.l, p.label) as label, coalesce(b.a, p.area) as area, p.line, p.done or b.l is not null as done from dil{_n - 1} p
        left join (select p.image_id, p.x, p.y, min({{'a': q.area, 'l': q.label}}).l as l, min({{'a': q.area, 'l': q.label}}).a as a
        from dil{_n - 1} p cross join step4 s join dil{_n - 1} q on q.image_id = p.image_id and q.x = p.x + s.dx and q.y = p.y + s.dy and q.done
        where not p.done group by all) b using (image_id, x, y)""",
    )
view(
    "out_stats",
    """select image_id, label, count(*) as area, min(x) as bx, min(y) as by, max(x) - min(x) + 1 as bw, max(y) - min(y) + 1 as bh,
    sum(x)::bigint // count(*) as cx, sum(y)::bigint // count(*) as cy from dil2 group by all""",
)
component_views("out", "select image_id, x, y, label as cls from dil2")

# Fragments below 12 pixels: steps over line pixels to regions and other fragments, then the settling in raster order.
MERGE_AREA, MERGE_STEPS, MERGE_ROUNDS = 12, 40, 8
view(
    "loose",
    f"select image_id, component as f from grown where component is not null and label is null group by image_id, component having count(*) < {MERGE_AREA}",
)
view(
    "land",
    "select g.image_id, g.x, g.y, g.line, g.label, l.f from grown g left join loose l on l.image_id = g.image_id and l.f = g.component",
)
view(
    "ring",
    f"""select image_id, f, x, y, 0 as d from land where f is not null union
    select r.image_id, r.f, p.x, p.y, r.d + 1 from ring r cross join step4 s join land p on p.image_id = r.image_id and p.x = r.x + s.dx and p.y = r.y + s.dy
    where p.line and p.label is null and r.d < {MERGE_STEPS}""",
)
view(
    "reach",
    """select r.image_id, r.f, p.label, p.f as other, min(r.d) + 1 as d from ring r cross join step4 s
    join land p on p.image_id = r.image_id and p.x = r.x + s.dx and p.y = r.y + s.dy
    where p.label is not null or (p.f is not null and p.f < r.f) group by all""",
)
view("grown_area", "select image_id, label, count(*) as area from grown where label is not null group by all")
view(
    "settle0",
    """select r.image_id, r.f, r.d, a.area, r.label from reach r join grown_area a using (image_id, label)
    qualify row_number() over (partition by r.image_id, r.f order by r.d, a.area desc, r.label) = 1""",
)
for _n in range(1, MERGE_ROUNDS):
    view(
        f"settle{_n}",
        f"""select image_id, f, d, area, label from (select image_id, f, d, area, label from settle0 union all
        select r.image_id, r.f, r.d, s.area, s.label from reach r join settle{_n - 1} s on s.image_id = r.image_id and s.f = r.other
        where r.d <= coalesce((select n.d from settle0 n where n.image_id = r.image_id and n.f = r.f), {MERGE_STEPS}))
        qualify row_number() over (partition by image_id, f order by d, area desc, label) = 1""",
    )
