"""Seeds, region growing, fragment merging and region statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import hex_color, idiv
from tessella.functions.shape import key_x, key_y, raster_key
from tessella.operators.chunked import attach_totals, fan_out, row_numbers, spread_join
from tessella.operators.components import TILE, component_runs, components, star_forest
from tessella.session import materialize

MIN_SEED_AREA = 64
MIN_ORPHAN_AREA = 500
SOLID = 255

STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))


def tile_id(tile: int = TILE) -> Column:
    """A chunk of at most ``tile * tile`` pixels."""
    return raster_key(idiv("x", tile), idiv("y", tile))


# --- statistics -----------------------------------------------------------------------------


def line_ratio(px: DataFrame, line: Column) -> DataFrame:
    """Share of line pixels per image; 0 when nothing was counted."""
    return px.groupBy("image_id").agg(
        F.coalesce(F.avg(line.cast("int")), F.lit(0.0)).alias("line_ratio")
    )


def box_struct() -> Column:
    """``[x, y, w, h]`` of the grouped pixels."""
    return F.struct(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
    )


def region_stats(labels: DataFrame, *keys: str) -> DataFrame:
    """Area, box, truncated-mean centroid and first raster pixel per region."""
    keys = keys or ("image_id", "label")
    return (
        labels.where(F.col(keys[-1]).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("area"),
            box_struct().alias("bbox"),
            F.struct(
                idiv(F.sum("x"), F.count(F.lit(1))).cast("int").alias("x"),
                idiv(F.sum("y"), F.count(F.lit(1))).cast("int").alias("y"),
            ).alias("centroid"),
            F.min(raster_key("x", "y")).alias("first_pixel"),
        )
    )


def palette(regions: DataFrame) -> DataFrame:
    """Distinct colours by total area, largest first, ties to the lower region id.

    ``regions`` holds ``image_id, id, area, suggested_color``.
    """
    colors = regions.groupBy("image_id", "suggested_color").agg(
        F.sum("area").alias("area"), F.min("id").alias("id")
    )
    # A hex colour has 2**24 values at most, and an image 65,535 regions at most.
    return colors.groupBy("image_id").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct((-F.col("area")).alias("o"), "id", "suggested_color"))
            ),
            lambda s: s["suggested_color"],
        ).alias("palette")
    )


# --- seeds ----------------------------------------------------------------------------------


def read_seeds(seed_px: DataFrame, tile: int = TILE) -> DataFrame:
    """Every 4-connected blob of visible pixels is a seed, numbered by raster order of anchor.

    Gives ``image_id, seed_id, ax, ay, r, g, b, solid_area``.
    """
    blobs = components(seed_px.where("a > 0"), F.lit(0), tile).select(
        "image_id", "x", "y", F.col("component").alias("blob")
    )
    pixels = materialize(seed_px.select("image_id", "x", "y", "r", "g", "b", "a").join(blobs.hint("merge"), ["image_id", "x", "y"]), "blobs")
    centred = attach_totals(
        pixels,
        ["image_id", "blob"],
        tile_id(tile),
        {
            "n": ("count", F.lit(1)),
            "sx": ("sum", F.col("x").cast("long")),
            "sy": ("sum", F.col("y").cast("long")),
        },
    )
    dx = F.col("x") - idiv("sx", F.col("n"))
    dy = F.col("y") - idiv("sy", F.col("n"))
    anchors = centred.groupBy("image_id", "blob").agg(
        F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("y"), F.col("x"))).alias("at"),
        F.count(F.when(F.col("a") == SOLID, 1)).alias("solid_area"),
    )
    # Most frequent solid colour, ties to the lexicographically smallest.
    colors = (
        pixels.where(F.col("a") == SOLID)
        .groupBy("image_id", "blob", "r", "g", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("image_id", "blob")
        .agg(F.min(F.struct((-F.col("n")).alias("o"), "r", "g", "b")).alias("c"))
    )
    rgb = [F.coalesce(F.col(f"c.{k}"), F.lit(0)).cast("int").alias(k) for k in "rgb"]
    seeds = materialize(
        anchors.join(colors.hint("merge"), ["image_id", "blob"], "left").select(
            "image_id",
            F.col("at.x").alias("ax"),
            F.col("at.y").alias("ay"),
            *rgb,
            "solid_area",
        ),
        "seeds",
    )
    return row_numbers(
        seeds, ["image_id"], F.col("ay").cast("long"), [F.col("ay"), F.col("ax")], "seed_id"
    )


# --- growing --------------------------------------------------------------------------------


def grow(seeds: DataFrame, px: DataFrame, tile: int = TILE) -> dict[str, DataFrame]:
    """Give every closed area to the first seed that stands in it.

    ``px`` holds ``image_id, x, y, line``.  The result has ``pixels`` (``label`` is NULL where no
    seed reached, ``component`` is NULL on lines), ``collisions`` (owner, seed) and ``on_line``.
    """
    # Lines are a class of their own, so that every pixel comes back and none has to be joined again.
    both = components(px, F.col("line").cast("int"), tile)
    line = F.col("cls") == 1
    free = materialize(
        both.select("image_id", "x", "y", line.alias("line"), F.when(~line, F.col("component")).alias("component")), "free"
    )
    at = seeds.select("image_id", "seed_id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    stand = at.join(free, ["image_id", "x", "y"])
    on_line = stand.where("line").select("image_id", "seed_id", "x", "y")
    owned = attach_totals(
        stand.where(~F.col("line")),
        ["image_id", "component"],
        F.col("y").cast("long"),
        {"owner": ("min", F.col("seed_id"))},
    )
    collisions = owned.where("seed_id > owner").select("image_id", "owner", "seed_id")
    owners = owned.where("seed_id = owner").select(
        "image_id", "component", F.col("seed_id").alias("label")
    )
    pixels = spread_join(free, owners, ["image_id", "component"], tile_id(tile)).select(
        "image_id", "x", "y", "line", "component", "label"
    )
    return {"pixels": pixels, "collisions": collisions, "on_line": on_line}


def orphans(grown: DataFrame) -> DataFrame:
    """Closed areas without a seed: area, box and first pixel (before closing)."""
    return (
        grown.where("component is not null and label is null")
        .groupBy("image_id", "component")
        .agg(F.count(F.lit(1)).alias("area"), box_struct().alias("bbox"))
        .select(
            "image_id",
            "component",
            "area",
            key_x("component").alias("x"),
            key_y("component").alias("y"),
            "bbox",
        )
    )


# --- merging of small fragments -------------------------------------------------------------


#: What a pixel is to a fragment that looks for its region.
NOTHING, LINE, REGION, FRAGMENT, OUTSIDE = range(5)
_FOUND_SCHEMA = "image_id long, tx int, ty int, f long, what int, target long, x int, y int, d int"
_FAR = 1 << 30


def _pack_tile(table: pa.Table) -> pa.Table:
    """One row for a tile: its corner, its width, and kind and value of each cell."""
    x, y = (table.column(c).to_numpy() for c in ("x", "y"))
    x0, y0 = int(x.min()), int(y.min())
    width, height = int(x.max()) - x0 + 1, int(y.max()) - y0 + 1
    kind, value = np.zeros(width * height, np.uint8), np.full(width * height, -1, np.int64)
    at = (y - y0) * width + (x - x0)
    kind[at], value[at] = table.column("kind").to_numpy(), table.column("value").to_numpy()
    row = {c: [table.column(c)[0].as_py()] for c in ("image_id", "tx", "ty")}
    row |= {"x0": [x0], "y0": [y0], "width": [width], "kinds": [kind.tobytes()], "values": [value.tobytes()]}
    return pa.table({k: pa.array(v, {"image_id": pa.int64(), "kinds": pa.binary(), "values": pa.binary()}.get(k, pa.int32())) for k, v in row.items()})


class _Tile:
    """The cells of a tile with a border of cells that are outside."""

    def __init__(self, x0: int, y0: int, width: int, kinds: bytes, values: bytes):
        kind = np.frombuffer(kinds, np.uint8).reshape(-1, width)
        self.width, self.x0, self.y0 = width + 2, x0 - 1, y0 - 1
        self.kind = np.pad(kind, 1, constant_values=OUTSIDE).ravel()
        self.value = np.pad(np.frombuffer(values, np.int64).reshape(-1, width), 1, constant_values=-1).ravel()

    def cells(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (y - self.y0) * self.width + (x - self.x0)

    def search(self, names: np.ndarray, limits: np.ndarray, start: dict[int, np.ndarray], begin: np.ndarray | None):
        """Rings of line cells around all fragments at once; yields (what, fragments, values, cells, distance).

        A state is a fragment's number times the number of cells, plus a cell. ``start`` has states to be looked at, by
        distance; those of ``begin`` are the fragments' own cells. A fragment stops after the ring with its first region.
        """
        n = len(self.kind)
        limits, seen = limits.copy(), np.empty(0, np.int64)
        steps = np.array([-1, 1, -self.width, self.width])
        ahead, d = begin, 0
        while start or ahead is not None:
            if ahead is not None:
                d += 1
                states = (ahead[:, None] + steps).ravel()
            else:
                d, states = min(start), np.empty(0, np.int64)
            states = np.unique(np.concatenate([states, start.pop(d, np.empty(0, np.int64))]))
            f, cell = np.divmod(states, n)
            near = limits[f] >= d
            states, f, cell = states[near], f[near], cell[near]
            kind = self.kind[cell]
            for what in (REGION, FRAGMENT, OUTSIDE):
                hit = kind == what
                if what == FRAGMENT:
                    hit &= self.value[cell] != names[f]
                if hit.any():
                    yield what, f[hit], self.value[cell[hit]], cell[hit], d
            stop = f[kind == REGION]
            limits[stop] = np.minimum(limits[stop], d)
            fresh = states[(kind == LINE) & (limits[f] > d)]
            fresh = fresh[~np.isin(fresh, seen)]
            seen = np.union1d(seen, fresh)
            ahead = fresh if len(fresh) else None


def _found(tile: _Tile, key: tuple[int, int, int], names: np.ndarray, limits: np.ndarray, start: dict, begin: np.ndarray | None) -> pa.Table:
    parts = [[np.empty(0, np.int64)] for _ in range(6)]
    for what, f, value, cell, d in tile.search(names, limits, start, begin):
        y, x = np.divmod(cell, tile.width)
        columns = (names[f], np.full(len(f), what), value, x + tile.x0, y + tile.y0, np.full(len(f), d))
        for part, column in zip(parts, columns):
            part.append(column)
    f, what, value, x, y, d = (np.concatenate(p) for p in parts)
    ints = lambda a: a.astype(np.int32)
    place = {c: np.full(len(f), k, t) for c, k, t in zip(("image_id", "tx", "ty"), key, (np.int64, np.int32, np.int32))}
    return pa.table({**place, "f": f, "what": ints(what), "target": value, "x": ints(x), "y": ints(y), "d": ints(d)})


def _search_from_own(table: pa.Table) -> pa.Table:
    """The first search of a tile, from all cells of its fragments."""
    row = {c: table.column(c)[0].as_py() for c in table.column_names}
    tile = _Tile(row["x0"], row["y0"], row["width"], row["kinds"], row["values"])
    own = np.flatnonzero(tile.kind == FRAGMENT)
    names, number = np.unique(tile.value[own], return_inverse=True)
    begin = number.astype(np.int64) * len(tile.kind) + own
    return _found(tile, (row["image_id"], row["tx"], row["ty"]), names, np.full(len(names), _FAR), {}, begin if len(begin) else None)


def _search_from_arrivals(tiles: pa.Table, arrivals: pa.Table) -> pa.Table:
    """Goes on in a tile from the cells that searches of its neighbours have reached."""
    row = {c: tiles.column(c)[0].as_py() for c in tiles.column_names}
    tile = _Tile(row["x0"], row["y0"], row["width"], row["kinds"], row["values"])
    f, x, y, d, most = (arrivals.column(c).to_numpy().astype(np.int64) for c in ("f", "x", "y", "d", "most"))
    names, number = np.unique(f, return_inverse=True)
    limits = np.full(len(names), _FAR)
    np.minimum.at(limits, number, most)
    states = number * len(tile.kind) + tile.cells(x, y)
    return _found(tile, (row["image_id"], row["tx"], row["ty"]), names, limits, {int(k): states[d == k] for k in np.unique(d)}, None)


def _ring_targets(grown: DataFrame, small: DataFrame, tile: int) -> DataFrame:
    """Distance over line pixels from every fragment to the regions and fragments it can reach.

    Every tile searches from all its fragments at once, ring by ring. A search that leaves a tile arrives in the
    next one with its distance; arrivals that are nearer than what is known there, and not beyond the
    fragment's nearest region so far, are searched on. So there is a round for every tile that a shortest way
    crosses, however thick the lines are, and a round reads only tiles in which something arrives.
    Targets beyond the ring of the nearest region are dropped, since nothing farther can win.
    """
    land = spread_join(
        grown,
        small.select("image_id", "component", F.col("component").alias("fragment")),
        ["image_id", "component"],
        tile_id(tile),
    )
    kind = (
        F.when(F.col("label").isNotNull(), REGION)
        .when(F.col("fragment").isNotNull(), FRAGMENT)
        .when(F.col("line"), LINE)
        .otherwise(NOTHING)
    )
    place = [idiv(c, tile).cast("int").alias(f"t{c}") for c in "xy"]
    cells = land.select(
        "image_id", *place, "x", "y", kind.alias("kind"), F.coalesce("label", "fragment", F.lit(-1).cast("long")).alias("value")
    )
    key = ["image_id", "tx", "ty"]
    tiles = materialize(
        fan_out(cells, *key).groupBy(*key).applyInArrow(
            _pack_tile, "image_id long, tx int, ty int, x0 int, y0 int, width int, kinds binary, values binary"
        ),
        "land",
    )
    out = materialize(fan_out(tiles, *key).groupBy(*key).applyInArrow(_search_from_own, _FOUND_SCHEMA), "found")
    found, known = out, None
    while True:
        nearest = found.where(F.col("what") == REGION).groupBy("image_id", "f").agg(F.min("d").alias("most"))
        spot = ["image_id", "f", "x", "y"]
        # What leaves a tile for no other one has left the image.
        left = (F.floor(F.col("x") / tile) != F.col("tx")) | (F.floor(F.col("y") / tile) != F.col("ty"))
        fresh = out.where((F.col("what") == OUTSIDE) & left & (F.col("x") >= 0) & (F.col("y") >= 0)).groupBy(*spot).agg(F.min("d").alias("d"))
        fresh = fresh.join(nearest, ["image_id", "f"], "left").withColumn("most", F.coalesce("most", F.lit(_FAR))).where("d <= most")
        if known is not None:
            best = known.groupBy(*spot).agg(F.min("d").alias("_d"))
            fresh = fresh.join(best, spot, "left").where("_d is null or d < _d").drop("_d")
        fresh = materialize(fresh.select("*", *place), "arrivals")
        here = tiles.join(fresh.select(*key).distinct(), key, "left_semi")
        if here.isEmpty():
            break
        known = fresh if known is None else known.unionByName(fresh)
        searched = fan_out(here, *key).groupBy(*key).cogroup(fan_out(fresh, *key).groupBy(*key))
        # Arrivals off the image have no tile, so their side stands alone.
        out = materialize(searched.applyInArrow(_search_or_nothing, _FOUND_SCHEMA), "found")
        found = found.unionByName(out)
    hits = found.where(F.col("what") != OUTSIDE).groupBy("image_id", "f", "what", "target").agg(F.min("d").alias("d"))
    hits = hits.join(nearest, ["image_id", "f"], "left").where(F.col("d") <= F.coalesce("most", F.lit(_FAR)))
    of = lambda what, name: F.when(F.col("what") == what, F.col("target")).alias(name)
    return hits.select("image_id", "f", "d", of(REGION, "label"), of(FRAGMENT, "fragment"))


def _search_or_nothing(tiles: pa.Table, arrivals: pa.Table) -> pa.Table:
    if tiles.num_rows and arrivals.num_rows:
        return _search_from_arrivals(tiles, arrivals)
    empty = _Tile(0, 0, 1, bytes(1), bytes(8))
    return _found(empty, (0, 0, 0), np.empty(0, np.int64), np.empty(0, np.int64), {}, None)


_FOLD_SCHEMA = "image_id long, component long, label long"


def _fold_fragments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle fragments in raster order; rows arrive sorted by image, group, fragment and distance.

    Only fragments that a later one can reach are remembered, and only within a group.
    """
    image = group = frag = None
    settled: dict[int, tuple[int, int]] = {}
    best: tuple[int, int] | None = None
    best_d = 0
    wanted = False

    def close():
        if frag is None or best is None:
            return []
        area, label = -best[0], best[1]
        if wanted:
            settled[frag] = (area, label)
        return [(image, frag, label)]

    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if row.image_id != image or row.group != group or row.component != frag:
                out += close()
                if row.image_id != image or row.group != group:
                    settled = {}
                image, group, frag, best, wanted = row.image_id, row.group, row.component, None, row.wanted
            if row.other >= 0:
                area, label = settled.get(row.other, (0, -1))
                if label < 0:
                    continue
            else:
                area, label = row.area, row.label
            if best is None or row.d == best_d:
                here = (-area, label)
                if best is None or here < best:
                    best, best_d = here, row.d
        yield pd.DataFrame(out, columns=["image_id", "component", "label"]).astype("int64")
    yield pd.DataFrame(close(), columns=["image_id", "component", "label"]).astype("int64")


def merge_fragments(
    grown: DataFrame, min_area: int = MIN_ORPHAN_AREA, tile: int = TILE
) -> tuple[DataFrame, DataFrame]:
    """Give fragments below ``min_area`` to the largest region of the nearest ring.

    Returns the pixels with merged labels and the orphans that are left (``area >= min_area``).
    Areas are those before merging.  A fragment may join a fragment settled earlier in raster
    order; that dependency is the only sequential part. It runs over the fragment table, in groups of
    fragments that can reach each other, sorted by Spark and streamed.
    """
    grown = materialize(grown, "grown")
    lost = orphans(grown)
    kept = lost.where(F.col("area") >= min_area)
    small = materialize(lost.where(F.col("area") < min_area), "fragments")
    if small.isEmpty():
        return grown, kept
    targets = materialize(_ring_targets(grown, small, tile), "targets")
    areas = grown.where("label is not null").groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area")
    )
    rows = targets.join(areas, ["image_id", "label"], "left").select(
        "image_id",
        F.col("f").alias("component"),
        "d",
        F.coalesce("label", F.lit(-1)).alias("label"),
        F.coalesce("area", F.lit(0)).alias("area"),
        F.coalesce("fragment", F.lit(-1)).alias("other"),
    ).where("other < component")
    asked = rows.where("other >= 0").select("image_id", F.col("other").alias("component")).distinct()
    rows = rows.join(asked.withColumn("_asked", F.lit(True)), ["image_id", "component"], "left")
    edges = rows.where("other >= 0").select("image_id", F.col("component").alias("u"), F.col("other").alias("v"))
    stars = star_forest(edges).select("image_id", F.col("u").alias("component"), F.col("v").alias("_first"))
    settled = (
        rows.join(stars, ["image_id", "component"], "left")
        .withColumn("wanted", F.coalesce("_asked", F.lit(False)))
        .withColumn("group", F.coalesce("_first", "component"))
        .drop("_asked", "_first")
        .repartition("image_id", "group")
        .sortWithinPartitions("image_id", "group", "component", "d")
        .mapInPandas(_fold_fragments, _FOLD_SCHEMA)
    )
    merged = (
        spread_join(
            grown,
            settled.withColumnRenamed("label", "_merged"),
            ["image_id", "component"],
            tile_id(tile),
        )
        .withColumn("label", F.coalesce("label", "_merged"))
        .select("image_id", "x", "y", "line", "component", "label")
    )
    return merged, kept


# --- splits and checks of a finished map ----------------------------------------------------


def pieces_per_region(labels: DataFrame, tile: int = TILE) -> DataFrame:
    """Number of 4-connected pieces of every region."""
    parts = component_runs(labels, F.col("label"), tile)
    return (
        parts.select("image_id", F.col("cls").alias("label"), "component")
        .distinct()
        .groupBy("image_id", "label")
        .agg(F.count(F.lit(1)).alias("pieces"))
    )


def region_table(stats: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pack-form region rows: id, centroid, area, box and suggested colour."""
    colors = seeds.select(
        "image_id", F.col("seed_id").alias("label"), hex_color("r", "g", "b").alias("suggested_color")
    )
    return stats.join(colors, ["image_id", "label"]).select(
        "image_id", F.col("label").alias("id"), "centroid", "area", "bbox", "suggested_color"
    )
