"""4-connected components over a pixel table, for images of any size.

Pixels are folded to runs of equal class along the rows, cut at the borders of the tiles; everything after that
moves runs. Every tile labels its runs on its own (a tile is a bounded group). Runs that touch across a border are
found by an interval join and give edges between the labels of two tiles. Eight by eight tiles make a block,
eight by eight blocks the next larger one, and so on: an edge is resolved in the smallest block that holds both
of its tiles, after its ends have been renamed by the smaller blocks. A block of any level only sees the edges on
its inner borders, so no group grows with the image, and the number of levels is the logarithm of the widest
image. A component is named by the raster key of its first pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.color import idiv
from tessella.functions.shape import ROW_SHIFT, raster_key
from tessella.operators.chunked import attach_totals, fan_out
from tessella.operators.intervals import overlap_join
from tessella.session import materialize

TILE = 256
#: Blocks per side that are merged at each level, and the most levels: 8**7 tiles a side.
MERGE = 8
MAX_LEVELS = 7

_RUN_SCHEMA = "image_id long, tx int, ty int, y int, x0 int, x1 int, cls long, root long"


def _resolve(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable node per node: hook the larger parent, then halve the paths."""
    parent = np.arange(n)
    while True:
        a, b = parent[first], parent[second]
        differ = a != b
        if not differ.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            grand = parent[parent]
            if (grand == parent).all():
                break
            parent = grand


def row_runs(px: DataFrame, cls: Column, tile: int = TILE) -> DataFrame:
    """Runs ``image_id, tx, ty, y, x0, x1, cls`` of the pixels whose class is not NULL, dealt by tile."""
    cells = px.select(
        F.col("image_id").cast("long").alias("image_id"),
        F.col("x").cast("int").alias("x"),
        F.col("y").cast("int").alias("y"),
        cls.cast("long").alias("cls"),
    ).where("cls is not null")
    tiles = ["image_id", "tx", "ty"]
    dealt = fan_out(
        cells.withColumn("tx", idiv("x", tile).cast("int")).withColumn("ty", idiv("y", tile).cast("int")), *tiles
    )
    order = W.partitionBy(*tiles).orderBy("y", "x")
    before = F.lag(F.struct("y", (F.col("x") + 1).alias("x"), "cls")).over(order)
    opened = dealt.withColumn("_new", (~before.eqNullSafe(F.struct("y", "x", "cls"))).cast("int"))
    numbered = opened.withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy(*tiles, "_run").agg(
        F.min("y").alias("y"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("cls").alias("cls")
    ).drop("_run")


def _label_tile(table: pa.Table) -> pa.Table:
    """Components inside one tile: runs of rows below each other that overlap and have one class."""
    y, x0, x1, cls = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "cls"))
    order = np.lexsort((x0, y))
    y, x0, x1, cls = y[order], x0[order], x1[order], cls[order]
    starts, ends = (y << ROW_SHIFT) | x0, (y << ROW_SHIFT) | x1
    below = (y + 1) << ROW_SHIFT
    first = np.searchsorted(ends, below | x0)
    many = np.searchsorted(starts, below | x1, "right") - first
    upper = np.repeat(np.arange(len(y)), many)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    same = cls[upper] == cls[lower]
    # Runs are in raster order, so the smallest run number is the first pixel.
    root = starts[_resolve(upper[same], lower[same], len(y))]
    out = table.take(pa.array(order))
    return out.select(["image_id", "tx", "ty", "y", "x0", "x1", "cls"]).append_column("root", pa.array(root))


def _border_edges(runs: DataFrame, tile: int) -> DataFrame:
    """Edges ``image_id, tx, ty, nx, ny, a, b`` between labels of neighbouring tiles, (tx, ty) above or left of (nx, ny)."""
    side = ["image_id", "y", "cls"]
    left = runs.where(F.col("x1") % tile == tile - 1).select(*side, "tx", "ty", (F.col("x1") + 1).alias("x"), F.col("root").alias("a"))
    right = runs.where(F.col("x0") % tile == 0).select(*side, F.col("x0").alias("x"), F.col("root").alias("b"))
    beside = left.join(right, [*side, "x"]).select("image_id", "tx", "ty", (F.col("tx") + 1).alias("nx"), F.col("ty").alias("ny"), "a", "b")
    top = runs.where(F.col("y") % tile == tile - 1).select(
        "image_id", (F.col("y") + 1).alias("y"), "cls", "tx", "ty", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("root").alias("a")
    )
    low = runs.where(F.col("y") % tile == 0).select(*side, F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("root").alias("b"))
    under = overlap_join(top, low, side, ("a0", "a1"), ("b0", "b1"), tile).select(
        "image_id", "tx", "ty", F.col("tx").alias("nx"), (F.col("ty") + 1).alias("ny"), "a", "b"
    )
    return beside.unionByName(under).distinct()


def _level(merge: int) -> Column:
    """The smallest level whose block holds both tiles of an edge."""
    apart = [
        (idiv("tx", merge**n) != idiv("nx", merge**n)) | (idiv("ty", merge**n) != idiv("ny", merge**n))
        for n in range(1, MAX_LEVELS)
    ]
    return F.lit(1) + sum((a.cast("int") for a in apart), F.lit(0))


def _resolve_block(table: pa.Table) -> pa.Table:
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    first = nodes[_resolve(index[: len(a)], index[len(a) :], len(nodes))]
    moved = nodes != first
    image = np.full(int(moved.sum()), table.column("image_id")[0].as_py(), dtype=np.int64)
    return pa.table({"image_id": image, "node": nodes[moved], "name": first[moved]})


def _renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """``df`` with the new name where the column has one."""
    to = names.select("image_id", F.col("node").alias(column), F.col("name").alias("_name"))
    return df.join(to.hint("merge"), ["image_id", column], "left").withColumn(column, F.coalesce("_name", column)).drop("_name")


def block_names(edges: DataFrame, merge: int = MERGE) -> DataFrame:
    """``image_id, node, name`` for the labels that have a smaller one in their component."""
    edges = materialize(edges.withColumn("level", _level(merge)), "edges")
    names, top = None, edges.agg(F.max("level")).first()[0] or 0
    for level in range(1, top + 1):
        block = [idiv(c, merge**level).alias(f"b{c}") for c in ("tx", "ty")]
        here = (
            edges.where(F.col("level") == level)
            .select("image_id", *block, "a", "b")
            .groupBy("image_id", "btx", "bty")
            .applyInArrow(_resolve_block, "image_id long, node long, name long")
        )
        if level < top:
            here = materialize(here, "names")
            edges = materialize(_renamed(_renamed(edges.where(F.col("level") > level), here, "a"), here, "b"), "edges")
        names = here if names is None else _renamed(names, here, "name").unionByName(here)
    if names is None:
        return edges.select("image_id", F.col("a").alias("node"), F.col("b").alias("name")).limit(0)
    return names


def component_runs(px: DataFrame, cls: Column, tile: int = TILE, merge: int = MERGE) -> DataFrame:
    """Runs ``image_id, y, x0, x1, cls, component``; neighbours connect when their class is equal."""
    runs = row_runs(px, cls, tile).groupBy("image_id", "tx", "ty").applyInArrow(_label_tile, _RUN_SCHEMA)
    runs = materialize(runs, "runs")
    names = block_names(_border_edges(runs, tile), merge)
    return _renamed(runs, names, "root").select("image_id", "y", "x0", "x1", "cls", F.col("root").alias("component"))


def components(px: DataFrame, cls: Column, tile: int = TILE, merge: int = MERGE) -> DataFrame:
    """Rows ``image_id, x, y, cls, component`` for the pixels whose class is not NULL.

    ``px`` holds ``image_id, x, y``; neighbours connect when their class is equal.
    """
    runs = component_runs(px, cls, tile, merge)
    return runs.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "cls", "component")


# --- graphs without a place ------------------------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round on edges ``u > v``; the minimum is taken over salted neighbour groups."""
    if large:
        both = edges.unionByName(edges.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    rows = attach_totals(
        both, ["image_id", "u"], F.shiftright("v", ROW_SHIFT), {"m": ("min", F.col("v"))}
    ).withColumn("m", F.least("m", "u"))
    if large:
        out = rows.where("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = rows.select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            rows.select("image_id", "u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every ``u`` points one way, and nothing that is pointed at points on."""
    ends = edges.select("image_id", F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(
        edges.select("image_id", F.col("v").alias("node"), F.lit(None).cast("int").alias("out")).distinct()
    )
    counts = ends.groupBy("image_id", "node").agg(F.count("out").alias("n_out"), F.count(F.lit(1)).alias("n"))
    return counts.where("n_out > 1 or (n_out = 1 and n > 1)").isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """Edges ``image_id, u, v`` with ``u > v`` to stars: every ``u`` points at the minimum of its component.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until only stars are left; each round lowers a pointer or ends.
    """
    current = materialize(edges.distinct(), "stars")
    while not _settled(current):
        current = materialize(_star(_star(current, large=True), large=False), "stars")
    return current
