"""A content hash of large label planes as a tree of tile digests, and damage found by descending it.

The hash of a whole pack frames one byte string per entry, so one task has to read an image to its end. Here
a plane is cut into tiles. A leaf is the digest of a tile's place and of its ids as little-endian 16-bit numbers, row
by row; ``FAN`` digests in the order of the tiles make one node of the next level, up to a single one, and
the root also covers the size of the plane. No group holds more than a tile or ``FAN`` digests, however
large the image is, and a changed pixel changes only the nodes on the path above its tile. The version tag
in front of the hash keeps it apart from the hash of whole packs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.color import idiv
from tessella.operators.runs import le_hex
from tessella.session import materialize

TILE = 256
FAN = 16
TREE_PREFIX = "sha256-tree-1:"
# First byte of what is digested: leaves, inner nodes and roots cannot stand for each other.
LEAF, NODE, ROOT = "00", "01", "02"


def _digest(kind: str, *hexed: Column) -> Column:
    return F.unhex(F.sha2(F.unhex(F.concat(F.lit(kind), *hexed)), 256))


def leaves(labels: DataFrame, images: DataFrame, tile: int = TILE) -> DataFrame:
    """``image_id, node, digest`` per tile; ``images`` holds ``image_id, width``, NULL labels count as 65,535."""
    at = labels.select(
        "image_id",
        idiv("x", tile).cast("long").alias("tx"),
        idiv("y", tile).cast("long").alias("ty"),
        "x",
        "y",
        F.coalesce(F.col("label").cast("long"), F.lit(0xFFFF)).alias("label"),
    )
    rows = at.groupBy("image_id", "ty", "tx", "y").agg(F.array_sort(F.collect_list(F.struct("x", le_hex(F.col("label"), 2).alias("h")))).alias("cells"))
    rows = rows.select("image_id", "ty", "tx", "y", F.array_join(F.transform("cells", lambda c: c["h"]), "").alias("h"))
    tiles = rows.groupBy("image_id", "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("y", "h"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["h"]), "")
    across = idiv(F.col("width").cast("long") + tile - 1, tile)
    return tiles.join(images.select("image_id", "width"), "image_id").select(
        "image_id",
        (F.col("ty") * across + F.col("tx")).alias("node"),
        _digest(LEAF, le_hex(F.col("tx"), 4), le_hex(F.col("ty"), 4), body).alias("digest"),
    )


def tree(labels: DataFrame, images: DataFrame, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """All nodes ``image_id, level, node, digest``; the highest level of an image has one node.

    ``images`` holds ``image_id, width, height``. The number of levels follows from the largest image.
    """
    tiles = idiv(F.col("width").cast("long") + tile - 1, tile) * idiv(F.col("height").cast("long") + tile - 1, tile)
    sizes = images.select("image_id", tiles.alias("nodes"))
    most = sizes.agg(F.max("nodes")).first()[0] or 0
    level = materialize(leaves(labels, images, tile), "leaves")
    out, depth = level.withColumn("level", F.lit(0)), 0
    while most > 1:
        most, depth = -(-most // fan), depth + 1
        # Images that already have one node at the level below end there.
        above = sizes.where(F.ceil(F.col("nodes") / F.lit(fan ** (depth - 1))) > 1)
        children = F.array_sort(F.collect_list(F.struct("node", F.hex("digest").alias("h"))))
        level = materialize(
            level.join(above, "image_id", "left_semi")
            .groupBy("image_id", idiv("node", fan).alias("parent"))
            .agg(children.alias("children"))
            .select(
                "image_id",
                F.col("parent").alias("node"),
                _digest(NODE, F.array_join(F.transform("children", lambda c: c["h"]), "")).alias("digest"),
            ),
            "level",
        )
        out = out.unionByName(level.withColumn("level", F.lit(depth)))
    return out.select("image_id", "level", "node", "digest")


def tree_hash(nodes: DataFrame, images: DataFrame, tile: int = TILE) -> DataFrame:
    """``image_id, tree_hash`` from the nodes of ``tree``."""
    top = nodes.groupBy("image_id").agg(F.max_by("digest", F.struct("level")).alias("digest"))
    size = [le_hex(F.col(c), 4) for c in ("width", "height")]
    root = F.lower(F.hex(_digest(ROOT, *size, le_hex(F.lit(tile), 4), F.hex("digest"))))
    return top.join(images.select("image_id", "width", "height"), "image_id").select(
        "image_id", F.concat(F.lit(TREE_PREFIX), root).alias("tree_hash")
    )


def damaged_tiles(stored: DataFrame, found: DataFrame, images: DataFrame, tile: int = TILE, fan: int = FAN) -> DataFrame:
    """Tiles ``image_id, tx, ty`` whose digests differ between two trees, ``stored`` and ``found``.

    Goes down from the roots: below a node that agrees nothing is compared. A node that one of the trees does not
    have counts as different.
    """
    top = stored.agg(F.max("level")).first()[0]
    if top is None:
        return images.select("image_id", F.lit(0).cast("long").alias("tx"), F.lit(0).cast("long").alias("ty")).limit(0)
    width = images.select("image_id", idiv(F.col("width").cast("long") + tile - 1, tile).alias("across"))
    mine = stored.withColumnRenamed("digest", "_a")
    other = found.withColumnRenamed("digest", "_b")
    roots = stored.groupBy("image_id").agg(F.max("level").alias("level"))
    differ = None
    for level in range(top, -1, -1):
        a, b = (t.where(F.col("level") == level).drop("level") for t in (mine, other))
        both = a.join(b, ["image_id", "node"], "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("image_id", "node")
        below = roots.where(F.col("level") == level).select("image_id")
        here = both.join(below, "image_id", "left_semi")
        if differ is not None:
            under = both.withColumn("parent", idiv("node", fan)).join(
                differ.withColumnRenamed("node", "parent"), ["image_id", "parent"], "left_semi"
            )
            here = here.unionByName(under.select("image_id", "node"))
        differ = here
    return differ.join(width, "image_id").select(
        "image_id", (F.col("node") % F.col("across")).alias("tx"), idiv("node", F.col("across")).alias("ty")
    )
