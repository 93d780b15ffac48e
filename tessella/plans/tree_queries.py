"""Tree hashes of label planes, small and large, and the tiles in which two planes differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import tree_hash as H
from tessella.plans import views as V
from tessella.plans.registry import query, view

TREE_TILE, TREE_FAN, LEVELS = 8, 4, 10
#: The image number of the plane that holds every row.
WIDE = -1


def _le(n: str, size: int) -> str:
    return " || ".join(f"printf('%02x', (({n}) // {256 ** i} % 256)::int)" for i in range(size))


view(
    "plane_px",
    f"select image_id, x, y, label from labels_px union all select {WIDE}, x, y, (x // 5 + 52 * (y // 5)) % 60000 from mosaic",
)
view("plane_size", "select image_id, max(x) + 1 as w, max(y) + 1 as h from plane_px group by image_id")
view(
    "tree0",
    f"""select image_id, 0 as level, ty * ((any_value(w) + {TREE_TILE - 1}) // {TREE_TILE}) + tx as node,
    sha256(unhex('00' || {_le('tx', 4)} || {_le('ty', 4)} || string_agg({_le('label', 2)}, '' order by y, x))) as digest
    from (select *, x // {TREE_TILE} as tx, y // {TREE_TILE} as ty from plane_px) join plane_size using (image_id) group by image_id, tx, ty""",
)
for _n in range(1, LEVELS):
    view(
        f"tree{_n}",
        f"""select image_id, {_n} as level, node // {TREE_FAN} as node, sha256(unhex('01' || string_agg(digest, '' order by node))) as digest
        from tree{_n - 1} where image_id in (select image_id from tree{_n - 1} group by image_id having count(*) > 1) group by image_id, node // {TREE_FAN}""",
    )
view("tree_nodes", " union all ".join(f"select image_id, level, node, digest from tree{n}" for n in range(LEVELS)))


def planes(spark, sf):
    """All small planes and the wide one, with their sizes."""
    wide = V.mosaic(spark, sf).selectExpr(f"{WIDE}L as image_id", "x", "y", "cast((x div 5 + 52 * (y div 5)) % 60000 as bigint) as label")
    size = wide.agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    images = V.images(spark, sf).unionByName(size.withColumn("image_id", F.lit(WIDE).cast("long")))
    return V.labels_px(spark, sf).select("image_id", "x", "y", "label").unionByName(wide), images


@query("tree_nodes", "select * from tree_nodes")
def tree_nodes(spark, sf):
    """Digests of all tiles and of the nodes above them."""
    nodes = H.tree(*planes(spark, sf), TREE_TILE, TREE_FAN)
    return nodes.withColumn("digest", F.lower(F.hex("digest")))


@query(
    "tree_hash",
    f"""select image_id, 'sha256-tree-1:' || sha256(unhex('02' || {_le('w', 4)} || {_le('h', 4)} || {_le(str(TREE_TILE), 4)} || digest)) as tree_hash
    from (select image_id, arg_max(digest, level) as digest from tree_nodes group by image_id) join plane_size using (image_id)""",
)
def tree_hash(spark, sf):
    labels, images = planes(spark, sf)
    return H.tree_hash(H.tree(labels, images, TREE_TILE, TREE_FAN), images, TREE_TILE)


_HURT = "(x * 31 + y * 17 + image_id) % 701 = 3"


@query(
    "damaged_tiles",
    f"""select distinct image_id, x // {TREE_TILE} as tx, y // {TREE_TILE} as ty from plane_px where {_HURT}""",
)
def damaged_tiles(spark, sf):
    """Some pixels carry the next id: their tiles are named from the stored digests alone."""
    labels, images = planes(spark, sf)
    hurt = labels.withColumn("label", F.when(F.expr(_HURT), F.col("label") + 1).otherwise(F.col("label")))
    stored, found = (H.tree(p, images, TREE_TILE, TREE_FAN) for p in (labels, hurt))
    return H.damaged_tiles(stored, found, images, TREE_TILE, TREE_FAN)
