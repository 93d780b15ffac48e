"""The bake's gates: what stops where, pruned scans, all findings of a stage at once."""

from pyspark.sql import functions as F

from tessella.operators import findings as N
from tessella.plans import bake as B
from tessella.plans.params import BakeParams

SIDE = 16


def picture(line, dots):
    """Pixel rows of one image; ``line`` and ``dots`` say which are set."""
    at = [(x, y) for y in range(SIDE) for x in range(SIDE)]
    rows = lambda on: [(x, y, 9, 9, 9, 255 if on(x, y) else 0) for x, y in at]
    return rows(line), rows(dots)


def cross(x, y):
    return x in (7, 15) or y in (7, 15)


def test_gates_in_order(spark, tmp_path):
    good = lambda x, y: x % 8 in (2, 3) and y % 8 in (2, 3)
    one_short = lambda x, y: good(x, y) and not (x > 8 and y > 8)
    # 0 no line art, 1 sizes differ, 2 wrong profile and an area without seed at once, 3 gap in the line, 4 sound
    images = {0: (cross, good), 1: (cross, good), 2: (cross, one_short), 3: (lambda x, y: cross(x, y) and (x, y) != (7, 3), good), 4: (cross, good)}
    lines, dots = [], []
    for i, (line, dot) in images.items():
        a, b = picture(line, dot)
        lines += [(i, *r) for r in a]
        dots += [(i, *r) for r in b]
    schema = "image_id long, x int, y int, r int, g int, b int, a int"
    tables = []
    for name, rows in (("line", lines), ("dots", dots)):
        B.write_pixels(spark.createDataFrame(rows, schema), f"{tmp_path}/{name}")
        tables.append(spark.read.schema(schema).parquet(f"{tmp_path}/{name}"))
    layers = [(i, layer, 3072 if (i, layer) != (1, "seeds") else 2048, 4096, i != 2 or layer == "lineart", "icc") for i in images for layer in ("lineart", "seeds") if (i, layer) != (0, "lineart")]
    layers = spark.createDataFrame(layers, "image_id long, layer string, width int, height int, is_srgb boolean, basis string")
    frame = spark.createDataFrame([(i, f"art-{i}", "animal", SIDE, SIDE) for i in images], "image_id long, id string, category string, width int, height int")
    meta = frame.select("image_id", F.col("id").alias("folder_id"), "id", "category")
    made = B.bake(frame, *tables, None, BakeParams(min_seed_area=1, min_orphan_area=1), tile=8, layers=layers, meta=meta)
    errors = {}
    for r in made.diagnostics.where("severity = 'error'").collect():
        errors.setdefault(r.image_id, set()).add(r.code)
    assert errors == {0: {"source-incomplete"}, 1: {"size-mismatch"}, 2: {"color-space", "orphan-area"}, 3: {"seed-collision"}}
    assert {r.image_id for r in made.seeds.select("image_id").distinct().collect()} == {2, 3, 4}  # no pixels of the others
    assert {r.image_id for r in made.ids.select("image_id").distinct().collect()} == {4}
    assert [r.image_id for r in made.packs.collect()] == [4] and made.shade is None
    collision = made.diagnostics.where("code = 'seed-collision'").first()
    assert [(c.x, c.y, c["count"]) for c in collision.coords] == [(2, 2, 1), (10, 2, 1)] and collision.stage == "master"


def test_scans_are_pruned_by_the_gate(spark, tmp_path):
    px = spark.range(400).selectExpr("id % 10 as image_id", "cast(id % 20 as int) as x", "cast(id div 20 as int) as y", "1 as a")
    B.write_pixels(px, f"{tmp_path}/px")
    images = spark.range(10).withColumnRenamed("id", "image_id")
    found = N.finding(images.where("image_id < 7"), "size-mismatch")
    going = B.gate(images, found, "size-mismatch")
    read = B.of_images(spark.read.schema(px.schema).parquet(f"{tmp_path}/px"), going)
    assert {r.image_id for r in read.select("image_id").distinct().collect()} == {7, 8, 9}
    assert "dynamicpruning" in read._jdf.queryExecution().executedPlan().toString()
    assert B.gate(images, found, "canvas-size").count() == 10
