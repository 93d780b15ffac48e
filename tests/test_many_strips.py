"""Many small images are read by few tasks, large ones by a task for each strip."""

from tessella.plans import views as V
from tessella.sources import readers as R


def test_small_images_share_tasks(spark, tmp_path):
    root = f"file://{tmp_path}/px"
    px = V.px(spark, "/root/testdata/sf0.01")
    R.write_pam(px, root, "lineart")
    R.register(spark)
    got = spark.read.format("pam_strips").option("strip_bytes", 64).load(root)
    assert got.rdd.getNumPartitions() < 10
    columns = ["image_id", "x", "y", "r", "g", "b", "a"]
    assert got.withColumnRenamed("folder_id", "image_id").selectExpr("cast(image_id as long) image_id", *columns[1:]).exceptAll(px.select(columns)).isEmpty()
    assert got.count() == px.count()


def test_large_strips_have_tasks_of_their_own():
    strips = [R.Strip(f"{i}.pam", 0, 1) for i in range(1000)]
    assert len(R.packed(strips, [R.STRIP_BYTES] * 1000)) == 1000
    assert sum(len(t.strips) for t in R.packed(strips, [1] * 1000)) == 1000
