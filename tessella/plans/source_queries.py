"""The data sources on files written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.plans import views as V
from tessella.plans.registry import query
from tessella.session import scratch_dir
from tessella.sources import assets, readers
from tessella.streaming import documents as SD

#: Samples of a frame, and frames that are written to one folder.
FRAME, FOLDER_FRAMES = 64, 1024


@query("strip_pixels", "select image_id, x, y, r, g, b, a from px")
def strip_pixels(spark, sf):
    """Images written as files and read back in strips of a few rows."""
    readers.register(spark)
    root = f"{scratch_dir(spark)}/pam-{uuid.uuid4().hex}"
    readers.write_pam(V.px(spark, sf), root, "lineart")
    px = spark.read.format("pam_strips").option("strip_bytes", 256).load(root)
    return px.select(F.col("folder_id").cast("long").alias("image_id"), "x", "y", "r", "g", "b", "a")


@query(
    "asset_scan",
    "select 'art-' || image_id as folder_id, true as lineart, image_id % 2 = 0 as seeds, image_id % 3 = 0 as meta, case when image_id % 3 = 0 then 'title ' || image_id end as title from folders",
)
def asset_scan(spark, sf):
    """Folders of layers and metadata, listed and read."""
    root = f"{scratch_dir(spark)}/assets-{uuid.uuid4().hex}"
    ids = V.images(spark, sf).select("image_id")

    def write(batches):
        files, base = readers.place(root)
        for batch in batches:
            for i in batch.image_id.tolist():
                files.create_dir(f"{base}/art-{i}", recursive=True)
                made = {"lineart.pam": b"P7"} | ({"seeds.pam": b"P7"} if i % 2 == 0 else {})
                made |= {"meta.json": f'{{"id": "art-{i}", "title": "title {i}", "category": "animal"}}'.encode()} if i % 3 == 0 else {}
                for name, data in made.items():
                    with files.open_output_stream(f"{base}/art-{i}/{name}") as out:
                        out.write(data)
            yield batch

    ids.mapInPandas(write, "image_id long").count()
    found = assets.list_assets(spark, root)
    titles = assets.read_meta(spark, root).select("folder_id", "title")
    return found.join(titles, "folder_id", "left").select(
        "folder_id", *[F.col(c).isNotNull().alias(c) for c in ("lineart", "seeds", "meta")], "title"
    )


@query(
    "frame_samples",
    f"""select seq // {FRAME} as frame, (row_number() over (partition by seq // {FRAME} order by predicted, seq) - 1)::int as place, stroke_id, seq, x, y, round(t, 6) as t,
    round(pressure, 6) as pressure, round(radius, 6) as radius, predicted from samples""",
)
def frame_samples(spark, sf):
    """Samples streamed frame by frame, real ones first and predicted ones last."""
    readers.register(spark)
    root = f"{scratch_dir(spark)}/frames-{uuid.uuid4().hex}"
    columns = ["stroke_id", "seq", "x", "y", "t", "pressure", "radius", "predicted"]
    framed = V.samples(spark, sf).select((F.expr(f"seq div {FRAME}")).alias("frame"), *columns)
    last = framed.agg(F.max("frame")).first()[0] or 0
    first = F.expr(f"frame div {FOLDER_FRAMES} * {FOLDER_FRAMES}")
    folder = F.concat_ws("-", first, F.least(first + (FOLDER_FRAMES - 1), F.lit(last)))
    framed.withColumn("frames", folder).repartition("frames").write.partitionBy("frames").option("compression", "gzip").json(root)
    out = SD.run_to_table(spark.readStream.format("sample_frames").load(root), "frames")
    return spark.read.parquet(out).select("frame", "place", "stroke_id", "seq", "x", "y", *[F.round(c, 6).alias(c) for c in ("t", "pressure", "radius")], "predicted")
