import json

from pyspark.sql import functions as F

from tessella.sources import assets
from tessella.streaming import documents as SD
from tessella.streaming import strokes as SS


def pam(w, h, depth, body):
    return f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH {depth}\nMAXVAL 255\nENDHDR\n".encode() + bytes(body)


def test_asset_folders(spark, tmp_path):
    for name, layers in {"cat-1": ["lineart", "seeds"], "dog-2": ["lineart"]}.items():
        d = tmp_path / name
        d.mkdir()
        (d / "meta.json").write_text(json.dumps({"id": name, "title": "t", "category": "animal", "extra": 1}))
        for layer in layers:
            (d / f"{layer}.pam").write_bytes(pam(2, 1, 2, [10, 20, 30, 40]))
    found = {r["folder_id"]: r for r in assets.list_assets(spark, str(tmp_path)).collect()}
    assert found["cat-1"]["seeds"] and found["dog-2"]["seeds"] is None and found["dog-2"]["meta"]
    assert assets.layer_rows(assets.list_assets(spark, str(tmp_path))).count() == 3
    meta = {r["folder_id"]: r for r in assets.read_meta(spark, str(tmp_path)).collect()}
    assert meta["cat-1"]["id"] == "cat-1" and meta["cat-1"]["notes"] is None
    px = assets.read_pixels(spark, str(tmp_path)).where("folder_id = 'dog-2'").orderBy("x").collect()
    assert [(r["x"], r["y"], r["r"], r["g"], r["b"], r["a"]) for r in px] == [(0, 0, 10, 10, 10, 20), (1, 0, 30, 30, 30, 40)]


def test_stroke_stream_sessions_and_predictions(spark, tmp_path):
    SS.use_state_store(spark)

    def row(sid, seq, kind, x, predicted=False):
        return (sid, seq, kind, float(x), 5.0, seq / 120.0, 0.5, 0.0, predicted, "marker", 24.0, 7)

    first = [row(1, 0, "begin", 0), row(1, 1, "append", 9), row(1, 2, "append", 30, True)]
    first += [row(2, 0, "begin", 0), row(2, 1, "append", 9), row(3, 0, "append", 9)]
    second = [row(1, 3, "append", 20), row(1, 4, "append", 30), row(1, 5, "end", 0)]
    second += [row(2, 2, "cancel", 0), row(3, 1, "end", 0)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, SS.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = SD.read_files(spark, str(tmp_path / "in"), spark.createDataFrame([], SS.EVENT_SCHEMA).schema, per_batch=1)
    out = spark.read.parquet(SD.run_to_table(SS.stream_dabs(events, predictions=True, idle_ms=None), "test-dabs"))
    got = SS.committed(out)
    assert {r["stroke_id"] for r in got.select("stroke_id").distinct().collect()} == {1}
    assert out.where("stroke_id = 1 and state = 'predicted'").count() > 0

    from tessella.operators import strokes as K

    real = spark.createDataFrame([r for r in first + second if r[0] == 1 and r[2] != "end"], SS.EVENT_SCHEMA)
    batch = K.generate_dabs(real.drop("kind"))
    a = [tuple(r) for r in got.select(*K.DAB_COLUMNS).orderBy("dab_no").collect()]
    b = [tuple(r) for r in batch.select(*K.DAB_COLUMNS).orderBy("dab_no").collect()]
    assert a == b and len(a) > 5


def test_idle_sessions(spark, tmp_path):
    rows = [(1, 0.0), (1, 2.0), (1, 7.0), (1, 60.0)]
    spark.createDataFrame(rows, "doc_id long, ts double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = SD.read_files(spark, str(tmp_path / "in"), "doc_id long, ts double", per_batch=1)
    out = SD.run_to_table(SD.stroke_sessions(stream), "idle")
    got = spark.read.parquet(out).orderBy("start").select("events", F.col("end").cast("double")).collect()
    assert [tuple(r) for r in got] == [(2, 5.0), (1, 10.0)]


def test_a_file_that_does_not_decode_is_reported(spark, tmp_path):
    from tessella.sources import assets

    folder = tmp_path / "art-1"
    folder.mkdir()
    (folder / "lineart.png").write_bytes(b"no image at all")
    bad = assets.unreadable_images(spark, str(tmp_path)).collect()
    assert [(r.folder_id, r.code) for r in bad] == [("art-1", "source-unreadable")]
    assert assets.image_source_pixels(spark, str(tmp_path)).count() == 0


def test_strips_equal_the_whole_reader(spark, tmp_path):
    import random

    import pytest

    from tessella.sources import readers

    readers.register(spark)
    rng = random.Random(1)
    for i, (w, h, depth) in enumerate([(5, 7, 1), (3, 40, 2), (17, 9, 3), (8, 33, 4), (1, 1, 4)]):
        (tmp_path / f"a{i}").mkdir()
        (tmp_path / f"a{i}" / "lineart.pam").write_bytes(pam(w, h, depth, rng.randbytes(w * h * depth)))
    want = sorted(map(tuple, assets.read_pixels(spark, str(tmp_path)).select("folder_id", "layer", "x", "y", "r", "g", "b", "a").collect()))
    for size in (50, 1 << 20):
        got = spark.read.format("pam_strips").option("strip_bytes", size).load(str(tmp_path))
        assert sorted(map(tuple, got.collect())) == want
        assert (got.rdd.getNumPartitions() > 5) == (size == 50)
    (tmp_path / "a0" / "lineart.pam").write_bytes(pam(5, 7, 1, b"short"))
    with pytest.raises(Exception, match="cut short"):
        spark.read.format("pam_strips").load(str(tmp_path)).count()


def test_frames_are_streamed_once_and_in_order(spark, tmp_path):
    from tessella.sources import readers

    readers.register(spark)

    def write(frame, rows, last=False):
        (tmp_path / "in" / f"frame={frame}").mkdir(parents=True)
        lines = [json.dumps({"stroke_id": 1, "seq": s, "x": s, "y": 0, "t": s / 120, "pressure": 1, "radius": 0, "predicted": p}) for s, p in rows]
        (tmp_path / "in" / f"frame={frame}" / "part.json").write_text("\n".join(lines))
        if last:
            (tmp_path / "in" / "_SUCCESS").write_text("")

    def run():
        query = spark.readStream.format("sample_frames").load(str(tmp_path / "in")).writeStream.format("parquet")
        query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        return [(r.frame, r.place, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame", "place").collect()]

    write(0, [(2, True), (1, False), (0, False)])
    write(1, [(5, False)])
    first = [(0, 0, 0), (0, 1, 1), (0, 2, 2)]
    assert run() == first  # the second frame may still grow
    write(2, [(6, True), (7, False)], last=True)
    assert run() == first + [(1, 0, 5), (2, 0, 7), (2, 1, 6)]
    assert run() == first + [(1, 0, 5), (2, 0, 7), (2, 1, 6)]
