"""The stroke stream on attempts that are begun again, cancelled and left open."""

import pytest

from tessella.streaming import documents as SD
from tessella.streaming import strokes as SS


def event(stroke, seq, kind, predicted=False):
    return (stroke, seq, kind, 30.0 * seq, 10.0, seq / 120.0, 0.5, 0.0, predicted, "soft_round", 24.0, 7)


@pytest.fixture(scope="module")
def output(spark, tmp_path_factory):
    SS.use_state_store(spark)
    open_then_again = [event(1, i, "begin" if i in (0, 3) else "end" if i == 5 else "append") for i in range(6)]
    cancelled = [event(2, i, k) for i, k in enumerate(["begin", "append", "cancel", "begin", "append", "end"])]
    abandoned = [event(3, i, "begin" if i == 0 else "append", i == 3) for i in range(4)]
    plain = [event(4, i, "begin" if i == 3 else "end" if i == 5 else "append") for i in range(3, 6)]
    folder = str(tmp_path_factory.mktemp("strokes"))
    events = spark.createDataFrame(open_then_again + cancelled + abandoned + plain, SS.EVENT_SCHEMA)
    for part, rows in enumerate((events.where("seq < 2"), events.where("seq >= 2"))):  # state is carried over
        rows.coalesce(1).write.parquet(f"{folder}/{part}")
    out = SD.run_to_table(SS.stream_dabs(SD.read_files(spark, f"{folder}/*", events.schema, per_batch=1), idle_ms=None), "dabs")
    return spark.read.parquet(out).cache()


def dabs(rows):
    return [tuple(r)[1:7] for r in sorted(rows, key=lambda r: r.dab_no)]


def test_only_the_last_attempt_is_committed(output):
    done = SS.committed(output).collect()
    by_stroke = {s: [r for r in done if r.stroke_id == s] for s in (1, 2, 3, 4)}
    assert {r.epoch for r in by_stroke[1]} == {3} and {r.epoch for r in by_stroke[2]} == {3}
    assert [r.dab_no for r in sorted(by_stroke[1], key=lambda r: r.dab_no)] == list(range(len(by_stroke[1])))
    marker = output.where("state = 'done' and stroke_id = 1").first()
    assert marker.dab_no == len(by_stroke[1]) and by_stroke[3] == []
    assert dabs(by_stroke[1]) == dabs(by_stroke[4]) == dabs(by_stroke[2])


def test_predictions_stay_out_of_the_sink(output):
    assert output.where("state = 'predicted'").count() == 0


def test_overlay_holds_the_newest_guess_and_batches_may_run_again(spark, tmp_path):
    SS.use_state_store(spark)
    batches = [
        [event(1, i, "begin" if i == 0 else "append", i == 3) for i in range(4)] + [event(2, i, "begin" if i == 0 else "append", i == 2) for i in range(3)],
        [event(1, 4, "append"), event(1, 5, "append", True), event(3, 0, "begin"), event(3, 1, "append"), event(3, 2, "append"), event(3, 3, "append", True)],
        [event(2, 4, "append"), event(2, 5, "end"), event(3, 4, "cancel")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, SS.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = SD.read_files(spark, f"{tmp_path}/in", spark.createDataFrame(batches[0], SS.EVENT_SCHEMA).schema, per_batch=1)
    sinks, last = SS.run_to_sinks(stream, f"{tmp_path}/out")
    assert last == 2
    shown = [sorted({r.stroke_id for r in sinks.overlay(spark, n).collect()}) for n in range(3)]
    assert shown == [[1, 2], [1, 2, 3], [1]]  # an ended and a cancelled stroke leave the overlay, an untouched one stays
    raw = spark.read.parquet(f"{tmp_path}/out/committed")
    assert {r.state for r in raw.select("state").distinct().collect()} == {"wet", "done"}
    assert {r.stroke_id for r in sinks.committed(spark).collect()} == {2}
    newest = dabs(sinks.overlay(spark, 1).where("stroke_id = 1").collect())
    assert newest and newest != dabs(sinks.overlay(spark, 0).where("stroke_id = 1").collect())
    before = [sorted(map(tuple, sinks.overlay(spark, n).collect())) for n in range(3)]
    for n in (1, 2):  # as after a failure between the two sinks
        batch = spark.read.schema(SS.OUT_SCHEMA).parquet(f"{tmp_path}/out/received/batch={n}")
        sinks(spark.createDataFrame(batch.collect(), batch.schema), n)
    assert [sorted(map(tuple, sinks.overlay(spark, n).collect())) for n in range(3)] == before
