"""Dabs whose end is in sight are sealed; what is written of them is whole thousandths."""

import math

import pandas as pd
from pyspark.sql import functions as F

from tessella.plans.stream_queries import stream_dabs
from tessella.streaming import strokes as SS


class NoState:
    def exists(self):
        return False

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def handled(kinds, predicted=()):
    rows = [(1, i, k, 30.0 * i, 10.0, i / 120, 0.5, 0.0, i in predicted, "soft_round", 24.0, 7) for i, k in enumerate(kinds)]
    names = [c.split()[0] for c in SS.EVENT_SCHEMA.split(", ")]
    processor = SS.StrokeProcessor(predictions=True)
    processor._state = NoState()
    return pd.concat(list(processor.handleInputRows((1,), iter([pd.DataFrame(rows, columns=names)]), None)))


def test_only_attempts_that_end_are_sealed():
    out = handled(["begin", "append", "append", "begin", "append", "append", "end", "begin", "append", "append", "append"], {2, 10})
    wet = out[out.state == "wet"].groupby("epoch").sealed.unique()
    assert {e: list(s) for e, s in wet.items()} == {0: [False], 3: [True], 7: [False]}
    assert set(out[out.state == "predicted"].epoch) == {7}


def test_a_long_stroke_is_handed_on_in_frames():
    rows = pd.DataFrame({"stroke_id": 1, "seq": range(3000), "kind": "append", "x": [i * 37.0 % 160 for i in range(3000)], "y": 5.0})
    rows = rows.assign(t=rows.seq / 10, pressure=0.5, radius=0.0, predicted=False, brush="marker", size=24.0, seed=7)
    rows.loc[0, "kind"], rows.loc[2999, "kind"] = "begin", "end"
    processor = SS.StrokeProcessor()
    processor._state = NoState()
    frames = list(processor.handleInputRows((1,), iter([rows]), None))
    assert sum(map(len, frames)) > 100_000 and max(map(len, frames)) < 40_000


def test_thousandths_round_as_numbers_do(spark):
    values = [0.0005, 1.0005, -2.71828, 1066.1235, 0.1 + 0.2, 3e6 + 0.0014, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    want = [r.x for r in df.select(F.round("x", 3).alias("x")).collect()]
    got = [r.x for r in SS.of_thousandths(SS.thousandths(df)).collect()]
    assert got[:-1] == want[:-1] and math.isnan(got[-1])


def test_the_result_is_joined_without_moving_dabs(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    out = stream_dabs(spark, str(tmp_path))
    assert out.count() > 100
    dabs = out.inputFiles()
    assert dabs and spark.read.parquet(*dabs).schema["x"].dataType.typeName() == "long"
    assert spark.read.parquet(*dabs).where("state = 'wet' and not sealed").count() == 0
