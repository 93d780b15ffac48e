"""Stroke events as a stream: dabs as they become certain, predictions on the side."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.shape import rounded
from tessella.operators.strokes import ROWS_OUT, SLICE, StrokeFold

EVENT_SCHEMA = (
    "stroke_id long, seq long, kind string, x double, y double, t double, pressure double, "
    "radius double, predicted boolean, brush string, size double, seed long"
)
OUT_SCHEMA = (
    "stroke_id long, dab_no long, x double, y double, size double, angle double, alpha double, state string, epoch long, sealed boolean"
)
_OUT = ["stroke_id", "dab_no", "x", "y", "size", "angle", "alpha", "state", "epoch", "sealed"]
#: Columns of ``thousandths``, and how they are best written: numbers of neighbouring dabs differ little.
_PARTS = ("x", "y", "size", "angle", "alpha")
COMPACT = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
#: A stroke without an event for so long is abandoned and its state dropped.
IDLE_MS = 3_600_000
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The stateful operator needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class StrokeProcessor(StatefulProcessor):
    """begin / append / end / cancel of one stroke; the state is its fold, a few dozen numbers.

    Rows are ``wet`` for dabs of real samples, ``predicted`` for dabs of a copied state that is
    thrown away, and one ``done`` marker with the number of dabs when the stroke ends.  A begin
    discards what was open, samples without a begin are ignored, a cancel emits nothing.  Rows carry
    the number of the begin event as their ``epoch``, so that dabs of a discarded attempt are told
    from those of the next.  Dabs of an attempt whose end came in the same batch are ``sealed``: they need not
    be looked up among the ended ones.  With predictions, a ``seen`` row says that older predictions of the stroke no longer hold.
    The state of a stroke without events expires.
    """

    def __init__(self, predictions: bool = False, idle_ms: int | None = IDLE_MS):
        self._predictions, self._idle_ms = predictions, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("json", StringType())])
        self._state = handle.getValueState("fold", schema, ttlDurationMs=self._idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stroke = int(key[0])
        frame = pd.concat(list(rows)).sort_values("seq", kind="stable")
        fold = meta = epoch = None
        if self._state.exists():
            meta, state, epoch = json.loads(self._state.get()[0])
            fold = StrokeFold(*meta).load(state)
        out: list[tuple] = []
        guess = None
        kinds, guesses = frame["kind"].tolist(), frame["predicted"].tolist()
        cuts = [i for i in range(len(kinds)) if i == 0 or (kinds[i], guesses[i]) != (kinds[i - 1], guesses[i - 1])]
        runs = list(zip(cuts, [*cuts[1:], len(kinds)]))
        closed_by, following = {}, None
        for lo, _ in reversed(runs):
            closed_by[lo] = following
            if kinds[lo] != "append":
                following = kinds[lo]
        for lo, hi in runs:
            kind, sealed = kinds[lo], closed_by[lo] == "end"
            if kind == "begin":
                lo, last = hi - 1, frame.iloc[hi - 1]
                meta = [last["brush"], float(last["size"]), int(last["seed"])]
                fold, epoch = StrokeFold(*meta), int(last["seq"])
            if fold is None:
                continue
            if kind in ("begin", "append") and guesses[lo]:
                guess = (lo, hi)  # of a copy of the state, and only if nothing real follows
            elif kind in ("begin", "append"):
                guess = None
                for at in range(lo, hi, SLICE):
                    out += [(*d, "wet", epoch, sealed) for d in fold.push(stroke, frame.iloc[at : min(at + SLICE, hi)])]
                    if len(out) >= ROWS_OUT:
                        yield pd.DataFrame(out, columns=_OUT)
                        out = []
            elif kind == "end":
                out += [(*d, "wet", epoch, True) for d in fold.finish(stroke)]
                out.append((stroke, fold.made, None, None, None, None, None, "done", epoch, None))
                fold = guess = None
            else:
                fold = guess = None
        if self._predictions:
            out.append((stroke, None, None, None, None, None, None, "seen", epoch, None))
            if guess:
                out += [(*d, "predicted", epoch, None) for d in copy.deepcopy(fold).push(stroke, frame.iloc[slice(*guess)])]
        if fold is None:
            self._state.clear()
        else:
            self._state.update((json.dumps([meta, fold.state(), epoch]),))
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def close(self) -> None:
        pass


def stream_dabs(events: DataFrame, predictions: bool = False, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Dabs of a stream of ``EVENT_SCHEMA`` rows; with ``predictions``, for a display, those of guessed samples too.

    Expiry needs processing time, with which a stream never runs out of batches: a replay that is to end
    with its input passes ``idle_ms=None``.
    """
    return events.groupBy("stroke_id").transformWithStateInPandas(
        statefulProcessor=StrokeProcessor(predictions, idle_ms),
        outputStructType=OUT_SCHEMA,
        outputMode="Append",
        timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def committed(dabs: DataFrame) -> DataFrame:
    """Dabs of attempts that ended, from the written output of the stream.

    Only dabs of attempts that ended in a later batch are shuffled, to be joined with the markers.
    """
    wet = dabs.where("state = 'wet'").drop("state")
    done = dabs.where("state = 'done'").select("stroke_id", "epoch").distinct()
    earlier = wet.where("not sealed").join(done, ["stroke_id", "epoch"], "left_semi").select(*wet.columns)
    return wet.where("sealed").unionByName(earlier).drop("sealed")


def thousandths(dabs: DataFrame) -> DataFrame:
    """Numbers as whole thousandths, half up: a tenth of the bytes when written as ``COMPACT``. What is no number is NULL."""

    def whole(c: str):
        # From there on doubles have no exact thousandths, and a pixel has none so far out.
        return F.when(F.abs(F.col(c)) < 1e12, F.rint(rounded(F.col(c), 3) * 1000).cast("long"))

    return dabs.withColumns({c: whole(c) for c in _PARTS if c in dabs.columns})


def of_thousandths(rows: DataFrame) -> DataFrame:
    """Numbers of ``thousandths``, rounded to three places."""
    return rows.withColumns({c: F.coalesce(F.col(c) / 1000, F.lit(float("nan"))) for c in _PARTS if c in rows.columns})


def compact_batch(batch: DataFrame, n: int, out: str) -> None:
    """One folder per batch of ``thousandths``: a repeated batch overwrites itself."""
    batch.write.mode("overwrite").options(**COMPACT).parquet(f"{out}/batch={n}")


class TwoSinks:
    """What a stream with predictions writes, batch by batch: dabs that stay, and an overlay of the newest predictions.

    Under ``base``, ``committed/batch=n`` holds the wet dabs and done markers of batch n, never a prediction, and
    ``overlay/version=n`` the predictions that hold after batch n: those of version n-1 without the strokes
    that batch n has seen, and the batch's own. Both follow from the batch and the version before alone and are
    overwritten, so a batch that runs again changes nothing. The overlay is as large as what is being drawn.
    ``compact`` sinks hold whole ``thousandths`` and give them back as numbers with three places.
    """

    def __init__(self, base: str, compact: bool = False):
        self.base, self.compact = base, compact

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").options(**(COMPACT if self.compact else {})).parquet(f"{self.base}/{folder}")

    def __call__(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        self._write(batch, f"received/batch={n}")  # once, as the stateful operator must not run again for the second sink
        rows = spark.read.schema(batch.schema).parquet(f"{self.base}/received/batch={n}")
        self._write(rows.where("state in ('wet', 'done')"), f"committed/batch={n}")
        guesses = rows.where("state = 'predicted'")
        if n:
            seen = rows.select("stroke_id").distinct()
            before = spark.read.schema(batch.schema).parquet(f"{self.base}/overlay/version={n - 1}")
            guesses = guesses.unionByName(before.join(seen, "stroke_id", "left_anti").select(*batch.columns))
        self._write(guesses, f"overlay/version={n}")

    def _read(self, spark: SparkSession, folder: str) -> DataFrame:
        if not self.compact:
            return spark.read.schema(OUT_SCHEMA).parquet(f"{self.base}/{folder}")
        rows = spark.read.schema(OUT_SCHEMA.replace("double", "long")).parquet(f"{self.base}/{folder}")
        return of_thousandths(rows)

    def committed(self, spark: SparkSession) -> DataFrame:
        return committed(self._read(spark, "committed/*"))

    def overlay(self, spark: SparkSession, version: int) -> DataFrame:
        """The predictions that hold after a batch."""
        return self._read(spark, f"overlay/version={version}").drop("state", "sealed")


def run_to_sinks(events: DataFrame, base: str, compact: bool = False) -> tuple[TwoSinks, int]:
    """Streams all available events with predictions into two sinks; also the number of the last batch."""
    sinks, last = TwoSinks(base, compact), [-1]

    def write(batch: DataFrame, n: int) -> None:
        sinks(batch, n)
        last[0] = n

    dabs = stream_dabs(events, predictions=True, idle_ms=None)
    dabs = thousandths(dabs) if compact else dabs
    query = dabs.writeStream.outputMode("append").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return sinks, last[0]
