"""Repeated byte strings by a logarithmic family of suffix arrays.

Every string of ``length`` bytes has a key, the smallest hash of the ``GRAM``-byte grams in it, so equal
strings have equal keys, and the strings that start at neighbouring bytes mostly share one: a text falls
into runs of about forty starts with one key. A key whose gram occurs once has no repeated string;
the runs of the other keys are dealt out by key with the bytes they cover. In such a share batches of runs
arrive in the order of the documents. The suffixes at their starts, as far as ``length`` bytes, are sorted
(the batch's suffix array); the sorted array is scanned against the levels that exist, and a suffix found
there, or before it in its own batch, repeats an earlier string. What is new becomes a level, and levels of
equal size merge, so there are as many levels as the number of batches has binary digits.

Equal texts are put together first: all but the first are covered whole if they are long enough.

The order of documents is that of their integer keys, then of the digests of their texts; null keys come
last. Cases: a null or empty text, or one shorter than ``length``, loses nothing; of rows with equal key and
text one is the first; an empty table gives an empty result; runs of one byte are one run of any length.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import PRE, keyed_text, written

LENGTH = 100
GRAM = 32
#: Suffixes that a share of the keys has about, and suffixes in a batch.
SHARE, BATCH = 1 << 20, 1 << 17
LAST = (1 << 63) - 1

_MULTIPLY, _FACTOR = np.uint64(0x9E3779B97F4A7C15), 0x100000001B3


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two) from each byte on, by doubling."""
    h = data.astype(np.uint64) * _MULTIPLY
    h ^= h >> np.uint64(29)
    width, factor = 1, _FACTOR
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = width * 2, factor * factor % (1 << 64)
    h *= _MULTIPLY
    return h ^ (h >> np.uint64(32))


def window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    reach, low = 1, h
    while reach * 2 <= width:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    return np.minimum(low[: len(low) - (width - reach)], low[width - reach :])


def key_runs(data: np.ndarray, length: int, gram: int, block: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """(key, first start, end of starts, own) of the runs of a text; a run ends at the end of a block at the latest.

    ``own`` says that the key's gram occurs again in the block, so that a single run may repeat itself.
    """
    keys, starts, ends, own = [], [], [], []
    for at in range(0, len(data) - length + 1, block):
        part = data[at : at + block + length - 1]
        hashes = gram_hashes(part, gram)
        low = window_minimum(hashes, length - gram + 1)
        hashes.sort()
        again = np.unique(hashes[1:][hashes[1:] == hashes[:-1]])
        first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        keys.append(low[first].view(np.int64))
        own.append(np.isin(low[first], again))
        starts.append(first + at)
        ends.append(np.r_[first[1:], len(low)] + at)
    if not keys:
        return (*(np.empty(0, np.int64),) * 3, np.empty(0, bool))
    return tuple(map(np.concatenate, (keys, starts, ends, own)))


class SuffixFamily:
    """Sorted levels of distinct strings of ``length`` bytes; ``add`` says which of a batch were there before."""

    def __init__(self, length: int):
        self.kind, self.levels = np.dtype(f"S{length}"), []

    def add(self, text: bytes, starts: np.ndarray) -> np.ndarray:
        """Whether the string at each start is at an earlier start, or in an earlier batch."""
        view = np.ndarray(len(text) - self.kind.itemsize + 1, self.kind, text, strides=(1,))
        suffixes = view[starts]
        order = np.argsort(suffixes, kind="stable")  # the batch's suffix array; ties in the order of the starts
        suffixes = suffixes[order]
        again = np.r_[False, suffixes[1:] == suffixes[:-1]]
        new = np.flatnonzero(~again)
        known = np.zeros(len(new), bool)
        for level in self.levels:
            at = np.searchsorted(level, suffixes[new])
            at[at == len(level)] = 0
            known |= level[at] == suffixes[new]
        self.insert(suffixes[new[~known]])
        again[new] = known
        seen = np.empty(len(starts), bool)
        seen[order] = again
        return seen

    def insert(self, level: np.ndarray) -> None:
        """Adds a level; while the one before is not more than twice as large, the two merge."""
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = np.concatenate([self.levels.pop(), level])
            level.sort(kind="stable")  # two sorted runs: one merge
        if len(level):
            self.levels.append(level)


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The spans covered by strings of ``length`` bytes at the starts, in order."""
    if not len(starts):
        return []
    gaps = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.r_[0, gaps + 1]].tolist(), (starts[np.r_[gaps, len(starts) - 1]] + length).tolist()))


def _order(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(digest, ord, n): the first key of each text and its number in the order of the documents."""
    first = rows.groupBy("sha").agg(F.min("ord").alias("ord"))
    return written(first.orderBy("ord", "sha").withColumn("n", F.monotonically_increasing_id()), "texts")


def repeated_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, n, a, b, own): the runs of starts whose key occurs in more than one run, or again in the text."""
    names = ["key", "n", "a", "b", "own"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[] for _ in names]
            size = 0
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data")):
                keys, a, b, own = key_runs(np.frombuffer(data.as_buffer(), np.uint8), length, gram)
                for part, values in zip(parts, (keys, np.full(len(keys), n), a, b, own)):
                    part.append(values)
                size += len(keys)
                if size > 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)
                    parts, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive in the order of their keys; the last of a batch waits for the next batch."""
        last, last_shared = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            keys = rows["key"].to_numpy()
            same = keys[1:] == keys[:-1]
            keep = np.r_[last_shared, same] | np.r_[same, False] | rows["own"].to_numpy()
            yield from rows.slice(0, len(keep) - 1).filter(pa.array(keep[:-1])).to_batches()
            last, last_shared = rows.slice(len(keep) - 1).to_batches()[0], bool(keep[-1])
        if last is not None and (last_shared or last.column("own")[0].as_py()):
            yield last

    schema = "key long, n long, a long, b long, own boolean"
    return texts.mapInArrow(runs, schema).repartition("key").sortWithinPartitions("key").mapInArrow(shared, schema)


def repeated_starts(contexts: DataFrame, length: int) -> DataFrame:
    """(n, spans): the bytes of each run that repeat earlier bytes; ``contexts`` has (key, n, a, b, data)."""
    spans = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end")]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily(length)
        held: list[tuple] = []
        size = 0
        last = None

        def flush() -> pa.RecordBatch:
            text, starts, at = [], [], 0
            for _, _, m, data in held:
                starts.append(np.arange(at, at + m))
                text.append(data)
                at += len(data)
            seen = family.add(b"".join(text), np.concatenate(starts))
            out, at = [], 0
            for n, a, m, _ in held:
                if (found := covered(a + np.flatnonzero(seen[at : at + m]), length)):
                    out.append((n, [{"start": s, "end": e} for s, e in found]))
                at += m
            return pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], schema.field("spans").type)], schema=schema
            )

        for batch in batches:
            for n, a, data in zip(batch.column("n").to_pylist(), batch.column("a").to_pylist(), batch.column("data")):
                if (n, a) == last:  # a repeated row
                    continue
                last, data = (n, a), data.as_py()
                held.append((n, a, len(data) - length + 1, data))
                size += len(data) - length + 1
                if size >= BATCH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    schema = pa.schema([("n", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    return contexts.mapInArrow(scan, T.StructType([T.StructField("n", T.LongType()), T.StructField("spans", spans)]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """One row per input row: key, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay."""
    rows = keyed_text(df, id_col, text_col).select(
        F.col(f"{PRE}id").alias(id_col), _order(f"{PRE}id").alias("ord"), F.col(f"{PRE}text").cast("binary").alias("data")
    )
    rows = rows.withColumn("sha", F.unhex(F.sha2("data", 256)))
    firsts = distinct_texts(rows)
    texts = written(
        rows.where(F.octet_length("data") >= length).join(firsts, ["sha", "ord"]).select("n", "data"), "distinct"
    )
    runs = written(repeated_runs(texts, length, gram), "runs")
    suffixes = runs.agg(F.coalesce(F.sum(F.col("b") - F.col("a")), F.lit(0))).first()[0]
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    contexts = runs.join(texts, "n").select(
        "key", "n", "a", F.substring("data", (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a") + length - 1).cast("int")).alias("data")
    )
    contexts = contexts.repartition(max(least, suffixes // SHARE), "key").sortWithinPartitions("n", "a")
    found = written(repeated_starts(contexts, length), "repeats").groupBy("n").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    firsts = firsts.join(found, "n", "left")
    turn = F.row_number().over(Window.partitionBy("sha", "ord").orderBy(F.lit(1)))
    judged = rows.join(firsts, ["sha", "ord"], "left").withColumn("first", F.col("n").isNotNull() & (turn == 1))
    id_type = rows.schema[0].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, spans, first in zip(batch.column("data"), batch.column("spans"), batch.column("first").to_pylist()):
                data = data.as_py()
                if first:
                    gone = merged([(s["start"], s["end"]) for s in spans.as_py() or ()])
                else:
                    gone = [(0, len(data))] if len(data) >= length else []
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), len(gone), kept))
            columns = list(zip(*out)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"],
            )

    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    return judged.select(id_col, "data", "spans", "first").mapInArrow(
        cut, T.StructType([T.StructField(id_col, id_type), *counts, T.StructField("kept", T.BinaryType())])
    )


def repeats_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The counts and the checksum of the bytes that stay."""
    return remove_repeats(df, id_col, text_col, **options).select(
        id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
