"""Stretches of words that repeat with a period, found with string synchronising sets.

A run is a stretch of words with smallest period q and at least max(6, 4q) words that cannot be made longer.
Periods up to three are found by comparing each word with the one q before. For the others there is a
scale T = 4, 8, 16 and so on for the periods from T to 2T. Every stretch of T words has a name (a hash made of the names
of its halves). The synchronising set of T holds a place i if the least name among the places i to i+T is that of
i or of i+T; whether it does depends on the 2T words from i on alone. Places whose T words have a
period of T/4 or less lie in runs that smaller scales have found already; they are passed over when the least name is
taken. So any T places in a row hold one of the set, unless their words are highly periodic. A run of period q from
T to 2T has one in its first T places, and the next place with the same 2T words is q further, as a nearer
one would be a smaller period. Places of the set are therefore sorted by their 2T words, neighbours at a
distance of T to 2T propose it as a period, and the stretch is extended word by word both ways, which also rules out
equal hashes by chance. A text of n words takes O(n log² n) steps; texts are handled many at a time with a
mark of their own between them.

Cases: a null or empty text has no words and no runs; keys may be null; repeated rows give a row each; an empty
table gives an empty result; texts are looked at whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import keyed_text

#: Periods found by direct comparison; the first scale takes over after them.
SMALL = 3
LEAST_WORDS, LEAST_TURNS = 6, 4
#: Words of the texts that are handled together.
GROUP_WORDS = 1 << 17
NEVER = np.uint64((1 << 64) - 1)

Run = tuple[int, int, int]


def long_enough(length: int, period: int) -> bool:
    return length >= max(LEAST_WORDS, LEAST_TURNS * period)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed random-looking bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of stretches of twice the width."""
    return mixed(names[:-width] * np.uint64(0x9E3779B97F4A7C15) + (names[width:] ^ np.uint64(0xD6E8FEB86659FD93)))


def extent(codes: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words ``period`` apart are equal, as start and end."""
    n, end, step = len(codes) - period, at, 64
    while end < n:
        stop = min(n, end + step)
        differ = codes[end:stop] != codes[end + period : stop + period]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = stop, 2 * step
    start, step = at, 64
    while start > 0:
        stop = max(0, start - step)
        differ = codes[stop:start] != codes[stop + period : start + period]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = stop, 2 * step
    return start, end + period


def runs_of_codes(codes: np.ndarray, lengths: list[int]) -> list[Run]:
    """All runs (start, length, period) of words given as numbers.

    The texts, the longest first, follow each other, each with a number of its own behind it; ``lengths`` are
    their numbers of words.
    """
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, period: int) -> None:
        if long_enough(end - start, period):
            found.setdefault((start, end), period)

    for period in range(1, SMALL + 1):
        same = np.concatenate([[False], codes[period:] == codes[:-period], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(turns[::2].tolist(), (turns[1::2] + period).tolist()):
            keep(start, end, period)

    ends = np.cumsum(np.array(lengths, np.int64) + 1)
    names, width = mixed(codes.astype(np.uint64) + np.uint64(1)), 1
    while True:
        many = int(np.searchsorted(-np.array(lengths), -LEAST_TURNS * max(width, SMALL + 1), "right"))
        if not many:
            break
        names = names[: int(ends[many - 1]) - width + 1]  # shorter texts have no run of this scale
        if len(names) <= width:
            break
        wider = doubled(names, width)
        if width > SMALL:
            propose(codes, names, wider, width, found, keep)
        names, width = wider, 2 * width
    return sorted((start, end - start, period) for (start, end), period in found.items())


def synchronising(names: np.ndarray, width: int, found: dict[tuple[int, int], int]) -> np.ndarray:
    """The places of the set for this scale, ascending."""
    inside = np.zeros(len(names) + 1, np.int32)
    for (start, end), period in found.items():
        if LEAST_TURNS * period <= width <= end - start and start < len(names):
            inside[start] += 1
            inside[min(end - width + 1, len(names))] -= 1
    names = np.where(np.cumsum(inside[:-1]) > 0, NEVER, names)
    least, span = names, 1
    while span < width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    here, there = names[:-width], names[width:]
    least = np.minimum(least[: len(there)], there)
    return np.flatnonzero(((here == least) | (there == least)) & (least != NEVER))


def propose(codes, names, wider, width: int, found: dict[tuple[int, int], int], keep: Callable[[int, int, int], None]) -> None:
    """Runs with a period from ``width`` to below twice that."""
    places = synchronising(names, width, found)
    context = wider[places]
    order = np.argsort(context, kind="stable")
    context, places = context[order], places[order]
    gap = places[1:] - places[:-1]
    near = np.flatnonzero((context[1:] == context[:-1]) & (gap >= width) & (gap < 2 * width))
    start = end = last = -1
    for period, at in sorted(zip(gap[near].tolist(), places[near].tolist())):
        if period == last and at < end - period:
            continue  # in the stretch that was found before
        start, end = extent(codes, at, period)
        last = period
        keep(start, end, period)


def split_words(key: object, text: str) -> list[bytes]:
    """The words between blanks, tabs and line ends, as UTF-8."""
    return text.encode().split()


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, by start and then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = [len(texts[i]) for i in order]
    known = _Codes()
    parts = [np.fromiter(map(known.__getitem__, texts[i]), np.int64, len(texts[i])) for i in order]
    marks = len(known) + np.arange(len(order))
    codes = np.concatenate([x for part, mark in zip(parts, marks) for x in (part, [mark])]) if parts else np.empty(0, np.int64)
    starts = np.cumsum([0, *(n + 1 for n in lengths)])
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, period in runs_of_codes(codes, lengths) if len(codes) > SMALL else []:
        at = int(np.searchsorted(starts, start, "right")) - 1
        out[order[at]].append((start - int(starts[at]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that lie in a run behind its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join(w for w, d in zip(words, np.cumsum(drop).tolist()) if not d)


def periodic_runs(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_of: Callable[[object, str], list[bytes]] = split_words,
) -> DataFrame:
    """One row per input row: key, ``runs`` (start, length, period in words) and ``collapsed``, the text with one turn of each."""
    rows = keyed_text(df, id_col, text_col)
    id_type = rows.schema[0].dataType
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    names = [f.name for f in run_type.elementType]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            runs = runs_of_texts(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, arrow[0].type),
                    pa.array([[dict(zip(names, r)) for r in one] for one in runs], arrow[1].type),
                    pa.array([collapsed(w, r).decode() for w, r in zip(texts, runs)], arrow[2].type),
                ],
                schema=arrow,
            )

        keys, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(key, text.as_py())
                keys.append(key)
                texts.append(words)
                size += len(words)
                if size >= GROUP_WORDS:
                    yield done(keys, texts)
                    keys, texts, size = [], [], 0
        yield done(keys, texts)

    return rows.mapInArrow(run, schema)


def planted_words(key: object, text: str) -> list[bytes]:
    """The words; in a tenth of the documents, chosen by the key, the rest from one place on repeats its first words."""
    words = split_words(key, text)
    n, h = len(words), crc32(str(key).encode())
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    turn = words[at : at + period]
    return words[:at] + (turn * ((n - at) // period + 1))[: n - at]


def runs_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document with planted repeats: number of runs, the one with most turns, checksums of all runs and of the text left."""
    rows = periodic_runs(df, id_col, text_col, planted_words)
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        id_col, "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
