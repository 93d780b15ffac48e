"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman alignment as judge.

A first pass counts in how many documents each n-gram of the items occurs. N-grams that occur nowhere are of no use; of
those that are left in each stretch of ``STRETCH`` places of an item, the ``KEPT`` rarest are its seeds. There is no
limit on how frequent a seed may be, so a passage that many documents share and a copy of
any part of an item have theirs. Where a document has a seed, the words around it are aligned with the item's
(local alignment, linear gaps), unless these words have too few in common with the item, in any order, to reach
a limit. A document holds an item if the alignment reaches ``min_score`` of the item's own score, or
``min_equal`` equal words of which at least ``min_identity`` of the aligned stretch; so edited, shortened and
paraphrased copies count, chance meetings of frequent words do not. A copy in which no n words in a row are
left of the item has no seed.

Items go to the tasks in blocks of bounded size, each two passes over the documents; documents are not moved.

Cases: null or empty texts and items match nothing, nor do items with fewer words than an n-gram; a null
key stays null; repeated rows give one result each; items with equal texts each match; empty tables give
empty results. Texts are read whole. Columns other than the key and the text are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import keyed_text

GRAM = 3
STRETCH, KEPT = 4, 2
MIN_SCORE, MIN_EQUAL, MIN_IDENTITY = 0.45, 16, 0.7
EQUAL, DIFFERENT, GAP = 2.0, -2.0, -1.5
#: N-grams of the items in one block.
BLOCK_GRAMS = 200_000

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(n)))


@dataclass(frozen=True)
class Alignment:
    score: float
    equal: int
    start: int
    end: int


def align(item: np.ndarray, words: np.ndarray) -> Alignment:
    """The best local alignment: its score, its equal words and the stretch of ``words`` it covers.

    A row at a time; within a row a gap carries on from the largest cell before it.
    """
    n = len(words)
    steps = np.arange(n + 1) * GAP
    rows = np.zeros((len(item) + 1, n + 1))
    for i, word in enumerate(item, 1):
        cell = rows[i - 1, :-1] + np.where(words == word, EQUAL, DIFFERENT)
        best = np.maximum(np.maximum(np.r_[0.0, cell], rows[i - 1] + GAP), 0.0)
        rows[i] = np.maximum.accumulate(best - steps) + steps
    i, j = np.unravel_index(rows.argmax(), rows.shape)
    score, end, equal = float(rows[i, j]), int(j), 0
    while i and j and rows[i, j] > 0:
        if abs(rows[i, j] - rows[i - 1, j - 1] - (EQUAL if item[i - 1] == words[j - 1] else DIFFERENT)) < 1e-9:
            equal += bool(item[i - 1] == words[j - 1])
            i, j = i - 1, j - 1
        elif abs(rows[i, j] - rows[i - 1, j] - GAP) < 1e-9:
            i -= 1
        else:
            j -= 1
    return Alignment(score, equal, int(j), end)


@dataclass
class Items:
    """A block of test items: their words, and which item has which seed where."""

    ids: list
    words: list[list[str]]
    seeds: dict[tuple[str, ...], list[tuple[int, int]]]

    def matches(self, text: str, limits: tuple[float, int, float]) -> list[tuple]:
        """(item, score as a share, equal words, start, end) of each item that the text holds; code points."""
        words = words_of(text)
        n = len(next(iter(self.seeds))) if self.seeds else GRAM
        found: dict[int, list[int]] = defaultdict(list)
        for at, gram in enumerate(grams_of(words, n)):
            if gram in self.seeds:
                for item, place in self.seeds[gram]:
                    found[item].append(at - place)
        if not found:
            return []
        number: dict[str, int] = {}
        code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws])
        out, spans = [], None
        min_score, min_equal, min_identity = limits
        for item, begins in sorted(found.items()):
            length, best = len(self.words[item]), None
            slack, own, bag = 8 + length // 2, code(self.words[item]), Counter(self.words[item])
            for begin in windows(begins, slack):
                lo = max(0, begin[0] - slack)
                around = words[lo : begin[1] + length + slack]
                most = sum((Counter(w for w in around if w in bag) & bag).values())  # equal words of any alignment
                if most < min_score * length and most < min_equal:
                    continue
                a = align(own, code(around))
                held = a.score >= min_score * EQUAL * length or (
                    a.equal >= min_equal and a.equal >= min_identity * (a.end - a.start)
                )
                if held and (best is None or a.score > best[0].score):
                    best = a, lo
            if best:
                a, lo = best
                spans = spans or [m.span() for m in _WORD.finditer(text)]
                first, last = (spans[min(lo + i, len(spans) - 1)] for i in (a.start, a.end - 1))
                out.append((self.ids[item], a.score / (EQUAL * length), a.equal, first[0], last[1]))
        return out


def windows(begins: list[int], slack: int) -> list[tuple[int, int]]:
    """Places where an item may begin, put together where they are close."""
    out: list[list[int]] = []
    for b in sorted(begins):
        if out and b - out[-1][1] <= slack and b - out[-1][0] <= 4 * slack:
            out[-1][1] = b
        else:
            out.append([b, b])
    return [(a, b) for a, b in out]


def item_blocks(items: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[tuple[list, list[list[str]]]]:
    """The items a block at a time."""
    ids, words, grams = [], [], 0
    for key, text in keyed_text(items, id_col, text_col).toLocalIterator():
        ids.append(key)
        words.append(words_of(text))
        grams += max(0, len(words[-1]) - n + 1)
        if grams >= BLOCK_GRAMS:
            yield ids, words
            ids, words, grams = [], [], 0
    if ids:
        yield ids, words


def gram_counts(rows: DataFrame, words: list[list[str]], n: int) -> dict[str, int]:
    """In how many documents each n-gram of a block of items occurs; ``rows`` is a table of texts alone."""
    asked = {" ".join(g) for ws in words for g in grams_of(ws, n)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(asked.intersection(map(" ".join, grams_of(words_of(text.as_py()), n))))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    counted = rows.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counted.toLocalIterator()}  # those of the block at most


def seeded(ids: list, words: list[list[str]], n: int, counts: dict[str, int] | None = None) -> Items:
    """The block with its rare n-grams as seeds, or with all of them where nothing is counted."""
    seeds: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
    for item, ws in enumerate(words):
        stretches: dict[int, list[tuple]] = defaultdict(list)
        for at, gram in enumerate(grams_of(ws, n)):
            if counts is None:
                seeds[gram].append((item, at))
            elif known := counts.get(" ".join(gram)):
                stretches[at // STRETCH].append((known, at, gram))
        for stretch in stretches.values():
            for _, at, gram in sorted(stretch)[:KEPT]:
                seeds[gram].append((item, at))
    return Items(ids, words, dict(seeds))


def find_items(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = GRAM,
    limits: tuple[float, int, float] = (MIN_SCORE, MIN_EQUAL, MIN_IDENTITY),
) -> DataFrame:
    """One row per document and item it holds: keys, ``score`` (1 for an exact copy), ``n_equal`` words, and
    ``start`` and ``end`` of the passage in code points."""
    rows = keyed_text(df, id_col, text_col)
    id_type, item_type = rows.schema[0].dataType, items.schema[item_id_col].dataType
    kinds = [("score", T.DoubleType()), *((c, T.LongType()) for c in ("n_equal", "start", "end"))]
    schema = T.StructType([T.StructField(c, k) for c, k in [(id_col, id_type), (item_id_col, item_type), *kinds]])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def search(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [
                    (key.as_py(), *m) for key, text in zip(*batch.columns) for m in block.matches(text.as_py(), limits)
                ]
                columns = list(zip(*out)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        return rows.mapInArrow(run, schema)

    found = df.sparkSession.createDataFrame([], schema)
    for ids, words in item_blocks(items, item_id_col, item_text_col, n):
        counts = gram_counts(rows.select(rows.columns[1]), words, n)
        found = found.union(search(seeded(ids, words, n, counts)))
    return found


def without_items(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = GRAM,
    limits: tuple[float, int, float] = (MIN_SCORE, MIN_EQUAL, MIN_IDENTITY),
) -> DataFrame:
    """The rows of ``df`` whose text holds no item, as they are; a row with a null text stays."""
    at = df.columns.index(text_col)

    def keep(block: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [t.as_py() is None or not block.matches(t.as_py(), limits) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    out, texts = df, df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for ids, words in item_blocks(items, item_id_col, item_text_col, n):
        out = out.mapInArrow(keep(seeded(ids, words, n, gram_counts(texts, words, n))), df.schema)
    return out
