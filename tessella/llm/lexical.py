"""Ranked lexical search over K2-treaps.

The index holds a row for each block of documents. The block's terms (the most frequent first) and documents
span a grid whose cells have the impact of the term in the document. A quadtree over the grid says
for each of its cells which quarters are not empty and what their greatest impact is: bitmaps by level, and, where
a cell has more than one such quarter, their difference from its maximum, in as few bytes as the level needs. An item's terms are rows of the grid. The
search goes down the paths of all these rows together: a state is a range of documents and, for each term, the
cell that holds its row there. The weighted sum of their maxima bounds the score of each document of the range.
States with the highest bound are opened first, some at a time, until no bound reaches the score of the k-th
document that is known; that score is carried from block to block of a task, so that later blocks open little. At the
last level a cell is one term in one document and the bound is the score.

Impacts need the number of documents and terms of the corpus, which a first pass counts. All documents are indexed
and searched. Items are taken in blocks of a bounded number of terms: for each, the document frequencies of
its terms are summed over the index, which gives their weights, and the index is searched once.

Cases: a null or empty text has no terms and is never found; an item without terms or without a match gives no
row; equal scores are ordered by key, a null key last; repeated rows are found once each; repeated items are
answered once each (``item_no`` tells them apart); empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import PRE, keyed_text, written

TOP = 10
#: Where a block of documents ends.
BLOCK_DOCS, BLOCK_TERMS = 2048, 1 << 20
#: Terms of the items that are looked for in one pass over the index.
PASS_TERMS = 1 << 18
#: States that are opened together.
BATCH = 128
#: Impact: SCALE * tf / (1000 * tf + LEVEL * m), with m = 100 - SLOPE + SLOPE * length / mean length.
SCALE, LEVEL, SLOPE = 1_000_000_000, 8, 90

# Letters, digits and whatever is not ASCII; only A to Z get lower case.
_TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM_BYTES).split()


def spread(x: np.ndarray) -> np.ndarray:
    """Each bit of ``x`` (up to 31 of them) at twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Treap:
    """A quadtree over (row, column) with the maximum of each cell.

    For each level from the root down: ``slots``, at four times a node's number plus the quarter the number of the child
    (the number of children if there is none), and ``tops``, the children's maxima with a zero behind them.
    """

    def __init__(self, height: int, slots: list[np.ndarray], tops: list[np.ndarray]):
        self.height, self.slots, self.tops = height, slots, tops

    @staticmethod
    def packed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[int, list[bytes], list[bytes]]:
        """Height (0 for no points), bitmaps, and differences from the parent's maximum, by level."""
        if not len(rows):
            return 0, [], []
        height = max(1, int(max(rows.max(), columns.max())).bit_length())
        keys = spread(rows) << np.uint64(1) | spread(columns)
        order = np.argsort(keys)
        keys, values = keys[order].astype(np.int64), values[order]
        bitmaps, drops = [], []
        for _ in range(height):
            first = np.flatnonzero(np.r_[True, keys[1:] >> 2 != keys[:-1] >> 2])
            sizes = np.diff(np.r_[first, len(keys)])
            above = np.maximum.reduceat(values, first)
            bits = np.zeros(4 * len(first), bool)
            bits[4 * np.repeat(np.arange(len(first)), sizes) + (keys & 3)] = True
            bitmaps.append(np.packbits(bits).tobytes())
            drop = (np.repeat(above, sizes) - values)[np.repeat(sizes > 1, sizes)]  # an only child has the maximum
            if not len(drop):
                drops.append(b"")
            else:
                drops.append(drop.astype(np.min_scalar_type(int(drop.max()))).tobytes())
            keys, values = keys[first] >> 2, above
        return height, [values.astype("<i8").tobytes(), *bitmaps[::-1]], drops[::-1]

    @staticmethod
    def unpacked(height: int, bitmaps: list[bytes], drops: list[bytes]) -> Treap:
        if not height:
            return Treap(0, [], [])
        tops, slots, out = np.frombuffer(bitmaps[0], "<i8"), [], []
        for bitmap, drop in zip(bitmaps[1:], drops):
            places = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), count=4 * len(tops)))
            nodes = places >> 2
            several = (np.bincount(nodes) > 1)[nodes]
            tops = tops[nodes]
            if drop:
                tops[several] -= np.frombuffer(drop, f"<u{len(drop) // int(several.sum())}").astype(np.int64)
            slot = np.full(4 * (int(places[-1]) // 4 + 2), len(places), np.int32)
            slot[places] = np.arange(len(places), dtype=np.int32)
            slots.append(slot)
            out.append(np.append(tops, 0).astype(np.int32 if tops.max() < 1 << 31 else np.int64))
        return Treap(height, slots, out)

    def descend(self, rows: np.ndarray, weights: np.ndarray, best: Best, keys: list) -> None:
        """Offers to ``best`` what may be among its highest; ``keys`` are those of the columns, in order."""
        pools: dict[int, tuple] = {}

        def put(level: int, bounds, ranges, nodes) -> None:
            if level in pools:
                bounds, ranges, nodes = (np.concatenate(x) for x in zip(pools[level], (bounds, ranges, nodes)))
            if len(bounds):
                pools[level] = (bounds, ranges, nodes)

        if self.height:
            put(0, np.array([np.iinfo(np.int64).max]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32))
        while pools:
            level = max(pools, key=lambda at: pools[at][0].max())
            bounds, ranges, nodes = pools.pop(level)
            open_ = np.flatnonzero(bounds >= best.least)
            if len(open_) > BATCH:
                cut = np.argpartition(-bounds[open_], BATCH)
                later, open_ = open_[cut[BATCH:]], open_[cut[:BATCH]]
                put(level, bounds[later], ranges[later], nodes[later])
            if not len(open_):
                continue
            if level == self.height:
                best.offer(bounds[open_], ranges[open_], keys)
                continue
            half = 2 * (rows >> (self.height - 1 - level) & 1)
            slot = 4 * nodes[open_] + half
            for right in (0, 1):
                children = self.slots[level][slot + right]
                bounds = self.tops[level][children] @ weights
                some = np.flatnonzero(bounds >= best.least)
                put(level + 1, bounds[some], 2 * ranges[open_][some] + right, children[some])


class Best:
    """The k highest scores above zero so far, equal ones by key."""

    def __init__(self, k: int):
        self.k, self.least, self.rows = k, 1, []

    def offer(self, scores: np.ndarray, columns: np.ndarray, keys: list) -> None:
        new = [(-s, keys[c] is None, keys[c]) for s, c in zip(scores.tolist(), columns.tolist())]
        self.rows = nsmallest(self.k, [*self.rows, *new], key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def corpus_size(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Number of documents with a term, and of terms with repeats."""
    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py()))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_pylist([{"docs": docs, "terms": terms}])

    total = rows.mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return (total[0] or 0, total[1] or 0)


class _Codes(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = code = len(self)
        return code


def build_index(df: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row per block of documents: ``keys``, ``terms`` (joined by blanks) with their document frequencies, and the treap."""
    rows = keyed_text(df, id_col, text_col)
    schema = T.StructType(
        [T.StructField("keys", T.ArrayType(rows.schema[0].dataType))]
        + [T.StructField(c, T.BinaryType()) for c in ("terms", "frequencies")]
        + [T.StructField("height", T.IntegerType())]
        + [T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("bitmaps", "drops")]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def block(keys: list, texts: list[np.ndarray], known: dict[bytes, int]) -> pa.RecordBatch:
        order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, 0 if keys[i] is None else keys[i]))
        keys, texts = [keys[i] for i in order], [texts[i] for i in order]
        lengths = np.array([len(t) for t in texts], np.int64)
        cells, counts = np.unique(np.concatenate(texts).astype(np.int64) << 32 | np.repeat(np.arange(len(keys)), lengths), return_counts=True)
        codes, columns = cells >> 32, cells & 0xFFFFFFFF
        frequencies = np.bincount(codes, minlength=len(known))
        by_frequency = np.argsort(-frequencies, kind="stable")
        place = np.empty(len(known), np.int64)
        place[by_frequency] = np.arange(len(known))
        m = 100 - SLOPE + SLOPE * lengths * n_docs // max(n_terms, 1)
        impacts = SCALE * counts // (1000 * counts + LEVEL * m[columns])
        height, bitmaps, drops = Treap.packed(place[codes], columns, impacts)
        names = list(known)
        terms = b" ".join(names[c] for c in by_frequency.tolist())
        line = [keys, terms, frequencies[by_frequency].astype("<i4").tobytes(), height, bitmaps, drops]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(line, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size, known = [], [], 0, _Codes()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                keys.append(key.as_py())
                texts.append(np.fromiter(map(known.__getitem__, terms), np.int32, len(terms)))
                size += len(terms)
                if len(keys) >= block_docs or size >= BLOCK_TERMS:
                    yield block(keys, texts, known)
                    keys, texts, size, known = [], [], 0, _Codes()
        if keys:
            yield block(keys, texts, known)

    return rows.mapInArrow(run, schema)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per item that has terms: ``item_no``, the key, and its ``terms`` once each."""
    texts = keyed_text(items, id_col, text_col)
    key = texts.schema[0]
    schema = T.StructType([T.StructField("item_no", T.LongType()), key, T.StructField("terms", T.ArrayType(T.BinaryType()))])
    numbered = texts.withColumn("item_no", F.monotonically_increasing_id()).select("item_no", key.name, f"{PRE}text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([sorted(set(terms_of(t.as_py()))) for t in batch.column(2)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], names=schema.names)

    return numbered.mapInArrow(run, schema).where(F.size("terms") > 0)


def document_frequencies(index: DataFrame, asked: set[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each of the terms; the terms are those of one block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for terms, frequencies in zip(batch.column(0), batch.column(1)):
                counts = np.frombuffer(frequencies.as_py(), "<i4")
                for at, term in enumerate(terms.as_py().split()):
                    if term in asked:
                        total[term] = total.get(term, 0) + int(counts[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    counted = index.select("terms", "frequencies").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in counted.toLocalIterator()}


def weighted(index: DataFrame, block: list[tuple], n_docs: int) -> list[tuple]:
    """The items of a block with those of their terms that the index has, and the weights of these."""
    frequencies = document_frequencies(index, set().union(*(terms for _, _, terms in block)))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in frequencies.items()}
    held = [(number, item, [t for t in terms if t in weight]) for number, item, terms in block]
    return [(number, item, terms, np.array([weight[t] for t in terms], np.int64)) for number, item, terms in held]


def passes(items: DataFrame, most: int = PASS_TERMS) -> Iterator[list[tuple]]:
    """The items in blocks of a bounded number of terms (a block is at least one item)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.terms) > most:
            yield block
            block, size = [], 0
        block.append((row.item_no, row[f"{PRE}id"], [bytes(t) for t in row.terms]))
        size += len(row.terms)
    if block:
        yield block


def found_by(index: DataFrame, items: list[tuple], id_type: T.DataType, item_type: T.DataType, k: int) -> DataFrame:
    """The k best documents of each task for each item of the block."""
    schema = T.StructType(
        [T.StructField("item_no", T.LongType()), T.StructField("item", item_type), T.StructField("key", id_type), T.StructField("score", T.LongType())]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = set().union(*(terms for _, _, terms, _ in items))
        best = [Best(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                line = {c: batch.column(c)[i] for c in batch.schema.names}
                keys = line["keys"].as_py()
                treap = Treap.unpacked(line["height"].as_py(), line["bitmaps"].as_py(), line["drops"].as_py())
                row = {t: at for at, t in enumerate(line["terms"].as_py().split()) if t in asked}
                for (_, _, terms, weights), top in zip(items, best):
                    held = [j for j, t in enumerate(terms) if t in row]
                    if held:
                        treap.descend(np.array([row[terms[j]] for j in held]), weights[held], top, keys)
                del line, row, treap  # before the next block is read
        lines = [(number, item, key, -score) for (number, item, _, _), top in zip(items, best) for score, _, key in top.rows]
        columns = list(zip(*lines)) or [[]] * len(arrow)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return index.select("keys", "terms", "height", "bitmaps", "drops").mapInArrow(run, schema)


def search(index: DataFrame, items: DataFrame, n_docs: int, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = TOP, pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_no``, item, ``rank`` from 1, key, ``score``.

    ``index`` is a written table.
    """
    id_type = index.schema["keys"].dataType.elementType
    asked = written(item_terms(items, item_col, text_col), "item-terms")
    item_type = asked.schema[f"{PRE}id"].dataType
    found = None
    for block in passes(asked, pass_terms):
        one = found_by(index, weighted(index, block, n_docs), id_type, item_type, k)
        found = one if found is None else found.union(one)
    if found is None:
        found = found_by(index.limit(0), [], id_type, item_type, k)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_no", F.col("item").alias(item_col), "rank", F.col("key").alias(id_col), "score")


def ranked_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", k: int = TOP) -> DataFrame:
    """Counts, indexes (in the shared folder) and searches."""
    n_docs, n_terms = corpus_size(docs, text_col)
    index = written(build_index(docs, n_docs, n_terms, id_col, text_col), "treaps")
    return search(index, items, n_docs, id_col, item_col, text_col, k).drop("item_no")


def ranked_sql() -> str:
    """The same in DuckDB, by scoring every document that shares a term."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return rf"""
with doc_terms as (select doc_id, {words} term from documents),
tf as (select doc_id, term, count(*) tf from doc_terms group by all),
doc as (select doc_id, sum(tf)::bigint n from tf group by doc_id),
corpus as (select count(*) n_docs, sum(n)::bigint n_terms from doc),
asked as (select distinct item_id, {words} term from benchmark),
weight as (
  select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint w
  from tf, corpus where term in (select term from asked) group by term),
score as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::bigint score
  from asked join weight using (term) join tf using (term) join doc using (doc_id), corpus group by all)
select item_id, rank, doc_id, score from (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int rank, doc_id, score from score where score > 0)
where rank <= 10"""
