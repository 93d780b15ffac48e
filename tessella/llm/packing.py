"""Packing into fixed windows by minimum bin slack.

Documents become token ids; full windows are cut off, and what remains of each document is known by
its length alone. For each window the longest remainder is placed and a subset-sum over the bits of
one integer finds which multiset of the others comes closest to the capacity; the counts come back by
tracing the layers. A chosen multiset is used as often as its counts last. Where no multiset fills the
window, one document is cut to close it, so the only padding is in the last windows of a task, and
these are cut into powers of two, which need none.

The lengths of one block of ``block_docs`` documents are packed together; what is left over goes to the
next block, and nothing is shuffled. Window numbers are the task's number and a counter: read the
documents from a written table, so that a task that runs again sees the same rows.

Cases: a null or empty text is one end mark; null keys and repeated rows are packed like any other
row; an empty table gives no pieces; a text longer than a window goes through in window-sized pieces.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import PRE, keyed_text
from tessella.llm.tokens import in_groups, vocabulary, word_encoder

CAPACITY = 4096
END_ID = 2
BLOCK_DOCS = 4096
VOCABULARY = "word_bpe_49k.json"


def closest_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` of the ascending lengths, each used ``counts`` times at most, and its counts.

    Bit s of ``reach`` says that some multiset sums to s. The layers before each length let the choice
    be traced back: the fewest copies that lead to a sum the earlier lengths reach.
    """
    reach, mask, layers = 1, (1 << (capacity + 1)) - 1, []
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        layers.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> capacity:
            break
    total = at = reach.bit_length() - 1
    chosen = {}
    for length, before in reversed(layers):
        copies = 0
        while not before >> at & 1:
            at, copies = at - length, copies + 1
        if copies:
            chosen[length] = copies
    return total, chosen


class Packer:
    """Packs blocks of pieces; a piece is (row, start, ids as bytes)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id, self.left, self.out = capacity, first_id, [], []

    def window(self, pieces: list[tuple]) -> None:
        at = 0
        for row, start, ids in pieces:
            self.out.append((row, start, ids, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def block(self, pieces: list[tuple]) -> None:
        """Fills windows from the pieces and those left over; keeps less than one window's worth."""
        by_length = defaultdict(deque)
        for piece in [*self.left, *pieces]:
            by_length[len(piece[2]) // 4].append(piece)
        self.left = []
        counts = {n: len(v) for n, v in by_length.items()}
        lengths = sorted(counts)
        total = sum(n * c for n, c in counts.items())

        def used(length: int, copies: int) -> None:
            counts[length] -= copies
            if not counts[length]:
                del counts[length], lengths[bisect_left(lengths, length)]

        while total >= self.capacity:
            first = lengths[-1]
            counts[first] -= 1
            best, chosen = closest_fill(lengths, counts, self.capacity - first)
            counts[first] += 1
            chosen[first] = chosen.get(first, 0) + 1
            slack = self.capacity - first - best
            times = 1 if slack else min(counts[n] // c for n, c in chosen.items())
            for n, c in chosen.items():
                used(n, c * times)
            for _ in range(times):
                window = [by_length[n].popleft() for n, c in chosen.items() for _ in range(c)]
                if slack:  # as the fill was the closest, every length that is left is longer than the slack
                    n = lengths[0]
                    row, start, ids = by_length[n].popleft()
                    window.append((row, start, ids[: 4 * slack]))
                    by_length[n - slack].append((row, start + slack, ids[4 * slack :]))
                    used(n, 1)
                    if n - slack not in counts:
                        insort(lengths, n - slack)
                    counts[n - slack] = counts.get(n - slack, 0) + 1
                total -= self.capacity
                self.window(window)
        self.left = [p for n in lengths for p in by_length[n]]

    def finish(self) -> None:
        """What is left, under one window, becomes windows of a power of two each."""
        left, self.left = deque(self.left), []
        total = sum(len(p[2]) // 4 for p in left)
        while total:
            size = 1 << (total.bit_length() - 1)
            total, pieces, need = total - size, [], size
            while need:
                row, start, ids = left.popleft()
                n = min(need, len(ids) // 4)
                pieces.append((row, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    left.appendleft((row, start + n, ids[4 * n :]))
                need -= n
            self.window(pieces)


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int | None = END_ID,
    vocabulary_path: str | None = None,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One row per piece: key, ``start`` in its document, ``length``, ``ids`` (little-endian 32-bit), the
    document's ``doc_tokens``, and the window (``sequence_id``) with the piece's ``offset`` there."""
    rows = keyed_text(df, id_col, text_col)
    id_type = rows.schema[0].dataType
    arrow_id = to_arrow_type(id_type)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    schema = T.StructType(
        [T.StructField(id_col, id_type)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length")]
        + [T.StructField("ids", T.BinaryType())]
        + [T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(vocabulary_path or vocabulary(VOCABULARY))
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        block: list[tuple] = []

        def emit() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r, *_ in out], type=arrow_id),
                    pa.array([s for _, s, *_ in out], type=pa.int64()),
                    pa.array([len(i) // 4 for _, _, i, *_ in out], type=pa.int64()),
                    pa.array([i for _, _, i, *_ in out], type=pa.binary()),
                    pa.array([r[1] for r, *_ in out], type=pa.int64()),
                    pa.array([q for *_, q, _ in out], type=pa.int64()),
                    pa.array([o for *_, o in out], type=pa.int64()),
                ],
                names=schema.names,
            )

        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            for key, ids in zip(batch.column(0), in_groups(encode, texts)):
                ids += end
                row, n = (key.as_py(), len(ids) // 4), len(ids) // 4
                full = n - n % capacity
                for at in range(0, full, capacity):
                    packer.window([(row, at, ids[4 * at : 4 * (at + capacity)])])
                if full < n:
                    block.append((row, full, ids[4 * full :]))
                if len(block) >= block_docs:
                    packer.block(block)
                    block = []
                if len(packer.out) >= 4096:
                    yield emit()
        packer.block(block)
        packer.finish()
        yield emit()

    return rows.mapInArrow(run, schema)


def pack_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pack(df, id_col, text_col, **options).select(
        id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
