"""Token-id output: best-fit-decreasing packing into the rows of id matrices.

Documents become ids of a lossless byte-level vocabulary with an end mark. One longer than a row is split
into full rows and a rest. The pieces of a block of documents are placed from the longest to the shortest,
each into the open row with the least room that is enough; a segment tree over the amounts of room says
which that is. A row is written with its ids (padded), the cumulative lengths of its segments and the
positions that start anew at each segment. Nothing is shuffled; a row's number is its task's number and a
counter, so read the documents from a written table.

Cases: a null or empty text is one end mark; null keys and repeated rows are packed like any other row; an
empty table gives no rows; texts of any length are split without loss (``unpacked`` puts them together).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import PRE, keyed_text
from tessella.llm.tokens import byte_encoder, in_groups, vocabulary

ROW = 2048
END_ID = 50256
BLOCK_DOCS = 4096
VOCABULARY = "byte_bpe_50k.tiktoken"


class RoomTree:
    """Counts of open rows by room, in a segment tree; finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        """The least room of ``need`` or more that some row has."""
        at = need + self.size
        if self.sums[at]:
            return need
        while at > 1 and (at & 1 or not self.sums[at + 1]):  # up, to the first subtree on the right that has a row
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.size:
            at = 2 * at if self.sums[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(lengths: list[int], row: int) -> list[list[int]]:
    """Rows of indices into ``lengths``, placed from the longest to the shortest."""
    tree, open_rows, rows = RoomTree(row), [[] for _ in range(row + 1)], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room is None:
            room, at = row, len(rows)
            rows.append([])
        else:
            at = open_rows[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        if left := room - lengths[i]:
            open_rows[left].append(at)
            tree.add(left, 1)
    return rows


def packed_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row: int = ROW,
    end_id: int = END_ID,
    pad_id: int = END_ID,
    vocabulary_path: str | None = None,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """One line per row of the matrices: ``row_id``, ``n_tokens``, ``input_ids`` (``row`` little-endian 32-bit
    ids), ``cu_seqlens``, ``position_ids`` (like the ids), and for each segment ``doc_ids`` and ``starts``."""
    rows = keyed_text(df, id_col, text_col)
    id_type = rows.schema[0].dataType
    schema = T.StructType(
        [T.StructField("row_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("input_ids", T.BinaryType())]
        + [T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_ids", T.BinaryType())]
        + [T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("starts", T.ArrayType(T.LongType()))]
    )
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    counting = np.arange(row, dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_encoder(vocabulary_path or vocabulary(VOCABULARY))
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        lines: list[tuple] = []

        def line(pieces: list[tuple]) -> None:
            nonlocal number
            ids = b"".join(p[2] for p in pieces)
            sizes = [len(p[2]) // 4 for p in pieces]
            n = sum(sizes)
            lines.append(
                (
                    number, n, ids + np.full(row - n, pad_id, "<u4").tobytes(), [0, *np.cumsum(sizes).tolist()],
                    b"".join(counting[:s].tobytes() for s in sizes) + bytes(4 * (row - n)),
                    [p[0] for p in pieces], [p[1] for p in pieces],
                )
            )
            number += 1

        def emit() -> pa.RecordBatch:
            columns = list(zip(*lines)) or [[]] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            lines.clear()
            return batch

        def place(pieces: list[tuple]) -> None:
            for members in best_fit([len(p[2]) // 4 for p in pieces], row):
                line([pieces[i] for i in members])

        pieces: list[tuple] = []
        for batch in batches:
            for key, ids in zip(batch.column(0), in_groups(encode, (t.as_py() for t in batch.column(1)))):
                ids += end
                full = len(ids) // 4 - len(ids) // 4 % row
                for at in range(0, full, row):
                    line([(key.as_py(), at, ids[4 * at : 4 * (at + row)])])
                if 4 * full < len(ids):
                    pieces.append((key.as_py(), full, ids[4 * full :]))
                if len(pieces) >= block_docs:
                    place(pieces)
                    pieces = []
                if len(lines) >= 1024:
                    yield emit()
        place(pieces)
        yield emit()

    return rows.mapInArrow(run, schema)


def write_packed(df: DataFrame, path: str, **options) -> None:
    """Writes the matrices, a file for each task: its rows one below the other."""
    packed_rows(df, **options).write.mode("overwrite").parquet(path)


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every segment, cut out of the rows by their cumulative lengths."""
    at = F.col("at")
    parts = rows.select(F.posexplode("doc_ids").alias("at", "doc_id"), "starts", "cu_seqlens", "input_ids")
    first = F.get("cu_seqlens", at)
    return parts.select(
        "doc_id", F.get("starts", at).alias("start"), F.substring("input_ids", 4 * first + 1, 4 * (F.get("cu_seqlens", at + 1) - first)).alias("ids")
    )


def rows_digest(df: DataFrame, **options) -> DataFrame:
    """The rows with checksums in place of ids and positions."""
    return packed_rows(df, **options).select(
        "row_id", "n_tokens", F.crc32("input_ids").alias("ids_crc32"), "cu_seqlens",
        F.crc32("position_ids").alias("positions_crc32"), "doc_ids", "starts",
    )
