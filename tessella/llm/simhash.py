"""SimHash near-duplicates, linked with tables of distances to pivots.

A fingerprint has a bit where over half of the hashes of the text's word shingles have it. Equal
fingerprints are put together first. Two fingerprints that differ in ``bits`` places at most agree on
at least three of seven blocks of bits, so each is dealt to 35 groups by its bits in three blocks. In a
group every fingerprint has its Hamming distances to reference fingerprints, the pivots. As these
distances obey the triangle inequality, a pair whose distances to any pivot differ by more than ``bits``
is discarded; the survivors are verified. A pair belongs to the first group that both are in, and a
group only says which of its members hang together (fewer links than members), so a large group of
near copies gives no pairs. Components of these links are found on the cluster.

Cases: a null or empty text has fingerprint zero, linked like any other; a null key gets its component's
smallest key (null if there is none); repeated rows give one result each; an empty table gives an empty
result; texts are hashed whole. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessella.llm.common import PRE, keyed_text, written
from tessella.llm.graph import components, spread_to

SEED = 42
BITS = 4
#: With seven blocks and four differing bits, three blocks are equal.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)
EQUAL_BLOCKS = 3
PIVOTS = 32
SMALL_RUN = 8
COMPONENT = f"{PRE}component"


def shingle_hashes(text: str, words: int) -> np.ndarray:
    parts = text.encode().lower().split()
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if parts else [], np.uint64)
    ends = list(accumulate((len(p) + 1 for p in parts), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[words:])), np.uint64, len(parts) - words + 1
    )


def fingerprint(text: str, words: int = 4) -> int:
    hashes = shingle_hashes(text, words).astype(">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(key, fingerprint as a signed long), a row per row."""
    rows = keyed_text(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, f"{PRE}print"])

    return rows.mapInArrow(
        run, T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField(f"{PRE}print", T.LongType())])
    )


def with_fingerprints(df: DataFrame, text_col: str, words: int = 4) -> DataFrame:
    """``df`` with a fingerprint for each row, whatever its columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or "", words) for t in batch.column(at)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, f"{PRE}print"]
            )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(f"{PRE}print", T.LongType())]))


def block_masks() -> list[int]:
    edges = list(accumulate(BLOCKS, initial=0))
    blocks = [((1 << n) - 1) << at for n, at in zip(BLOCKS, edges)]
    return [sum(c) for c in combinations(blocks, EQUAL_BLOCKS)]


def pivot_prints(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def first_group(x: np.ndarray) -> np.ndarray:
    """The first group that two fingerprints share, from the bits in which they differ."""
    first = np.full(len(x), 255, np.uint8)
    for i, mask in reversed(list(enumerate(block_masks()))):
        first[x & np.uint64(mask) == 0] = i
    return first


class GroupLinker:
    """Links inside groups; a group is a run of equal keys in sorted order."""

    def __init__(self, bits: int = BITS):
        self.bits, self.pivots = bits, pivot_prints()

    def distances(self, prints: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints[:, None] ^ self.pivots[None, :]).astype(np.int8)

    def near(self, prints, table, groups, left, right) -> np.ndarray:
        """Of the pairs (left, right) those that survive the pivots, are near, and belong to this group."""
        ok = np.abs(table[left] - table[right]).max(1) <= self.bits
        left, right = left[ok], right[ok]
        differ = prints[left] ^ prints[right]
        near = np.bitwise_count(differ) <= self.bits
        left, right = left[near], right[near]
        own = first_group(differ[near]) == groups[left]
        return np.stack([left[own], right[own]], 1)

    def small(self, keys, prints, groups) -> np.ndarray:
        """Pairs of all runs at once, by their distance in the sorted order."""
        table, found = self.distances(prints), [np.empty((0, 2), np.int64)]
        at = np.arange(len(keys))
        for step in range(1, SMALL_RUN):
            left = at[:-step][keys[:-step] == keys[step:]]
            if not len(left):
                break
            found.append(self.near(prints, table, groups, left, left + step))
        return prints[np.concatenate(found)]

    def large(self, prints, group: int) -> np.ndarray:
        """A spanning forest of one run: each member, once reached, looks at those not yet reached."""
        order = np.argsort(self.distances(prints)[:, 0], kind="stable")
        prints = prints[order]
        table = self.distances(prints)
        groups = np.full(len(prints), group, np.uint8)
        waiting, found = np.ones(len(prints), bool), []
        first = table[:, 0].astype(np.int16)
        for seed in range(len(prints)):
            if not waiting[seed]:
                continue
            waiting[seed], todo = False, [seed]
            while todo:
                x = todo.pop()
                lo, hi = np.searchsorted(first, [first[x] - self.bits, first[x] + self.bits + 1])
                other = lo + np.flatnonzero(waiting[lo:hi])
                pairs = self.near(prints, table, groups, np.full(len(other), x), other)
                found.append(pairs)
                waiting[pairs[:, 1]] = False
                todo += pairs[:, 1].tolist()
        return prints[np.concatenate(found)] if found else np.empty((0, 2), np.uint64)

    def link(self, keys, prints, groups) -> Iterator[np.ndarray]:
        """Keys in order; every run is whole."""
        if not len(keys):
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        some = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
        yield self.small(keys[some], prints[some], groups[some])
        for i in np.flatnonzero(sizes > SMALL_RUN):
            a, b = starts[i], starts[i] + sizes[i]
            yield self.large(prints[a:b], groups[a])


def near_links(prints: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints``; their components are those of all near pairs."""
    if bits > len(BLOCKS) - EQUAL_BLOCKS:
        raise ValueError(f"{len(BLOCKS)} blocks of which {EQUAL_BLOCKS} are equal allow {len(BLOCKS) - EQUAL_BLOCKS} bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*(F.col(column).bitwiseAND(F.lit(signed(m))) for m in block_masks()))
    dealt = prints.select(F.col(column).alias("print"), F.posexplode(masks).alias("grp", "part"))
    dealt = dealt.select(F.xxhash64("grp", "part").alias("key"), F.col("grp").cast("byte"), "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = GroupLinker(bits)
        rest = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)]

        def out(found):
            for pairs in found:
                if len(pairs):
                    a, b = pairs.view(np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a.copy()), pa.array(b.copy())], names=["a", "b"])

        for batch in batches:
            new = [batch.column("key").to_numpy(), batch.column("print").to_numpy().view(np.uint64), batch.column("grp").to_numpy().view(np.uint8)]
            keys, *others = (np.concatenate([r, n]) for r, n in zip(rest, new))
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last run may go on
            yield from out(linker.link(keys[:cut], *(o[:cut] for o in others)))
            rest = [keys[cut:], *(o[cut:] for o in others)]
        yield from out(linker.link(*rest))

    return dealt.repartition("key").sortWithinPartitions("key", "grp").mapInArrow(run, "a long, b long")


def labelled(prints: DataFrame, id_col: str, bits: int = BITS) -> DataFrame:
    """``prints`` (a written table of keys and fingerprints) with the smallest key of each row's component (``COMPONENT``)."""
    own = f"{PRE}print"
    distinct = written(prints.groupBy(own).agg(F.min(id_col).alias(f"{PRE}least")), "prints")
    roots = components(near_links(distinct.select(own), own, bits)).select(F.col("node").alias(own), F.col("root").alias(f"{PRE}root"))
    roots = distinct.join(roots, own, "left").withColumn(f"{PRE}root", F.coalesce(f"{PRE}root", own))
    least = roots.groupBy(f"{PRE}root").agg(F.min(f"{PRE}least").alias(COMPONENT))
    return prints.join(spread_to(roots, least, f"{PRE}root", own).select(own, COMPONENT), own)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """One row per input row: key, ``fingerprint`` (16 hexadecimal digits) and ``component_id``."""
    prints = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    return labelled(prints, id_col, bits).select(
        id_col, F.lower(F.lpad(F.hex(f"{PRE}print"), 16, "0")).alias("fingerprint"), F.col(COMPONENT).alias("component_id")
    )


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = BITS) -> DataFrame:
    """The rows of ``df``, one of each component: the one with the smallest key, of equal keys any one."""
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(with_fingerprints(df, text_col, words).withColumn(f"{PRE}rank", rank), "ranked")
    return labelled(rows, f"{PRE}rank", bits).where(F.col(f"{PRE}rank") == F.col(COMPONENT)).select(*df.columns)
