"""Near copies by similarity: SimHash finds candidates, exact word shingles confirm them.

The fingerprints of ``simhash`` link what differs in a few bits. Texts that share ``SIMILAR`` of their five-word
shingles mostly differ in more, so this module takes a longer fingerprint (128 bits) and verifies texts.

* Texts of equal words are put together first; the rest works on different texts.
* Each text is dealt to tables by some of its bits. Their number follows from the number of texts, and the number of
  tables from the chance that two texts at the least similarity agree on these bits: together they miss one in fifty.
* In a group of a table, small ones compare all members. In larger ones a member is compared with the leaders, texts
  that no leader before was near to: distances to pivots discard most, the fingerprints decide, and the member is
  linked to the nearest. So a group gives fewer links than members and holds its leaders alone. Groups of more than
  ``HOT`` members are dealt out further; their leaders meet once more.
* Candidates are verified by the exact similarity of the texts' shingle sets, first the nearest one of every text, then
  those between texts that are not connected yet. A hub's links are spread over many tasks.
* Fingerprints miss some pairs, so an exact join follows between texts that are still apart: in one order of all shingles, two
  similar texts share a shingle among the first fifth of either's, and so many of these that the rest can make up for the others;
  only such pairs are verified. The order puts rare shingles first, as told by a bounded sample; it settles how much is
  compared, not what is found.

Cases: a null or empty text has no shingle and is linked to its equals alone; of equal keys any one row stays; repeated rows
count as copies; null keys come last; an empty table gives an empty table; other columns are kept as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessella.llm.common import PRE, written
from tessella.llm.graph import components
from tessella.llm.simhash import SEED, shingle_hashes

WORDS, SIMILAR = 5, 0.8
PRINT_BITS, LEAST_BITS = 128, 16
#: Share of the pairs at the least similarity that the tables find, and the most differing bits of a candidate.
RECALL, REACH = 0.98, 30
PIVOTS, SMALL, HOT = 8, 8, 4096
#: Copies of a hub's text, at most, when its links are verified.
SPOTS = 1024
#: Texts whose shingles are counted for the order, about; how often a frequent one occurs in them, and how many are kept, at most.
SAMPLE, OFTEN, MOST_OFTEN = 16_384, 4, 1 << 18
NODE, LOW, HIGH, RANK, SIZE, FIRST = (f"{PRE}{c}" for c in ("node", "low", "high", "rank", "size", "first"))


def bit_chance(similar: float = SIMILAR) -> float:
    """How often a bit differs between two texts of one length that share so many of all their shingles."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def table_bits(texts: int) -> int:
    """Bits of a group's key: some dozens of unrelated texts a group, whatever their number."""
    return max(LEAST_BITS, math.ceil(math.log2(max(texts, 1))) - 6)


def table_count(bits: int) -> int:
    return math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - bit_chance()) ** bits))


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits of a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def frequent(df: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that are frequent in a sample of the texts, the rarest first."""
    share = max(1, df.count() // SAMPLE)
    some = df.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py() or "", WORDS)) for t in batch.column(0)]
            hashes, counts = np.unique(np.concatenate([*found, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts)], names=["shingle", "n"])

    counts = some.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    kept = counts.orderBy(F.desc("n"), "shingle").limit(MOST_OFTEN).select("shingle").toArrow().column(0)
    return kept.to_numpy().view(np.uint64)[::-1]


def first_shingles(hashes: np.ndarray, often: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of a set of shingles (sorted) those that a similar text must share one of, in the order of all shingles.

    ``often`` are the frequent ones, sorted, and ``places`` their places behind all others.
    """
    many = len(hashes) - math.ceil(SIMILAR * len(hashes) - 1e-9) + 1 if len(hashes) else 0
    at = np.searchsorted(often, hashes)
    late = np.flatnonzero(often[np.minimum(at, len(often) - 1)] == hashes) if len(often) else at[:0]
    last = hashes[late][np.argsort(places[at[late]])]
    return np.concatenate([np.delete(hashes, late)[:many], last])[:many]


def sketch(text: str, often: np.ndarray, places: np.ndarray) -> tuple[bytes, int, int, int, np.ndarray]:
    """Digest of the words, the two halves of the fingerprint of the shingles, their number, and the first of them."""
    digest = xxhash.xxh3_128_digest(b" ".join(text.encode().lower().split()), SEED)
    hashes = np.unique(shingle_hashes(text, WORDS))
    counts = np.zeros(PRINT_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        both = np.stack([part, mixed(part)], 1).astype(">u8").view(np.uint8)
        counts += np.unpackbits(both).reshape(-1, PRINT_BITS).sum(0, dtype=np.int64)
    low, high = np.packbits(2 * counts > len(hashes)).view(">i8").tolist()
    return digest, low, high, len(hashes), first_shingles(hashes, often, places).view(np.int64)


def with_sketches(df: DataFrame, text_col: str) -> DataFrame:
    at = df.columns.index(text_col)
    kinds = {NODE: T.BinaryType(), LOW: T.LongType(), HIGH: T.LongType(), SIZE: T.LongType(), FIRST: T.ArrayType(T.LongType())}
    extra = [T.StructField(name, kind) for name, kind in kinds.items()]
    arrow = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    ordered = frequent(df, text_col)
    places = np.argsort(ordered)
    often = ordered[places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(t.as_py() or "", often, places) for t in batch.column(at)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *kinds])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *extra]))


def dealt(prints: DataFrame, bits: int) -> DataFrame:
    """(key, node, low, high): a row for every text and table."""
    many = table_count(bits)
    rng = np.random.default_rng(SEED)
    places = np.array([rng.permutation(PRINT_BITS)[:bits] for _ in range(many)])
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                halves = np.stack([batch.column(i).to_numpy().astype(">i8") for i in (1, 2)], 1)
                ones = np.unpackbits(halves.view(np.uint8).reshape(-1, PRINT_BITS // 8), axis=1)
                for number, place in enumerate(places):
                    key = (ones[:, place] @ powers) * many + number
                    yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], names=["key", "node", "low", "high"])

    rows = prints.select(F.col(NODE).alias("node"), F.col(LOW).alias("low"), F.col(HIGH).alias("high"))
    return rows.mapInArrow(run, "key long, node binary, low long, high long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints given as two 64-bit halves."""
    return np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int64) + np.bitwise_count(a[..., 1] ^ b[..., 1])


class Leaders:
    """The leaders of one group, with their distances to the pivots."""

    def __init__(self):
        self.pivots = np.random.default_rng(SEED).integers(0, 1 << 63, (PIVOTS, 2), np.uint64)
        self.prints = np.empty((16, 2), np.uint64)
        self.table = np.empty((16, PIVOTS), np.int16)
        self.nodes: list[bytes] = []

    def take(self, node: bytes, own: np.ndarray) -> tuple[bytes, bytes, int] | None:
        """A link to the nearest leader; without one the text becomes a leader itself."""
        n, spots = len(self.nodes), distance(own, self.pivots)
        near = np.flatnonzero(np.abs(self.table[:n] - spots).max(1, initial=0) <= REACH)
        if len(near):
            apart = distance(self.prints[near], own)
            best = int(apart.argmin())
            if apart[best] <= REACH:
                return self.nodes[near[best]], node, int(apart[best])
        if n == len(self.prints):
            self.prints, self.table = np.resize(self.prints, (2 * n, 2)), np.resize(self.table, (2 * n, PIVOTS))
        self.prints[n], self.table[n] = own, spots
        self.nodes.append(node)
        return None


def links_of(nodes: list[bytes], prints: np.ndarray) -> Iterator[tuple[bytes, bytes, int]]:
    """All pairs of a small group that are near enough."""
    for step in range(1, len(nodes)):
        apart = distance(prints[:-step], prints[step:])
        for i in np.flatnonzero(apart <= REACH).tolist():
            yield nodes[i], nodes[i + step], int(apart[i])


def linked(groups: DataFrame, leaders_too: bool = False) -> DataFrame:
    """Links (a, b, apart) inside groups, the rows of ``dealt`` brought together by ``key`` (and ``salt``, if there).

    With ``leaders_too`` every leader comes as well, as a row whose b is null.
    """
    by = [c for c in ("key", "salt") if c in groups.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, few, leaders, out = None, [], None, []

        def end() -> None:
            nonlocal few, leaders
            if leaders is None and not leaders_too:
                out.extend((now[0], *link, None, None) for link in links_of([n for n, _ in few], np.array([p for _, p in few])) if len(few) > 1)
            elif leaders is None:
                grow()
            if leaders_too and leaders is not None:
                halves = leaders.prints[: len(leaders.nodes)].view(np.int64).tolist()
                out.extend((now[0], node, None, None, *h) for node, h in zip(leaders.nodes, halves))
            few, leaders = [], None

        def grow() -> None:
            nonlocal leaders
            leaders = Leaders()
            for node, own in few:
                if link := leaders.take(node, own):
                    out.append((now[0], *link, None, None))

        def emit() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out)) or [[]] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "a", "b", "apart", "low", "high"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            prints = np.stack([batch.column(c).to_numpy() for c in ("low", "high")], 1).view(np.uint64)
            for key, node, own in zip(keys, batch.column("node").to_pylist(), prints):
                if key != now:
                    if now is not None:
                        end()
                    now = key
                if leaders is not None:
                    if link := leaders.take(node, own):
                        out.append((now[0], *link, None, None))
                    continue
                few.append((node, own))
                if len(few) > SMALL:
                    grow()
                    few = []
            if len(out) > 10_000:
                yield emit()
        if now is not None:
            end()
        yield emit()

    rows = groups.repartition(*by).sortWithinPartitions(*by, "node")
    return rows.mapInArrow(run, "key long, a binary, b binary, apart long, low long, high long")


def candidates(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b, apart) between different texts that may be similar, a before b."""
    bits = table_bits(prints.count())
    rows = dealt(prints, bits)
    crowded = written(rows.groupBy("key").count().where(F.col("count") > hot), "hot-groups")
    usual, links = rows, None
    if not crowded.isEmpty():
        usual = rows.join(crowded, "key", "left_anti")
        salt = (F.xxhash64("node") % F.ceil(F.col("count") / hot)).alias("salt")
        first = written(linked(rows.join(F.broadcast(crowded), "key").select("key", salt, "node", "low", "high"), True), "leaders")
        lead = first.where("b is null").select("key", F.col("a").alias("node"), "low", "high")
        links = first.where("b is not null").unionByName(linked(lead))
    links = linked(usual) if links is None else linked(usual).unionByName(links)
    ends = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    return links.select(*ends, "apart").where("a <> b").groupBy("a", "b").agg(F.min("apart").alias("apart"))


def similar(links: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The links (a, b) whose texts (``texts`` has node and text) share ``least`` of their shingles."""
    spotted = links.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SPOTS)).alias("spot_b"), F.pmod(F.xxhash64("a"), F.lit(SPOTS)).alias("spot_a"))

    def with_text(rows: DataFrame, end: str, spot: str) -> DataFrame:
        spots = rows.select(end, spot).distinct().join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
        return rows.join(spots, [end, spot])

    both = with_text(with_text(spotted, "a", "spot_b"), "b", "spot_a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3))]
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def similarity(a: str, b: str) -> float:
    x, y = (np.unique(shingle_hashes(t, WORDS)) for t in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if common else 0.0


def missed(prints: DataFrame, groups: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between texts of different groups that share one of their first shingles and may be similar.

    Of two similar texts the first shingle they share leaves enough behind it in both. What they share besides the first
    ones of both lies behind the last of one of them, so the first ones alone must hold about half in common. A shingle of
    many texts is dealt to many tasks: each of its texts is in one part on one side and in all on the other.
    """
    nodes = prints.select(F.col(NODE).alias("node"), F.col(RANK)["row"].alias("id"), F.col(SIZE).alias("size"), F.col(FIRST).alias("first"))
    roots = groups.join(nodes.select(F.col("node").alias("root"), F.col("id").alias("group")), "root").select("node", "group")
    own = nodes.join(roots, "node", "left").withColumn("group", F.coalesce("group", "id"))
    rest = (F.col("size") - F.size("first")).alias("rest")
    rows = own.select("id", "group", "size", rest, F.posexplode("first").alias("at", "shingle"))
    of = W.partitionBy("shingle")
    shared = rows.withColumns({"n": F.count("*").over(of), "least": F.min("group").over(of), "most": F.max("group").over(of)})
    shared = written(shared.where("least < most").drop("least", "most"), "shared")
    parts = F.ceil(F.col("n") / hot)
    names = ("id", "group", "size", "rest", "at")
    left = shared.select("shingle", F.pmod(F.xxhash64("id"), parts).alias("part"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = shared.select("shingle", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in names])
    # With more than a rounding error to spare: the texts themselves decide.
    least = F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("size_a") + F.col("size_b")) - 1e-6
    links = left.join(right, ["shingle", "part"]).where("id_a < id_b and group_a <> group_b").where(F.least("size_a", "size_b") >= least)
    ends = [F.max(c).alias(c) for c in ("size_a", "size_b", "rest_a", "rest_b")]
    places = [F.min("at_a").alias("from_a"), F.min("at_b").alias("from_b"), F.max("at_a").alias("to_a"), F.max("at_b").alias("to_b")]
    links = links.groupBy("id_a", "id_b").agg(F.count("*").alias("common"), *ends, *places)
    most = F.expr("common + greatest(least(rest_a, size_b - to_b - 1), least(rest_b, size_a - to_a - 1))")
    links = links.where(F.expr("least(size_a - from_a, size_b - from_b)") >= least).where(most >= least).select("id_a", "id_b")
    for end in ("a", "b"):
        links = links.join(nodes.select(F.col("id").alias(f"id_{end}"), F.col("node").alias(end)), f"id_{end}")
    return links.select("a", "b")


def near_groups(rows: DataFrame, text_col: str, hot: int = HOT) -> DataFrame:
    """(node, root): texts of ``rows`` (a written table with sketches and ``RANK``) that hang together, where there are others."""
    least = rows.groupBy(NODE).agg(F.min(F.struct(RANK, LOW, HIGH, SIZE, FIRST)).alias("s"))
    prints = written(least.select(NODE, "s.*"), "prints")
    links = written(candidates(prints, hot), "candidates")
    own = rows.select(F.col(NODE).alias("node"), RANK, F.coalesce(text_col, F.lit("")).alias("text"))
    first = prints.select(F.col(NODE).alias("node"), F.col(RANK).alias("first"))

    def texts_of(links: DataFrame) -> DataFrame:
        asked = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        rows = own.join(first.join(asked, "node", "left_semi"), "node").where(F.col(RANK) == F.col("first"))
        return written(rows.select("node", "text"), "texts")

    texts = texts_of(links)
    ends = links.select(F.col("a").alias("node"), "a", "b", "apart").union(links.select("b", "a", "b", "apart"))
    nearest = ends.groupBy("node").agg(F.min(F.struct("apart", "a", "b")).alias("l")).select("l.a", "l.b").distinct()
    held = written(similar(nearest, texts), "similar")
    groups = written(components(held), "groups")
    name = lambda end: groups.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rest = links.join(nearest, ["a", "b"], "left_anti").join(name("a"), "a", "left").join(name("b"), "b", "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    held = written(held.union(similar(rest, texts)), "similar")
    groups = written(components(held), "groups")
    left = written(missed(prints, groups, hot), "candidates")
    if left.isEmpty():
        return groups
    return written(components(written(held.union(similar(left, texts_of(left))), "similar")), "groups")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of ``df``, of each group of similar texts the one with the smallest key, of equal keys any one."""
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = written(with_sketches(df, text_col).withColumn(RANK, rank), "sketched")
    groups = near_groups(rows, text_col, hot)
    nodes = rows.groupBy(NODE).agg(F.min(RANK).alias("least")).join(groups, F.col(NODE) == F.col("node"), "left")
    kept = nodes.groupBy(F.coalesce("root", NODE)).agg(F.min("least").alias("least")).select(F.col("least").alias(RANK))
    return rows.join(kept, RANK, "left_semi").select(*df.columns)
