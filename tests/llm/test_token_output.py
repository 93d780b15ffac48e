"""Token-id rows: best fit against brute force, exact round trip, positions, odd inputs."""

import base64
import random

import numpy as np
import tiktoken
from public_tokenizers import PATTERN, path

from tessella.llm.token_output import RoomTree, best_fit, packed_rows, rows_digest, unpacked, write_packed


def brute_fit(lengths, row):
    rooms, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else None
        if room is None:
            rooms.append(row)
            room = row
        rooms.remove(room)
        rooms.append(room - lengths[i])
        rows.append(room)
    return sorted(rooms)


def test_room_tree():
    rng = random.Random(1)
    tree, rooms = RoomTree(37), []
    for _ in range(500):
        if rooms and rng.random() < 0.4:
            tree.add(rooms.pop(rng.randrange(len(rooms))), -1)
        else:
            rooms.append(rng.randint(0, 37))
            tree.add(rooms[-1], 1)
        need = rng.randint(0, 37)
        assert tree.least(need) == min((r for r in rooms if r >= need), default=None)


def test_best_fit_equals_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.randint(1, 30) for _ in range(rng.randrange(60))]
        rows = best_fit(lengths, 30)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(30 - sum(lengths[i] for i in r) for r in rows) == brute_fit(lengths, 30)


def test_round_trip(spark, tmp_path):
    texts = ["", None, "é😀 \t x", "word  two\n\n three ", "long text " * 9000, *["again"] * 30, "\x1c\xa0　"]
    df = spark.createDataFrame([(i if i else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, starts int").repartition(3)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    write_packed(df, f"{tmp_path}/rows", block_docs=7)
    rows = spark.read.parquet(f"{tmp_path}/rows")
    got = {}
    for r in unpacked(rows).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, t in enumerate(texts):
        ids = np.frombuffer(b"".join(b for _, b in sorted(got[i or None])), "<u4").tolist()
        assert ids[-1] == 50256 and encoding.decode(ids[:-1]) == (t or "")
    for r in rows.collect():
        assert len(r.input_ids) == len(r.position_ids) == 4 * 2048 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        positions = np.frombuffer(r.position_ids, "<u4")
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert a < b and positions[a:b].tolist() == list(range(b - a))
    assert len({r.row_id for r in rows.collect()}) == rows.count()
    assert packed_rows(df.limit(0)).count() == 0 and rows_digest(df).count() > 0


def test_whole_table_equals_plain_encoding(spark):
    """The query's own rows over a table: every document's ids in order, by checksum of its segments."""
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: np.array([*encoding.encode_ordinary(r.text or ""), 50256], "<u4") for r in docs.collect()}
    rows = rows_digest(docs).collect()
    for r in rows:
        parts = [want[d][s : s + b - a] for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:])]
        ids = np.concatenate([*parts, np.full(2048 - r.n_tokens, 50256, "<u4")])
        assert [len(p) for p in parts] == np.diff(r.cu_seqlens).tolist() and r.ids_crc32 == zlib.crc32(ids.tobytes())
    held = {}
    for r in rows:
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            held.setdefault(d, []).append((s, s + b - a))
    for d, ids in want.items():
        spans = sorted(held[d])
        assert spans[0][0] == 0 and spans[-1][1] == len(ids) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def test_one_very_long_run(spark):
    text = "".join(random.Random(3).choices("etaoin", k=400_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sum(r.n_tokens for r in rows_digest(df).collect()) > 100_000
