"""Repeated strings against a brute-force set of all strings; levels; odd inputs."""

import hashlib
import random

import numpy as np

from tessella.llm import suffix_index
from tessella.llm.queries import QUERIES
from tessella.llm.suffix_index import LENGTH, SuffixFamily, repeats_digest


def brute(docs, length=LENGTH):
    """docs: texts in the order of the documents."""
    seen, out = set(), []
    for text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = int((gone[1:] < gone[:-1]).sum())
        out.append((len(data), int(gone[:-1].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (15, 25, 60, 200)]
    docs = []
    for _ in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randrange(1, 80)) for _ in range(rng.randrange(1, 6))]
        docs.append("\n".join(parts))
    docs += [docs[3], docs[5][:300], docs[7] + "x", "x" + docs[7], docs[9][1:]]
    docs += ["a" * 1000, "a" * 300, "ab" * 400, "", None, "q" * 99, "q" * 99, "q" * 100, "q" * 100]
    rng.shuffle(docs)
    return docs


def test_equals_brute_force(spark):
    for seed in range(2):
        docs = corpus(random.Random(seed))
        df = spark.createDataFrame([(3 * i - 50, t, i) for i, t in enumerate(docs)], "doc_id long, text string, n long").repartition(5)
        got = {r.doc_id: tuple(r)[1:] for r in repeats_digest(df).collect()}
        assert got == {3 * i - 50: want for i, want in enumerate(brute(docs))}


def test_blocks_and_short_lengths(spark, monkeypatch):
    docs = corpus(random.Random(9))
    for text in docs:
        data = np.frombuffer((text or "").encode(), np.uint8)
        runs = suffix_index.key_runs(data, LENGTH, 32)
        cut = suffix_index.key_runs(data, LENGTH, 32, block=37)
        flat = lambda r: [k for k, a, b in zip(*map(np.ndarray.tolist, r[:3])) for _ in range(a, b)]
        assert flat(runs) == flat(cut) and len(flat(runs)) == max(0, len(data) - LENGTH + 1)


def test_family_of_levels():
    rng = random.Random(7)
    family, seen = SuffixFamily(4), set()
    for _ in range(40):
        text = bytes(rng.choice(b"ab\x00") for _ in range(rng.randrange(4, 60)))
        starts = np.arange(len(text) - 3)
        want = []
        for i in starts:
            want.append(text[i : i + 4] in seen)
            seen.add(text[i : i + 4])
        assert family.add(text, starts).tolist() == want
        sizes = [len(level) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(map(len, family.levels)) == len(seen)


def test_ties_nulls_and_empty_tables(spark):
    a, b = "first text " * 12, "second text " * 12
    rows = [(1, a), (1, a), (None, a), (1, b), (2, b), (None, None), (7, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_bytes - r.n_removed == 0) for r in repeats_digest(df).collect()), key=str)
    kept_a = [r.n_removed for r in repeats_digest(df).where("doc_id = 1").collect() if r.n_bytes == len(a)]
    assert sorted(x == len(a) for x in kept_a) == [False, True]  # of two equal rows one is the first
    assert (None, len(a), True) in got and (2, len(b), True) in got and (None, 0, True) in got and (7, 5, False) in got
    assert repeats_digest(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_suffix_family"](spark, sf).collect()}
    assert got == dict(zip(sorted(texts), brute([texts[i] for i in sorted(texts)])))
