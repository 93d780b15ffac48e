"""Near copies by similarity: recall against brute force, only similar texts linked, large groups, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import near_text as N
from tessella.llm.common import written


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def edited(rng, words, share):
    """Some words changed, a few in a row, until about so many shingles are gone."""
    words = list(words)
    for _ in range(max(1, int(len(words) * share / 6))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def corpus(rng, families, most):
    texts = []
    for _ in range(families):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(words)
        texts += [edited(rng, words, rng.choice([0.05, 0.1, 0.15, 0.2, 0.3])) for _ in range(rng.randrange(most))]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def groups_of(pairs, n):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return [find(i) for i in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string").repartition(4)


def test_recall_and_precision(spark):
    rng = random.Random(1)
    texts = corpus(rng, 150, 4)
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(sets[i], sets[j]) >= 0.8]
    label = groups_of(pairs, len(texts))
    for hot in (N.HOT, 2):  # the second deals almost every group with company out
        kept = {r.doc_id for r in N.one_of_each(frame(spark, texts), hot=hot).collect()}
        found = sum(label[i] != i and i not in kept for i in range(len(texts)))
        assert found >= 0.9 * sum(label[i] != i for i in range(len(texts))), (found, len(pairs))
        assert {i for i in range(len(texts)) if label[i] == i} <= kept  # nothing clean goes, the smallest key stays


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: shingles(r.text or "") for r in docs.collect()}
    ids = sorted(rows)
    at = {}
    for i in ids:
        for s in rows[i]:
            at.setdefault(s, []).append(i)
    near = {(a, b) for v in at.values() if len(v) < 300 for k, a in enumerate(v) for b in v[k + 1 :]}
    pairs = [(ids.index(a), ids.index(b)) for a, b in near if jaccard(rows[a], rows[b]) >= 0.8]
    label = groups_of(pairs, len(ids))
    kept = {r.doc_id for r in N.one_of_each(docs).collect()}
    gone = [i for i, x in enumerate(ids) if label[i] != i]
    assert sum(ids[i] not in kept for i in gone) >= 0.9 * len(gone)
    assert {ids[i] for i in range(len(ids)) if label[i] == i} <= kept


def test_a_large_group_gives_few_links(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = [" ".join(edited(rng, words, 0.06)) for _ in range(600)] + [" ".join(words)] * 300
    df = frame(spark, texts)
    rows = written(N.with_sketches(df, "text").withColumn(N.RANK, F.struct("doc_id")), "sketched")
    prints = written(rows.groupBy(N.NODE).agg(F.min(N.RANK).alias(N.RANK), F.min(N.LOW).alias(N.LOW), F.min(N.HIGH).alias(N.HIGH)), "prints")
    tables = N.table_count(N.table_bits(prints.count()))
    assert N.candidates(prints).count() < (N.SMALL - 1) / 2 * tables * 601
    assert [r.doc_id for r in N.one_of_each(df).collect()] == [0]
    assert [r.doc_id for r in N.one_of_each(df, hot=20).collect()] == [0]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(None, "a b c", 1), (3, "A  b\nC", 2), (3, "a b c", 3), (4, None, 4), (5, "", 5), (6, long, 6), (7, long + " more", 7), (8, "a b d", 8)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {N.LOW[6:]} long")
    got = N.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 4, 6, 8]
    assert N.one_of_each(df.limit(0)).count() == 0


def test_numbers_of_tables():
    assert N.table_bits(1) == N.table_bits(10**6) == 16 and N.table_bits(1 << 30) == 24
    for bits in (16, 20, 24):
        assert 1 - (1 - (1 - N.bit_chance()) ** bits) ** N.table_count(bits) >= N.RECALL


def far_pairs(rng, many):
    """Pairs of similar texts whose fingerprints are too far apart for a candidate."""
    none = np.empty(0, np.uint64)
    prints = lambda t: np.array([x & (2**64 - 1) for x in N.sketch(t, none, none)[1:3]], np.uint64)
    pairs = []
    while len(pairs) < many:
        words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        a, b = " ".join(words), " ".join([*(f"n{rng.randrange(10**6)}" for _ in range(5)), *words[5:], *(f"n{rng.randrange(10**6)}" for _ in range(5))])
        if jaccard(shingles(a), shingles(b)) >= 0.8 and N.distance(prints(a), prints(b)) > N.REACH:
            pairs += [a, b]
    return pairs


def test_pairs_of_far_fingerprints_are_linked(spark):
    texts = far_pairs(random.Random(3), 10)
    for hot in (N.HOT, 2):
        kept = {r.doc_id for r in N.one_of_each(frame(spark, texts), hot=hot).collect()}
        assert kept == set(range(0, len(texts), 2))


def test_groups_are_those_of_brute_force(spark):
    rng = random.Random(4)
    # A line that many texts begin with, frequent shingles alone, members of a family near to one another but not to its first.
    texts = corpus(rng, 120, 6) + far_pairs(rng, 4)
    texts += ["the same line at the head of many short texts " + " ".join(f"v{rng.randrange(40)}" for _ in range(4)) for _ in range(150)]
    sets = [shingles(t) for t in texts]
    label = groups_of([(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(sets[i], sets[j]) >= 0.8], len(texts))
    for hot in (N.HOT, 5):
        kept = {r.doc_id for r in N.one_of_each(frame(spark, texts), hot=hot).collect()}
        assert kept == {i for i in range(len(texts)) if label[i] == i}
