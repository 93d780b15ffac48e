"""SimHash: fingerprints by definition, components against all pairs, large groups, odd inputs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessella.llm import simhash
from tessella.llm.graph import components
from tessella.llm.queries import QUERIES


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """By id: the smallest id that is reached over links of at most four bits."""
    ids, label = list(prints), {i: i for i in prints}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint_by_definition():
    rng = random.Random(1)
    texts = ["", " \n", "One", "one two three", "One TWO three four", "é\x1cÀ b c d", "a b c d " * 9] + [
        " ".join(rng.choice(["a", "Bc", "é", "\x0b", "\n", "x1"]) for _ in range(rng.randrange(60))) for _ in range(100)
    ]
    for t in texts:
        assert simhash.fingerprint(t) == brute_print(t), t


def near_set(rng, n):
    out = []
    while len(out) < n:
        out.append(p := rng.getrandbits(64))
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(7)):
                p ^= 1 << rng.randrange(64)
            out.append(p)
    return out


def test_components_equal_all_pairs(spark):
    rng = random.Random(2)
    hot = rng.getrandbits(64)
    crowd = [hot ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(250)]
    prints = {i: p for i, p in enumerate(near_set(rng, 300) + crowd + [0, 1, 3, (1 << 64) - 1, 1 << 63])}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    df = spark.createDataFrame(rows, f"doc_id long, {simhash.PRE}print long").repartition(4)
    got = {r.doc_id: r[simhash.COMPONENT] for r in simhash.labelled(df, "doc_id").collect()}
    assert got == brute_components(prints)
    links = simhash.near_links(df.select(f"{simhash.PRE}print").distinct(), f"{simhash.PRE}print").count()
    assert links < 4 * len(rows)  # a crowd gives no pairs


def test_pivots_only_discard(spark):
    rng = np.random.default_rng(3)
    linker = simhash.GroupLinker()
    x = rng.integers(0, 1 << 63, 2000, np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    assert (np.abs(linker.distances(x) - linker.distances(y)).max(1) <= 4).all()
    far = np.abs(linker.distances(x[:-1]) - linker.distances(x[1:])).max(1) > 4
    assert far.mean() > 0.99


def test_chain_components(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text, 0), (3, text.upper(), 0), (3, text.upper(), 0), (None, text, 0), (9, text.replace("w77 ", "zz "), 0), (7, None, 0), (8, "", 0), (1, "w " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    want_near = brute_components({5: brute_print(text), 9: brute_print(rows[4][1])})[9] == 5
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (9, 3 if want_near else 9), (7, 7), (8, 7), (1, 1)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([3, 7, 1] + ([] if want_near else [9]))
    assert simhash.one_of_each(df.limit(0)).count() == 0
    alone = simhash.near_duplicates(df.where(F.col("doc_id").isNull())).first()
    assert alone.component_id is None


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: brute_print(texts[i]) for i in sorted(texts)}
    labels = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_pivots"](spark, sf).collect()}
    assert got == {i: (f"{prints[i]:016x}", labels[i]) for i in prints}
