"""Ranked search: the treap against its points, ranks against scoring every document, ties, odd rows, the query against SQL."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from oracle import compare, duck
from tessella.llm import lexical
from tessella.llm.queries import QUERIES, SQL

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """(item, rank, key, score) by scoring every document."""
    counts = [(key, Counter(terms(text))) for key, text in docs]
    counts = [(key, c) for key, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s:
                scores.append((-s, key is None, key or 0, key, s))
        out += [(item, rank + 1, key, s) for rank, (*_, key, s) in enumerate(sorted(scores, key=lambda r: r[:3])[:k])]
    return out


def test_treap_keeps_points_and_maxima():
    rng = np.random.default_rng(1)
    for side, n in ((1, 1), (2, 3), (300, 500), (70_000, 2_000)):
        points = np.unique(rng.integers(0, side, (n, 2)), axis=0)
        values = rng.integers(0, 10**6, len(points))
        treap = lexical.Treap.unpacked(*lexical.Treap.packed(points[:, 0], points[:, 1], values))
        assert treap.tops[0].max() == values.max()
        for (row, column), value in zip(points.tolist(), values.tolist()):
            node, bound = 0, 10**9
            for level in range(treap.height):
                shift = treap.height - 1 - level
                node = treap.slots[level][4 * node + 2 * (row >> shift & 1) + (column >> shift & 1)]
                assert treap.tops[level][node] <= bound
                bound = treap.tops[level][node]
            assert bound == value
        assert sum(len(t) - 1 for t in treap.tops[-1:]) == len(points)


def test_split_is_the_pattern_s():
    rng = random.Random(1)
    chars = [chr(c) for c in range(256)] + ["é", "İ", " ", "漢", "\U0001f600", "ﬁ"]
    for _ in range(300):
        text = "".join(rng.choices(chars, k=60))
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


def table_of(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))
    copies = text()
    docs = [(i, copies if rng.random() < 0.3 else text()) for i in range(n)]
    return docs, [(i, text()) for i in range(25)]


@pytest.mark.parametrize("block_docs", [3, 64, 4096])
def test_ranks_equal_brute_force(spark, block_docs):
    docs, items = table_of(random.Random(block_docs), 400)
    docs += [(None, docs[5][1]), (None, docs[6][1]), (1000, None), (1001, "!!"), (7, docs[7][1])]
    items += [(90, None), (91, "unknown"), (92, "W0 w0, W0"), (None, "w1 w2"), (92, "W0")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, rank int").repartition(2)
    n_docs, n_terms = lexical.corpus_size(d)
    index = lexical.written(lexical.build_index(d, n_docs, n_terms, block_docs=block_docs), "index")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(index, i, n_docs, pass_terms=60).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items), key=str)


def test_bounds_leave_states_closed():
    """With copies of the item in the first block, the second opens less than its documents."""
    rng = random.Random(3)
    docs = [" ".join(f"x{rng.randrange(3000)}" for _ in range(30)).split() for _ in range(500)]
    known = lexical._Codes()
    points = sorted({(known[t], d) for d, words in enumerate(docs) for t in words})
    rows, columns = np.array(points).T
    treap = lexical.Treap.unpacked(*lexical.Treap.packed(rows, columns, np.full(len(rows), 1000)))
    best, opened = lexical.Best(10), []
    best.rows, best.least = [(-25_000, False, -i) for i in range(10)], 25_000
    best.offer = lambda scores, columns, keys: opened.extend(columns)
    treap.descend(np.array([known[t] for t in sorted(set(docs[0]))]), np.ones(len(set(docs[0])), np.int64), best, list(range(500)))
    assert opened == [0]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked_documents(docs.limit(0), items).count() == 0
    assert lexical.ranked_documents(docs, items.limit(0)).count() == 0
    assert lexical.ranked_documents(docs.where("text is null"), items).count() == 0
    assert [tuple(r) for r in lexical.ranked_documents(docs, items).collect()] == brute([(1, "a b")], [(1, "a")])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    ok, text, _ = compare(spark, sf, "op12_treap_search", QUERIES["op12_treap_search"], SQL["op12_treap_search"], duck(sf))
    assert ok, text
