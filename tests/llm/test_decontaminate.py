"""Decontamination: alignment against a plain table, planted copies, clean texts, odd inputs."""

import random

import numpy as np

from tessella.llm import decontaminate as D
from tessella.llm.queries import QUERIES


def plain_score(a, b):
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.EQUAL if a[i - 1] == b[j - 1] else D.DIFFERENT
            rows[i][j] = max(0.0, rows[i - 1][j - 1] + s, rows[i - 1][j] + D.GAP, rows[i][j - 1] + D.GAP)
    return max(map(max, rows))


def test_alignment_equals_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 15))]
        b = [rng.randrange(5) for _ in range(rng.randrange(1, 25))]
        got = D.align(np.array(a), np.array(b))
        assert abs(got.score - plain_score(a, b)) < 1e-9
        assert plain_score(a, b[got.start : got.end]) == got.score and 0 <= got.equal <= len(a)


def words(rng, n):
    common = ["the", "of", "and", "to", "in", "is"]
    return [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(n)]


def test_planted_copies_and_clean_texts(spark):
    rng = random.Random(2)
    items = [words(rng, rng.randrange(16, 60)) for _ in range(30)] + [["too", "short"], []]
    rows, want = [], set()
    for i in range(240):
        body, kind = words(rng, rng.randrange(20, 200)), i % 6
        k = i % 30
        copy = list(items[k])
        if kind == 1:  # some words replaced
            copy = [w if rng.random() > 0.12 else "changed" for w in copy]
        if kind == 2:  # some words left out, some put in
            copy = [x for w in copy for x in ([w] if rng.random() > 0.1 else []) + (["new"] if rng.random() < 0.05 else [])]
        if kind == 3:
            copy = [w.upper() + "," for w in copy]
        if kind < 4:
            at = rng.randrange(len(body))
            body[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(body), -1))
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(w), 0) for k, w in enumerate(items)] + [(99, None, 0)], "item_id long, text string, score int")
    found = D.find_items(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        if r.score == 1:
            assert D.words_of(texts[r.doc_id][r.start : r.end]) == items[r.item_id]
    kept = {r.doc_id for r in D.without_items(df, bench).collect()}
    assert kept == set(texts) - {i for i, _ in got}


def test_hot_item_keeps_its_seeds(spark):
    rng = random.Random(3)
    item = " ".join(words(rng, 30))
    df = spark.createDataFrame([(i, item if i % 2 else " ".join(words(rng, 50))) for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_items(df, bench).collect()} == {(i, k) for i in range(1, 200, 2) for k in (1, 2)}


def test_parts_of_an_item_in_one_document_and_in_a_third(spark):
    rng = random.Random(6)
    item = words(rng, 60)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for part in (item[:20], item[-20:]):
        for every in (300, 3):
            rows = [(i, [*words(rng, 15), *(part if i % every == 0 else []), *words(rng, 15)]) for i in range(300)]
            df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
            assert {r.doc_id for r in D.find_items(df, bench).collect()} == set(range(0, 300, every))


def test_only_places_that_cannot_reach_a_limit_are_passed_over():
    rng = random.Random(7)
    few = ["the", "of", "and", "to", "in", "is", "was", "it"]
    held = 0
    for _ in range(300):
        item = [rng.choice(few) for _ in range(rng.randrange(8, 40))]
        text = [rng.choice([*few, "else", "other"]) for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.5:
            text[3:3] = item[: rng.randrange(3, len(item))]
        got = D.seeded([0], [item], D.GRAM).matches(" ".join(text), (D.MIN_SCORE, D.MIN_EQUAL, D.MIN_IDENTITY))
        a = D.align(*(np.array([hash(w) for w in ws]) for ws in (item, text)))
        best = a.score >= D.MIN_SCORE * D.EQUAL * len(item)
        shared = set(D.grams_of(item, D.GRAM)) & set(D.grams_of(text, D.GRAM))
        assert not (best and shared) or got
        held += bool(got)
    assert 50 < held < 290


def test_blocks_nulls_and_empty_tables(spark, monkeypatch):
    rng = random.Random(4)
    items = [" ".join(words(rng, 20)) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    rows = [(1, items[0]), (1, items[0]), (None, items[1] + " " + items[2]), (3, None), (4, ""), (5, "x " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, 0), (1, 0), (None, 1), (None, 2)], key=str)
    for size in (D.BLOCK_GRAMS, 25):
        monkeypatch.setattr(D, "BLOCK_GRAMS", size)
        assert sorted(((r.doc_id, r.item_id) for r in D.find_items(df, bench).collect()), key=str) == want
        assert sorted(str(r.doc_id) for r in D.without_items(df, bench).collect()) == ["3", "4", "5"]
    assert D.find_items(df.limit(0), bench).count() == 0 and D.find_items(df, bench.limit(0)).count() == 0


def test_query_finds_all_exact_copies(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: f" {' '.join(D.words_of(r.text))} " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: f" {' '.join(D.words_of(r.text))} " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in texts.items() for i, s in items.items() if s in t}
    got = {(r.doc_id, r.item_id): r.score for r in QUERIES["op9_seeded_alignment"](spark, sf).collect()}
    assert want and {k for k, s in got.items() if s == 1} == want


def test_seeds_are_the_rare_present_ones_of_each_stretch(spark):
    item = [f"w{i}" for i in range(14)]
    docs = [" ".join(item[:9])] * 3 + [" ".join(item[2:5]), " ".join(item[4:9]), None]
    rows = spark.createDataFrame([(d or "",) for d in docs], "text string")
    counts = D.gram_counts(rows, [item], 3)
    want = {g: sum(f" {' '.join(g)} " in f" {d} " for d in docs if d) for g in D.grams_of(item, 3)}
    assert counts == {" ".join(g): n for g, n in want.items() if n}
    seeds = D.seeded([0], [item], 3, counts).seeds
    places = sorted(at for spots in seeds.values() for _, at in spots)
    assert places == [0, 1, 4, 5] and len(D.seeded([0], [item], 3).seeds) == 12
