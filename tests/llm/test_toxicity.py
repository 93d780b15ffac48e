"""Toxicity: held-out accuracy, folds, scores from the text alone, odd inputs."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import toxicity as X
from tessella.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = X.train(X.training_sample(docs, labels, "doc_id", "text", "toxic"))
    held = docs.join(labels, "doc_id").where(X.held_out(F.col("doc_id")))
    rows = X.score(held, model).join(labels, "doc_id").select("score", "toxic").collect()
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    assert np.mean([b > g for b in bad for g in good]) > 0.9
    assert np.mean([(r.score >= 0.5) == r.toxic for r in rows]) > 0.9


def test_query_folds_and_range(spark):
    rows = QUERIES["op7_toxicity_subwords"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_unseen_misspelling_shares_grams():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    sample = [(" ".join([word() for _ in range(30)] + (["wretched"] if i % 2 else [])), i % 2) for i in range(400)]
    model = X.train(sample)
    score = X.Scorer(*model)
    assert score("abcde wretchedd fghab") > 0.5 > score("abcde fghab ghabc")
    assert score("wretchd") > score("gardens")


def test_sample_leaves_out_the_held_out_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = {int(t.split()[1]) for t, _ in X.training_sample(docs, labels, "doc_id", "text", "toxic")}
    assert got == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


def test_odd_inputs(spark):
    rows = [(1, None, 9.0), (1, None, 9.0), (None, "", 9.0), (2, "w " * 100_000, 9.0), (3, "é😀 \x00", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1)], "doc_id long, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0.5 for r in X.toxicity(docs, labels.limit(0)).collect())
    assert X.toxicity(docs.limit(0), labels).count() == 0


def test_long_runs_are_read_to_their_end():
    rng = random.Random(6)
    run = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for n in (1, 39, 40, 41, 75, 76, 300):
        word = run(n)
        got = X.words_of(f"x {word} y")
        assert got[0] == "x" and got[-1] == "y" and all(len(w) <= X.PIECE for w in got)
        grams = {word[i : i + k] for k in range(X.SHORTEST, X.LONGEST + 1) for i in range(n - k + 1)}
        assert grams == {p[i : i + k] for p in got[1:-1] for k in range(X.SHORTEST, X.LONGEST + 1) for i in range(len(p) - k + 1)}
    sample = [(" ".join([run(5) for _ in range(30)] + (["wretched"] if i % 2 else [])), i % 2) for i in range(400)]
    score = X.Scorer(*X.train(sample))
    assert score(run(60) + "wretched") > score(run(68))


def brute_score(model, text):
    """Every passage by itself, every word from its grams."""
    shares, bias = model
    words = X.words_of(text)
    value = [np.mean([shares[b] for b in X.subwords(w)]) for w in words]
    spans = [(a, min(len(words), a + X.PASSAGE)) for a in range(0, max(1, len(words) - X.PASSAGE + X.STRIDE), X.STRIDE)] if len(words) > X.PASSAGE else [(0, len(words))]
    best = max(sum(value[a:b]) / max(1, b - a) for a, b in spans)
    return 1 / (1 + np.exp(-np.clip(best + bias, -30, 30)))


def test_scorer_equals_brute_force():
    rng = random.Random(7)
    model = (np.random.default_rng(1).normal(size=X.BUCKETS), 0.3)
    score = X.Scorer(*model)
    for n in [0, 1, 11, 12, 13, 18, 19, 50, 200]:
        text = " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.choice([2, 6, 90]))) for _ in range(n))
        assert abs(score(text) - brute_score(model, text)) < 1e-9


def test_very_long_texts_are_not_fitted(spark):
    docs = spark.createDataFrame([(i, "text " * (6000 if i == 7 else 3)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert all(len(t) <= X.SAMPLE_CHARS for t, _ in X.training_sample(docs, labels, "doc_id", "text", "toxic"))
