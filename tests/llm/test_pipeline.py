"""The pipeline's stages against brute force on a small table, and on odd inputs."""

import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm import decontaminate, pii, quality
from tessella.llm.tokens import vocabulary
from test_near_text import groups_of, jaccard, shingles

SF = "/root/testdata/sf0.001"


def expected(spark, docs, bench):
    """doc_id to final text, by plain code on collected rows, without and with the near copies."""
    good = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    ids = sorted(texts)
    sets = [shingles(texts[i]) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if jaccard(sets[a], sets[b]) >= 0.8]
    label = groups_of(near, len(ids))
    copies = {i for k, i in enumerate(ids) if label[k] != k}
    items = [decontaminate.words_of(r.text) for r in bench.collect()]
    held = lambda t: any(f" {' '.join(w)} " in t for w in items)
    texts = {i: t for i, t in texts.items() if not held(f" {' '.join(decontaminate.words_of(t))} ")}
    final = {i: pii.redacted(t) for i, t in texts.items()}
    return {i: t for i, t in final.items() if i not in copies}, final


def test_rows_equal_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want, with_copies = expected(spark, docs, bench)
    rows = corpus_pipeline.run(spark, SF).collect()
    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    # All that is no copy stays; of the copies at most a tenth is overlooked.
    assert set(want) <= set(got) <= set(with_copies)
    assert len(set(got) - set(want)) <= 0.1 * (len(with_copies) - len(want))
    for i, parts in got.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(parts)), "<u4").tolist()
        assert ids == [*plain.encode(with_copies[i], add_special_tokens=False).ids, 2]


def test_stages_keep_the_columns(spark):
    rng = random.Random(1)
    prose = lambda n: "The " + " ".join(rng.choice(["the", "of", *["".join(rng.choice("aeioustrnl") for _ in range(6))] * 6]) for _ in range(n))
    a, b = prose(120), prose(120)
    rows = [(1, a, "en", None, 5, 0.5, "x"), (1, a, "en", None, 5, 0.5, "x"), (2, a, None, "s", 5, 0.1, None), (None, b + " a@b.cd", "en", "s", None, None, "y"), (4, None, None, None, None, None, None), (5, "", "en", "s", 0, 0.0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept double, ids string")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.count() > 0
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted(r.doc_id is None for r in docs.collect()) == [False, True]
    masked = next(r for r in docs.collect() if r.doc_id is None)
    assert masked.text == b + " [EMAIL]" and masked.n_chars == len(masked.text) and masked.ids == "y"
