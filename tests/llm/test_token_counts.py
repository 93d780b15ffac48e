"""Token counts: equal to the library's own on whole tables and odd texts, the merging against its definition."""

import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import token_counts
from tessella.llm.queries import QUERIES
from tessella.llm.tokens import vocabulary

PATH = vocabulary(token_counts.VOCABULARY)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute_merge(symbols, ranks):
    """Always merges the leftmost pair of least rank, looking at all pairs each time."""
    symbols = list(symbols)
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in ranks]
        if not pairs:
            return symbols
        _, i = min(pairs)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_merging_by_definition():
    rng = random.Random(1)
    for _ in range(300):
        ranks = {"".join(rng.choices("ab", k=rng.randrange(2, 6))): rng.randrange(6) for _ in range(12)}
        text = "".join(rng.choices("abc", k=rng.randrange(30)))
        left = brute_merge(text, ranks)
        assert [s for s in token_counts.merge(text, ranks) if s] == [len(s) for s in left], (text, ranks)


ODD = ["", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "\n\na", "a\n b", "a \nb", "▁", "a▁▁b", "<s>x</s><unk><0x0A>", "\x00﻿　",
       "\U0001f600‍漢字", "a" * 5000, "ab " * 900, "é" * 300, "\t\tx\r\n", " " * 100, "x" + " " * 37 + "y"]


def test_counts_equal_the_library():
    count = token_counts.counter(PATH)
    for text in ODD:
        assert count(text) == len(LIBRARY.encode(text)), repr(text[:40])


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeht., \n▁'é一\U0001f600<s>0x9") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    assert token_counts.counter(PATH)(text) == len(LIBRARY.encode(text))


def test_long_run_without_blanks():
    rng = random.Random(2)
    text = "".join(rng.choices("etaoin", k=300_000))
    start = time.time()
    n = token_counts.counter(PATH)(text)
    assert time.time() - start < 60
    assert n == len(LIBRARY.encode(text))


def test_whole_table(spark):
    rows = QUERIES["op13_heap_merge_counts"](spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(LIBRARY.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5), (None, "two words", 6), (2, "", 7), (2, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = [tuple(r) for r in token_counts.token_counts(df, limit=1).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, False), (None, 9, 2, True), (2, 0, 0, False), (2, 0, 0, False)], key=str)
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Vocabulary({"a▁": -1.0})
