"""Near copies beyond the fingerprints' reach are linked, texts that share a mere passage are not even verified."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import near_text as N
from tessella.llm.common import written
from test_near_text import frame, jaccard, shingles


def far_pair(rng):
    """Two texts of similarity 0.8 whose fingerprints are too far apart for a candidate."""
    none = np.empty(0, np.uint64)
    prints = lambda t: np.array([x & (2**64 - 1) for x in N.sketch(t, none, none)[1:3]], np.uint64)
    while True:
        words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        a, b = " ".join(words), " ".join([*words[:44], *(f"n{rng.randrange(10**6)}" for _ in range(5))])
        if jaccard(shingles(a), shingles(b)) == 0.8 and N.distance(prints(a), prints(b)) > N.REACH:
            return [a, b]


def test_only_pairs_that_can_be_similar_are_verified(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(30):  # three texts of a passage, a fifth of each
        passage = [f"w{rng.randrange(10**6)}" for _ in range(24)]
        texts += [" ".join([*passage, *(f"n{rng.randrange(10**6)}" for _ in range(96))]) for _ in range(3)]
    texts += [*far_pair(rng), *far_pair(rng)]
    df = frame(spark, texts).withColumn("row", F.col("doc_id"))
    prints = written(N.with_sketches(df, "text").withColumn(N.RANK, F.struct("doc_id", "row")), "prints")
    links = N.missed(prints, spark.createDataFrame([], "node binary, root binary"))
    ids = {bytes(r[N.NODE]): r.doc_id for r in prints.select(N.NODE, "doc_id").collect()}
    assert {frozenset((ids[bytes(r.a)], ids[bytes(r.b)])) for r in links.collect()} == {frozenset((90, 91)), frozenset((92, 93))}
    kept = {r.doc_id for r in N.one_of_each(frame(spark, texts)).collect()}
    assert kept == set(range(len(texts))) - {91, 93}
