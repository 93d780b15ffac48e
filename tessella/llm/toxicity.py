"""Toxicity by subword-bag embeddings, averaged into a linear softmax.

A word is the bag of its hashed character n-grams and itself; its vector is the mean of theirs, so a
misspelt or inflected word shares most of its vector with the word it comes from. A passage is the average
of its words, and goes into a softmax over two classes; embeddings and softmax are trained together in
numpy on a bounded sample of labelled texts. A label speaks of a whole text of which few words may be to
blame, so a text is read in overlapping passages of ``PASSAGE`` words and its score is that of its worst
passage, in training as well (the passage that scores highest learns from the label).

As the softmax is linear, every n-gram has one number, its share of the logit, and scoring a text adds up
numbers by word. Scores come from the text alone.

Cases: a null or empty text scores the prior of a passage without words; a null key is not held out and is
never trained on; repeated rows each get their score; with no labelled text, or with labels of one class only,
every score is that class's share (0.5 if none); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import PRE, keyed_text

BUCKETS, DIM = 1 << 16, 8
SHORTEST, LONGEST = 3, 6
PASSAGE, STRIDE = 12, 6
#: At most so many labelled texts are fitted, at most so many of them clean, none with more characters.
SAMPLE, CLEAN, SAMPLE_CHARS = 6000, 3000, 20_000
#: A longer run of letters and digits is read in pieces of this length; they overlap, so that no n-gram is lost.
PIECE = 40
EPOCHS, RATE, SEED, DECAY = 12, 0.5, 7, 1e-5
MEMO = 300_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    if words and max(map(len, words)) > PIECE:
        words = [p for w in words for p in pieces(w)]
    return words


def pieces(word: str) -> list[str]:
    step = PIECE - LONGEST + 1
    return [word[i : i + PIECE] for i in range(0, max(1, len(word) - LONGEST + 1), step)]


def subwords(word: str) -> set[int]:
    """Buckets of the word and of its n-grams, with marks at both ends."""
    marked = f"<{word}>"
    if marked.isascii():  # a gram is a slice of the bytes as well
        data, hash_of = marked.encode(), zlib.crc32
        n = len(data)
        grams = {data[i : i + k] for k in range(SHORTEST, LONGEST + 1) for i in range(n - k + 1)}
        return {hash_of(g) % BUCKETS for g in grams} | {hash_of(data) % BUCKETS}
    grams = {marked[i : i + k] for k in range(SHORTEST, LONGEST + 1) for i in range(len(marked) - k + 1)} | {marked}
    return {zlib.crc32(g.encode()) % BUCKETS for g in grams}


def passages(n: int) -> np.ndarray:
    """Begin and end of the overlapping passages of a text of n words; one without words if it has none."""
    begin = np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE) if n > PASSAGE else np.zeros(1, np.int64)
    return np.stack([begin, np.minimum(n, begin + PASSAGE)], 1)


class Vocabulary:
    """Number of each word of the sample, and the buckets of each number in one long array."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int32)

    def buckets(self) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = array("i"), array("q", [0])
        for word in self.number:
            flat.extend(sorted(subwords(word)))
            ends.append(len(flat))
        return np.array(flat, np.int32), np.array(ends, np.int64)


def gather(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start to its end, one after another, and which range each is from."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which], which


class Model:
    """Embeddings of the buckets and the softmax's weights."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.weights = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def word_vectors(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.vectors[flat], ends[:-1], axis=0) if len(flat) else np.zeros((0, DIM), np.float32)
        return sums / np.diff(ends)[:, None]

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        """Adagrad over groups of texts; each text teaches through its worst passage."""
        rng = np.random.default_rng(SEED)
        spans = [passages(len(t)) for t in texts]
        squares = np.full((BUCKETS, 1), 1e-3, np.float32)
        share = np.clip(labels.mean(), 0.02, 0.98)
        cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        head = np.full(DIM * 2 + 2, 1e-3, np.float32)
        for epoch in range(EPOCHS):
            words = self.word_vectors(flat, ends)
            logit = words @ (self.weights[:, 1] - self.weights[:, 0])
            worst = []
            for t, ps in zip(texts, spans):
                run = np.r_[0.0, np.cumsum(logit[t])]
                a, b = ps.T
                scores = (run[b] - run[a]) / np.maximum(1, b - a)
                worst.append(ps[int(np.argmax(scores))] if epoch else ps[int(rng.integers(len(ps)))])
            order = rng.permutation(len(texts))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                members = [texts[i][slice(*worst[i])] for i in some]
                sizes = np.array([len(m) for m in members])
                numbers = np.concatenate(members) if sizes.sum() else np.zeros(0, np.int32)
                owner = np.repeat(np.arange(len(some)), sizes)
                place, of_word = gather(ends[numbers], ends[numbers + 1])
                buckets = flat[place]
                weight = (1 / np.diff(ends)[numbers] / np.maximum(sizes, 1)[owner])[of_word].astype(np.float32)
                passage = owner[of_word]
                mean = np.zeros((len(some), DIM), np.float32)
                np.add.at(mean, passage, self.vectors[buckets] * weight[:, None])
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), labels[some]] -= 1
                p *= cost[some][:, None] / len(some)
                to_vectors = (p @ self.weights.T)[passage] * weight[:, None]
                gradient = np.r_[(mean.T @ p + DECAY * self.weights).ravel(), p.sum(0)]
                head += gradient**2
                step = 0.1 * gradient / np.sqrt(head)
                self.weights -= step[:-2].reshape(DIM, 2)
                self.bias -= step[-2:]
                used, back = np.unique(buckets, return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, back, to_vectors)
                squares[used] += (total**2).mean(1, keepdims=True)
                self.vectors[used] -= RATE * total / np.sqrt(squares[used])

    def logits(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the logit of class 1, and the logit of a passage without words."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores texts with one number a bucket; words seen before are looked up.

    The memo has two generations, the older one goes when the newer is full.
    """

    def __init__(self, shares: np.ndarray, bias: float):
        self.shares, self.bias, self.new, self.old = shares.tolist(), bias, {}, {}

    def word(self, word: str) -> float:
        if (value := self.old.get(word)) is None:
            buckets, shares = subwords(word), self.shares
            value = sum([shares[b] for b in buckets]) / len(buckets)
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        self.new[word] = value
        return value

    def __call__(self, text: str) -> float:
        words, known = words_of(text), self.new
        values = np.array([v if (v := known.get(w)) is not None else self.word(w) for w in words])
        run = np.r_[0.0, np.cumsum(values)]
        a, b = passages(len(values)).T
        return float(1 / (1 + np.exp(-np.clip(((run[b] - run[a]) / np.maximum(1, b - a)).max() + self.bias, -30, 30))))


def held_out(key) -> F.Column:
    """Whether the key's fold is 0; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts outside the held-out fold, chosen by the hash of their keys; very long ones are not fitted."""
    keys = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias(f"{PRE}id"))
    keys = keys.agg(F.max(label_col).cast("int").alias("label")).where(~held_out(F.col(f"{PRE}id")))
    rank = F.xxhash64(f"{PRE}id")
    clean = keys.where("label = 0").orderBy(rank, f"{PRE}id").limit(CLEAN)
    toxic = keys.where("label = 1").orderBy(rank, f"{PRE}id").limit(SAMPLE - CLEAN)
    rows = keyed_text(df, id_col, text_col).where(F.length(f"{PRE}text") <= SAMPLE_CHARS)
    rows = rows.join(F.broadcast(clean.union(toxic)), f"{PRE}id")  # SAMPLE keys at most
    rows = rows.orderBy(rank, f"{PRE}id", f"{PRE}text").limit(SAMPLE)
    return [(r[0], r[1]) for r in rows.select(f"{PRE}text", "label").toLocalIterator()]


def train(sample: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Each bucket's number and the bias."""
    labels = np.array([label for _, label in sample], np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return np.zeros(BUCKETS), float(np.clip(np.log(max(share, 1e-12) / max(1 - share, 1e-12)), -30, 30))
    vocabulary = Vocabulary()
    texts = [vocabulary.encode(text) for text, _ in sample]
    model = Model()
    model.fit(texts, labels, *vocabulary.buckets())
    return model.logits()


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, score) for every row; the model is an array of fixed size, sent to the executors once."""
    rows = keyed_text(df, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch in batches:
            values = pa.array([scorer(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[id_col, "score"])

    return rows.mapInArrow(
        run, T.StructType([T.StructField(id_col, rows.schema[0].dataType), T.StructField("score", T.DoubleType())])
    )


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: key, ``held_out``, ``score`` and ``predicted``."""
    model = train(training_sample(df, labels, id_col, text_col, label_col))
    return score(df, model, id_col, text_col).select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
