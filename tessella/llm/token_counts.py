"""Token counts by byte-pair merging with a heap and a linked list, without ids.

The symbols of a stretch of text are its characters, in a doubly linked list. A heap holds the adjacent
pairs that the vocabulary has as a piece, by rank and then by place. The lowest is popped; if its two symbols
are still the ones it was made of, they become one symbol, and the pairs on its left and right go on the
heap. A merge takes one symbol away, so the count is the number of characters less the number of merges;
a character the vocabulary does not know counts as its UTF-8 bytes. A run of n characters without a
blank takes O(n log n).

No piece goes on past a blank after another character, or holds a line end, so texts are cut there; the counts
of short words are kept in a bounded memo, which only saves time. The vocabulary is held to these
rules when it is read. The rank of a piece is its place in the order of scores; the pieces are read from the
``sentencepiece`` file, whose own encoder is not used for counting.

Cases: a null or empty text has no bytes and no tokens; null keys and repeated rows give a row each; an empty
table gives an empty result; long texts are counted whole. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import keyed_text
from tessella.llm.tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Words in a memo, and the longest one that is kept there; they only save time.
MEMO, MEMO_CHARS = 400_000, 48
SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def merge(text: str, ranks: dict[str, int]) -> list[int]:
    """The length of each symbol that is left, in order; 0 where a character went into the symbol before."""
    n = len(text)
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[pair], i, 2) for i in range(n - 1) if (pair := text[i : i + 2]) in ranks]
    heapify(heap)
    while heap:
        _, i, length = heappop(heap)
        j = after[i]
        if not size[i] or j == n or size[i] + size[j] != length:
            continue  # one of the two has been merged since
        size[i], size[j] = length, 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            wider = length + size[k]
            if (rank := ranks.get(text[i : i + wider])) is not None:
                heappush(heap, (rank, i, wider))
        h = before[i]
        if h >= 0 and (rank := ranks.get(text[h : i + length])) is not None:
            heappush(heap, (rank, h, size[h] + length))
    return size


class Vocabulary:
    """Ranks of the pieces, and the characters that are pieces."""

    def __init__(self, scores: dict[str, float]):
        order = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: order[score] for piece, score in scores.items() if len(piece) > 1}
        self.known = {piece for piece in scores if len(piece) == 1}
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ranks):
            raise ValueError("a piece goes on past a blank or a line end")
        self.pairs = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}

    def count(self, text: str) -> int:
        """Symbols less merges; the bytes of what is not known."""
        size = merge(text, self.ranks)
        left = len(text) - size.count(0)
        if not self.known.issuperset(text):
            left += sum(len(c.encode()) - 1 for c, s in zip(text, size) if s == 1 and c not in self.known)
        return left


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a file whose normalisation only marks blanks and whose unknown characters become bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.normalize(" Aﬁ  a ") != f"{SPACE * 2}Aﬁ{SPACE * 2}a{SPACE}":
        raise ValueError("the vocabulary changes texts before it cuts them")
    ids = range(model.get_piece_size())
    if sum(map(model.is_byte, ids)) != 256:
        raise ValueError("the vocabulary has no pieces for bytes")
    special = lambda i: model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i)
    return Vocabulary({model.id_to_piece(i): model.get_score(i) for i in ids if not special(i)})


class Counts(dict):
    """Counts of words after ``lead``, emptied when full.

    A last character that follows the one before it in no piece (as a full stop mostly does) is counted apart.
    """

    def __init__(self, known: Vocabulary, lead: str):
        super().__init__()
        self.known, self.lead = known, lead

    def __missing__(self, word: str) -> int:
        if len(word) > 1 and word[-2:] not in self.known.pairs and len(word) <= MEMO_CHARS:
            n = self[word[:-1]] + self.known.count(word[-1])
        else:
            n = self.known.count(self.lead + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def counter(path: str) -> Callable[[str], int]:
    """From a text to its number of tokens."""
    known = read_vocabulary(path)
    count, line_end = known.count, known.count("\n")
    spaced, bare = Counts(known, SPACE), Counts(known, "")

    def line(words: list[str], first: bool) -> int:
        """Words with a blank before each, but for the first one of a later line."""
        if "" in words[not first :]:  # blanks beside each other
            return sum(map(count, _CHUNK.findall(SPACE * first + SPACE.join(words))))
        if first:
            return sum(map(spaced.__getitem__, words))
        return (bare[words[0]] if words[0] else 0) + sum(map(spaced.__getitem__, words[1:]))

    def total(text: str) -> int:
        if not text:
            return 0
        first, *lines = text.replace(SPACE, " ").split("\n")
        return line(first.split(" "), True) + sum(line_end + line(x.split(" "), False) for x in lines)

    return total


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocabulary_path: str | None = None
) -> DataFrame:
    """One row per input row: key, ``n_bytes``, ``n_tokens``, and whether these are more than ``limit``."""
    rows = keyed_text(df, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema[0].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path or vocabulary(VOCABULARY))
        for batch in batches:
            tokens = pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens], names=schema.names)

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
