"""Token ids from public vocabularies, with a bounded memo of pieces that can be encoded alone."""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: Entries of a generation of a memo. It only saves time, ids do not depend on it.
MEMO = 250_000


class Memo:
    """Piece to its little-endian 32-bit ids; holds two generations, the older one is dropped when the newer is full."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], limit: int = MEMO):
        self.encode, self.limit, self.new, self.old = encode, limit, {}, {}

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pieces, joined."""
        used = set().union(*texts)
        missing = used.difference(self.new)
        if len(self.new) + len(missing) > self.limit:
            self.old, self.new = self.new, {p: self.new[p] for p in used - missing}
        known, old = self.new, self.old
        again = [p for p in missing if p in old]
        known.update((p, old[p]) for p in again)
        missing.difference_update(again)
        if missing:
            todo = list(missing)
            known.update(zip(todo, self.encode(todo)))
        return [b"".join([known[p] for p in pieces]) for pieces in texts]


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


# The classes of the word vocabulary's split pattern below U+0300, where text is in NFC as it stands and
# lower case does not depend on the neighbours; two letters there have a lower case beyond it.
_PLAIN_END = 0x300
_LOWER_BEYOND = "".join(c for c in map(chr, range(_PLAIN_END)) if len(c.lower()) == 1 and ord(c.lower()) >= _PLAIN_END)
_ODD = re.compile(rf"[\x1c-\x1f{_LOWER_BEYOND}\u0300-\U0010ffff]")


def _class(initial: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c)).startswith(initial))


_SPACES = r" \t\n\r\x0b\f\x85\xa0"
_PIECES = re.compile(
    rf"'(?:[stmd]|re|ve|ll)|[{_class('L')}]+|[{_class('N')}]|[^{_SPACES}{_class('L')}{_class('N')}]+"
)


def in_groups(encode: Callable[[list[str]], list[bytes]], texts: Iterable[str], chars: int = 1 << 21) -> Iterator[bytes]:
    """The ids of each text, encoded a few texts at a time."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= chars:
            yield from encode(group)
            group, size = [], 0
    yield from encode(group)


@lru_cache(maxsize=1)
def word_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """For the ``tokenizers`` file that drops white space.

    No rule of it looks across white space, so words are encoded alone. A text with characters from U+0300
    on (or whose lower case is there), with the separators that Python alone takes for white space, or with the
    string of a special token, goes through the tokenizer whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole, bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
    special = "|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values())
    odd_text = re.compile(f"{_ODD.pattern}|{special}" if special else _ODD.pattern)
    bare.encode_special_tokens = True
    bare.normalizer = normalizers.Sequence([])
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bare.model._resize_cache(0)
    pieces = Memo(lambda new: [packed(e.ids) for e in bare.encode_batch_fast(new, add_special_tokens=False)])
    words = Memo(lambda new: pieces([_PIECES.findall(w.lower()) for w in new]))

    def encode(texts: list[str]) -> list[bytes]:
        odd = [bool(odd_text.search(t)) for t in texts]
        plain = iter(words([t.split() for t, o in zip(texts, odd) if not o]))
        return [packed(whole.encode(t, add_special_tokens=False).ids) if o else next(plain) for t, o in zip(texts, odd)]

    return encode


@lru_cache(maxsize=1)
def byte_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """For a ``tiktoken`` rank file of byte-level pieces; lossless. A memo of words costs more here than it saves."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ids = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return lambda texts: [packed(ids(t)) for t in texts]


def vocabulary(name: str) -> str:
    """Place of a vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
