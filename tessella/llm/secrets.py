"""Secrets by a linear-chain conditional random field over tokens.

Base kinds (assign, access, hex) are patterns whose matches are always reported. The field adds spans: it
tags tokens as begin, inside or outside of a secret from the token's shape, the words near it and features
of the file, and decodes by Viterbi. A token of fewer than 24 plain letters, with no capital behind a small one, no
underscore and no digit, and not soon after a telling word, is outside by definition; a stretch of such tokens is one
known tag, so only the stretches between are decoded, exactly.

The field is trained here: words around come from a bounded sample of the texts' lines (``SAMPLE`` different ones, in
pieces of ``PIECE`` characters), with the features of the text each is from; secrets of many forms, and harmless
look-alikes, are set among them, more of them where the text looks like code.

Cases: a null or empty text has no span; a null key stays null; repeated rows give one result each; with no
text at all the sample is empty and the field learns from the generated lines alone; an empty table gives
an empty result; texts are read whole, each pattern moves forward only. Other columns are not looked at.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import PRE, count_kind, keyed_text, map_texts, span_list

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "crf")
TAGS = ("O", "B", "I")
BUCKETS = 1 << 14
#: Lines whose words surround the training secrets, and lines made of them.
SAMPLE, PIECE, LINES, SEED, EPOCHS = 2000, 2000, 2800, 11, 4
#: Share of generated lines with a secret, in code and elsewhere.
IN_CODE, IN_PROSE = 0.6, 0.45
#: A token this soon after a telling word is always looked at, and one of so many characters.
REACH, LONG = 4, 24

# Words that announce a secret, and words that announce a harmless code.
TELLING = {
    "password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "api_key", "auth", "authorization",
    "bearer", "credential", "credentials", "private", "access", "client_secret", "passwort", "contraseña", "clave",
}
HARMLESS = {"commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "guid", "id", "hash", "revision", "etag", "isbn", "version", "build"}

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[^\s\"'`,;:=()\[\]{}<>|]+|[:=]")
#: Words whose names announce a secret when they end in them, as in signing_key.
ENDINGS = ("key", "token", "secret", "password")
_DIGIT = re.compile("[0-9]")
_CAMEL = re.compile("[a-z][A-Z]")
#: The shortest of the telling words and endings that all others hold.
_PARTS = [w for w in sorted({*TELLING, *ENDINGS}) if not any(v != w and v in w for v in {*TELLING, *ENDINGS})]

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield "assign", *m.span()
    for m in _ACCESS.finditer(text):
        if len(m[0]) >= 20:
            yield "access", *m.span()
    for m in _HEX.finditer(text):
        yield "hex", *m.span()


def shape(token: str) -> str:
    """Runs of capitals, letters, digits and signs, each with a sign for its length."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "." for c in token[:64])
    return re.sub(r"(.)\1*", lambda m: m[1] + ("+" if len(m[0]) > 3 else ""), kinds)[:12]


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def bare(token: str) -> str:
    return token.strip(".-_*#!?").lower()


@dataclass(frozen=True)
class File:
    """Features of the whole text."""

    code: bool
    short: bool

    @classmethod
    def of(cls, text: str) -> File:
        signs = text.count("=") + text.count("{") + text.count(";")
        return cls(signs * 60 > len(text), len(text) < 400)


def worth_a_look(text: str) -> bool:
    """Whether ``looked_at`` could be true of a token; finds in the lowered text are much faster than one pattern.

    A digit is one of any script (``str.isdigit``), as there.
    """
    if _DIGIT.search(text) or not text.isascii() and any(c.isdigit() for c in set(text)):
        return True
    if "_" in text or _CAMEL.search(text) or max(map(len, text.split()), default=0) >= LONG:
        return True
    low = text.lower()
    return any(w in low for w in _PARTS)


def odd_letters(token: str) -> bool:
    """Whether a token without digits does not look like a word."""
    return len(token) >= LONG or "_" in token.strip("_") or _CAMEL.search(token) is not None


def looked_at(tokens: list[str]) -> list[bool]:
    """Tokens that may be part of a secret; all others are outside."""
    near, out = 0, []
    for t in tokens:
        if t in ":=":
            out.append(False)
            continue
        word = bare(t)
        digits = sum(c.isdigit() for c in t)
        out.append(len(t) >= 6 and word not in TELLING and (near > 0 or (0 < digits and len(t) - digits >= 2) or odd_letters(t)))
        near = REACH if word in TELLING or any(word.endswith(f"_{w}") for w in ENDINGS) else near - 1
    return out


def features(tokens: list[str], i: int, file: File) -> list[int]:
    """Buckets of a token's features."""
    t = tokens[i]
    classes = sum((any(c.islower() for c in t), any(c.isupper() for c in t), any(c.isdigit() for c in t)))
    digits = sum(c.isdigit() for c in t) / len(t)
    names = [
        "bias", f"shape={shape(t)}", f"len={min(len(t) // 4, 10)}", f"entropy={int(entropy(t) * 2)}", f"classes={classes}",
        f"digits={int(digits * 5)}", f"hex={bool(re.fullmatch('[0-9a-fA-F-]+', t))}", f"start={re.match('[A-Za-z]*[_-]?', t)[0][:6]}",
        f"file={file.code}{file.short}", f"dots={min(t.count('.'), 3)}", f"dash={min(t.count('-'), 5)}",
    ]
    before = [bare(tokens[k]) for k in range(max(0, i - 4), i)]
    names += [f"tell={len(before) - k}" for k, w in enumerate(before) if w in TELLING]
    names += ["tells"] * any(w in TELLING for w in before) + ["harmless"] * any(w in HARMLESS for w in before)
    for d in (-2, -1, 1):
        if 0 <= i + d < len(tokens):
            w = tokens[i + d]
            names.append(f"{d}={w if w in ':=' else bare(w) if bare(w) in TELLING | HARMLESS else shape(w)}")
        else:
            names.append(f"{d}=edge")
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def stretches(looked: list[bool]) -> Iterator[tuple[int, int]]:
    """Runs of tokens that are looked at."""
    start = None
    for i, on in enumerate([*looked, False]):
        if on and start is None:
            start = i
        elif not on and start is not None:
            yield start, i
            start = None


class Field:
    """Weights of features by tag and of pairs of tags; an inside never follows an outside."""

    def __init__(self):
        self.emit = np.zeros((BUCKETS, 3))
        self.move = np.zeros((3, 3))
        self.barred = np.zeros((3, 3))
        self.barred[0, 2] = -1e9

    def potentials(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.emit[r].sum(0) for r in rows])

    def moves(self) -> np.ndarray:
        return self.move + self.barred

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        """The best tags of a stretch that has an outside before and after it."""
        score, move = self.potentials(rows), self.moves()
        best, back = score[0] + move[0], []
        for s in score[1:]:
            paths = best[:, None] + move
            back.append(paths.argmax(0))
            best = paths.max(0) + s
        tags = [int((best + move[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def gradient(self, rows: list[list[int]], tags: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood: by token and tag, and by pair of tags (forward and backward sums)."""
        score, move = self.potentials(rows), self.moves()
        n = len(rows)
        log_sum = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
        forward, backward = np.empty((n, 3)), np.empty((n, 3))
        forward[0] = score[0] + move[0]
        for i in range(1, n):
            forward[i] = score[i] + log_sum(forward[i - 1][:, None] + move, 0)
        backward[-1] = move[:, 0]
        for i in range(n - 2, -1, -1):
            backward[i] = log_sum(move + (score[i + 1] + backward[i + 1])[None, :], 1)
        total = log_sum(forward[-1] + backward[-1], 0)
        by_token = -np.exp(forward + backward - total)
        pairs = np.zeros((3, 3))
        pairs[0] += by_token[0]
        pairs[:, 0] += by_token[-1]
        for i in range(1, n):
            pairs -= np.exp(forward[i - 1][:, None] + move + (score[i] + backward[i])[None, :] - total)
        by_token[np.arange(n), tags] += 1
        for a, b in zip([0, *tags], [*tags, 0]):
            pairs[a, b] += 1
        return by_token, pairs

    def fit(self, examples: list[tuple[list[list[int]], list[int]]]) -> None:
        """Adagrad, a stretch at a time."""
        rng = random.Random(SEED)
        emit_sq, move_sq = np.full_like(self.emit, 1e-2), np.full_like(self.move, 1e-2)
        for _ in range(EPOCHS):
            rng.shuffle(examples)
            for rows, tags in examples:
                by_token, pairs = self.gradient(rows, tags)
                for r, g in zip(rows, by_token):
                    emit_sq[r] += g**2
                    self.emit[r] += 0.2 * g / np.sqrt(emit_sq[r])
                move_sq += pairs**2
                self.move += 0.2 * pairs / np.sqrt(move_sq)


# Beginnings of the tokens of well-known services.
PREFIXES = ["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_", "AIza", "ya29.", "hf_"]
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def some(rng: random.Random, signs: str, n: int) -> str:
    return "".join(rng.choice(signs) for _ in range(n))


def secret(rng: random.Random) -> tuple[str, bool]:
    """A generated secret, and whether it is one wherever it stands."""
    kind = rng.randrange(11)
    if kind == 9:
        return rng.choice(PREFIXES) + some(rng, _ALNUM[:52], rng.randint(20, 40)), True
    if kind == 10:
        return some(rng, _ALNUM[:52], rng.randint(24, 44)), True
    if kind == 0:
        return some(rng, _ALNUM, rng.randint(20, 64)), True
    if kind == 1:
        return rng.choice(PREFIXES) + some(rng, _ALNUM + "_", rng.randint(20, 40)), True
    if kind == 2:
        return some(rng, _ALNUM + "+/", rng.randint(28, 60)) + rng.choice(["", "=", "=="]), True
    if kind == 3:
        return "eyJ" + some(rng, _ALNUM, 20) + "." + some(rng, _ALNUM + "_-", 40) + "." + some(rng, _ALNUM + "_-", 30), True
    if kind == 4:
        return some(rng, "0123456789abcdef", rng.choice([32, 40, 64])), False
    if kind == 5:
        return some(rng, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", rng.randint(16, 32)), True
    if kind == 6:
        return some(rng, _ALNUM + "!@$%*-_.", rng.randint(8, 16)), False
    if kind == 7:
        return some(rng, "abcdefghijklmnopqrstuvwxyz", rng.randint(4, 8)).title() + some(rng, "0123456789", rng.randint(2, 4)) + rng.choice(["", "!", "$"]), False
    return "-".join(some(rng, "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 5) for _ in range(rng.randint(3, 5))), False


def harmless(rng: random.Random) -> list[str]:
    """A look-alike with the words before it."""
    digits, hexes = "0123456789", "0123456789abcdef"
    kind = rng.randrange(14)
    part = lambda: some(rng, "abcdefghilmnorst", rng.randint(3, 9))
    if kind == 10:
        return [part() + "".join(part().title() for _ in range(rng.randint(1, 4)))]
    if kind == 11:
        return [rng.choice(["_", "-"]).join(part() for _ in range(rng.randint(2, 5)))]
    if kind == 12:
        return ["".join(part().title() for _ in range(rng.randint(2, 5)))]
    if kind == 13:
        return [rng.choice([str.lower, str.upper])("".join(part() for _ in range(rng.randint(3, 7))))]
    if kind == 0:
        return [f"{some(rng, digits, 3)}-{some(rng, digits, 4)}", "ext", some(rng, digits, 3)]
    if kind == 1:
        return [rng.choice(["commit", "sha1", "md5", "checksum", "hash"]), some(rng, hexes, rng.choice([7, 12, 32, 40]))]
    if kind == 2:
        return [rng.choice(["uuid", "id", "guid", ""]), "-".join(some(rng, hexes, n) for n in (8, 4, 4, 4, 12))]
    if kind == 3:
        return ["v" + ".".join(some(rng, digits, 1) for _ in range(3)) + rng.choice(["", "-rc1", "-beta2"])]
    if kind == 4:
        return [f"https://{some(rng, 'abcdefgh', 7)}.com/{some(rng, 'abcdefgh', 5)}/{some(rng, digits, 4)}"]
    if kind == 5:
        return [f"20{some(rng, digits, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T{some(rng, digits, 2)}:{some(rng, digits, 2)}"]
    if kind == 6:
        return [f"{some(rng, 'abcdefghilmnorst', rng.randint(4, 10))}{some(rng, digits, rng.randint(1, 3))}.{rng.choice(['py', 'txt', 'html', 'jpg'])}"]
    if kind == 7:
        return [some(rng, "abcdefghilmnorst", 6) + "." + some(rng, digits, 2) + "@mail" + some(rng, digits, 1) + ".example.com"]
    if kind == 8:
        return [some(rng, "ABCDEFGH", 2) + some(rng, digits, rng.randint(5, 9))]
    return [some(rng, "abcdefghilmnorst", rng.randint(3, 7)) + some(rng, digits, 4) + rng.choice(["th", "km", "px", "kg", "st"])]


def line_of(words: list[str], rng: random.Random, share: float) -> tuple[list[str], list[int]]:
    """Tokens and tags of a generated line; ``share`` of them hold a secret."""
    around = lambda k: [rng.choice(words) for _ in range(rng.randint(0, k))]
    tokens, tags = around(8), []
    what = rng.random()
    if what < share:
        value, plain = secret(rng)
        if not plain or rng.random() < 0.6:
            lead = [rng.choice(sorted(TELLING))] + rng.choice([[":"], ["="], ["is"], [], ["the", "is"]])
            tokens += [w.upper() if rng.random() < 0.2 else w for w in lead]
        start = len(tokens)
        tokens += [value]
        if rng.random() < 0.15:  # a phrase of several parts
            tokens += [some(rng, _ALNUM, rng.randint(6, 12)) for _ in range(rng.randint(1, 3))]
        tags = [0] * start + [1] + [2] * (len(tokens) - start - 1)
    elif what < 0.9:
        tokens += [w for w in harmless(rng) if w]
    else:  # a telling word with nothing to tell
        tokens += [rng.choice(sorted(TELLING)), rng.choice(["is", "of", "for", ":"]), *around(3)]
    tokens += around(8)
    return tokens, tags + [0] * (len(tokens) - len(tags))


def lines(words: list[str], rng: random.Random, n: int) -> Iterator[tuple[list[str], list[int]]]:
    """Tokens and tags of generated lines."""
    for _ in range(n):
        yield line_of(words, rng, 0.5)


def text_signs() -> Column:
    """``File.of`` as columns: whether the text looks like code, and whether it is short."""
    text = F.col(f"{PRE}text")
    signs = sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(sign), F.lit(""))) for sign in "={;")
    return F.struct((signs * 60 > F.length(text)).alias("code"), (F.length(text) < 400).alias("short"))


def training_lines(df: DataFrame, text_col: str) -> list[tuple[list[str], File]]:
    """Words and file features of a bounded sample of different lines, chosen by hash.

    Lines are taken in pieces of ``PIECE`` characters, so that the sample is bounded whatever their length. The least hashes are
    found first, by partial distinct, and the pieces with these hashes (``SAMPLE`` numbers) are read then. Tokens with
    digits are left out.
    """
    texts = keyed_text(df, text_col, text_col).select(f"{PRE}text", text_signs().alias("file"))  # once a text, not once a line
    texts = texts.select("file", F.explode(F.split(f"{PRE}text", "\n", -1)).alias("line"))
    begins = F.sequence(F.lit(0), F.expr(f"(length(line) - 1) div {PIECE}").cast("int"))
    cut = F.when(F.length("line") <= PIECE, F.array("line")).otherwise(F.transform(begins, lambda i: F.substring("line", i * PIECE + 1, F.lit(PIECE))))
    parts = texts.where(F.length("line") > 0).select("file", F.explode(cut).alias("t"))
    parts = parts.select(F.xxhash64("t").alias("h"), "t", "file")
    least = parts.select("h").distinct().orderBy("h").limit(SAMPLE)
    held = parts.join(F.broadcast(least), "h").groupBy("h").agg(F.min(F.struct("t", "file")).alias("s"))
    rows = held.orderBy("h").select("s.t", "s.file.code", "s.file.short").repartition(1).collect()
    keep = lambda t: [w for w in _TOKEN.findall(t) if not any(c.isdigit() for c in w) and bare(w) not in TELLING]
    return [(words, File(r.code, r.short)) for r in rows if (words := keep(r.t))]


def train(words: list[str], sample: list[tuple[list[str], File]] | None = None) -> Field:
    """A field from generated lines among ``words``, or among the words of the lines of ``sample`` with their features."""
    rng = random.Random(SEED)
    examples = []
    for _ in range(LINES):
        around, file = rng.choice(sample) if sample else (words, File(rng.random() < 0.3, rng.random() < 0.3))
        tokens, tags = line_of(around, rng, IN_CODE if file.code else IN_PROSE)
        for a, b in stretches(looked_at(tokens)):
            examples.append(([features(tokens, i, file) for i in range(a, b)], tags[a:b]))
    field = Field()
    field.fit(examples)
    return field


def field_spans(text: str, field: Field) -> Iterator[tuple[int, int]]:
    """Secrets that the field tags; lines without a digit and without a telling word are not decoded, as ``looked_at`` is false there."""
    if not worth_a_look(text):
        return
    file, at = File.of(text), 0
    for line in text.split("\n"):
        if worth_a_look(line):
            found = list(_TOKEN.finditer(line))
            tokens = [m[0] for m in found]
            for a, b in stretches(looked_at(tokens)):
                open_at = None
                tags = field.viterbi([features(tokens, i, file) for i in range(a, b)])
                for i, tag in zip(range(a, b + 1), [*tags, 0]):
                    if tag != 2 and open_at is not None:
                        yield at + found[open_at].start(), at + found[i - 1].end()
                        open_at = None
                    if tag == 1:
                        open_at = i
        at += len(line) + 1


def secrets_of(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Base spans, and those of the field that no base span touches, by start, then kind."""
    base = list(base_spans(text))
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    added = []
    for a, b in field_spans(text, field):
        k = int(np.searchsorted(starts, b)) if taken else 0  # spans that start before b
        if not k or reach[k - 1] <= a:
            added.append(("crf", a, b))
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its key and ``secrets`` (kind, start, end)."""
    field = train(["the", "of", "and", "line"], training_lines(df, text_col))
    held = df.sparkSession.sparkContext.broadcast((field.emit, field.move))  # of fixed size

    def make():
        mine = Field()
        mine.emit, mine.move = held.value
        return lambda text: secrets_of(text, mine)

    return map_texts(df, id_col, text_col, "secrets", SPANS, make)


def secrets_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans."""
    found = find_secrets(df, id_col, text_col).withColumn(f"{PRE}base", F.filter("secrets", lambda s: s["kind"] != "crf"))
    base = F.col(f"{PRE}base")
    return found.select(
        id_col,
        *(count_kind(base, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("secrets")).alias("spans"),
    )
