"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (email, ip, card, phone) are reported whenever their pattern and check hold. Further
kinds are proposed by looser patterns and reported only if the score of pattern, checksum and
context reaches ``THRESHOLD``.

Cases: a null or empty text has no span; a null key stays null; repeated rows give one result each;
an empty table gives an empty result; texts of any length are read whole, each pattern moves forward
only, so the time is in proportion to the length. Other columns are not looked at.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import PRE, count_kind, map_texts, span_list

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "card_other", "phone_local", "email_spelled", "ipv6")
ORDER = {kind: i for i, kind in enumerate(BASE_KINDS + ADDED_KINDS)}
THRESHOLD = 0.6
BEFORE, AFTER = 48, 24

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("base", T.BooleanType()),
            T.StructField("value", T.StringType()),
        ]
    )
)

# Words that speak for or against a kind, in the languages of the corpus.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "credit", "debit", "visa", "mastercard", "amex", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "contact", "whatsapp", "anruf", "telefon", "téléphone", "llame"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security", "taxpayer", "tax id"),
}
AGAINST = ("version", "isbn", "order", "invoice", "sku", "serial", "part no", "tracking", "ticket", "timestamp")
SAME_CONTEXT = {"card_other": "card", "phone_local": "phone", "email_spelled": "email", "ipv6": "ip"}
# Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that fails from the start of a run of digits fails from every later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Sizes of the groups in which card numbers are printed.
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
_GROUP = re.compile(r"[0-9]+")
_HEX_GROUP = re.compile(r"[0-9A-Fa-f]+")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ -]?[A-Za-z0-9])")
_SSN = re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])")
_NATIONAL = re.compile(r"(?<![\w+.(-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[-. ])[2-9][0-9]{2}[-. ][0-9]{4}(?![\w-]|\.[0-9])")
_PLUS = re.compile(r"\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?|[0-9]{1,4}[ .-])?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")
_DOUBLE_ZERO = re.compile(r"(?<![\w+.-])00[1-9][ ().0-9-]{6,20}[0-9](?!\w)")
_SPELLED_AT = re.compile(r"[(\[{<][Aa][Tt][)\]}>]")
_SPELLED = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}|<at>) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\.) ?[A-Za-z0-9-]{1,63})+",
    re.I | re.A,
)
_SIXES = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
#: Beginnings of addresses that are in use.
_SIX_PREFIX = re.compile(r"(?:2[0-9a-f]{3}|3[0-9a-f]{3}|fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}):", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def issuer(digits: str) -> bool:
    """A prefix and length that card issuers use."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        (digits[0] == "4" and n in (13, 16, 19))
        or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65))
        or (n == 15 and two in (34, 37))
        or (n == 14 and (two in (36, 38, 39) or 300 <= four // 10 <= 305))
        or (n in (16, 17, 18, 19) and (3528 <= four <= 3589 or two == 62))
    )


def digits_of(text: str) -> str:
    return "".join(_GROUP.findall(text))


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                done = m.end()
                yield "email", start, done
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p[:-3].strip("0") for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _DIGITS.finditer(text):
        if 16 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def context(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - BEFORE):start]} {text[end:end + AFTER]}".lower()
    words = CONTEXT[SAME_CONTEXT.get(kind, kind)]
    for_it = any(re.search(rf"(?<!\w){re.escape(w)}(?!\w)", near) for w in words if w in near)
    return 0.3 * for_it - 0.2 * any(w in near for w in AGAINST)


def proposals(text: str) -> Iterator[tuple[str, int, int, float]]:
    """Spans of the further kinds with the score of pattern and checksum."""
    for m in _IBAN.finditer(text):
        need, at, body = IBAN_LENGTH.get(m[0][:2], 0) - 4, m.end(), ""
        while len(body) < need and at < len(text):
            c = text[at]
            if c in " -" and at + 1 < len(text) and text[at + 1].isascii() and text[at + 1].isalnum():
                c, at = text[at + 1], at + 1
            if not (c.isascii() and c.isalnum()):
                break
            body, at = body + c, at + 1
        if need > 0 and len(body) == need and not text[at : at + 1].isalnum() and mod_97(m[0] + body.upper()):
            yield "iban", m.start(), at, 0.9
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), 0.6
    for m in _DOTTED.finditer(text):
        if luhn(d := digits_of(m[0])):
            yield "card_other", m.start(), m.end(), 0.5 + 0.15 * issuer(d)
    for m in _DIGITS.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        sizes = tuple(b - a for a, b in groups)
        for i, (start, _) in enumerate(groups):
            for n in (1, 3, 4):
                if sizes[i : i + n] in CARD_GROUPS or n == 1 and 13 <= sizes[i] <= 19:
                    digits = "".join(text[a:b] for a, b in groups[i : i + n])
                    alone = n == 1 and sizes[i] >= 16  # as good as a base card, but for the numbers beside it
                    if luhn(digits) and (alone or issuer(digits)):
                        yield "card_other", start, groups[i + n - 1][1], 0.65
    for m in _PLUS.finditer(text):  # where a base match runs into the next number and fails
        if 8 <= len(digits_of(m[0])) <= 15:
            yield "phone_local", m.start(), m.end(), 0.65
    for pattern in (_NATIONAL, _DOUBLE_ZERO):
        for m in pattern.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 17:
                yield "phone_local", m.start(), m.end(), 0.6 if m[0][0] == "(" or "-" in m[0] else 0.4
    if _SPELLED_AT.search(text):
        for m in _SPELLED.finditer(text):
            yield "email_spelled", m.start(), m.end(), 0.65
    for m in _SIXES.finditer(text):
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        groups = len(_HEX_GROUP.findall(m[0]))
        usual = groups >= 4 or groups >= 2 and _SIX_PREFIX.match(m[0])
        yield "ipv6", m.start(), m.end(), 0.65 if usual else 0.4


def entities(text: str) -> list[tuple]:
    """All spans of a text by kind as listed, then start; an added span never overlaps another span."""
    found = [(k, a, b, min(1.0, 0.7 + context(text, k, a, b)), True, text[a:b]) for k, a, b in base_spans(text)]
    added, starts, ends = [], [], []
    for a, b in sorted((a, b) for _, a, b, *_ in found):  # as stretches that do not overlap
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    if _GROUP.search(text) or _SPELLED_AT.search(text) or "::" in text:
        for kind, a, b, score in proposals(text):
            score += context(text, kind, a, b)
            if score >= THRESHOLD - 1e-9:
                added.append((-score, a, b, kind))
    for score, a, b, kind in sorted(added):
        at = bisect_left(starts, b)  # stretches that begin before the span ends
        if not at or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            found.append((kind, a, b, min(1.0, -score), False, text[a:b]))
    return sorted(found, key=lambda s: (ORDER[s[0]], s[1]))


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its key and ``entities`` (kind, start, end, score, base, value)."""
    return map_texts(df, id_col, text_col, "entities", SPANS, lambda: entities)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans go together."""
    parts, at = [], 0
    for kind, a, b, *_ in sorted(entities(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with the spans of ``text_col`` masked; a null text stays null, other columns stay as they are.

    ``length_col``, where the table has it, is set to the new length.
    """
    fields = df.schema.fields
    at = df.columns.index(text_col)
    counts = df.columns.index(length_col) if length_col in df.columns else -1
    def run(batches):
        for batch in batches:
            texts = [None if (t := v.as_py()) is None else redacted(t) for v in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            if counts >= 0:
                columns[counts] = pa.array(
                    [old.as_py() if t is None else len(t) for t, old in zip(texts, columns[counts])],
                    type=batch.schema.field(counts).type,
                )
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, T.StructType(fields))


def personal_data_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans."""
    found = find_personal_data(df, id_col, text_col).withColumn(f"{PRE}base", F.filter("entities", lambda s: s["base"]))
    base = F.col(f"{PRE}base")
    return found.select(
        id_col,
        *(count_kind(base, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("entities")).alias("spans"),
    )
