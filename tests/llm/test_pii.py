"""Personal data: base spans against the plain patterns, checksums, context, odd inputs."""

import random
import re

from pyspark.sql import functions as F

from tessella.llm import pii


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    bits = ["@", "a", ".", "b.c", "1", "2.", "255", "256", "0001", "+1", " ", "-", "(", ")", "é", "😀", "4785380592391139", "%", "\n", "x@y.z", "+49 (30) 555-1234", "1.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert list(pii.base_spans(text)) == brute(text), text
        assert [s[:3] for s in pii.entities(text) if s[4]] == brute(text)


def test_checksums_and_context():
    kinds = lambda t: [s[0] for s in pii.entities(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE89 3704 0044 0532 0130 01.") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("ssn 000-45-6789") == []
    assert kinds("order 123-45-6789") == []
    assert kinds("amex 378282246310005") == ["card_other"] and kinds("378282246310006") == []
    assert kinds("card 4111 1111 1111 1111 2026") == ["card_other"]
    beside = "+1 (743) 555-3824 4785380592391139 and 152.143.123.131 1219538112535715"
    assert [s[:3] for s in pii.entities(beside)] == [("ip", 39, 54), ("card_other", 18, 34), ("card_other", 55, 71), ("phone_local", 0, 17)]
    assert kinds("call 555 234 5678 now") == ["phone_local"] and kinds("555 234 5678") == []
    assert kinds("jo (at) example (dot) org") == ["email_spelled"]
    assert kinds("2001:db8:85a3:0:0:8a2e:370:7334") == ["ipv6"] and kinds("12:30:45") == []
    assert kinds("plain words, 2024-05-06, version 1.2.3, 3.14159") == []


def test_compressed_addresses():
    for text in ("see 2001:db8::1 there", "at fe80::1ff:fe23 now", "host fe80::1", "2001:0db8:0:0::1:8a2e", "::ffff:1:2:3:4 x"):
        (span,) = [s for s in pii.entities(text) if s[0] == "ipv6"]
        assert "::" in text[span[1] : span[2]] and span[1] == min(i for i, c in enumerate(text) if c in "0123456789abcdef:" and ":" in text[i:].split()[0])
    for text in ("std::vector a::b", "12:30:45", "1:2:3:4:5:6:7:8:9", "dead::beef", "a :: b"):
        assert [s for s in pii.entities(text) if s[0] == "ipv6"] == [], text


def test_many_spans_in_one_text():
    """Spans never overlap an added one, and eight times the spans take no more than about eight times the time."""
    import time

    rng = random.Random(4)
    part = lambda: f"{rng.choice(['call', 'x'])} (555) 234-{rng.randrange(1000, 9999)} a@b.cd 2001:db8::{rng.randrange(1, 9999)} "
    spent = []
    for n in (2_000, 16_000):
        text = "".join(part() for _ in range(n))
        start = time.process_time()
        spans = pii.entities(text)
        spent.append(time.process_time() - start)
        assert len(spans) == 3 * n
        ordered = sorted(s[1:3] for s in spans)
        assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:]))
    assert spent[1] < 20 * spent[0]


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "1." * 150_000, "a." * 150_000 + "@"):
        pii.entities(text)


def test_rows_nulls_and_masking(spark):
    rows = [(1, "mail a@b.cd now", "x", 15), (1, "mail a@b.cd now", "x", 15), (None, "+1 (743) 555-3824", None, None), (4, None, None, 0), (5, "", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, entities string, n_chars long")
    got = sorted(map(tuple, pii.personal_data_digest(df).select("doc_id", "n_email", "n_phone", "spans").collect()), key=str)
    assert got == sorted([(1, 1, 0, "email:5:11")] * 2 + [(None, 0, 1, "phone:0:17"), (4, 0, 0, ""), (5, 0, 0, "")], key=str)
    masked = pii.redact(df)
    assert masked.columns == df.columns
    assert {(r.text, r.n_chars) for r in masked.collect()} == {("mail [EMAIL] now", 16), ("[PHONE]", 7), (None, 0), ("", 0)}
    empty = df.limit(0)
    assert pii.personal_data_digest(empty).count() == 0 and pii.redact(empty).count() == 0


def test_digest_of_the_base_spans(spark):
    import hashlib

    df = spark.createDataFrame([(1, "a@b.c 1.2.3.4")], "doc_id long, text string")
    row = pii.personal_data_digest(df).select(F.col("base_sha256")).first()
    assert row[0] == hashlib.sha256(b"email:0:5,ip:6:13").hexdigest()
