"""Periodic runs: all runs against a search over all periods, on random and built texts and on whole tables."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

from tessella.llm import periodic_runs
from tessella.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    out, seen = [], set()
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def built(rng):
    """Words with planted repeats of many periods, some inside others."""
    words = [rng.choice("abcdefghijkl") for _ in range(rng.randrange(40))]
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(words) + 1)
        turn = [rng.choice("ab" if rng.random() < 0.5 else "abcdefghijkl") for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 31, 33]))]
        if rng.random() < 0.3:
            turn = turn * rng.randrange(1, 6) + [rng.choice("xyz")]
        n = int(len(turn) * rng.choice([1.5, 3, 3.9, 4, 4.1, 6, 9]))
        words[at:at] = (turn * 10)[:n]
    return [w.encode() for w in words]


def test_runs_equal_brute_force():
    rng = random.Random(1)
    fibonacci = ["a", "b"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts = [built(rng) for _ in range(400)]
    texts += [[bytes([c]) for c in rng.choices(b"ab", k=200)] for _ in range(60)]
    texts += [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [c.encode() for c in fibonacci[-1]]]
    rng.shuffle(texts)
    wanted = [brute_runs(t) for t in texts]
    assert periodic_runs.runs_of_texts(texts) == wanted and sum(map(len, wanted)) > 500
    for t, want in zip(texts[:120], wanted):
        assert periodic_runs.runs_of_texts([t]) == [want]


def test_long_periods():
    rng = random.Random(2)
    for q in (63, 64, 65, 100, 127, 128, 1000):
        turn = [str(rng.random()).encode() for _ in range(q)]
        words = [b"x", *(turn * 5)[: 4 * q + q // 2], b"y"]
        assert periodic_runs.runs_of_texts([words]) == [[(1, 4 * q + q // 2, q)]]
    few = [rng.choice([b"u", b"v"]) for _ in range(6)]
    words = (few * 5 + [b"z"]) * 4  # a period of 31 whose turns are full of periods of six
    assert periodic_runs.runs_of_texts([words]) == [brute_runs(words)]


def test_set_depends_on_its_words_alone():
    """Equal stretches of twice the width are both in the set or both not."""
    rng = random.Random(3)
    for _ in range(50):
        text = built(rng) + built(rng)
        codes = periodic_runs._Codes()
        codes = periodic_runs.np.array([codes[w] for w in text] + [10**6], periodic_runs.np.int64)
        found = {(s, s + n): q for s, n, q in brute_runs(text)}
        names, width = periodic_runs.mixed(codes.astype("u8")), 1
        while 2 * width < len(names):
            if width >= 4:
                held, seen = set(periodic_runs.synchronising(names, width, found).tolist()), {}
                for i in range(len(text) - 2 * width + 1):
                    assert seen.setdefault(tuple(text[i : i + 2 * width]), i in held) == (i in held)
            names, width = periodic_runs.doubled(names, width), 2 * width


def expected(key, text):
    for c in "\x09\x0a\x0b\x0c\x0d":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    n = len(words)
    h = crc32(str(key).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        key, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, QUERIES["op11_synchronised_runs"](spark, SF).collect()))
    assert got == sorted(expected(r.doc_id, (r.text or "")) for r in docs)
    assert sum(r[1] for r in got) > 10


def test_odd_rows(spark):
    rows = [(None, "a " * 9, 1), (2, None, 2), (3, "", 3), (3, "", 3), (4, "x\x1cy z x\x1cy z\t" * 6, 4), (5, "w " * 70_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {(None, "a"): [(0, 9, 1)], (2, ""): [], (3, ""): [], (4, "x\x1cy z"): [(0, 12, 1)], (5, "w"): [(0, 70_000, 1)]}
    digest = periodic_runs.runs_digest(df)
    assert digest.count() == 6 and {r.n_runs for r in digest.where("doc_id is null").collect()} == {1}
    assert digest.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert periodic_runs.runs_digest(df.limit(0)).count() == 0
