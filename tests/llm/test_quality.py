"""Quality rules: the registered query next to its SQL, counts by brute force, odd inputs."""

import random
import re
from collections import Counter

import duckdb
import pytest

from oracle import compare, duck
from tessella.llm import quality
from tessella.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_query_equals_sql(spark):
    ok, text, _ = compare(spark, SF, "op5", QUERIES["op5_quality_rules"], SQL["op5_quality_rules"], duck(SF))
    assert ok, text


def odd_texts():
    rng = random.Random(4)
    texts = ["", " \t\n", None, "a", "a b", "a b c", "a b c a b c", "a a a a", "x\x0by\x0cz\r\n", "\x1ca \x85b \xa0c", "é😀 |<>", "a\n\na\n b\na", "- a\n* b...", "w " * 60_000]
    return texts + ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(200))) for _ in range(200)]


def test_counts_and_verdict(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(4)
    rows = {r.doc_id: r for r in quality.quality_digest(df).collect()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t in enumerate(texts) if t is None or len(t) < 1000])
    sql = {r[0]: r for r in con.execute(SQL["op5_quality_rules"]).fetchall()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert tuple(r)[1:6] == brute(t or ""), t
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        if i in sql:
            assert tuple(r) == sql[i]


@pytest.mark.parametrize("ids", [[None, 1, 1]])
def test_null_keys_repeats_and_empty_tables(spark, ids):
    good = "The fox of the north went to a town that is in the valley, and it was happy. " * 1 + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    df = spark.createDataFrame([(i, good) for i in ids], "doc_id long, text string")
    rows = quality.judge(df).collect()
    assert len(rows) == 3 and all(r.kept and not r.failed_rules for r in rows)
    assert quality.judge(df.limit(0)).count() == 0
    loud = spark.createDataFrame([(1, good.upper()), (2, good.replace(" ", "### "))], "doc_id long, text string")
    assert {r.doc_id: r.failed_rules for r in quality.judge(loud).collect()}[1] == ["capitals"]
    assert all(not r.kept for r in quality.judge(loud).collect())
