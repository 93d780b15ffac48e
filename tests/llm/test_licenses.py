"""License scans: every template in text, edited wordings, near relatives, odd inputs."""

import random

from tessella.llm import licenses as L
from tessella.llm.queries import QUERIES


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_every_wording_is_found():
    rng, scan = random.Random(1), L.Scanner(L.templates())
    for name, texts in L.templates().items():
        for wording in texts:
            text = f"{prose(rng, 60)}\n{wording}\n{prose(rng, 60)}"
            hits = scan(text)
            assert [h[0] for h in hits] == [name], (name, hits)
            assert L._WORD.findall(text[hits[0][1] : hits[0][2]].lower()) == L._WORD.findall(wording.lower())


def test_edits_and_relatives():
    rng, scan = random.Random(2), L.Scanner(L.templates())
    words = L._MIT_GRANT.replace("Software", "Library").split()
    words[40:42] = ["hereby"]
    hit = scan(prose(rng, 30) + "\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)))
    assert [h[0] for h in hit] == ["MIT"] and hit[0][5] and hit[0][6]
    assert [h[0] for h in scan(f"{L._BSD_TWO}\n{L._BSD_THIRD}")] == ["BSD-3-Clause"]
    assert [h[0] for h in scan(f"x {L._BSD_TWO} y")] == ["BSD-2-Clause"]
    assert [h[0] for h in scan("Licensed under CC BY-SA 4.0.")] == ["CC-BY-SA-4.0"]
    two = scan(f"Released under the MIT License. {prose(rng, 10)} Licensed under the Apache License, Version 2.0.")
    assert [h[0] for h in two] == ["MIT", "Apache-2.0"]
    for text in ("a driving license is required", "Licensed under CC BY-XX 9.0.", "all copyright and no permission", prose(rng, 500)):
        assert scan(text) == []


def test_rows(spark):
    rows = [(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (None, "licensed under CC BY-NC 4.0.", None), (3, None, None), (4, "", None), (5, "license " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = sorted(map(tuple, L.licenses_digest(df).collect()), key=str)
    want = [(1, 1, 1, "MIT:0:30")] * 2 + [(None, 1, 1, "CC-BY-NC-4.0:0:27"), (3, 0, 0, ""), (4, 0, 0, ""), (5, 0, 0, "")]
    assert got == sorted(want, key=str)
    assert L.licenses_digest(df.limit(0)).count() == 0


def test_query_finds_all_short_forms(spark):
    sf = "/root/testdata/sf0.01"
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        found = sorted((r.text.find(line), name) for line, name in lines.items() if line in r.text)
        want[r.doc_id] = [name for _, name in found]
    got = {r.doc_id: [s.rsplit(":", 2)[0] for s in r.spans.split(",") if s] for r in QUERIES["op2_license_compression"](spark, sf).collect()}
    assert any(want.values()) and {k: sorted(set(v)) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_tags_long_forms_and_disclaimers():
    scan = L.Scanner(L.templates())
    want = {
        "# SPDX-License-Identifier: MIT": "MIT",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
        "under the Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        f"x {L._BSD_TWO} {L._BSD_DISCLAIMER} y": "BSD-2-Clause",
        f"x {L._BSD_DISCLAIMER} y": "BSD-Disclaimer",
    }
    for text, name in want.items():
        assert [h[0] for h in scan(text)] == [name], text
    assert scan("Creative Commons Attribution-Other 4.0 International License") == []


def test_ranking_goes_on_to_the_end(monkeypatch):
    """Whatever the order of the ranking, the same license is confirmed."""
    rng, scan = random.Random(5), L.Scanner(L.templates())
    texts = [f"{prose(rng, 40)}\n{w}\n{prose(rng, 40)}" for ws in list(L.templates().values())[:12] for w in ws]
    want = [scan(t) for t in texts]
    real = L.Scanner.ranked
    monkeypatch.setattr(L.Scanner, "ranked", lambda self, block: real(self, block)[::-1])
    assert [scan(t) for t in texts] == want


def test_equals_alignment_with_every_template():
    """Brute force: every wording is aligned with the whole text, without compression or bags of words."""
    from difflib import SequenceMatcher

    rng, scan = random.Random(6), L.Scanner(L.templates())
    wordings = [(name, L._WORD.findall(" ".join(t.lower().split()))) for name, ts in L.templates().items() for t in ts]
    for name, ts in list(L.templates().items())[::3]:
        words = ts[0].split()
        if len(words) > 12:
            words[len(words) // 2] = "otherwise"
        text = f"{prose(rng, 20)}\n{' '.join(words)}\n{prose(rng, 20)}"
        tokens = L._WORD.findall(text.lower())
        scored = []
        for other, wording in wordings:
            parts = L.dense([p for p in SequenceMatcher(None, wording, tokens, autojunk=False).get_matching_blocks() if p.size])
            equal = sum(p.size for p in parts)
            if parts and equal >= L.LEAST * len(wording):
                held = {i for p in parts for i in range(p.a, p.a + p.size)}
                missing = [w for i, w in enumerate(wording) if i not in held]
                differ = len(missing) + parts[-1].b + parts[-1].size - parts[0].b - equal
                if differ <= L.MOST_DIFFERENT * len(wording) and not L.telling(missing):
                    scored.append((differ / equal, -equal, other))
        assert scan(text)[0][0] == min(scored)[2] == name
