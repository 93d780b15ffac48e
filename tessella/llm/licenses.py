"""License scans by conditional compression.

Words of license language mark candidate blocks. A block is compressed on its own and with each template as
a raw zstandard dictionary; templates are ranked by how many bytes their dictionary saves. Down to the last one that
saves anything, those most of whose words occur in the block are aligned with it word by word, and the one with
the least differing wording wins if enough of its words are there in order. Its span, its missing and its additional words are reported. The rest of the block
is looked at again until nothing more is found.

Cases: a null or empty text has no license; a null key stays null; repeated rows give one result each; an
empty table gives an empty result; texts are read whole, a block ends where 400 characters hold no such word.
Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import map_texts

GAP, MARGIN = 400, 250
#: Least share of a template's words, most differing words for each of its words.
LEAST, MOST_DIFFERENT = 0.85, 0.25
#: A level that looks at every byte of a dictionary; the fast ones step over some.
LEVEL = 19
#: A block of so many characters at most is aligned at once; longer ones are cut with an overlap.
BLOCK, OVERLAP = 12_000, 4_000

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_GNU = """This {kind} is free software: you can redistribute it and/or modify it under the terms of the GNU {name}
General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version."""
_UNLICENSE = "This is free and unencumbered software released into the public domain."


CC_PARTS = {"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: Wordings that are no license of their own.
WITHOUT_TAG = {"BSD-Disclaimer"}


def templates() -> dict[str, list[str]]:
    """Wordings by license. The wordings that licenses ask for and the usual short forms."""
    out = {
        "MIT": [_MIT_GRANT, "Released under the MIT License.", "Licensed under the MIT license."],
        "BSD-2-Clause": [_BSD_TWO, f"{_BSD_TWO} {_BSD_DISCLAIMER}", "Licensed under the BSD 2-Clause License."],
        "BSD-3-Clause": [f"{_BSD_TWO} {_BSD_THIRD}", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_DISCLAIMER}", "Licensed under the BSD 3-Clause License."],
        "ISC": [_ISC, "Licensed under the ISC License."],
        "Apache-2.0": [_APACHE, "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."],
        "MPL-2.0": [_MPL, "Licensed under the Mozilla Public License, version 2.0."],
        "BSD-Disclaimer": [_BSD_DISCLAIMER],
        "Unlicense": [_UNLICENSE],
        "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    }
    for name, short, versions in (("", "GPL", (2, 3)), ("Lesser", "LGPL", (2.1, 3)), ("Affero", "AGPL", (3,))):
        for v in versions:
            full = " ".join(f"GNU {name} General Public License".split())
            out[f"{short}-{float(v)}"] = [
                _GNU.format(kind="program", name=name, version=v),
                f"This work is licensed under the {full}, version {v}.",
                f"Released under the {full} version {v}.",
            ]
    for form in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("3.0", "4.0"):
            long = "-".join(["Attribution", *(CC_PARTS[p] for p in form.split("-")[1:])])
            scope = "International" if v == "4.0" else "Unported"
            out[f"CC-{form}-{v}"] = [
                f"Licensed under CC {form} {v}.",
                f"This work is licensed under CC {form} {v}.",
                f"Creative Commons {long} {v} {scope} License",
                f"This work is licensed under a Creative Commons {long} {v} {scope} License.",
            ]
    for name, texts in out.items():
        if name in WITHOUT_TAG:
            continue
        tags = [name] if "GPL" not in name else [name, f"{name}-only", f"{name}-or-later"]
        texts += [f"SPDX-License-Identifier: {tag}" for tag in tags]
    return out


_MARK = re.compile(
    r"licen[cs]e|copyright|permission|redistribut|warrant|public domain|unencumbered|spdx|liab|copies|disclaimer|endorse|apache|mozilla|creative commons",
    re.I,
)
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("license", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("start", "end", "saved")]
        + [T.StructField("share", T.DoubleType())]
        + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("missing", "additional")]
    )
)


class Scanner:
    """Compressors with each template as dictionary, made once a task."""

    def __init__(self, wordings: dict[str, list[str]]):
        self.entries = []
        for name, texts in wordings.items():
            for text in texts:
                plain = " ".join(text.lower().split())
                data = zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
                self.entries.append((name, _WORD.findall(plain), len(plain), packer))
        self.alone = zstandard.ZstdCompressor(level=LEVEL)

    def ranked(self, block: str) -> list[tuple[int, str, list[str]]]:
        """(bytes saved, license, words) of the templates that save any, the most for their length first."""
        data = " ".join(block.lower().split()).encode()
        size = len(self.alone.compress(data))
        saved = [(size - len(c.compress(data)), name, words, n) for name, words, n, c in self.entries]
        return [(s, name, words) for s, name, words, n in sorted(saved, key=lambda s: (-s[0] / s[3], s[1])) if s > 0]

    def best(self, text: str, lo: int, hi: int) -> tuple | None:
        """The license of text[lo:hi] with the least differing wording, if any is confirmed."""
        words = [(m[0].lower(), lo + m.start(), lo + m.end()) for m in _WORD.finditer(text[lo:hi])]
        found, there = [], Counter(w for w, *_ in words)
        for saved, name, wording in self.ranked(text[lo:hi]):
            if sum((Counter(wording) & there).values()) < LEAST * len(wording):
                continue  # no alignment can have enough of its words
            parts = [p for p in SequenceMatcher(None, wording, [w for w, *_ in words], autojunk=False).get_matching_blocks() if p.size]
            parts = dense(parts)
            equal = sum(p.size for p in parts)
            if not parts or equal < LEAST * len(wording):
                continue
            a, b = parts[0].b, parts[-1].b + parts[-1].size
            held = {i for p in parts for i in range(p.a, p.a + p.size)}
            at = {i for p in parts for i in range(p.b, p.b + p.size)}
            missing = [w for i, w in enumerate(wording) if i not in held]
            more = [words[i][0] for i in range(a, b) if i not in at]
            if len(missing) + len(more) <= MOST_DIFFERENT * len(wording) and not telling(missing):
                found.append((len(missing) + len(more), -equal, -saved, name, words[a][1], words[b - 1][2], equal / len(wording), missing, more))
        if not found:
            return None
        _, _, saved, name, start, end, share, missing, more = min(found, key=lambda f: (f[0] / -f[1], f[1:4]))
        return name, start, end, -saved, share, missing, more

    def __call__(self, text: str) -> list[tuple]:
        out, todo = [], list(blocks(text))
        while todo:
            lo, hi = todo.pop()
            if not _MARK.search(text, lo, hi):
                continue
            if hit := self.best(text, lo, hi):
                out.append(hit)
                todo += [(lo, hit[1]), (hit[2], hi)]
        return sorted(dict.fromkeys(map(freeze, out)), key=lambda h: (h[1], h[0]))


def freeze(hit: tuple) -> tuple:
    return (*hit[:5], tuple(hit[5]), tuple(hit[6]))


def telling(missing: list[str]) -> bool:
    """Whether words are missing that tell one license from another: numbers and the letters of a form."""
    return any(any(c.isdigit() for c in w) or re.fullmatch(r"by(-\w\w)*|attribution(-\w+)*", w) for w in missing)


def dense(parts: list) -> list:
    """The run of matching parts around the largest one, as far as the gaps in the text stay short."""
    if not parts:
        return []
    main = max(range(len(parts)), key=lambda i: parts[i].size)
    lo = hi = main
    while lo and parts[lo].b - (parts[lo - 1].b + parts[lo - 1].size) <= 12:
        lo -= 1
    while hi + 1 < len(parts) and parts[hi + 1].b - (parts[hi].b + parts[hi].size) <= 12:
        hi += 1
    return parts[lo : hi + 1]


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Where words of license language stand close together, with a margin."""
    marks = [m.span() for m in _MARK.finditer(text)]
    i = 0
    while i < len(marks):
        j = i
        while j + 1 < len(marks) and marks[j + 1][0] - marks[j][1] <= GAP:
            j += 1
        lo, hi = max(0, marks[i][0] - MARGIN), min(len(text), marks[j][1] + MARGIN)
        while hi - lo > BLOCK:
            yield lo, lo + BLOCK
            lo += BLOCK - OVERLAP
        yield lo, hi
        i = j + 1


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per input row: its key and ``licenses`` (license, start, end, saved bytes, share of the
    template's words, missing and additional words)."""
    known = wordings or templates()
    make: Callable = lambda: Scanner(known)
    return map_texts(df, id_col, text_col, "licenses", SPANS, make)


def licenses_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and places of the licenses, and how many are in the exact wording."""
    found, spans = find_licenses(df, id_col, text_col), F.col("licenses")
    exact = F.filter(spans, lambda s: (F.size(s["missing"]) == 0) & (F.size(s["additional"]) == 0))
    place = F.transform(spans, lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select(
        id_col, F.size(spans).cast("long").alias("n_licenses"), F.size(exact).cast("long").alias("n_exact"), F.array_join(place, ",").alias("spans")
    )
