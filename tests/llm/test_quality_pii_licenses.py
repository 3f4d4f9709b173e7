"""Quality rules, personal data and licences against plain versions."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from eventide.llm import boosting, licenses, pii, quality
from eventide.llm import words as WD

from conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_quality(text, rules=quality.Rules()):
    text = text or ""
    ws = WORD.findall(text)
    spots = {}
    for i in range(len(ws) - 7):
        spots.setdefault(tuple(ws[i:i + 8]), []).append(i)
    again = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup, lost, total = set(), 0, 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            continue
        chars = sum(map(len, own))
        total += chars
        twice = line in seen
        seen.add(line)
        dup += twice
        bars = sum(line.count(c) for c in "|<>")
        bad = (not any(w[-1] in quality.ENDS for w in own) or bars >= 2 or twice
               or 100 * sum(line.count(c) for c in quality.SYMBOLS) > 10 * chars
               or any(p in line.lower() for p in quality.PHRASES))
        lost += chars * bad
    failed = len(ws) < 20 or 100 * len(again) > 30 * len(ws)
    return (len(ws), total, sum(text.count(c) for c in quality.SYMBOLS), dup, len(again), failed,
            not failed and 100 * lost <= 50 * total)


def test_quality_equals_plain(sample):
    r = random.Random(2)
    parts = ["a b c.", "x", "\n", " ", "#", "|", "<b>", "menu | home | up", "Read more", "same line here.", "é漢。", "\r", "\t"]
    texts = [t or "" for t in ODD] + [r["text"] for r in sample.collect()]
    texts += ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randrange(60))) for _ in range(400)]
    got = []
    for _, data, offsets in WD.text_slices(pa.array(texts), 5000):
        got += list(zip(*[quality.judge(data, offsets, quality.Rules())[0][c].tolist() for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]))
    for text, row in zip(texts, got):
        assert row == plain_quality(text), text[:200]


def test_quality_tables(spark, odd_docs, no_docs):
    out = quality.clean(odd_docs)
    assert out.count() == odd_docs.count() and "node" in out.columns and out.columns.count("kept") == 1
    assert out.where("text is null").select("n_words", "kept", "clean_text").distinct().collect() == [(0, False, None)]
    assert quality.clean(no_docs).count() == 0
    text = "A clean sentence stands here.\nhome | news | sport\nA clean sentence stands here.\nAnd one more of them."
    got = quality.clean(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                        rules=quality.Rules(min_words=5, repeat_pct=100)).collect()[0]
    assert got["clean_text"] == "A clean sentence stands here.\nAnd one more of them." and got["n_lines_removed"] == 2


def test_quality_measures_lines_by_length(spark):
    def prose(lo, hi):
        return " ".join(f"Sentence {i} tells of w{i} and of x{i * 7}." for i in range(lo, hi))

    parts = ["If a < b, c < d holds, then so it does.", "Please click here for it.", "The row is 1 | 2 | 3 there.",
             "The shop asks you to read more on it.", "See the terms of use."]
    clean = [f"{prose(0, 30)} {x} {prose(30, 60)}" for x in parts]
    clean += [" ".join(f"{prose(40 * i, 40 * i + 40)} {x}" for i, x in enumerate(parts))]
    short = "Twenty and more clean words stand on this one line, and the last of them say where to {} for all that is left."
    clean += [short.format("click here"), short.format("find a < b, c < d")]
    menu = " ".join(f"Shop{i} | News{i} | Sport{i}. |" for i in range(80))
    notes = " ".join(f"Read more on {i}. Click here for {i}." for i in range(80))
    mixed = [f"{prose(0, 30)}\n{x}\n{prose(30, 60)}" for x in parts]
    texts = clean + [menu, notes] + mixed
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r for r in quality.clean(docs).orderBy("doc_id").collect()]
    n = len(clean)
    for row in got[:n]:
        assert row["kept"] and row["clean_text"] == row["text"], row["text"][:80]
    assert [(r["kept"], r["n_lines_removed"]) for r in got[n:n + 2]] == [(False, 1)] * 2
    for row in got[n + 2:]:  # short lines fail as before
        assert row["kept"] and row["clean_text"] == f"{prose(0, 30)}\n{prose(30, 60)}"


def plain_spans(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_equal_patterns(sample):
    r = random.Random(5)
    texts = [x["text"] for x in sample.collect()]
    texts += ["".join(r.choice("0123456789.@+-() ab4.1") for _ in range(200)) for _ in range(1500)]
    bits = ["a.b@c.d", "@", "1.2.3.4", ".", "256", " ", "+1 (234) 555-6789", "4111111111111111", " 4", "-", "x@y", "@.com", "_"]
    texts += ["".join(r.choice(bits) for _ in range(30)) for _ in range(1500)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(t)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def people(spark):
    r = random.Random(9)

    def card():
        d = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    rows = []
    for i in range(500):
        kinds = [f"user{i}@mail{i % 7}.example.com", f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", card(),
                 ".".join(str(r.randrange(256)) for _ in range(4))]
        r.shuffle(kinds)
        rows.append((i, " some words stand here, ".join(kinds[:3]) + " to the end."))
    rows += [(1000 + i, f"call +1 (234) 555-{1000 + i} {card()} now.") for i in range(20)]
    rows += [(2000 + i, "clean words of a text with 12 numbers and 1999 years.") for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_method_adds_what_patterns_miss(people):
    got = {r["doc_id"]: r for r in pii.find(people, pii.fit(people)).collect()}
    for i in range(1000, 1020):
        assert got[i]["n_phone"] == 0 and got[i]["n_card"] == 0 and got[i]["redacted"] == "call [PHONE] [CARD] now."
    assert all(got[2000 + i]["spans"] == "" for i in range(50))
    texts = {r["doc_id"]: r["text"] for r in people.collect()}
    for i in range(500):
        base = plain_spans(texts[i])
        assert got[i]["base_sha256"] == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert set(pii.shown(base).split(",")) <= set(got[i]["spans"].split(","))


def test_written_out_addresses(spark, people):
    shown = ["john (at) example (dot) com", "jane.doe [at] mail.example.org", "max@ example.net", "info(at)firm.net"]
    plain = ["apples @ 3.50 each", "we met (at) 12.30 sharp", "no sign here. Next."]
    extra = spark.createDataFrame([(5000 + i, f"write to {s} for more of it") for i, s in enumerate(shown + plain)],
                                  "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(extra, pii.fit(people)).collect()}
    for i, s in enumerate(shown + plain):
        want = "[EMAIL]" if s in shown else s
        assert got[5000 + i]["redacted"] == f"write to {want} for more of it" and got[5000 + i]["n_email"] == 0


def test_many_spans_take_linear_time(people):
    import time

    redactor = pii.fit(people)
    text = " ".join(f"user{i}@mail.example.com 10.0.{i % 256}.7 +1 (234) 555-{1000 + i % 9000} and words" for i in range(20_000))
    start = time.time()
    base = pii.base_spans(text)
    spans = sorted(base + redactor.added(text, base))
    pii.training_rows(text[:200_000])
    assert len(spans) >= 60_000 and time.time() - start < 60


def test_taken_spans():
    taken = pii.Taken([(0, 5, 9), (1, 8, 12), (2, 20, 21)])
    assert [taken.overlaps(a, b) for a, b in ((0, 5), (0, 6), (11, 13), (12, 20), (12, 21), (21, 30))] == [
        False, True, True, False, True, False]
    taken.add(13, 15)
    assert taken.overlaps(14, 15) and not taken.overlaps(15, 20)


def test_pii_tables(odd_docs, no_docs):
    out = pii.find(odd_docs, pii.fit(odd_docs))
    assert out.count() == odd_docs.count() and out.columns.count("spans") == 1
    assert out.where("text is null and redacted is not null").count() == 0
    assert pii.find(no_docs, pii.fit(no_docs)).count() == 0


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    margin = model.margin(x[2000:])
    assert ((margin > 0) == y[2000:]).mean() > 0.95
    cut = boosting.calibrate(margin, y[2000:], 0.99)
    assert y[2000:][margin >= cut].mean() >= 0.99
    assert boosting.calibrate(np.array([1.0, 2.0]), np.array([0.0, 0.0]), 0.9) == float("inf")


def test_licenses(spark, odd_docs, no_docs):
    gpl = next(s for s in licenses.SENTENCES if s.startswith("this program is free software") and "version 3" in s)
    texts = {
        1: "Words of a text.\nReleased under the MIT License.", 2: "Text. Licensed under the Apache License, Version 2.0. End.",
        3: "This work is licensed under the GNU General\npublic license, version 3.",
        4: gpl.capitalize() + ". See the GNU General Public License for more details.",
        5: "Licensed under CC BY-NC 4.0. Released under the MIT License. Released under the MIT License.",
        6: "A licence is no sentence we know.", 7: "Licensed under the Apache License, Version 2.0 (the \"License\");\n"
        "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
        "    http://www.apache.org/licenses/LICENSE-2.0",
        8: "See the GNU General Public License for more details."}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [got[i]["licenses"] for i in range(1, 9)] == [
        "MIT", "Apache-2.0", "GPL-3.0", "GPL-3.0-or-later", "CC-BY-NC-4.0,MIT", "", "Apache-2.0", ""]
    assert got[5]["n_known"] == 3 and got[8]["unmatched"] == "gpl-see" and got[4]["unmatched"] == "gpl-see"
    assert licenses.scan(odd_docs).count() == odd_docs.count() and licenses.scan(no_docs).count() == 0


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MIT = """MIT License

Copyright (c) 2020 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

%s Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
%s Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
APACHE = """Licensed under the Apache License, Version 2.0
(the "License"); you may not use this file except in compliance
with the License.  You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law, the software is distributed on an "AS IS" BASIS."""


def test_wrapped_notices(spark):
    """Hard-wrapped notices, plain, indented and inside comments."""
    whole = [(GPL3, "GPL-3.0-or-later", "gpl3-later gpl-warranty gpl-see"), (MIT, "MIT", "mit-notice mit-warranty"),
             (APACHE, "Apache-2.0", "apache2-both apache2-copy")]
    whole += [(BSD % marks, "BSD-2-Clause", "bsd-start bsd-source bsd-binary")
              for marks in (("1.", "2."), ("(1)", "(2)"), ("a.", "b."), ("a)", "b)"), ("*", "*"), ("-", "-"))]
    rows = []
    for sign in ("", "# ", " * ", "// ", "-- ", ";; ", "dnl ", "REM ", "\t", "> "):
        rows += [("\n".join((sign + x).rstrip() for x in text.split("\n")), *want) for text, *want in whole]
    rows += [(t.replace("\n", "\r\n"), *want) for t, *want in rows]
    rows += [("All rights\nReserved.", "Proprietary", "all-rights"),
             ("Words stand here. This project is licensed under the\n  MIT License.\nMore.", "MIT", "mit-ref"),
             ("Licensed under the\n\nMIT License.", "", ""), ("A name\nReleased under the MIT License\nMore", "MIT", "mit-ref"),
             ("We were never\nlicensed under the MIT License.", "", "")]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, (text, name, ids) in enumerate(rows):
        assert (got[i]["licenses"], got[i]["identifiers"], got[i]["unmatched"]) == (name, ids, ""), text


BSD3 = """Copyright (c) 2020, A Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_WHOLE = """MIT License

Copyright (c) 2020 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE_WHOLE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GNU = """This %s is free software%s you can redistribute it and/or
modify it under the terms of the GNU %s as published by the Free Software
Foundation; either version %s of the License, or (at your option) any
later version.

This %s is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU %s for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""
FREE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


def test_whole_notices(spark):
    """Standard notices of ten licences, plain and as comments; nothing is left over but the rights line."""
    def gnu(kind, name, version):
        return GNU % (kind, ";" if kind == "library" else ":", name, version, kind, name)

    whole = [(BSD3, "BSD-3-Clause", "all-rights"), (MIT_WHOLE, "MIT", ""), (APACHE_WHOLE, "Apache-2.0", ""),
             (gnu("library", "Lesser General Public License", "2.1"), "LGPL-2.1-or-later", ""),
             (gnu("program", "Affero General Public License", "3"), "AGPL-3.0-or-later", ""),
             (gnu("program", "General Public License", "2"), "GPL-2.0-or-later", ""),
             (gnu("program", "Lesser General Public License", "3"), "LGPL-3.0-or-later", ""),
             (MPL, "MPL-2.0", ""), (ISC, "ISC", ""), (FREE, "Unlicense", ""),
             ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause", ""), ("All rights reserved.", "Proprietary", "")]
    rows = [("\n".join((sign + x).rstrip() for x in text.split("\n")), *want)
            for sign in ("", "# ", " * ", "// ") for text, *want in whole]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, (text, name, left) in enumerate(rows):
        assert (got[i]["licenses"], got[i]["unmatched"]) == (name, left), text
