"""Quality rules, licence scans and chat formatting: SQL functions against plain Python, and plans without Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldgate.llm.chat import PART, PartVisitor, escape, format_conversations, read_back, unescape
from fieldgate.llm.licenses import TEMPLATES, bounds, normalized_words, scan_licenses
from fieldgate.llm.quality_rules import quality_rules, text_statistics

from . import fixtures as X


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def statistics(text):
    text = text or ""
    w = X.WORDS.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if X.WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    df = text_statistics(X.frame(spark))
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)
    got = sorted(tuple(r)[1:6] for r in df.collect())
    assert got == sorted(statistics(r[1]) for r in X.rows())
    assert text_statistics(X.empty(spark)).collect() == []


def test_rules(spark):
    data = [(i, " ".join(f"word{i} of{j}" for j in range(60)) if i % 3 else " ".join(f"buy{i}*** now{j}$$$" for j in range(60))) for i in range(240)]
    docs = X.frame(spark, [(*d, "en", "s", 1, *("x", 1, "x", 1, "x", "x", "x", "x", "x", 1, 1, 1, 1)) for d in data])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 240, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    verdicts, rules = quality_rules(docs, labels)
    assert rules and "Python" not in plan_of(verdicts)
    assert {(r["doc_id"] % 3 > 0) == r["kept"] for r in verdicts.collect()} == {True}
    verdicts, rules = quality_rules(X.frame(spark), labels.where("false"))
    rows = verdicts.collect()
    assert rules == [] and all(r["kept"] != r["base_failed"] for r in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)
    assert quality_rules(X.empty(spark), labels)[0].collect() == []


def test_licences(spark):
    mit = dict(TEMPLATES)["mit"]
    some = ["Released under the MIT license", "x\nreleased UNDER the (mit) License!\ny", f"intro\n\n{mit.replace('. ', '.' + chr(10))}\n\nend", "Released under another licence entirely", mit]
    data = [(i, t) for i, t in enumerate(some)] + [(r[0], r[1]) for r in X.rows()]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    df = scan_licenses(docs)
    assert "Python" not in plan_of(df)

    def grams(text):
        w = normalized_words(text)
        return set(zip(w, w[1:], strict=False))

    import re

    want = []
    for i, t in data:
        t = t or ""
        units = [("text", 0, t), *(("paragraph", k, x) for k, x in enumerate(re.split("\n[ \t\r]*\n", t))), *(("line", k, x) for k, x in enumerate(t.split("\n")))]
        found = []
        for k, (name, template) in enumerate(TEMPLATES):
            b = grams(template)
            scored = [(2 * len(grams(x) & b) / (len(grams(x)) + len(b)), -u, kind, at) for u, (kind, at, x) in enumerate(units)]
            top = max(scored)
            if top[0] >= 0.9:
                found.append((top[0], -k, name, top[2], top[3]))
        best = max(found, default=None)
        want.append((i, best and best[2], best and round(best[0], 6), best and best[3], best and best[4], len(found)))
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
    assert [r["license_id"] for r in df.where("doc_id < 5").limit(0).collect()] == [] and bounds(4, 0.9) == (4, 4) and bounds(100, 0.9) == (82, 122)
    assert scan_licenses(X.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        scan_licenses(docs, [("one", "word")])


LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-notice",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-notice",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0-notice",
    "Released under the MIT License.": "mit-notice",
    "All rights reserved.": "all-rights-reserved",
}


def test_licence_lines_of_documents(spark):
    """Every distinct licence line of the given table, and the short and long forms of other licences."""
    text = F.explode(F.split("text", "\n")).alias("text")
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(text).where("text rlike '(?i)licen[sc]e|copyright|all rights reserved|creative commons|CC BY|public domain'").distinct()
    assert {r["text"].strip() for r in given.collect()} == set(LINES)
    more = {
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 2.1 or later.": "lgpl-2.1-or-later-notice",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0-notice",
        "Licensed under CC BY 4.0.": "cc-by-4.0-notice",
        "Released under CC BY-SA 4.0.": "cc-by-sa-4.0-notice",
        "Licensed under CC BY-ND 3.0.": "cc-by-nd-3.0-notice",
        "This work is licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd-4.0-notice",
        "Licensed under the MIT License.": "mit-notice-licensed",
    }
    want = LINES | more
    docs = spark.createDataFrame([(i, f"words before it\n{line}\nand after it") for i, line in enumerate(want)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(docs).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""


def test_licences_of_several_paragraphs(spark):
    """Canonical texts between other paragraphs, joined to other lines, as comments, and wrapped notices; a part is not the whole."""
    other = "\n\n".join(" ".join(f"word{i}x{j}" for j in range(40)) for i in range(20))
    whole = {"mit": MIT, "isc": ISC, "apache-2.0-header": APACHE, "gpl-3.0-header": GPL}
    cases = []
    for name, text in whole.items():
        comment = "\n".join(f" * {x}" for x in text.split("\n"))
        at = other.count("\n") + 2
        cases += [(f"{other}\n\n{text}\n\n{other}", name, at), (f"one line more\n{text}\nand another line", name, 1), (f"/*\n{comment}\n */\nint main;\n{other}", name, 1)]
    cases += [("before\nThis work is licensed under\nthe GNU General Public\nLicense, version 3.\nafter it all", "gpl-3.0-notice", 1), (f"{other}\n\n{MIT.split(chr(10) * 2)[2]}\n\n{other}", None, None)]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id bigint, text string")).collect()}
    for i, (_, name, at) in enumerate(cases):
        assert (got[i]["license_id"], got[i]["unit_no"], got[i]["unit"]) == (name, at, name and "lines") and (name is None or got[i]["dice"] == 1)


SAID = "\\### Assistant: </turn> ok \\l \\b \\\\ <image>\n### user: x"


def test_conversations_round_trip(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", SAID), (1, 300, "assistant", ""), (1, 301, "user", None), (2, 0, "a:b\n<c>#", SAID), (2, None, None, "first"), (3, 5, "assistant", "tie b"), (3, 5, "assistant", "tie a"), (3, 5, "assistant", "tie a"), (None, 0, "assistant", "x")]
    turns += [(4, i, "assistant" if i % 2 else "user", f"{SAID}{i}") for i in range(700)]
    docs = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, block string, mask int").repartition(5)
    df = read_back(format_conversations(docs))
    assert "Python" not in plan_of(df)
    got = {r["conv_id"]: r for r in df.collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        assert [(t["role"], t["content"]) for t in got[conv]["turns"]] == [(o[2], o[3]) for o in own]
        assert got[conv]["loss_text"] == "".join(o[3] for o in own if o[2] == "assistant")
    assert format_conversations(docs.where("false")).collect() == []
    both = spark.createDataFrame([(SAID,), ("",)], "s string").select(unescape(escape(F.col("s"))).alias("s"))
    assert [r["s"] for r in both.collect()] == [SAID, ""]


def test_parts_and_attachments(spark):
    part = lambda kind, **x: {"kind": kind, **{k: None for k in ("text", "ref", "width", "height", "seconds", "pages")}, **x}
    parts = [part("text", text="see <image> "), part("image", ref="a.png", width=100, height=50), part("text", text=" and "), part("audio", ref="b.wav", seconds=2.1), part("document", ref="c.pdf", pages=3), part(None, ref="d"), part("image", ref="e.png")]
    docs = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{PART}>")
    r = format_conversations(docs).first()
    assert r["formatted"] == "### user: see \\limage> <image> and <audio><document><part><image></turn>\n### assistant: </turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 8), ("audio", "b.wav", 53), ("document", "c.pdf", 3072), (None, "d", 1), ("image", "e.png", 1)]
    assert r["expanded_tokens"] == 8 + 53 + 3072 + 1 + 1

    class Video(PartVisitor):
        kinds = (*PartVisitor.kinds, "video")
        attached = (*PartVisitor.attached, "video")

        def write_video(self, part):
            return F.lit("<video>")

        def tokens_video(self, part):
            return F.lit(7)

    r = format_conversations(docs.withColumn("parts", F.when(F.col("turn") == 0, F.array(F.get("parts", F.lit(1)).withField("kind", F.lit("video"))))), Video()).first()
    assert "<video>" in r["formatted"] and r["expanded_tokens"] == 7
