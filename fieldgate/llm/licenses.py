"""Licence scans: Dice coefficient over word bigrams against licence templates, pruned by size bounds. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of licences as short notices have them, by the id that a notice gets.
NAMES = [
    ("mit-notice", "the MIT License"),
    ("isc-notice", "the ISC License"),
    ("apache-2.0-notice", "the Apache License, Version 2.0"),
    ("bsd-3-clause-notice", "the BSD 3-Clause License"),
    ("bsd-2-clause-notice", "the BSD 2-Clause License"),
    *(
        (f"{short}{later}-notice", f"the GNU {name}{words}")
        for short, name in (
            ("gpl-3.0", "General Public License, version 3"),
            ("gpl-2.0", "General Public License, version 2"),
            ("lgpl-3.0", "Lesser General Public License, version 3"),
            ("lgpl-2.1", "Lesser General Public License, version 2.1"),
            ("agpl-3.0", "Affero General Public License, version 3"),
        )
        for later, words in (("", ""), ("-or-later", " or later"))
    ),
    ("mpl-2.0-notice", "the Mozilla Public License, version 2.0"),
    ("epl-2.0-notice", "the Eclipse Public License, version 2.0"),
    *((f"cc-{kind}-{v}-notice", f"CC {kind.upper()} {v}") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("4.0", "3.0")),
    ("cc0-1.0-notice", "CC0 1.0"),
]
#: What stands before a name.
FORMS = ("Released under", "Licensed under", "This work is licensed under")
#: Creative Commons licences as long notices have them.
CREATIVE_COMMONS = [
    (f"cc-{kind}-{v}-notice", f"This work is licensed under a Creative Commons {words} {v} {port} License.")
    for v, port, nd in (("4.0", "International", "NoDerivatives"), ("3.0", "Unported", "NoDerivs"))
    for kind, words in (
        ("by", "Attribution"),
        ("by-sa", "Attribution-ShareAlike"),
        ("by-nc", "Attribution-NonCommercial"),
        ("by-nd", f"Attribution-{nd}"),
        ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
        ("by-nc-nd", f"Attribution-NonCommercial-{nd}"),
    )
]

#: Public licence notices and short licence texts.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice-licensed", "Licensed under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause-notice", "Licensed under the BSD 3-Clause License."),
    ("bsd-2-clause-notice", "Licensed under the BSD 2-Clause License."),
    ("gpl-3.0-notice", "Licensed under the GNU General Public License, version 3."),
    ("gpl-2.0-notice", "Licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0-notice", "Licensed under the GNU Lesser General Public License, version 3."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0-notice", "This work is dedicated to the public domain under the CC0 1.0 Universal dedication."),
    ("all-rights-reserved", "All rights reserved."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
]
# a template that is listed above keeps its id
TEMPLATES += [(name, text) for name, text in [*((name, f"{form} {words}.") for name, words in NAMES for form in FORMS), *CREATIVE_COMMONS] if text not in {t for _, t in TEMPLATES}]


def normalize(text: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalized_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = normalized_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The least and most distinct bigrams a text can have at a Dice coefficient of ``threshold`` with one of ``size``."""
    least = size * threshold / (2 - threshold)
    most = size * (2 - threshold) / threshold
    return int(-(-round(least, 9) // 1)), int(round(most, 9) // 1)


def bigrams(words: Column) -> Column:
    """The word bigrams of an array of words, repeated ones as well."""
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


FOUND = "struct<dice:double,order:int,unit:string,unit_no:int,license_id:string>"


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.9) -> DataFrame:
    """doc_id, license_id, dice, unit, unit_no, n_found per row of ``docs`` (doc_id, text).

    The units of a text are the whole (unit 'text'), its paragraphs, its lines and its windows (unit 'lines', unit_no of the first line): two or
    more lines that follow one another, across paragraphs too and not counting lines without words, whose words number at most
    (2 - threshold) / threshold times the template's. A unit is compared with a template only if the number of
    its distinct word bigrams is within the size bounds that the threshold sets. license_id is the template with the highest Dice coefficient
    of ``threshold`` or more (ties: the template listed first, then the first unit, of windows the one that starts first and is shortest), dice is
    rounded to 6 places, n_found counts the templates that some unit matches.

    A unit within bounds shares as many bigrams as the lower bound with the template, and every unit's bigrams are the text's: a text that shares
    fewer with a template is not taken apart for it, and a window not made where the words from its start on share fewer.

    Null, empty and unmatched texts have null license_id, dice, unit and unit_no, and n_found 0. Templates of fewer than two words
    are an error. Repeated rows give repeated rows, a null doc_id stays null, other columns are ignored, an empty table gives an empty
    table. ``templates`` is a list the caller writes out (some hundreds, not thousands): it is part of the plan.
    """
    listed = [(name, template_bigrams(text), len(normalized_words(text))) for name, text in (TEMPLATES if templates is None else templates)]
    if any(not grams for _, grams, _ in listed):
        raise ValueError("a template needs two words at least")
    limits = [bounds(len(grams), threshold) for _, grams, _ in listed]
    least = min((lo for lo, _ in limits), default=1)
    strings = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    known = F.array(
        *(
            F.struct(F.lit(name).alias("license_id"), F.lit(-k).alias("order"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(bounds(n, threshold)[1]).alias("words"), strings(grams).alias("grams"))
            for k, ((name, grams, n), (lo, hi)) in enumerate(zip(listed, limits, strict=True))
        )
    ).cast("array<struct<license_id:string,order:int,lo:int,hi:int,words:int,grams:array<string>>>")
    every = strings(dict.fromkeys(g for _, grams, _ in listed for g in grams))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("w", F.split(normalize(F.col("text")), " "))
    # array_intersect gives each bigram once
    rows = rows.select("doc_id", "text", F.when(F.size("w") > least, F.array_intersect(bigrams(F.col("w")), every)).otherwise(strings([])).alias("shared"))
    near = F.filter(known, lambda t: F.size(F.array_intersect(t["grams"], F.col("shared"))) >= t["lo"])
    rows = rows.select("doc_id", "text", F.when(F.size("shared") >= least, near).otherwise(F.slice(known, 1, 0)).alias("near"))

    part = lambda kind, at, x: F.struct(F.lit(kind).alias("unit"), at.alias("unit_no"), F.split(normalize(x), " ").alias("x"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: part("line", i, x))
    units = F.concat(F.array(part("text", F.lit(0), F.col("text"))), F.transform(F.split("text", "\n[ \t\r]*\n"), lambda x, i: part("paragraph", i, x)), lines)
    # all words with their line's number: w and at
    words = F.flatten(F.transform(lines, lambda u: F.transform(F.filter(u["x"], lambda w: w != ""), lambda w: F.struct(w.alias("w"), u["unit_no"].alias("at")))))
    some = F.size("near") > 0
    rows = rows.select("doc_id", "near", F.when(some, units).alias("units"), F.when(some, words).alias("words"))
    sets = F.transform(F.filter("units", lambda u: F.size(u["x"]) > least), lambda u: u.withField("x", F.array_distinct(bigrams(u["x"]))))
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda p: (p == 1) | (F.get("words", p - 1)["at"] != F.get("words", p - 2)["at"]))
    rows = rows.select("doc_id", "near", sets.alias("units"), F.col("words.w").alias("w"), F.col("words.at").alias("at"), F.when(F.size("words") > 0, starts).otherwise(F.array().cast("array<int>")).alias("starts"))
    # where each line's words end, that is where the next one's start
    rows = rows.withColumn("ends", F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(F.size("w") + 1)))

    def windows(t: Column) -> Column:
        def of(start: Column, i: Column) -> Column:
            enough = F.size(F.array_intersect(t["grams"], bigrams(F.slice("w", start, t["words"])))) >= t["lo"]
            ends = F.filter(F.slice("ends", i + 2, t["words"]), lambda e: (e - start > t["lo"]) & (e - start <= t["words"]))
            made = F.transform(ends, lambda e: F.struct(F.lit("lines").alias("unit"), F.get("at", start - 1).alias("unit_no"), F.array_distinct(bigrams(F.slice("w", start, e - start))).alias("x")))
            return F.when(enough, made).otherwise(F.array().cast("array<struct<unit:string,unit_no:int,x:array<string>>>"))

        return F.flatten(F.transform("starts", of))

    def best(t: Column) -> Column:
        sized = F.filter(F.concat("units", windows(t)), lambda u: F.size(u["x"]).between(t["lo"], t["hi"]))
        scored = F.transform(sized, lambda u: F.struct((F.lit(2.0) * F.size(F.array_intersect(u["x"], t["grams"])) / (F.size(u["x"]) + F.size(t["grams"]))).alias("dice"), t["order"].alias("order"), u["unit"].alias("unit"), u["unit_no"].alias("unit_no"), t["license_id"].alias("license_id")))
        # the first unit of the highest: reduce keeps the earlier of equals
        return F.aggregate(F.filter(scored, lambda s: s["dice"] >= threshold), F.lit(None).cast(FOUND), lambda a, s: F.when(a.isNull() | (s["dice"] > a["dice"]), s).otherwise(a))

    found = F.when(F.size("near") > 0, F.array_compact(F.transform("near", best))).otherwise(F.array().cast(f"array<{FOUND}>"))
    top = rows.select("doc_id", found.alias("found")).withColumn("top", F.array_max("found"))
    return top.select("doc_id", F.col("top.license_id").alias("license_id"), F.round("top.dice", 6).alias("dice"), F.col("top.unit").alias("unit"), F.col("top.unit_no").alias("unit_no"), F.size("found").cast("long").alias("n_found"))


def scan_sql(threshold: float = 0.9) -> str:
    """The same scan in DuckDB SQL, without the pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, template_bigrams(text)))}])" for k, (name, text) in enumerate(TEMPLATES))
    return f"""
    WITH t(k, license_id, grams) AS (VALUES {values}),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    u AS (
      SELECT r, 0 AS kind, 0 AS unit_no, text AS x FROM d
      UNION ALL SELECT r, 1, unnest(range(len(p)))::INT, unnest(p) FROM (SELECT r, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS p FROM d)
      UNION ALL SELECT r, 2, unnest(range(len(p)))::INT, unnest(p) FROM (SELECT r, string_split(text, chr(10)) AS p FROM d)),
    w AS (SELECT r, kind, unit_no, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
    g AS (SELECT r, kind, unit_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM w WHERE len(w) > 1),
    s AS (SELECT r, kind, unit_no, k, license_id, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g, t WHERE len(g.grams) <= 500),
    f AS (SELECT * FROM s WHERE dice >= {threshold} QUALIFY row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, kind, unit_no) = 1),
    b AS (SELECT *, count(*) OVER (PARTITION BY r) AS n_found FROM f QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, k) = 1)
    SELECT doc_id, license_id, round(dice::DOUBLE, 6) AS dice, CASE kind WHEN 0 THEN 'text' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'line' END AS unit,
      unit_no, coalesce(n_found, 0) AS n_found FROM d LEFT JOIN b USING (r)"""
