"""License scans by canonical digest, by DataFrame functions only.

A text is normalised: lower case, curly quotes made straight, copyright lines removed, punctuation made space, equivalent
spellings made one, runs of space made one. The SHA-256 of the result is looked up among the digests of known texts by a
hash join; known texts go through the same columns. Units are whole documents, lines, and paragraphs: a known text of n
paragraphs stands in a document where n paragraphs in a row have the digests of its own, whatever is before and behind,
which an equality join on digests and a count by (row, known text, place) finds. Paragraphs end at lines without a letter or
digit, so that comment marks don't matter; those that normalise to nothing aren't counted.

Before that, texts without any of a few letter sequences go by unread. That is sound if the normalised form of each known
text holds one of them, which is looked up in the table itself; another table isn't filtered. None of the steps of
normalising joins letters, and the spellings that make one of the sequences are made of one.

Known texts of `MOST_LINES` lines at most together, as the given ones, are broadcast as digests; a larger table is joined like any
other. Documents are never grouped by licence, so it doesn't
matter how many hold the same one.

Nulls, ties, empties: a null or empty text, and any that normalises to nothing, matches nothing. Rows that share a doc_id
share their notices and texts, but paragraphs of two rows make no text together. Equal lines count each. An empty table gives
an empty table. Columns beyond id and text aren't read, whatever their names.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, fixed values: regular expression over normalised text, replacement
SPELLINGS = (
    (r"\blicence", "license"),
    (r"\bsub license", "sublicense"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\bcopyright holders?\b", "copyright owner"),
    (r"\bcopyright owners\b", "copyright owner"),
    (r"\bwhilst\b", "while"),
    (r"\backnowledgement", "acknowledgment"),
    (r"\bfulfill\b", "fulfil"),
    (r"\borganisation", "organization"),
    (r"\brecognise", "recognize"),
    (r"\bhttps\b", "http"),
    (r"\bper cent\b", "percent"),
    (r"\bv ?([0-9])", "version $1"),
    (r"\bcreative commons attribution noncommercial\b", "cc by nc"),
    (r"\bgnu gpl\b", "gnu general public license"),
)
ANCHORS = ("licen", "permission", "cc", "creative", "redistribut", "gpl", "bsd")  # letters; a spelling above that makes one is made of one
MOST_LINES = 100_000  # of broadcast texts: a row of digest and id a line at most, 20 MB
PARAGRAPH_END = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
COPYRIGHT_LINE = r"^[ \t]*(?:copyright[ \t]+(?:\(c\)|©|by\b|[0-9])|\(c\)|©)[^\n]*"  # with ^ at each \n

# Known texts, fixed values: short notices and the texts of short licences
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
)
FULL_TEXTS = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    ),
)
# How notices begin, and what they call the licences
STARTS = tuple(
    f"{start} under" for start in ("Licensed", "Released", "Distributed", "Published", "Available", *(f"This {what} is {how}" for what in ("project", "work", "software", "code", "program", "library", "package", "file") for how in ("licensed", "released", "distributed", "available")))
)
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License', "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "zlib/libpng License", "zlib"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0", "BSL-1.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0", "Apache License v2.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License version 2.0", "GNU GPL 2.0", "GPLv2", "GPL-2.0", "GPL-2.0-only"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License version 3.0", "GNU GPL 3.0", "GPLv3", "GPL-3.0", "GPL-3.0-only"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}
FOLDER = Path(__file__).parent / "license_texts"  # whole texts, one file each, read on the driver


def anchored(body: str) -> bool:
    return any(a in body.lower() for a in ANCHORS)


def notices() -> list[tuple[str, str]]:
    """Sentences that name a licence, and SPDX lines; those without an anchor aren't known."""
    out = []
    for license_id, called in NAMES.items():
        rights = [f"{the}{name}" for name in called for the in ("", "the ", "the terms of the ")]
        out += [(license_id, f"{start} {right}.") for start in STARTS for right in rights]
        out += [(license_id, f"SPDX-License-Identifier: {x}") for x in (license_id, *(n for n in called if n.endswith("-only")))]
    out += [("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)")]
    return [x for x in out if anchored(x[1])]


def whole_texts() -> list[tuple[str, str]]:
    """Whole texts with and without their title, "All rights reserved", numbers of clauses and appendix."""
    files = {f: (FOLDER / f"{f}.txt").read_text(encoding="utf-8") for f in ("Apache-2.0", "BSD-3-Clause", "BSD-3-Clause-Regents", "BSL-1.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "Unlicense", "Zlib")}
    bodies = list(FULL_TEXTS)
    bodies += [("ISC", dict(FULL_TEXTS)["ISC"].replace("and/or", "and"))]
    for name in ("BSD-3-Clause", "BSD-3-Clause-Regents"):
        third = re.compile(r"\n3\. Neither.*?permission\.\n", re.S)
        bodies += [("BSD-3-Clause", files[name]), ("BSD-2-Clause", third.sub("\n", files[name]))]
    bodies += [("Zlib", files["Zlib"]), ("Unlicense", files["Unlicense"]), ("Unlicense", files["Unlicense"].partition("For more information")[0]), ("Unlicense", files["Unlicense"].replace("http://unlicense.org", "http://www.unlicense.org"))]
    bodies += [("BSL-1.0", files["BSL-1.0"].partition("2003")[2])]
    titles = {i: ["", *(f"{the}{n}" for n in called for the in ("", "The ") if n != i or i == "Unlicense")] for i, called in NAMES.items()}
    titles["MIT"].append("The MIT License (MIT)")
    titles["BSL-1.0"].append("Boost Software License - Version 1.0 - August 17th, 2003")
    out = []
    for license_id, body in bodies:
        for form in dict.fromkeys((body, re.sub(r"(?m)^\s*[0-9]\.\s+", "", body))):
            out += [(license_id, f"{title}\n\n{reserved}{form}") for title in titles[license_id] for reserved in ("", "All rights reserved.\n\n")]
    apache, end = files["Apache-2.0"], "END OF TERMS AND CONDITIONS"
    terms, _, appendix = apache.partition(end)
    header = appendix[appendix.index("Licensed under") :]
    out += [("Apache-2.0", x) for x in (apache, terms, terms + end, re.sub(r"Copyright \[yyyy\][^\n]*", "", apache), header)]
    out += [("Apache-2.0", x.partition("http://www.apache.org/licenses/")[2]) for x in (terms, terms + end)]
    for license_id, mark in (("GPL-2.0", "How to Apply These Terms"), ("GPL-3.0", "How to Apply These Terms"), ("MPL-2.0", "Exhibit A -")):
        text = files[license_id]
        before = text[: text.rindex(mark)]
        out += [(license_id, text), (license_id, before), (license_id, before.replace(end, ""))]
    source_form = dict((i, n) for i, n in NOTICES)["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at "
    out += [("MPL-2.0", f"{source_form}{url}") for url in ("http://mozilla.org/MPL/2.0/.", "http://www.mozilla.org/MPL/2.0/.")]
    return list(dict.fromkeys(out))


KNOWN = tuple(dict.fromkeys((*NOTICES, *notices(), *whole_texts())))


def canonical(text: Column) -> Column:
    """The normalised form of a text column."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), "“”‘’", "\"\"''")
    out = F.regexp_replace(out, "(?md)" + COPYRIGHT_LINE, "")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the normalised form, null if nothing is left."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def registry(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """(digest, license_id) of the known texts; of texts with equal digests the smallest id."""
    rows = spark.createDataFrame(list(known), "license_id string, known_text string")
    return rows.select(digest(F.col("known_text")).alias("digest"), "license_id").where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def paragraphs(text: Column) -> Column:
    """The normalised forms of a text's paragraphs, without those that are empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), canonical), lambda x: x != "")


def sequences(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> DataFrame:
    """(digest, license_id, known, place, n): the paragraphs of each known text, in order."""
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(known)], "known int, license_id string, known_text string")
    rows = rows.select("known", "license_id", paragraphs(F.col("known_text")).alias("forms"))
    rows = rows.select("known", "license_id", F.size("forms").alias("n"), F.posexplode("forms").alias("place", "form"))
    return rows.select(F.sha2("form", 256).alias("digest"), "license_id", "known", "place", "n")


def holds_anchor(text: Column) -> Column:
    low = F.lower(text)
    out = F.contains(low, F.lit(ANCHORS[0]))
    for anchor in ANCHORS[1:]:
        out = out | F.contains(low, F.lit(anchor))
    return out


def all_anchored(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> bool:
    """Whether the normalised form of each known text holds an anchor; forms that are empty match nothing anyway."""
    form = spark.createDataFrame(list(known), "license_id string, known_text string").select(canonical(F.col("known_text")).alias("form"))
    return form.where((F.col("form") != "") & ~holds_anchor(F.col("form"))).isEmpty()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """A row for each row of docs: doc_id, license_id (of the whole text, or null), notices (ids of its lines, sorted,
    joined by commas, empty if none), n_notices, how many lines match, and texts (ids of known texts among its paragraphs,
    likewise)."""
    spark = docs.sparkSession
    side = F.broadcast if sum(body.count("\n") + 1 for _, body in known) <= MOST_LINES else lambda df: df
    table = side(registry(spark, known))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    filtered = all_anchored(spark, known)
    possible = holds_anchor(F.col("text")) if filtered else F.lit(True)
    whole = texts.select("doc_id", F.when(possible, digest(F.col("text"))).alias("digest")).join(table, "digest", "left").select("doc_id", "license_id")
    lines = texts.where(possible).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = (lines.where(holds_anchor(F.col("line"))) if filtered else lines).select("doc_id", digest(F.col("line")).alias("digest"))
    found = lines.join(table, "digest").select("doc_id", F.col("license_id").alias("notice"), F.lit(None).cast("string").alias("in_text"))
    parts = texts.where(possible).select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(paragraphs(F.col("text"))).alias("at", "form"))
    parts = parts.select("doc_id", "row", "at", F.sha2("form", 256).alias("digest")).join(side(sequences(spark, known)), "digest")
    runs = parts.groupBy("doc_id", "row", "known", (F.col("at") - F.col("place")).alias("start"), "license_id", "n").agg(F.countDistinct("place").alias("own")).where("own = n")
    found = found.unionByName(runs.select("doc_id", F.lit(None).cast("string").alias("notice"), F.col("license_id").alias("in_text")).distinct())
    listed = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(to) for c, to in (("notice", "notices"), ("in_text", "texts"))]
    found = found.groupBy(F.col("doc_id").alias("found_id")).agg(*listed, F.count("notice").alias("n_notices"))
    out = whole.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return out.select("doc_id", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("texts", F.lit("")).alias("texts"))


def sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    """The scan of `documents` as DuckDB SQL."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def plain(x: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(translate(lower(coalesce({x}, '')), '“”‘’', '\"\"'''''), {quoted('(?m)' + COPYRIGHT_LINE)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
        return out

    def form(x: str) -> str:
        return f"sha256(nullif({plain(x)}, ''))"

    def split(x: str) -> str:
        return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), {quoted(PARAGRAPH_END)}), lambda p: {plain('p')}), lambda p: p <> '')"

    values = ", ".join(f"({n}, {quoted(i)}, {quoted(t)})" for n, (i, t) in enumerate(known))
    return f"""
with known(number, license_id, known_text) as (values {values}),
table_of as (select {form('known_text')} as digest, min(license_id) as license_id from known group by 1),
d as (select doc_id, text, row_number() over () as row_of from documents),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
found as (
  select doc_id, array_to_string(list_sort(list_distinct(list(license_id))), ',') as notices, count(*) as n_notices
  from (select doc_id, {form('line')} as digest from lines) join table_of using (digest) group by doc_id),
parts as (select doc_id, row_of, unnest(ps) as p, generate_subscripts(ps, 1) as at_ from (select doc_id, row_of, {split('text')} as ps from d)),
known_parts as (select number, license_id, len(ps) as n, unnest(ps) as p, generate_subscripts(ps, 1) as place from (select number, license_id, {split('known_text')} as ps from known)),
runs as (select doc_id, license_id from parts join known_parts using (p) group by doc_id, row_of, number, license_id, n, at_ - place having count(distinct place) = n),
inside as (select doc_id, array_to_string(list_sort(list_distinct(list(license_id))), ',') as texts from runs group by doc_id)
select d.doc_id, t.license_id, coalesce(f.notices, '') as notices, coalesce(f.n_notices, 0) as n_notices, coalesce(i.texts, '') as texts
from (select doc_id, {form('text')} as digest from documents) d
left join table_of t using (digest) left join found f on d.doc_id is not distinct from f.doc_id left join inside i on d.doc_id is not distinct from i.doc_id
"""
