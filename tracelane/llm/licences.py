"""Operator 5: licence scan by canonical digests.

A text's canonical form: lower case, one spelling of words that are written in several ways, no copyright lines,
no punctuation, single spaces. The SHA-256 of the form is hash-joined to the digests of known licence texts
and notices, those in ``KNOWN`` and the full texts in the folder ``known``. Texts compared: the whole document, its
blocks between lines without letters or digits, runs of adjacent blocks, and its lines; each entirely, never in part.
Runs are looked for where a known text's first letters start a block, and have the known text's length.

Defined cases: a null or empty text has no licence; a unit whose form is empty matches nothing; repeated rows
get a row each (the join key is the id and a hash of the text); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.llm.common import let, table

# Public licence texts and notices, by SPDX id.
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
    "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
    "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License " + _MIT_BODY),
    ("MIT", "The MIT License (MIT) " + _MIT_BODY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-2-Clause", f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_END}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_END}"),
]
#: Letters of a canonical form that a run of blocks must begin with.
HEAD = 16
#: (old, new) on lower-cased text: spellings that mean the same. Without spaces, so that line breaks make no difference.
SPELLINGS = (
    ("licence", "license"),
    ("sub-licens", "sublicens"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("organisation", "organization"),
    ("owner", "holder"),
    ("&", " and "),
    ("https://", "http://"),
    ("2.0", "2"),
)
#: A line that states a copyright: the word or sign, then a sign, year or blank for one (and a blank for the name, which a
#: line break may cut); or the reservation by itself.
COPYRIGHT_LINE = (
    r"(^|\n)[^\n0-9a-z]*((copyright|\(c\)|©)[ ,:]*[\[<{](year|yyyy|date)[\]>}]\s*[\[<{][^\]>}]*[\]>}][^\n]*|(copyright|\(c\)|©)[ ,:]*(\(c\)|©|copyright)?[ ,:]*((\(c\)|©)|[\[<{(]?(19|20)[0-9][0-9]|[\[<{(](year|yyyy|date)|[\[<{](name|copyright|owner|holder))"
    r"[^\n]*|(copyright|\(c\)|©)[ ,:]+(\(c\)|©)[^\n]*|all rights reserved[^\n0-9a-z]*($|\n))"
)


def _lines(text: Column) -> Column:
    """The lines of a text in canonical form, empty ones included: one pass over the text serves all its units."""
    low = F.lower(text)
    # The sign before a line keeps an emptied line from joining its neighbours.
    low = F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(low, COPYRIGHT_LINE, "\n")).otherwise(low)
    for old, new in SPELLINGS:
        low = F.replace(low, F.lit(old), F.lit(new))
    return F.transform(F.split(F.regexp_replace(low, r"[^0-9a-zà-ÿ\n]+", " "), "\n"), lambda x: F.trim(x))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def canonical(text: Column) -> Column:
    return let(_lines(text), _whole)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in ``known``; a text with an appendix counts without it too."""
    out = []
    for file in sorted(resources.files("tracelane.llm").joinpath("known").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        out.append((name, text))
        head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
        if end:
            out += [(name, head), (name, head + end)]
    return out


def known_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, digest, head, size), from texts in the same canonical form."""
    rows = spark.createDataFrame(known or [*KNOWN, *full_texts()], "licence string, text string").select("licence", canonical(F.col("text")).alias("form"))
    return rows.select("licence", F.sha2("form", 256).alias("digest"), F.substring("form", 1, HEAD).alias("head"), F.length("form").alias("size")).distinct()


def _runs(blocks: Column, sizes: dict[str, list[int]]) -> Column:
    """The runs of adjacent blocks that begin like a known text and are as long."""
    none = F.array().cast("array<string>")

    def found(marked: Column) -> Column:  # blocks with a line end between them
        def of(head: str, size: int) -> Column:
            pattern = rf"(?s)(?<![^\n])(?=({head.replace(' ', '[ \n]')}.{{{max(size - len(head), 0)}}})(?:\n|\z))"
            return F.transform(F.regexp_extract_all(marked, F.lit(pattern), F.lit(1)), lambda u: F.replace(u, F.lit("\n"), F.lit(" ")))

        def tried(plain: Column) -> Column:
            parts = [F.when(plain.contains(head), F.concat(*[of(head, n) for n in ns])).otherwise(none) for head, ns in sizes.items()]
            return F.when(reduce(or_, [plain.contains(head) for head in sizes]), F.concat(*parts)).otherwise(none)

        return let(F.replace(marked, F.lit("\n"), F.lit(" ")), tried)

    return let(F.array_join(F.filter(blocks, lambda b: b != ""), "\n"), found) if sizes else none


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the licences found (sorted, comma-joined), how many units held one, and whether the whole text is one."""
    body = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    blocks = lambda x: F.transform(F.split(F.array_join(x, "\n"), "\n\n+"), lambda b: F.trim(F.replace(b, F.lit("\n"), F.lit(" "))))
    sizes: dict[str, list[int]] = {}
    for r in known.where("size > 0").select("head", "size").distinct().orderBy("head", "size").collect():  # a few short rows
        sizes.setdefault(r["head"], []).append(r["size"])
    lengths = sorted({n for ns in sizes.values() for n in ns})
    units = let(_lines(F.col("t")), lambda x: let(blocks(x), lambda b: F.concat(F.array(_whole(x)), b, x, _runs(b, sizes))))
    # Only a unit as long as a known text can be one.
    spread = body.select("id", "h", F.posexplode(units).alias("at", "unit")).where(F.length("unit").isin(lengths))
    named = spread.select("id", "h", (F.col("at") == 0).alias("whole"), F.sha2("unit", 256).alias("digest"))
    found = named.join(known.select("licence", "digest"), "digest").groupBy("id", "h").agg(F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"), F.max("whole").alias("is_licence"))
    both = body.select("id", "h").join(found.select(F.col("id").alias("i"), F.col("h").alias("k"), "licences", "is_licence"), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("k")), "left")
    return both.select(F.col("id").alias(id_col), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("is_licence", F.lit(False)).alias("is_licence"))


def op5_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_table(spark))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    low = f"regexp_replace(lower({column}), {_quoted(COPYRIGHT_LINE)}, chr(10), 'g')"
    for old, new in SPELLINGS:
        low = f"replace({low}, {_quoted(old)}, {_quoted(new)})"
    return f"list_transform(string_split(regexp_replace({low}, '[^0-9a-zà-ÿ\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x))"


_SQL_WHOLE = "array_to_string(list_filter(l, lambda x: x <> ''), ' ')"
ORACLE = f"""
WITH known AS (SELECT DISTINCT licence, sha256({_SQL_WHOLE}) AS digest
               FROM (SELECT licence, {_sql_lines('text')} AS l FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) AS v(licence, text)) AS k),
body AS (SELECT doc_id, {_sql_lines("coalesce(text, '')")} AS l FROM documents),
units AS (SELECT doc_id, true AS whole, {_SQL_WHOLE} AS unit FROM body
          UNION ALL SELECT doc_id, false, unnest(list_transform(regexp_split_to_array(array_to_string(l, chr(10)), '\\n\\n+'), lambda b: trim(replace(b, chr(10), ' ')))) FROM body
          UNION ALL SELECT doc_id, false, unnest(l) FROM body),
found AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, bool_or(whole) AS is_licence
          FROM units JOIN known ON sha256(unit) = digest WHERE unit <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(is_licence, false) AS is_licence FROM body LEFT JOIN found USING (doc_id)
"""

REGISTERED = {"op5_licence_digests": (op5_licence_digests, ORACLE)}
