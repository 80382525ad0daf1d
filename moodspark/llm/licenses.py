"""Licence scan: canonical digests of whole texts and of lines, joined to those of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.llm.common import UPPER, lower_az, small_enough, stage, table

# Public licence texts and usual one-line notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED'
    " TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"
    " THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
    " DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
    " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
    " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
    " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
    " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
    " to permit persons to whom the Software is furnished to do so"
)
KNOWN = [
    (
        "MIT",
        f"MIT License\nCopyright (c) year holder\n{_GRANT}, subject to the following conditions:\nThe above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        + _WARRANTY,
    ),
    ("MIT-0", f"MIT No Attribution\nCopyright year holder\n{_GRANT}.\n{_WARRANTY}"),
    (
        "ISC",
        "ISC License\nCopyright (c) year holder\nPermission to use, copy, modify, and/or distribute this software for any"
        " purpose with or without fee is hereby granted, provided that the above copyright notice and this permission"
        f" notice appear in all copies.\n{_ISC_WARRANTY}",
    ),
    (
        "0BSD",
        "BSD Zero Clause License\nCopyright (c) year holder\nPermission to use, copy, modify, and/or distribute this"
        f" software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
_BSD = (
    "Copyright (c) year holder\nRedistribution and use in source and binary forms, with or without modification, are"
    " permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above"
    " copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must"
    " reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE"
    " USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole texts besides those of KNOWN; the long ones are files named after their licence.
WHOLE = [
    *((name, title + _BSD + names + _BSD_WARRANTY)
      for name, head, names in (("BSD-2-Clause", "BSD 2-Clause License\n", ""), ("BSD-3-Clause", "BSD 3-Clause License\n", _BSD_NAMES))
      for title in ("", head)),
    *((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
]
# Spellings that are one word to a licence.
SPELLINGS = [
    ("licen[cs](e|es|ed|ing|or|ee)", r"licens\1"),
    ("sub licens(e|es|ed|ing)", r"sublicens\1"),
    ("non (infringement|commercial)", r"non\1"),
    ("copyright owners?", "copyright holders"),
    ("copyright holder", "copyright holders"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
]
COPYRIGHT_LINE = r"(?i)(^|\n)[ \t]*(?:copyright|\(c\)|©)[^\n]*"
# The same, but not a line of prose that goes on with "copyright notice" and the like.
_PROSE = (
    r"(?![ \t]*(?:[,.;]|\n|$)|[ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|and|or|interests?|statements?"
    r"|treaty|treaties|rights?|protections?|permissions?|is|are|in|on|of|to|the|disclaimers?)\b)"
)
_OWNER_LINE = rf"(?i)(^|\n)[ \t]*(?:copyright{_PROSE}|\(c\)|©)[^\n]*"
SEPARATORS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Words of the text in lower case (A-Z), single spaces between them, spellings made one;
    without lines that name an owner after a copyright mark."""
    words = F.regexp_replace(lower_az(F.regexp_replace(text, _OWNER_LINE, "$1")), SEPARATORS, " ")
    words = F.concat(F.lit(" "), F.btrim(words), F.lit(" "))
    for one, other in SPELLINGS:
        words = F.regexp_replace(words, f" {one} ", " " + other.replace("\\", "$") + " ")
    return F.btrim(words)


def _digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def known_licenses(spark: SparkSession, known: list[tuple[str, str]] = [*KNOWN, *WHOLE]) -> DataFrame:
    """license, digest; licences whose texts are the same keep the first name."""
    rows = spark.createDataFrame(known, "license string, text string")
    return rows.groupBy(_digest(F.col("text")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, license, n_notices, notices of every row of docs.

    license is the known licence whose canonical digest the whole text has, n_notices counts the
    lines that have one, and notices names their distinct licences in order, comma-joined, empty
    without any.  Case, punctuation, white space, copyright lines and equivalent spellings make no
    difference.

    Digests are computed where the text is read; only digests and ids move.  A line that very many
    documents hold meets one row of known licences, which is broadcast if a count shows that it is
    small.  Null and empty texts, and texts of copyright lines only, match nothing.  A row without
    doc_id has no licence.  Repeated rows of one doc_id share what all of them have.  Extra columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    empty = F.md5(F.lit("").cast("binary"))
    known = small_enough(stage(known.where(F.col("digest") != empty), "licences"))
    some = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    whole = some.select("doc_id", F.lit(True).alias("whole"), _digest(F.col("text")).alias("digest")).distinct()
    lines = some.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select(
        "doc_id", F.lit(False).alias("whole"), _digest(F.col("line")).alias("digest")
    )
    found = whole.join(known, "digest").unionByName(lines.join(known, "digest"))
    found = found.groupBy("doc_id", "license", "whole").agg(F.count("*").alias("n"))
    found = found.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.sum(F.when(~F.col("whole"), F.col("n"))).alias("n_notices"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("notices"),
    )
    return docs.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id",
        "license",
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark))


def _sql_canonical(text: str) -> str:
    words = f"regexp_replace({text}, '{COPYRIGHT_LINE}', '\\1', 'g')"
    words = f"translate({words}, '{UPPER}', '{UPPER.lower()}')"
    words = f"concat(' ', trim(regexp_replace({words}, '{SEPARATORS}', ' ', 'g'), ' '), ' ')"
    for one, other in SPELLINGS:
        words = f"regexp_replace({words}, ' {one} ', ' {other} ', 'g')"
    return f"md5(trim({words}, ' '))"


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (
  SELECT {_sql_canonical("text")} AS digest, min(license) AS license
  FROM (VALUES {rows}) v(license, text) GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL
), whole AS (
  SELECT d.doc_id, min(k.license) AS license FROM documents d
  JOIN known k ON {_sql_canonical("d.text")} = k.digest WHERE k.digest <> md5('') GROUP BY d.doc_id
), notices AS (
  SELECT l.doc_id, count(*) AS n, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS names
  FROM lines l JOIN known k ON {_sql_canonical("l.line")} = k.digest WHERE k.digest <> md5('') GROUP BY l.doc_id
)
SELECT d.doc_id, w.license, coalesce(n.n, 0) AS n_notices, coalesce(n.names, '') AS notices
FROM documents d LEFT JOIN whole w USING (doc_id) LEFT JOIN notices n USING (doc_id)
"""


OP10_SQL = _sql()
