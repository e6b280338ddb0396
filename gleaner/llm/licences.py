"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, equivalent spellings unified,
copyright lines dropped, every run of punctuation and blanks one space. The digest of
the canonical form is looked up among the digests of known licences, so a match is a
match of the entire text. Two kinds of entire texts are scanned: whole documents, and
the lines of a document (notices of one line).

Canonical forms are built line by line with column functions; lines meet the known
digests in a hash join (``KNOWN`` and ``whole_texts`` are a fixed list, broadcast), and
only matches are grouped by document.

Cases: null, empty and blank texts have an empty canonical form that matches nothing;
lines that are empty in canonical form are skipped; repeated rows are scanned alike;
equal known texts keep the smallest name; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import row_key, table

#: equivalent spellings, applied in this order to lower-cased text
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authorisation", "authorization"), ("authorised", "authorized"), ("recognised", "recognized"),
    ("favour", "favor"), ("honour", "honor"), ("programme", "program"), ("judgement", "judgment"), ("acknowledgement", "acknowledgment"),
    ("fulfil ", "fulfill "), ("merchantibility", "merchantability"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("https://", "http://"), ("&", " and "),
]
COPYRIGHT_LINE = r"^[^\p{L}\p{N}©(]*(copyright\s*(\(c\)|©|[0-9]{4}|by\s)|©|\(c\)\s*[0-9]{4}|all rights reserved)"
NOT_WORD = r"[^\p{L}\p{N}]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: (name, text): well-known texts and one-line notices
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_TAIL),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]

#: usual title lines of the short licences in ``KNOWN``
TITLES = {
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["0BSD", "Zero-Clause BSD", "BSD Zero Clause License", "Zero Clause BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": [
        "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License",
        "New BSD License", "Modified BSD License", "BSD License",
    ],
}
#: (name, file in ``licence_texts``, title lines that its text starts with)
STORED = [
    ("Apache-2.0", "Apache-2.0", 3), ("Artistic-1.0-Perl", "Artistic", 1), ("BSD-3-Clause", "BSD", 0), ("CC0-1.0", "CC0-1.0", 2),
    ("GFDL-1.2", "GFDL-1.2", 2), ("GFDL-1.3", "GFDL-1.3", 2), ("GPL-1.0", "GPL-1", 2), ("GPL-2.0", "GPL-2", 2), ("GPL-3.0", "GPL-3", 2),
    ("LGPL-2.0", "LGPL-2", 2), ("LGPL-2.1", "LGPL-2.1", 2), ("LGPL-3.0", "LGPL-3", 2), ("MPL-1.1", "MPL-1.1", 2), ("MPL-2.0", "MPL-2.0", 1),
]
#: what may follow the terms: how to apply them, and the exhibits of the MPL
_AFTER = r"(?m)^\s*(END OF TERMS AND CONDITIONS|APPENDIX: How to|Appendix: How to|ADDENDUM: How to|How to Apply These Terms|Exhibit A -|EXHIBIT A -|The End\s*$)"


def whole_texts() -> list[tuple[str, str]]:
    """(name, text) of whole licences, with and without title lines and what follows the terms."""
    out = [(n, f"{title}\n{t}") for n, t in KNOWN if "\n" in t for title in TITLES.get(n, [])]
    for name, file, titles in STORED:
        text = pkgutil.get_data(__package__, f"licence_texts/{file}.txt").decode("utf-8").strip()
        ends = [len(text)]
        for m in re.finditer(_AFTER, text):
            ends += [m.start()] + [m.end(1)] * m[1].lower().startswith(("end of", "the end"))
        lines = [i for i, x in enumerate(text.split("\n")) if x.strip()]
        for end in sorted(set(ends)):
            part = text[:end]
            own = "\n".join(part.split("\n")[lines[titles]:])
            heads = {"", "\n".join(part.split("\n")[: lines[titles]]), *TITLES.get(name, [])}
            out += [(name, f"{head}\n{own}") for head in sorted(heads)]
    return out


def canonical_lines(text: Column) -> Column:
    """array<string>: the canonical form of each line, without empty and copyright lines."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for a, b in SPELLINGS:
        low = F.replace(low, F.lit(a), F.lit(b))
    lines = F.filter(F.split(low, "\n"), lambda x: ~F.rlike(x, F.lit(COPYRIGHT_LINE)))
    words = F.transform(lines, lambda x: F.btrim(F.regexp_replace(x, NOT_WORD, " ")))
    return F.filter(words, lambda x: x != "")


def digest_of(lines: Column) -> Column:
    """The digest of canonical lines read as one text; null for an empty one."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of the known texts: by default ``KNOWN`` and ``whole_texts``."""
    rows = spark.createDataFrame(KNOWN + whole_texts() if known is None else known, "licence string, text string")
    return rows.select("licence", digest_of(canonical_lines(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, licence (of the whole text), n_lines, n_notices, notices (names, joined by ``,``).

    n_lines counts canonical lines. The canonical form is written once per row into
    the digest and the lines; only (row, line digest) leaves the row.
    """
    rows = docs.select(row_key().alias("_row"), "doc_id", canonical_lines(F.col("text")).alias("lines"))
    whole = rows.select("_row", "doc_id", digest_of(F.col("lines")).alias("digest"), F.size("lines").cast("long").alias("n_lines"), F.col("lines"))
    lines = rows.select("_row", F.explode("lines").alias("line")).select("_row", F.sha2("line", 256).alias("digest"))
    listed = F.broadcast(known)  # a fixed list
    notices = lines.join(listed, "digest").groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_notices"), F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices")
    )
    out = whole.drop("lines").join(listed, "digest", "left").join(notices.withColumnRenamed("_row", "_hit"), F.col("_row") == F.col("_hit"), "left")
    return out.select("doc_id", "digest", "licence", "n_lines", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "notices")


def q_licences(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"), known_digests(spark))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = "lower(coalesce(text, ''))"
    for a, b in SPELLINGS:
        low = f"replace({low}, {quote(a)}, {quote(b)})"
    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in KNOWN)
    lines = (
        f"list_filter(list_transform(list_filter(string_split({low}, chr(10)), lambda x: NOT regexp_matches(x, {quote(COPYRIGHT_LINE)})), "
        f"lambda x: trim(regexp_replace(x, {quote(NOT_WORD)}, ' ', 'g'))), lambda x: x <> '')"
    )
    whole = "CASE WHEN len(ls) > 0 THEN sha256(array_to_string(ls, ' ')) END"
    return f"""
WITH known AS (
  SELECT digest, min(name) AS licence FROM (
    SELECT name, {whole} AS digest FROM (SELECT name, {lines} AS ls FROM (VALUES {values}) v(name, text))
  ) GROUP BY digest
),
docs AS (SELECT doc_id, {lines} AS ls FROM documents),
notices AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(licence))), ',') AS names
  FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM docs) JOIN known USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, d.digest, k.licence, d.n_lines, coalesce(n.n, 0) AS n_notices, n.names AS notices
FROM (SELECT doc_id, {whole} AS digest, len(ls) AS n_lines FROM docs) d
LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)
"""


SQL = _sql()
