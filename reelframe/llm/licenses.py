"""Licence scans by canonical digest: native DataFrame operations only.

A text is brought to a canonical form (lower case, no copyright lines, no punctuation,
one spelling for equivalent words, single spaces) and its SHA-256 is joined to the digests
of known licence texts. The whole text is looked up, and so is each line, which finds
licence notices inside other documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and notices, as their canonical form needs them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN = [
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
#: Spellings that licence matching takes as equal, after lower-casing and as whole words.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
]

COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The largest catalogue that is sent to all tasks; a larger one is joined by shuffled hash.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), PUNCTUATION, " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and digest of each known text; of texts with one canonical form, the first name in order stays."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license_id string, text string")
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per document: text_sha256 (of the canonical form), license_id, notices, n_notices.

    license_id names the licence that the whole text is, else null; notices lists, sorted and
    comma-joined, those that single lines are; n_notices counts such lines. Null and empty
    texts match nothing; a text of several lines that is a licence has its own digest beside
    those of its lines; rows with the same doc_id are looked up each on their own; other columns
    are ignored; an empty table gives an empty one.
    """
    known = catalogue(docs.sparkSession) if known is None else known
    # A count that stops just past the limit decides whether the catalogue may be sent around.
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sent = F.broadcast(known) if small else known.hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.withColumn("text_sha256", F.sha2(canonical(F.col("text")), 256)).join(sent.withColumnsRenamed({"digest": "text_sha256"}), "text_sha256", "left")
    lines = rows.select("doc_id", F.sha2("text", 256).alias("row"), F.explode(F.split("text", "\n")).alias("line"))
    found = lines.where(F.trim("line") != "").withColumn("digest", F.sha2(canonical(F.col("line")), 256)).join(sent, "digest")
    # Copies of one row share doc_id and text, so their counts are one copy's times the copies.
    per_row = found.groupBy("doc_id", "row").agg(F.concat_ws(",", F.array_sort(F.collect_set("license_id"))).alias("notices"), F.count("*").alias("lines"))
    copies = whole.select("doc_id", "text_sha256", "license_id", F.sha2("text", 256).alias("row"))
    counted = copies.groupBy("doc_id", "row", "text_sha256", "license_id").agg(F.count("*").alias("copies"))
    joined = counted.join(per_row.withColumnsRenamed({"doc_id": "d", "row": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    out = joined.select("doc_id", "text_sha256", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce((F.col("lines") / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias("n_notices"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def _sql_canonical(text: str) -> str:
    out = f"' ' || trim(regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g'), '{PUNCTUATION}', ' ', 'g')) || ' '"
    for a, b in EQUIVALENT:
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


def oracle_sql() -> str:
    def text(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    values = ", ".join(f"({text(i)}, {text(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(i) AS license_id FROM (VALUES {values}) AS k(i, t) GROUP BY 1),
rows AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
lines AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM rows),
found AS (SELECT l.row, k.license_id FROM (SELECT row, sha256({_sql_canonical("line")}) AS digest FROM lines WHERE trim(line) <> '') l JOIN known k USING (digest)),
notices AS (SELECT row, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices FROM found GROUP BY row)
SELECT r.doc_id, sha256({_sql_canonical("r.text")}) AS text_sha256, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM rows r LEFT JOIN known k ON k.digest = sha256({_sql_canonical("r.text")}) LEFT JOIN notices n ON n.row = r.row"""
