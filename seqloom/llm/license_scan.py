"""License scans by canonical digests.

Method: a text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings are levelled), the
form is hashed, and the hash is joined with the digests of known licence texts. Entire texts are matched, and, by the same
lookup, each entire line, which finds one-line notices inside longer documents. There is no search for parts of a text.

Everything runs in Spark's own expressions, in one scan: each line is brought to its form once, the text's form is made of its
lines' forms, and the digests of both go through one hash join. The known digests of this module are a constant (a fixed number
of rows), so their broadcast has a proven bound; a larger table of the caller's is joined as Spark sees fit. What is shuffled,
to bring a row's digests together again, is a row of digests for each document, and never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known licence texts and notices, and spellings that count as equal.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    ),
]
#: The first two paragraphs of the Unlicense, which are not the licence.
_CUT = [n for n in NOTICES if n[0] == "Unlicense"]
_BODY = {i: t for i, t in NOTICES if "\n" in t and i != "Unlicense"}
_UNLICENSE = (
    _CUT[0][1]
    + """

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
)
_REFER = "\n\nFor more information, please refer to "
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole licence texts, and the titles that may stand before each.
TEXTS = [
    ("MIT", _BODY["MIT"], ["MIT License", "The MIT License", "The MIT License (MIT)"]),
    ("ISC", _BODY["ISC"], ["ISC License", "The ISC License"]),
    ("Unlicense", _UNLICENSE, ["The Unlicense"]),
    ("Unlicense", _UNLICENSE + _REFER + "<https://unlicense.org>", ["The Unlicense"]),
    ("Unlicense", _UNLICENSE + _REFER + "<https://unlicense.org/>", ["The Unlicense"]),
    ("Unlicense", _UNLICENSE + _REFER + "<http://unlicense.org/>", ["The Unlicense"]),
    ("BSD-2-Clause", _BSD_2 + _BSD_END, ["BSD 2-Clause License"]),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END, ["BSD 3-Clause License"]),
]
#: Digests of the canonical forms of longer texts: the file as published, and without what follows its terms.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("GPL-2.0", "8126cac356e98c9f273e2d821c0d2f3969c7add1c0b09b73679f90fa7414205c"),
    ("GPL-2.0", "a07b31e413f005893efb82b73c1664077ccbad48a65bc01513dcfdc8af30d965"),
    ("GPL-2.0", "6682f0d9a5f2b5772c3fa93592f1011da82ec1b9dc4babcf73f7959ac7614e5b"),
    ("GPL-3.0", "969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.1", "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
    ("CC0-1.0", "e259b3e0bf831ddcd5351d255b832a3eccf42a266790e35dd570e35b737e30f2"),
]
#: Equivalent words, and equivalent phrases of the canonical form.
WORDS = {
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "sublicence": "sublicense",
    "organisation": "organization",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "acknowledgement": "acknowledgment",
    "judgement": "judgment",
    "noncommercial": "nc",
    "v": "version",
}
PHRASES = {"copyright owner": "copyright holder", "non infringement": "noninfringement"}
#: A line that says no more than whose copyright it is, or that all rights are reserved.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(copyright |\(c\)|©)[^\n]*[0-9]{4}[^\n]*$|^[ \t#*/;-]*all rights reserved\.?[ \t]*$"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without the end of a line.
NOT_WORD_IN_LINE = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: The known digests of a caller's table that may be broadcast.
BROADCAST_ROWS = 100_000


def line_forms(text: Column) -> Column:
    """The form of each line that has letters or digits, before equivalent phrases are levelled: lower case, no copyright lines,
    one space for each run of other than letters and digits, one spelling for equivalent words. Null has no lines."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "), NOT_WORD_IN_LINE, " "), "\n")
    same = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])

    def form(line: Column) -> Column:
        framed = F.concat(F.lit(" "), line, F.lit(" "))
        some = F.lit(False)
        for word in WORDS:  # most lines have none of these words, and are not taken apart
            some = some | framed.contains(f" {word} ")
        mapped = F.array_join(F.transform(F.split(F.trim(line), " "), lambda w: F.coalesce(same[w], w)), " ")
        return F.when(some, mapped).otherwise(F.trim(line))

    return F.filter(F.transform(lines, form), lambda x: x != "")


def level_phrases(form: Column) -> Column:
    """One spelling for equivalent phrases."""
    for old, new in PHRASES.items():
        form = F.when(form.contains(old), F.regexp_replace(form, f"(^| ){old}( |$)", f"$1{new}$2")).otherwise(form)
    return form


def canonical(text: Column) -> Column:
    """The canonical form of a text, made of its lines' forms. Null stays null; a text without letters and digits has the empty
    form."""
    return level_phrases(F.array_join(line_forms(text), " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form (lowercase hex)."""
    return F.sha2(canonical(text), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the known notices, and of whole texts with and without their titles."""
    return [n for n in NOTICES if n not in _CUT] + [(i, t) for i, body, titles in TEXTS for t in (body, *(f"{x}\n\n{body}" for x in titles))]


def known_digests(spark: SparkSession, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_digest, license_id) of the known texts, one row for each digest (the first id by name where two are equal)."""
    ready = spark.createDataFrame(DIGESTS if notices is None else [], "license_id string, license_digest string")
    rows = spark.createDataFrame(known_texts() if notices is None else notices, "license_id string, known_text string").select("license_id", digest(F.col("known_text")).alias("license_digest"))
    return rows.unionByName(ready).groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Look entire texts, and entire lines, up among known licences.

    Returns one row for each row of `docs` (repeated rows stay repeated): the id, `license_digest` of the whole text,
    `license_id` (null: not a known licence), `n_license_lines`, how many lines are entirely a known notice, and
    `line_licenses`, their distinct ids sorted and joined by commas (empty for none). Ids may be null or repeated; nothing is
    joined on them. A null text has a null digest, no licence and no lines; an empty text has the digest of the empty form, and
    no licence. A text of any length is one form and one digest, and a row for each
    of its lines inside the scan. An empty table gives an empty table. Other columns of `docs` are ignored, whatever their names.

    `known` (license_digest, license_id) may have any size; of rows that share a digest the first id by name counts, and rows
    with a null are left out. It is broadcast only up to BROADCAST_ROWS rows. The default is a constant.
    """
    few = known is None or known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    known = known_digests(docs.sparkSession) if known is None else known.dropna().groupBy("license_digest").agg(F.min("license_id").alias("license_id"))
    table = known.select(F.col("license_digest").alias("_d"), F.col("license_id").alias("_l"))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), line_forms(F.col(f"`{text_col}`").cast("string")).alias("_lines"))
    kinds = lambda whole, form: F.struct(F.lit(whole).alias("whole"), F.sha2(level_phrases(form), 256).alias("digest"))
    every = F.concat(F.array(kinds(True, F.array_join("_lines", " "))), F.coalesce(F.transform("_lines", lambda x: kinds(False, x)), F.array().cast("array<struct<whole:boolean,digest:string>>")))
    each = rows.select("_id", "_row", F.explode(every).alias("_x")).select("_id", "_row", "_x.*")
    found = each.join(F.broadcast(table) if few else table, F.col("digest") == F.col("_d"), "left").where(F.col("whole") | F.col("_l").isNotNull())
    line = F.when(~F.col("whole"), F.col("_l"))
    whole = lambda c: F.max(F.when(F.col("whole"), F.col(c)))
    out = found.groupBy("_row", "_id").agg(whole("digest").alias("_digest"), whole("_l").alias("_whole"), F.count(line).alias("_n"), F.collect_set(line).alias("_ids"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_digest").alias("license_digest"),
        F.col("_whole").alias("license_id"),
        F.col("_n").alias("n_license_lines"),
        F.array_join(F.array_sort("_ids"), ",").alias("line_licenses"),
    )


def _sql_canonical(x: str) -> str:
    spaced = f"trim(regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', ' ', 'g'), '{NOT_WORD}', ' ', 'g'))"
    words = ", ".join(f"'{k}': '{v}'" for k, v in WORDS.items())
    out = f"array_to_string(list_transform(string_split({spaced}, ' '), lambda w: coalesce(map {{{words}}}[w], w)), ' ')"
    for old, new in PHRASES.items():
        out = f"regexp_replace({out}, '(^| ){old}( |$)', '\\1{new}\\2', 'g')"
    return out


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known_texts())
    ready = ", ".join(f"('{d}', '{i}')" for i, d in DIGESTS)
    return f"""
        WITH known AS (
            SELECT d, min(i) AS l
            FROM (SELECT sha256({_sql_canonical("t")}) AS d, i FROM (VALUES {values}) AS k(i, t) UNION ALL FROM (VALUES {ready}) AS r(d, i))
            GROUP BY 1),
        line AS (
            SELECT doc_id, sha256({_sql_canonical("x")}) AS d
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> ''),
        found AS (
            SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(l))), ',') AS ids
            FROM line JOIN known USING (d) GROUP BY doc_id)
        SELECT a.doc_id, sha256({_sql_canonical("text")}) AS license_digest, k.l AS license_id,
               coalesce(f.n, 0) AS n_license_lines, coalesce(f.ids, '') AS line_licenses
        FROM documents a LEFT JOIN known k ON k.d = sha256({_sql_canonical("text")}) LEFT JOIN found f ON f.doc_id = a.doc_id
    """


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences among the whole texts, and the lines, of all documents."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": _sql()}
