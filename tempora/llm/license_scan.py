"""License scans: digests of canonical texts, hash-joined to the digests of known licences.

Two texts of one licence differ in case, punctuation, line breaks, copyright lines and spelling.
``canonical_lines`` takes those differences out; the SHA-256 of what is left is looked up among the
digests of known texts.  Units looked up are every entire document and every entire line of it (a
notice such as "Released under the MIT License." is a line of its own).

The known texts are a table; nothing is broadcast by hand, so Spark joins a small table by
broadcast and a large one by shuffle.  Only units as long as some known text are hashed.  One scan of the documents, no
shuffle of their texts.

Defined results: one row per hit, in no order: null, empty and punctuation-only texts have no hit;
repeated rows give repeated hits; a unit that equals several known licences gives one row for each;
known rows with null columns take no part; other columns of the input are ignored; an empty table
gives an empty result.  Lines are counted from 0 among those that are not blank once canonical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that count as equal.
SPELLINGS = [
    ("licence", "license"), ("sublicense", "sub license"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("noncommercial", "non commercial"), ("organisation", "organization"), ("organise", "organize"), ("percent", "per cent"), ("practise", "practice"), ("programme", "program"),
    ("recognise", "recognize"), ("redistributable", "re distributable"), ("utilisation", "utilization"), ("wilful", "willful"), ("whilst", "while"), ("https", "http"),
]

# Public licence texts and notices.
_MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
KNOWN = [
    ("MIT", _MIT),
    ("MIT", _MIT.split("\n\n", 1)[1]),
    ("ISC", _ISC),
    ("ISC", _ISC.split("\n\n", 1)[1]),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_START + _BSD_END),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_START + _BSD_THIRD + _BSD_END),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]

# Digests and lengths of the canonical forms (``known_digests``) of more public licences' whole texts, as their publishers give them;
# that of BSD-3-Clause is the text of the Regents of the University of California.
DIGESTS = [
    ("Apache-2.0", "f813bb2c8a0df8ee210168b6f69c7fc497924d1568a30ac17bec919112bd1d53", 9923),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "71c532bbed0a27a310a347e640090ae15d10b12867dbb01eabbb4a0c3a81e3bf", 19582),
    ("GFDL-1.3", "fec9cc5e5c1e9857dbb9bbf6f5507fab30f7b21ed301a6d1b150b2790a06992b", 22017),
    ("GPL-1.0", "a8fff404cd2e16b4410d4b541b4b81de8897d4680a0bf9d8fd49845d901c5ae3", 11766),
    ("GPL-2.0", "ba85b45f95a74795e68bc4e004ec7cf4bf64ce8b447ede551bbe4eb7a9b53a7c", 17118),
    ("GPL-3.0", "f12d187744fb4cd1d2a0eedaf8399aef21ee6a6d43d1554753a29ab928bd47ae", 33406),
    ("LGPL-2.0", "a8198070973030abc02b2ee6cc7ae0576aa62f61abe3291d932d20ad02eafae4", 24130),
    ("LGPL-2.1", "46d2725e225a88f2a72cbd615d17658ae817fbee8bdbc26a67c2afd780518db4", 25217),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "e89167a01f755ab1d3defe557d60489b0399b5e1e64cf4811304da092927995b", 22451),
    ("MPL-2.0", "0c0e48da106b389986ac108e2ee0ad1c64670b63f2fbe0703edcbaedb049daa8", 14343),
]

COPYRIGHT = r"(?m)^[^a-z\n]*(?:copyright[ \t]+(?:\(c\)|©|[0-9]{4}|<year>)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The lines of a text without case, punctuation, copyright lines and variant spellings; blank lines go."""
    text = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\n]+", " ")
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.filter(F.transform(F.split(text, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, text) to (license_id, digest, size): the digest and the length of the canonical text."""
    lines = known.dropna(subset=["license_id", "text"]).select("license_id", canonical_lines(F.col("text")).alias("lines"))
    text = F.array_join("lines", " ")
    return lines.where(F.size("lines") > 0).select("license_id", F.sha2(text, 256).alias("digest"), F.length(text).alias("size")).distinct()


def builtin_licenses(spark: SparkSession) -> DataFrame:
    quoted = ", ".join(f"('{i}', '{t}')" for i, t in ((i, t.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")) for i, t in KNOWN))
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(license_id, text)")


def builtin_digests(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{i}', '{d}', {n})" for i, d, n in DIGESTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(license_id, digest, size)")


def scan_licenses(docs: DataFrame, known: DataFrame, digests: DataFrame | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits (id, scope, line_no, license_id, digest); scope is ``text`` (line_no -1) or ``line``.

    ``digests`` (license_id, digest, size) are those of more known texts.
    """
    known = known_digests(known)
    known = known if digests is None else known.unionByName(digests).distinct()
    sizes = known.select(F.collect_set("size")).scalar()  # one number for each length that a known text has
    lines = docs.select(F.col(f"`{id}`").alias("id"), canonical_lines(F.col(f"`{text}`")).alias("lines")).where(F.size("lines") > 0)
    whole = F.array(F.struct(F.lit(-1).alias("line_no"), F.array_join("lines", " ").alias("unit")))
    each = F.transform("lines", lambda line, i: F.struct(i.alias("line_no"), line.alias("unit")))
    units = lines.withColumn("sizes", sizes).select("id", F.inline(F.filter(F.concat(whole, each), lambda u: F.array_contains("sizes", F.length(u.unit)))))
    hashed = units.select("id", "line_no", F.sha2("unit", 256).alias("digest"))
    scope = F.when(F.col("line_no") < 0, "text").otherwise("line").alias("scope")
    return hashed.join(known.drop("size"), "digest").select(F.col("id").alias(id), scope, "line_no", "license_id", "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document and every line of it."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), builtin_licenses(spark), builtin_digests(spark))


def _sql_lines(column: str) -> str:
    text = f"regexp_replace(regexp_replace(lower({column}), '{COPYRIGHT}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for a, b in SPELLINGS:
        text = f"replace({text}, '{a}', '{b}')"
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda line: trim(line)), lambda line: line <> '')"


SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)}),
digests AS (SELECT license_id, sha256(array_to_string({_sql_lines("text")}, ' ')) AS digest FROM known UNION SELECT * FROM (VALUES {", ".join(f"('{i}', '{d}')" for i, d, _ in DIGESTS)})),
docs AS (SELECT doc_id, {_sql_lines("text")} AS lines FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, -1 AS line_no, sha256(array_to_string(lines, ' ')) AS digest FROM docs WHERE len(lines) > 0
  UNION ALL SELECT doc_id, CAST(i - 1 AS INT), sha256(lines[i]) FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)
)
SELECT doc_id, CASE WHEN line_no < 0 THEN 'text' ELSE 'line' END AS scope, line_no, license_id, digest FROM units JOIN digests USING (digest)
"""
