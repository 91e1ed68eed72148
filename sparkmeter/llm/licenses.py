"""Licence scans: look up digests of canonical texts among those of known licences.

A text is made canonical: small letters, lines of copyright notices dropped, equivalent spellings
made equal, and every run of other signs than letters and digits turned into one space. Its
SHA-256 is then joined with the digests of the known texts. Units of a document are its whole text
and each of its lines, so that a short notice inside a document is found too; a unit always takes
part as a whole. The known texts are a fixed table of a few dozen rows, which is why it may be
broadcast; the documents are only scanned.

Null texts and empty units match nothing. Repeated rows are counted; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import let, table
from sparkmeter.llm.registry import query

# Texts of well-known licences, without their copyright lines.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ZERO_BSD_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
_ISC_DISCLAIMER = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

#: (licence id, text). Several texts may stand for one licence.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC_GRANT + "\n" + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n" + _ISC_GRANT + "\n" + _ISC_DISCLAIMER),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", _ZERO_BSD_GRANT + "\n" + _ISC_DISCLAIMER),
    ("BSD-2-Clause", "\n".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_DISCLAIMER))),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "\n".join((_BSD_GRANT, _BSD_1, _BSD_2, _BSD_3, _BSD_DISCLAIMER))),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)

#: (pattern, replacement) between words of a canonical text: spellings that mean the same.
SPELLINGS = (
    ("licenc", "licens"),
    (r"\bsub licens", "sublicens"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\bnon infringement\b", "noninfringement"),
    (r"\backnowledgement\b", "acknowledgment"),
    (r"\bper cent\b", "percent"),
)
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n©]*(copyright\s*(©|\(c\)|[0-9]{4}|by\b)|©|\(c\)\s).*$"
_SIGNS = r"[^\p{L}\p{N}]+"


#: A copyright line has one of these, and a text that a spelling changes one of the others.
_COPYRIGHT_SIGNS = ("copyright", "©", "(c)")
_SPELT = tuple(pattern.replace(r"\b", "") for pattern, _ in SPELLINGS)


def _where(text: Column, literals: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change`` of a text that holds one of some literals; other texts as they are."""
    found = [F.contains(text, F.lit(x)) for x in literals]
    return F.when(reduce(or_, found), change(text)).otherwise(text)


def _spelt(text: Column) -> Column:
    for pattern, replacement in SPELLINGS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null.

    Patterns run only on texts with a literal that every match of them has.
    """
    found = let(
        F.lower(text),
        lambda x: _where(x, _COPYRIGHT_SIGNS, lambda t: F.regexp_replace(t, _COPYRIGHT, " ")),
    )
    found = F.trim(F.regexp_replace(found, _SIGNS, " "))
    return let(found, lambda x: _where(x, _SPELT, _spelt))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, license_id) of the known texts: at most one row per entry of ``KNOWN``."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("t")) for i, t in KNOWN])
    )
    texts = spark.range(1).select(rows.alias("k")).select("k.license_id", "k.t")
    return texts.select(F.sha2(canonical(F.col("t")), 256).alias("digest"), "license_id").distinct()


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences of documents: (id, scope, license_id, digest, n_units), one row per licence found.

    ``scope`` is ``document`` when the whole text is that licence, ``line`` when lines of it are.
    """
    body = F.col(text)
    lines = F.when(F.contains(body, F.lit("\n")), F.split(body, "\n")).otherwise(F.array(body))
    unit = lambda scope: lambda t: F.struct(F.lit(scope).alias("scope"), t.alias("t"))
    units = F.array_append(F.transform(lines, unit("line")), unit("document")(body))
    digests = (
        docs.filter(body.isNotNull())
        .select(F.col(id_col), F.explode(units).alias("u"))
        .select(id_col, "u.scope", F.sha2(canonical(F.col("u.t")), 256).alias("digest"))
    )
    return (
        digests.join(F.broadcast(known_digests(docs.sparkSession)), "digest")
        .groupBy(id_col, "scope", "license_id", "digest")
        .agg(F.count("*").alias("n_units"))
    )


def _sql_canonical(text: str) -> str:
    found = f"regexp_replace(lower({text}), '{_COPYRIGHT}', ' ', 'g')"
    found = f"trim(regexp_replace({found}, '{_SIGNS}', ' ', 'g'))"
    for pattern, replacement in SPELLINGS:
        found = f"regexp_replace({found}, '{pattern}', '{replacement}', 'g')"
    return found


_VALUES = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
FOUND_SQL = f"""
WITH known AS (SELECT DISTINCT sha256({_sql_canonical("t")}) AS digest, license_id
               FROM (VALUES {_VALUES}) AS k(license_id, t)),
units AS (SELECT doc_id, 'document' AS scope, text AS t FROM documents WHERE text IS NOT NULL
          UNION ALL
          SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE text IS NOT NULL)
SELECT doc_id, scope, license_id, digest, count(*) AS n_units
FROM (SELECT doc_id, scope, sha256({_sql_canonical("t")}) AS digest FROM units) JOIN known USING (digest)
GROUP BY ALL
"""


@query("op2_license_digests", FOUND_SQL)
def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))
