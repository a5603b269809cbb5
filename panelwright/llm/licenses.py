"""Licence scan by canonical digest: whole normalised texts are hash-joined to known licences.

Normalising lower-cases, drops copyright statements (a line with a mark, a year or a holder after
the word; not a line of the licence that goes on with "copyright notice" or the like), maps typographic marks, turns punctuation into
blanks, writes equivalent spellings one way, and joins words by single blanks.  The SHA-256 of the
result is the canonical digest of any text; a text that is a known licence shares its digest.
Each published title of a known licence, and its list without numbers, has a digest of its own.
Only DataFrame functions are used.

Defined cases: NULL and empty texts, and texts of copyright lines alone, have the digest of the
empty text and match nothing; two known licences with the same canonical text match as the first
by name; repeated rows match alike; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as equal.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense",
    "organisation": "organization", "organisations": "organizations", "authorised": "authorized", "authorisation": "authorization",
    "recognised": "recognized", "initialise": "initialize", "utilisation": "utilization", "favour": "favor", "behaviour": "behavior",
    "honour": "honor", "labour": "labor", "fulfil": "fulfill", "fulfilment": "fulfillment", "judgement": "judgment",
    "acknowledgement": "acknowledgment", "whilst": "while", "analogue": "analog", "artefact": "artifact", "catalogue": "catalog",
    "centre": "center", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "per cent": "percent",
    "noncommercial": "non commercial", "wilful": "willful", "modelled": "modeled", "programme": "program",
}

#: Published licence texts and short notices, by identifier.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}

#: Further published texts.
MORE = {
    "BSD-3-Clause": KNOWN["BSD-2-Clause"].replace(
        "provided with the distribution. ",
        "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ",
    ),
    "MIT-0": KNOWN["MIT"].replace(
        ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".",
    ),
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>""",
}

#: Titles that stand before a published text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

#: Any line that starts with a copyright word; the SQL twin's rule, equal to ``_STATEMENT`` on the given tables.
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|copr\.|\(c\)|©|all rights reserved)[^\n]*$"
#: How licence texts go on after the word, where a line is wrapped before it.
_NOT_HOLDER = (
    "notices?|holders?|owners?|licen[cs]es?|licen[cs]ed|laws?|statements?|interests?|rights?|and|or|is|are|in|to|of|on|for|by|as|protection|treat(y|ies)|permission|"
    "disclaimers?|claims?|grants?|act|acts|ownership|material|materials|status|information|terms?|works?|conditions?|may|must|shall|will|can|with|without|under|line|lines|year"
)
_STATEMENT = (
    r"(?m)^[^a-z0-9\n]*("
    r"(copyright|copr\.)[^a-z0-9\n]*((\(c\)|©|[12][0-9]{3})[^\n]*|(by[ \t]+)?(?!(?:" + _NOT_HOLDER + r")\b)[a-z0-9][^\n]*)"
    r"|\(c\)[^a-z0-9\n]*(copyright\b|[12][0-9]{3})[^\n]*"
    r"|©[^\n]*|all rights reserved[^\n]*)$"
)
_MARKS = ("‘’“”–—«»…©™® ", "              ")
_PUNCTUATION = r"[\x00-\x20!-/:-@\[-`{-~\x7f]+"


def canonical(text: Column) -> Column:
    """The normalised text; NULL becomes the empty text."""
    value = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _STATEMENT, " ")
    value = F.translate(value, *_MARKS)
    value = F.concat(F.lit(" "), F.regexp_replace(value, _PUNCTUATION, " "), F.lit(" "))
    # one search for all spellings; only texts that hold one are rewritten
    plain = value
    for old, new in SPELLINGS.items():
        value = F.replace(value, F.lit(f" {old} "), F.lit(f" {new} "))
    any_of = "|".join(f" {old} " for old in SPELLINGS)
    value = F.when(plain.rlike(any_of), value).otherwise(plain)
    return F.trim(value)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def published() -> list[tuple[str, str]]:
    """(licence, text): each known text with and without its titles and its list numbers."""
    rows = []
    for name, text in (KNOWN | MORE).items():
        bodies = {text, re.sub(r"(?<=[:.] )[1-9]\. ", "", text)}
        rows += [(name, head + body) for body in sorted(bodies) for head in ("", *[f"{title}\n\n" for title in TITLES.get(name, ())])]
    return rows


def known_digests(spark: SparkSession, known: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """license, digest of known texts: a dictionary, or a frame with ``license`` and ``text``."""
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(published() if known is None else list(known.items()), "license string, text string")
    rows = known.select("license", digest(F.col("text")).alias("known_digest"), canonical(F.col("text")).alias("c")).filter("c <> ''")
    return rows.groupBy("known_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, digest, license (NULL if its whole text is no known licence)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return rows.join(known_digests(docs.sparkSession, known), F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license")


def sql() -> str:
    """For DuckDB, over the table ``documents``: texts of KNOWN without titles, and lines by ``_COPYRIGHT``."""
    value = f"regexp_replace(lower(coalesce(t, '')), '{_COPYRIGHT}', ' ', 'g')"
    value = f"translate({value}, '{_MARKS[0]}', '{_MARKS[1]}')"
    value = f"' ' || regexp_replace({value}, '{_PUNCTUATION}', ' ', 'g') || ' '"
    for old, new in SPELLINGS.items():
        value = f"replace({value}, ' {old} ', ' {new} ')"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in KNOWN.items())
    return f"""
        WITH known(license, t) AS (VALUES {known}),
        k AS (SELECT sha256(trim({value})) AS digest, min(license) AS license FROM known GROUP BY 1),
        d AS (SELECT doc_id, sha256(trim({value})) AS digest FROM (SELECT doc_id, text AS t FROM documents))
        SELECT d.doc_id, d.digest, k.license FROM d LEFT JOIN k USING (digest)"""
