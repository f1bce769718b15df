"""Licence scans by canonical digest: normalise a text, hash it whole, look the digest up.

A text is brought to a canonical form (mark-up, case, punctuation, copyright lines, comment marks, a leading line that only names
a licence, and equivalent spellings removed), digested as a whole and hash-joined to the digests of known licence texts. The same
lookup runs over every single line, for one-line notices inside other documents.

Only texts that hold one of ANCHORS (letters only, checked on the lower-cased text) are normalised, if every known text holds
one: normalisation neither makes nor breaks a run of plain letters, so no
match is lost. Built-in functions only. The known table is counted
before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, query, sized, table
from .license_texts import LONG_TEXTS

# Public licence texts and one-line notices by SPDX identifier. Copyright lines are left out.
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
BSD2 = """BSD 2-Clause License

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
ZLIB = """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
TEXTS = {
    "MIT": MIT, "MIT-0": MIT.replace(", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "."),
    "Unlicense": UNLICENSE, "BSL-1.0": BOOST, "ISC": ISC, "BSD-2-Clause": BSD2, "Zlib": ZLIB,
    "0BSD": ISC.replace("ISC License", "BSD Zero Clause License").replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
}
BSD3 = BSD2.replace("BSD 2-Clause", "BSD 3-Clause").replace("THIS SOFTWARE IS PROVIDED", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED""")


# Who else a BSD disclaimer may name in place of the copyright holders.
BSD_PARTIES = (("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"))
END = "END OF TERMS AND CONDITIONS"


def plain_texts() -> list[tuple[str, str]]:
    """(identifier, text): short texts with their variants, and the long ones as they are."""
    bsd = [("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3)]
    named = [(k, x.replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", a).replace("COPYRIGHT HOLDER OR CONTRIBUTORS", b)) for k, x in bsd for a, b in BSD_PARTIES]
    return [*TEXTS.items(), bsd[1], *named, *LONG_TEXTS.items()]


def whole_texts() -> list[tuple[str, str]]:
    """(identifier, text) of all whole texts known: with and without what follows the terms, links of either scheme, a blank year kept or filled in."""
    out = []
    for name, text in plain_texts():
        # only the last line that says so ends the terms
        head, end, tail = text.rpartition(END)
        for x in [text, head + end, head, text.replace("Copyright [yyyy]", "Copyright 2000")] if end else [text]:
            out += [(name, x.replace("https://", "http://")), (name, x.replace("http://", "https://"))]
    return sorted(set(out))


NOTICES = {
    "Released under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
}
# Word pairs that count as one spelling, each brought to the second form.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "cancelled": "canceled",
    "centre": "center", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "emphasise": "emphasize", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "licence": "license", "licences": "licenses", "licenced": "licensed",
    "merchantibility": "merchantability", "non commercial": "noncommercial", "non infringement": "noninfringement", "organisation": "organization", "organisations": "organizations",
    "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "sub license": "sublicense", "sub licence": "sublicense",
    "utilisation": "utilization", "while": "whilst", "wilful": "willful",
}
MOST_NOTICES = 10_000
#: Every built-in text holds one of these runs of letters; see `scan` for others.
ANCHORS = ("licen", "permission", "redistribut")
COPYRIGHT_LINE = r"^(copyright( c)?( \d{4}\b| c\b| by\b|$).*|copyright .*\b(19|20)\d\d\b.*|c \d{4}\b.*|all rights reserved|portions copyright .*)$"
#: The name of a short licence, where a canonical text begins with it.
TITLE = (
    r"^(the )?(mit|expat|x11|isc|zlib|zlib libpng|unlicense|mit no attribution|mit 0|(new |simplified |modified |revised )?(0|2 clause |3 clause )?bsd( [023] clause| zero clause| two clause| three clause)?)"
    r"( license| open source license| style license)?( (mit|expat|x11|isc|zlib|0bsd|mit 0|bsd( [023] clause)?|[023] clause( bsd)?( license)?|new|simplified|modified|revised))? "
)
#: Mark-up that breaks a line, and any other.
BREAK_TAGS, TAGS = r"(?i)<(br|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?pre|/?tr)\b[^<>]*>", r"</?[A-Za-z][^<>\n]*>"
#: Clause three of BSD names an organisation.
OWN_NAME, ANY_NAME = r"neither the names? of .{1,120}? nor the names of (its|their) contributors", "neither the name of the copyright owner nor the names of its contributors"


def canonical_lines(text: Column) -> Column:
    """Array of canonical lines: lower case, words of letters and digits with one blank between them; mark-up, copyright and empty lines are gone."""
    bare = F.regexp_replace(F.regexp_replace(text, BREAK_TAGS, "\n"), TAGS, " ")
    plain = F.lower(F.regexp_replace(bare, "[©]|\\([cC]\\)", " c "))
    words = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\n]+", " "), r"(?m)^ +| +$", "")
    return F.filter(F.split(spell(words), "\n"), lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def spell(words: Column) -> Column:
    """Equivalent spellings brought to one, where a pair's words have one blank between them."""
    spelled = words
    for old, new in sorted(SPELLINGS.items(), key=lambda x: -len(x[0])):
        spelled = F.regexp_replace(spelled, rf"\b{old}\b", new)
    return F.when(words.rlike(r"\b(" + "|".join(SPELLINGS) + r")\b"), spelled).otherwise(words)


def joined(lines: Column) -> Column:
    """The whole canonical text: lines joined by blanks, and once more spelled, as a line break may lie within a pair of words; names in clause three are one, and a leading title is gone."""
    return F.regexp_replace(F.regexp_replace(spell(F.array_join(lines, " ")), TITLE, ""), OWN_NAME, ANY_NAME)


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_licenses(spark: SparkSession) -> DataFrame:
    """(known_id, kind, body): the built-in texts; kind is text or notice."""
    rows = [(k, "text", v) for k, v in whole_texts()] + [(v, "notice", k) for k, v in NOTICES.items()]
    return spark.createDataFrame(rows, "known_id string, kind string, body string")


def known_digests(known: DataFrame) -> DataFrame:
    """(known_digest, known_id): one row per digest; of equal texts the smallest identifier counts. Texts without a word are left out."""
    rows = known.select("known_id", joined(canonical_lines(F.col("body"))).alias("_whole")).where("_whole <> ''")
    return rows.groupBy(digest(F.col("_whole")).alias("known_digest")).agg(F.min("known_id").alias("known_id"))


def scan(docs: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """Add license_id, text_digest, notice_ids and n_notices to every row.

    license_id: the known licence that the whole text is, else null. text_digest: digest of the whole canonical
    text, null where the text holds no anchor and so cannot be one. notice_ids: sorted identifiers of the lines that are
    known notices on their own, empty if none; n_notices: how many such lines. Null or empty texts match nothing.
    Rows and other columns stay as they are; clashing names get a trailing underscore.
    Very long texts are normalised and digested whole. `known` is the caller's own table like `known_licenses`; its digests are counted and broadcast only if small, and its notices, MOST_NOTICES
    at most (more raise an error), become a literal map. If any of its texts holds none of ANCHORS, all rows and lines are normalised.
    """
    known = known if known is not None else known_licenses(docs.sparkSession)
    lookup, lines, license_id, text_digest, ids, n = fresh(docs, "_known", "_lines", "license_id", "text_digest", "notice_ids", "n_notices")
    whole = known_digests(known).select(F.col("known_digest").alias(text_digest), F.col("known_id").alias(license_id))
    listed = known_digests(known.where("kind = 'notice'")).limit(MOST_NOTICES + 1).collect()
    if len(listed) > MOST_NOTICES:
        raise ValueError(f"more than {MOST_NOTICES} notices")
    pairs = [F.lit(v) for r in listed for v in r]
    notice = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    anchored = known.where(~has_anchor(F.lower("body"))).isEmpty()
    may = has_anchor(F.lower(F.col(text))) if anchored else F.lit(True)
    rows = docs.withColumn(lines, F.when(may, canonical_lines(F.col(text))))
    found = F.array_compact(F.transform(F.filter(lines, has_anchor) if anchored else F.col(lines), lambda x: notice[digest(x)]))
    rows = rows.withColumns({text_digest: digest(joined(F.col(lines))), ids: F.coalesce(found, F.array().cast("array<string>"))}).drop(lines)
    rows = rows.join(sized(whole, 160), text_digest, "left").withColumns({n: F.size(ids).cast("long"), ids: F.array_sort(F.array_distinct(ids))})
    return rows.select(*docs.columns, license_id, text_digest, ids, n)


def has_anchor(x: Column) -> Column:
    out = F.lit(False)
    for a in ANCHORS:
        out = out | x.contains(a)
    return out


def probes() -> list[tuple[int, str]]:
    """(doc_id, text): whole texts in the forms that they have in the wild, with negative ids; the query adds them to the documents."""
    body = MIT.partition("\n\n")[2]
    terms = BSD2.partition("\n\n")[2]
    page = "<p>MIT License</p>Copyright (c) 2020 Ann Lee<br/>" + body.replace("\n\n", "<br><br>").replace('"AS IS"', "<b>\"AS IS\"</b>")
    forms = [
        *[x for _, x in plain_texts()], "The MIT License (MIT)\n\nCopyright (c) 2015 Ann Lee\n\n" + body, body, "Copyright Ann Lee 2020\n\n" + body, "Copyright 2020 (c) Ann Lee <ann@example.org>\n" + body,
        "Copyright (c) 2010, Ann Lee. All rights reserved.\n\n" + terms, "Copyright (c) 2010, Ann Lee\nAll rights reserved.\n\n" + terms, page, BSD3.replace("the copyright holder nor", "Example Corp. nor"), body + "\nNot quite.", body[:200],
    ]
    return [(-1 - i, x) for i, x in enumerate(forms)]


def _sql() -> str:
    """The same steps over the same known texts; long ones stand in it once and their variants are made from them there."""

    def text(x):
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({text(k)}, 'text', {text(v)})" for k, v in plain_texts()) + ", " + ", ".join(f"({text(v)}, 'notice', {text(k)})" for k, v in NOTICES.items())
    planted = ", ".join(f"({i}, {text(x)})" for i, x in probes())
    bare = rf"regexp_replace(regexp_replace(body, '{BREAK_TAGS}', chr(10), 'g'), '{TAGS}', ' ', 'g')"
    words = rf"regexp_replace(regexp_replace(lower(regexp_replace({bare}, '[©]|\([cC]\)', ' c ', 'g')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')"

    def spelled(x):
        for old, new in sorted(SPELLINGS.items(), key=lambda y: -len(y[0])):
            x = rf"regexp_replace({x}, '\b{old}\b', '{new}', 'g')"
        return x

    may = " OR ".join(f"contains(lower(body), '{a}')" for a in ANCHORS)
    cut = f"length(body) - strpos(reverse(body), reverse('{END}')) - {len(END) - 1}"
    return rf"""
WITH listed AS (SELECT * FROM (VALUES {known}) v(known_id, kind, body)),
ended AS (SELECT known_id, kind, unnest(CASE WHEN kind = 'text' AND contains(body, '{END}')
          THEN [body, substr(body, 1, {cut} + {len(END)}), substr(body, 1, {cut}), replace(body, 'Copyright [yyyy]', 'Copyright 2000')] ELSE [body] END) AS body FROM listed),
known AS (SELECT known_id, kind, unnest([replace(body, 'https://', 'http://'), replace(body, 'http://', 'https://')]) AS body FROM ended),
texts AS (SELECT row_number() OVER () AS rn, doc_id, NULL AS known_id, NULL AS kind, body FROM (SELECT doc_id, text AS body FROM documents UNION ALL SELECT * FROM (VALUES {planted}) p(doc_id, body)) x
          UNION ALL SELECT -row_number() OVER (), NULL, known_id, kind, body FROM known),
w AS (SELECT rn, doc_id, known_id, kind, CASE WHEN {may} THEN {words} END AS w FROM texts),
c AS (SELECT rn, doc_id, known_id, kind, list_filter(string_split({spelled('w')}, chr(10)), lambda x: x <> '' AND NOT regexp_full_match(x, '{COPYRIGHT_LINE}')) AS a FROM w),
j AS (SELECT *, array_to_string(a, ' ') AS s FROM c),
d AS (SELECT rn, doc_id, known_id, kind, a, sha256(regexp_replace(regexp_replace({spelled('s')}, '{TITLE}', ''), '{OWN_NAME}', '{ANY_NAME}', 'g')) AS text_digest, s FROM j),
k AS (SELECT text_digest, min(known_id) AS license_id FROM d WHERE rn < 0 AND s <> '' GROUP BY 1),
nk AS (SELECT text_digest, min(known_id) AS notice_id FROM d WHERE rn < 0 AND kind = 'notice' AND s <> '' GROUP BY 1),
l AS (SELECT rn, string_agg(DISTINCT notice_id, ',' ORDER BY notice_id) AS notice_ids, count(*) AS n_notices
      FROM (SELECT rn, unnest(a) AS line FROM d WHERE rn > 0) JOIN nk ON sha256(line) = nk.text_digest GROUP BY rn)
SELECT doc_id, license_id, d.text_digest, coalesce(notice_ids, '') AS notice_ids, coalesce(n_notices, 0) AS n_notices
FROM d LEFT JOIN k USING (text_digest) LEFT JOIN l USING (rn) WHERE rn > 0
"""


@query("op1_license_scan", _sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scan(docs.unionByName(spark.createDataFrame(probes(), docs.schema)), "text")
    return out.select("doc_id", "license_id", "text_digest", F.array_join("notice_ids", ",").alias("notice_ids"), "n_notices")
