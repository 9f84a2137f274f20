"""Licence scans by canonical digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stash

# Short licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """zlib License

Copyright (c) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License

Copyright (c) <year>, <holder>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("0BSD", """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("WTFPL", """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Digests of the canonical forms of longer licences, as published.
LONG_TEXTS = [
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
]
# Equivalent spellings, and how they are written in canonical texts (after lower-casing).
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("organisation", "organization"), ("recognise", "recognize"), ("acknowledgement", "acknowledgment"), ("whilst", "while"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("https://", "http://"), ("&", " and "), ("“", " "), ("”", " "), ("‘", " "), ("’", " "), ("–", " "), ("—", " "), ("\u00a0", " ")]
# Lines that state the holder, and titles that some copies leave out.
COPYRIGHT = r"(?md)^[^a-z0-9©(\n]*(copyright([^\n]*[^a-z0-9](19|20)[0-9][0-9]|[ \t]*(©|\(c\)|<|\[|\{))|(©|\(c\))[ \t]*(copyright|(19|20)[0-9][0-9]|<|\[))[^\n]*$"
RESERVED = r"(?md)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
#: Larger tables of known digests are joined, not broadcast.
MOST_KNOWN = 10_000
#: The ASCII letters, digits and everything beyond ASCII are kept; a run of anything else is one space.
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def _lower(text):
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical(text):
    """The text in canonical form: A-Z lower-cased, spellings unified, copyright lines and punctuation removed."""
    out = _lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(out, COPYRIGHT, ""), RESERVED, "")
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def digest(text):
    return F.sha2(canonical(text).cast("binary"), 256)


def oracle_sql() -> str:
    """DuckDB SQL for `scan` of the whole table `documents`."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        for pattern, by in ((COPYRIGHT, ""), (RESERVED, ""), (PUNCTUATION, " ")):
            out = f"regexp_replace({out}, {quoted(pattern.replace('(?md)', '(?m)'))}, '{by}', 'g')"
        return f"sha256(trim({out}, ' '))"

    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in KNOWN)
    digests = ", ".join(f"('{b}', '{a}')" for a, b in LONG_TEXTS)
    return f"""
with known as (select {form("body")} as digest, min(licence) as licence from (values {values}) k(licence, body) group by 1 union all values {digests}),
d as (select doc_id, coalesce(text, '') as text from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
hits as (select doc_id, licence from (select doc_id, {form("line")} as digest from lines where regexp_matches(line, '[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]')) join known using (digest)),
n as (select doc_id, count(*) as n_notices, string_agg(distinct licence, ',' order by licence) as notices from hits group by doc_id)
select doc_id, text_digest, licence, coalesce(n_notices, 0) as n_notices, coalesce(notices, '') as notices
from (select doc_id, {form("text")} as text_digest from d) left join known on text_digest = digest left join n using (doc_id)
"""


def known_digests(spark) -> DataFrame:
    """(digest, licence) of the fixed texts: under 100 rows, so it may be broadcast."""
    texts = spark.createDataFrame(KNOWN, "licence string, body string").select(digest(F.col("body")).alias("digest"), "licence")
    return texts.union(spark.createDataFrame([(b, a) for a, b in LONG_TEXTS], "digest string, licence string")).groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, text_digest, licence (of a text that is a known licence as a whole, else null), n_notices, notices.

    Lines that are a known notice as a whole are counted and their licences listed, sorted and comma-joined (empty if none). Null
    counts as empty text; texts without letters or digits match nothing. An empty table gives no rows; other columns are ignored.

    Every digest is looked up in one join, broadcast as long as there are at most MOST_KNOWN known ones (there are under 100 by default). Only lines that name a licence at all
    leave their row, so nothing is grouped: lines are looked up inside the row, in a map of the known digests. Beyond MOST_KNOWN lines are joined and counted by row.
    """
    spark = docs.sparkSession
    known = known_digests(spark) if known is None else known
    table = known.select(F.col("digest").alias("known_digest"), "licence")
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]"))
    if known.count() <= MOST_KNOWN:
        table = F.broadcast(table)
        known_lines = F.create_map(*(F.lit(v) for r in known.select("digest", "licence").collect() for v in r)) if known.head(1) else F.lit(None).cast("map<string,string>")
        found = F.filter(F.transform(lines, lambda x: F.try_element_at(known_lines, digest(x))), lambda x: x.isNotNull())
        rows = rows.select("doc_id", digest(F.col("text")).alias("text_digest"), found.alias("found"))
    else:
        rows = stash(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), digest(F.col("text")).alias("text_digest"), F.transform(lines, digest).alias("lines")))
        hits = rows.select("row", F.explode("lines").alias("known_digest")).join(table, "known_digest").groupBy("row").agg(F.collect_list("licence").alias("found"))
        rows = rows.join(hits, "row", "left").select("doc_id", "text_digest", F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    rows = rows.join(table, rows["text_digest"] == table["known_digest"], "left")
    return rows.select("doc_id", "text_digest", "licence", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
