"""License scans by canonical digests.

A text is brought to a canonical form (lower case, title and copyright lines dropped, punctuation and runs of white space made one
space, equivalent spellings unified), digested, and joined with the digests of known licence texts.  A copyright line begins with
"copyright" and holds a year or the sign, or begins with the sign, or goes on with a name: where it goes on with a word such as "notice" or
"holder" (RUNNING), it is running text that a line break cut.  The unit is the
whole document; each of its lines is looked up as a text of its own too, for notices that stand between other lines.  The known
texts are a parameter; the table here has notices and short licences as texts, and long licences as digests of their canonical form.

Defined results: a null text, or one without a letter or digit, matches nothing; a line that occurs often counts each
time; repeated documents give repeated rows summed under one doc_id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings, applied in this order to words of the canonical form (fixed values).
SPELLINGS = [("licences?|licenses", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("v(ersion)? ?([0-9])", "version $2"), ("gpl", "gnu general public license"), ("https", "http"), ("cc by", "creative commons by")]

#: The two BSD licences share their text; list items are numbered or not (fixed values).
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{n1}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{n2}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Known notices: licence id and text (fixed values).
KNOWN = [
    ("BSD-2-Clause", BSD.format(n1="", n2="", third="")),
    ("BSD-2-Clause", BSD.format(n1="1. ", n2="2. ", third="")),
    ("BSD-3-Clause", BSD.format(n1="", n2="", third=BSD_THIRD + "\n")),
    ("BSD-3-Clause", BSD.format(n1="1. ", n2="2. ", third="3. " + BSD_THIRD + "\n")),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
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
]

#: Long licences: licence id, first two words of the canonical form or of the text, digest of the canonical form (fixed values; known_digests
#: of the public texts makes them, see test_license_long_texts).
DIGESTS: list[tuple[str, str, str]] = [
    ("Apache-2.0", "version 2", "fb10d45d1f13d219c8bd92f9913ccf2a542c611da27e6d6230c169cd6a3faf60"),
    ("Artistic-1.0-Perl", "the artistic", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "redistribution and", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "creative commons", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "gnu free", "2f1ccb19e9ad7a1acc349555a439d99b5b0886acdc18a092d51fbc693c43d5c5"),
    ("GFDL-1.3", "gnu free", "045d86c78423ef08e6bbe9b1b0a52bd8e3bcc5ea37a8dcfcf619e5073ad75ec8"),
    ("GPL-1.0", "gnu general", "4a30412e3dfe074a9b9d1065202be89812fc727145e77a2f13915adfee591e58"),
    ("GPL-2.0", "gnu general", "2ce6548c36ed5515006dbb0a983cbb329eb73dd206ebafb74593e9a069f339f7"),
    ("GPL-3.0", "gnu general", "93dbe719d7ad0a6d346f44b7e8c25de869bec3a76524467086d4f7ddb342c48f"),
    ("LGPL-2.0", "gnu library", "024edfffbeb74b6180e76a45b228d7b793557ec6d74dd9e40475f9227fa31783"),
    ("LGPL-2.1", "gnu lesser", "e11b0c1ed3c6b220140c231d13fb6e48282944920be63dc33bfa15e6eb6ff68a"),
    ("LGPL-3.0", "gnu lesser", "3ede7494a82fe6f9c1d0a28646ae309d51b9cc301b39d60d0de3be5c1869bd38"),
    ("MPL-1.1", "mozilla public", "fe2f38eba5f59c09b572240f8b7a0bb3530325bcc514fff4643ec578008bdb0e"),
    ("MPL-2.0", "mozilla public", "8ca1b1720c61cc2bde63df3d5a1634c1448cbbef99d787813997dc877dab603d"),
]

#: What a title line says, in lower case (fixed values).
TITLE = r"(the )?(mit|isc|zlib|apache|boost software|(new |modified |simplified )?bsd( [0-9][- ]clause)?)( [a-z\"\']+)? licen[sc]e( - version [0-9.]+|,? version [0-9.]+)?( \([^)\n]*\))?"
#: Words after "copyright" at the start of a line that a sentence goes on with (fixed values).
RUNNING = "notices? holders? owners? laws? licen[sc]es? licen[sc]ors? licensees? statements? and or is are in of for to on as that which may shall will must can interests? symbols? treaty treaties act permissions? protections? rights? disclaimers? material works? status infringements? claims? line lines file doctrines? ownership resulting patents? if".split() + ["the software", "the library"]
#: (pattern, replacement) of the canonical form, in order; both engines read them alike.
STEPS = [
    (r"[ \t]+", " "),
    (rf"(^|\n)[ \t]*{TITLE}[ \t]*(\n|$)", "$1"),
    (r"(^|\n)[ \t]*(copyright[^\n]*((19|20)[0-9][0-9]|\(c\)|©)|\(c\)[ \t]*(19|20)[0-9][0-9]|©|all rights reserved)[^\n]*", "$1"),
    # running text is kept from the step after this by a mark, which the last step removes
    (rf"(^|\n)[ \t]*(copyright[ \t,]+({'|'.join(RUNNING)})([^a-z\n]|\n|$))", "$1|$2"),
    (r"(^|\n)[ \t]*copyright[ \t]+[^ \t\n][^\n]*", "$1"),
    (r"[^\p{L}\p{N}]+", " "),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    x = F.lower(text)
    for pattern, to in STEPS:
        x = F.regexp_replace(x, pattern, to)
    for pattern, to in SPELLINGS:
        x = F.regexp_replace(x, rf"\b{pattern}\b", to)
    return F.trim(x)


def may_match(text: Column, known: list[tuple[str, str]], openings: list[str]) -> Column:
    """Whether a text can have the canonical form of a known one, from its first word: anchored, so it reads little.

    The first word of a canonical form is a first word of the text, or of a spelling that is replaced by one that begins so, unless
    a title or copyright line stood before it.  Of texts known by digest, the openings are known.
    """
    first = {re.findall(r"[^\W_]+", t.lower())[0] for _, t in known}
    for pattern, to in SPELLINGS:
        first |= {pattern} if to.split()[0] in first or to.split()[0].startswith("licens") and any(w.startswith("licen") for w in first) else set()
    words = "|".join([*sorted(first), *(o.replace(" ", r"[^\p{L}\p{N}]+") for o in openings)])
    gap = r"[^\p{L}\p{N}]+"
    title = rf"(the{gap})?(mit|isc|zlib|apache|boost|((new|modified|simplified){gap})?bsd)\b"
    return text.rlike(rf"(?i)^[^\p{{L}}\p{{N}}©]*({words}|copyright|c\)|©|all rights reserved|{title})")


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str, str]] = DIGESTS) -> DataFrame:
    """(license_id, digest) of the known texts: a fixed small table."""
    rows = spark.createDataFrame(known, "license_id string, _known string").select("license_id", digest(F.col("_known")).alias("digest"))
    return rows.unionByName(spark.createDataFrame(digests, "license_id string, opening string, digest string").select("license_id", "digest")).distinct()


def license_scan(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str, str]] = DIGESTS) -> DataFrame:
    """doc_id, scope ('text' or 'line'), license_id and n_matches, for every match in docs(doc_id, text).

    The table of known digests has a fixed size and is broadcast; only matches are shuffled.
    """
    table = F.broadcast(known_digests(docs.sparkSession, known, digests))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.trim(x)) > 0)
    unit = F.array(F.struct(F.lit("text").alias("scope"), F.col("text").alias("unit")))
    units = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.explode(F.concat(unit, F.transform(lines, lambda x: F.struct(F.lit("line").alias("scope"), x.alias("unit"))))).alias("u"),
    )
    likely = units.where(may_match(F.col("u.unit"), known, sorted({o for _, o, _ in digests})))
    hit = likely.select("doc_id", "u.scope", digest(F.col("u.unit")).alias("digest")).join(table, "digest")
    return hit.groupBy("doc_id", "scope", "license_id").agg(F.count("*").alias("n_matches"))


def oracle_sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str, str]] = DIGESTS) -> str:
    """The same in DuckDB SQL."""

    def canon(x: str) -> str:
        x = f"lower({x})"
        for pattern, to in STEPS:
            x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{re.sub('[$](?=[0-9])', chr(92) * 2, to)}', 'g')"
        for pattern, to in SPELLINGS:
            x = f"regexp_replace({x}, '\\b{pattern}\\b', '{to.replace('$2', chr(92) + '2')}', 'g')"
        return f"trim({x})"

    more = ", ".join(f"('{i}', '{h}')" for i, _, h in digests)
    values = ", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in known)
    return f"""
WITH known AS (SELECT DISTINCT license_id, sha256({canon('t')}) AS digest FROM (VALUES {values}) v(license_id, t)
  UNION SELECT * FROM (VALUES {more}) w(license_id, digest)),
units AS (
  SELECT doc_id, 'text' AS scope, text AS unit FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'line', unit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL) WHERE length(trim(unit)) > 0)
SELECT doc_id, scope, license_id, count(*) AS n_matches
FROM (SELECT doc_id, scope, sha256({canon('unit')}) AS digest FROM units) JOIN known USING (digest)
GROUP BY doc_id, scope, license_id"""
