"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines out,
equivalent spellings one way, everything but letters and digits one space. The
digest of the whole canonical text is looked up, by hash join, in the table of
known licence digests. Scanned units are the whole document and, because
notices mostly stand on a line of their own, every line as an entire text; no
unit is ever cut short.

Known are one-line notices (made by rule), whole texts, and digests of the long
texts (Apache, GNU, Mozilla, Creative Commons zero). That table is a constant
of this module (bounded), hence a safe broadcast; callers may pass a larger one,
which is broadcast only under the planner's own size limit. Native: column expressions and one join; no shuffle.

Edge cases: a null or empty text has no licence; canonical forms without a word
are never looked up; repeated rows give repeated hits; an empty table gives an
empty result; only id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound

# Licences by identifier, and the names that notices give them.
NAMES = (
    ("Apache-2.0", "the Apache License, Version 2.0"),
    ("Apache-2.0", "the Apache License 2.0"),
    ("Apache-2.0", "the Apache 2.0 License"),
    ("MIT", "the MIT License"),
    ("MIT", "MIT License"),
    ("ISC", "the ISC License"),
    ("Zlib", "the zlib License"),
    ("BSL-1.0", "the Boost Software License, Version 1.0"),
    ("BSL-1.0", "the Boost Software License 1.0"),
    ("Unlicense", "the Unlicense"),
    ("GPL-2.0", "the GNU General Public License, version 2"),
    ("GPL-2.0", "the GNU GPL version 2"),
    ("GPL-2.0", "the GPL version 2"),
    ("GPL-2.0", "the GPLv2"),
    ("GPL-3.0", "the GNU General Public License, version 3"),
    ("GPL-3.0", "the GNU GPL version 3"),
    ("GPL-3.0", "the GPL version 3"),
    ("GPL-3.0", "the GPLv3"),
    ("LGPL-2.1", "the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "the LGPL version 3"),
    ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "the AGPL version 3"),
    ("MPL-2.0", "the Mozilla Public License, Version 2.0"),
    ("MPL-2.0", "the Mozilla Public License 2.0"),
    ("EPL-2.0", "the Eclipse Public License 2.0"),
    ("EPL-2.0", "the Eclipse Public License, Version 2.0"),
    ("BSD-2-Clause", "the BSD 2-Clause License"),
    ("BSD-2-Clause", "the Simplified BSD License"),
    ("BSD-3-Clause", "the BSD 3-Clause License"),
    ("BSD-3-Clause", "the New BSD License"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-SA-4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    ("CC0-1.0", "CC0 1.0"),
)
#: A one-line notice is a subject, a verb, perhaps the terms, and a name.
SUBJECTS = ("", "This work is ", "This project is ", "This software is ", "This file is ", "This code is ")
VERBS = ("licensed under ", "released under ", "distributed under ", "made available under ")
TERMS = ("", "the terms of ")

# Known whole texts and longer notices, by identifier.
TEXTS = (
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("MIT-0", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSL-1.0", """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>"""),
)

# Digests and lengths of the canonical form of long texts that are too long to state here
# (whole; for some also up to the end of their terms).
DIGESTS = (
    ("Apache-2.0", 8654, "12f86c16bc805114581206e22e9b29718bc624ccdea8a1270ec9d8b68e70968a"),
    ("Apache-2.0", 8682, "e2d10372d57bde78e85d8bc1c71dc0efdc8ec553c481bbe9d8e63ef06413e9ee"),
    ("Apache-2.0", 9691, "5d8288bc70c6839256e6b57e272a06201bad7097064827249f08e66fed27e802"),
    ("Artistic-1.0-Perl", 5676, "271ae5fc059bb096108c73771e9d6786bebf93ece73f10bd84add9622a6be140"),
    ("BSD-3-Clause", 1381, "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9"),
    ("CC0-1.0", 6691, "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", 19488, "7a83f76b48dc8cb2e33d8e39560057d7299debc230caaead9821d1dc29301f14"),
    ("GFDL-1.3", 21857, "15a57d2edf0943357aad841e65f415453b2c9ee774f3186b1c5aa27c01e4ee38"),
    ("GPL-1.0", 9379, "3660ec374966fdca719f34ed29b4d1c8cdb2092c0f7b1549965a5453396bddbc"),
    ("GPL-1.0", 9407, "19c9d02aee43cf42e6efba1069ae3dbff61fec124f5f00d67f345d9b949856e4"),
    ("GPL-1.0", 11743, "f086874e03242e3e9eda099d324b356648a6f635f27b5dc76c255a0706d91743"),
    ("GPL-2.0", 14383, "c3a7b01df328126623f3fb1e7f7883701152942f12db5c2f5d09f93ef293a517"),
    ("GPL-2.0", 14411, "41b9a2e5ad517f50e7a53dc4b79cbf0977e143cc31ef84846e366508a2251326"),
    ("GPL-2.0", 17031, "afc90a689545ba0c1cca37f560914c7fd8e1267353f902c18e98bf78b18c7ea0"),
    ("GPL-3.0", 30778, "9b9fc518e2732c8f22367657349171847fbdabea1b75e43b5179232ce6b9e455"),
    ("GPL-3.0", 30806, "4ae74608356bbc61196c9a3b4d1ee12b037dc1b58885ea128d3f93c2459faa5f"),
    ("GPL-3.0", 33240, "fd968c17450fb2421c72c0562a38a305dea3bf90a1f38c9ab0f1cd88b194f92a"),
    ("LGPL-2.0", 22027, "cc63dfd5bfef93d97727160a82fabf50ca11f238191831095c38a360217d5845"),
    ("LGPL-2.0", 22055, "8a3427cd1141c4eb793ee3a7c6d48c070e9f725a5afef344fd3ceadd9b474ae2"),
    ("LGPL-2.0", 23901, "4bb35618f401601871bb8527c1a18dc2a6405713a2dca6f92138d541e592ecf6"),
    ("LGPL-2.1", 23115, "f75fd7e732cb385ea6e75a5f44aac1321db37d17a07db717804cad61bdc7a164"),
    ("LGPL-2.1", 23143, "83b0ab6818a42486e0844745417e00436683e7184daa0bb29a9bd8239bc0fc4c"),
    ("LGPL-2.1", 24988, "cb90a952289c33eb7ebab25ea93d99e54848f5ca3e833de3c3f87b284dbc3fc1"),
    ("LGPL-3.0", 7076, "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6"),
    ("MPL-1.1", 22312, "32e581cffc3aa02e6fa6e816f75c67d1e9bdb0dcb4898bcb570736c1b7365fa6"),
    ("MPL-2.0", 14222, "f8be2042c18f572b869e1a5be3b7962c166ab2cc5e536c2904b4a982586526ce"),
)

# Spellings that count as the same word, as pattern and common form.
SPELLINGS = (
    ("licen[cs](e|ed|es|ing|or|ee)", "licens$1"),
    ("sub ?licens", "sublicens"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non ?infringement", "noninfringement"),
    ("favour", "favor"),
    ("per cent", "percent"),
    ("copyright (owner|holder)s?", "copyright holder"),
    ("version ([0-9])", "v$1"),
)

# Every spelling rule needs one of these in the text, and every copyright line one of those.
SPELLING_SIGNS = ("licen", "organis", "authoris", "acknowledgement", "merchantibility", "infringement", "favour", "per cent", "copyright ", "version ")
COPYRIGHT_SIGNS = ("copyright", "(c)", "©")

#: A line that starts like this (at its start, after white space or comment signs) is a copyright line.
COPYRIGHT = r"(?m)^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*$"


def _has(text: Column, signs: tuple[str, ...]) -> Column:
    """Whether any sign occurs: byte searches, far cheaper than the rules that they stand before."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in signs])


def plain(text: Column) -> Column:
    """Lower case without copyright lines, everything but letters and digits one space."""

    def of(low: Column) -> Column:
        out = F.when(_has(low, COPYRIGHT_SIGNS), F.regexp_replace(low, COPYRIGHT, "")).otherwise(low)
        return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))

    return bound(F.lower(F.coalesce(text, F.lit(""))), of)


def respelled(plain_text: Column) -> Column:
    def of(v: Column) -> Column:
        out = v
        for pattern, common in SPELLINGS:
            out = F.regexp_replace(out, pattern, common)
        return F.when(_has(v, SPELLING_SIGNS), out).otherwise(v)

    return bound(plain_text, of)


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left."""
    return respelled(plain(text))


def notices(spark: SparkSession) -> DataFrame:
    """``license, text`` of the one-line notices: every subject, verb and term with every name."""
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("name")) for a, b in NAMES])))
    for k, parts in enumerate((SUBJECTS, VERBS, TERMS)):
        rows = rows.select("*", F.explode(F.array(*[F.lit(x) for x in parts])).alias(f"part{k}"))
    return rows.select("license", F.concat("part0", "part1", "part2", "name").alias("text"))


def digests_of(texts: DataFrame) -> DataFrame:
    """``digest, license, chars`` of a table ``license, text``; chars is the canonical length."""
    rows = texts.select("license", canonical(F.col("text")).alias("text")).filter("text <> ''").distinct()
    return rows.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "license", F.length("text").cast("int").alias("chars"))


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license, chars`` of all known notices and texts: a constant table of some thousand rows."""
    whole = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("text")) for a, b in TEXTS])))
    listed = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(a).alias("license"), F.lit(n).alias("chars")) for a, n, d in DIGESTS])))
    return digests_of(notices(spark).unionByName(whole)).unionByName(listed)


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, line, license, digest``: one row for each unit that is a known licence.

    ``unit`` is ``document`` (line 0) or ``line`` (its number from 1; given only
    where the document has more than one line, else the document is the unit).

    A unit whose canonical form has another length than every known one can't
    have a known digest, so it needs none.
    """
    lengths = sorted(r["chars"] for r in known.select("chars").distinct().collect())  # at most one for each length
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(text), lines)).otherwise(F.array(text))
    digests = F.transform(units, lambda u: bound(canonical(u), lambda v: F.when(F.length(v).isin(lengths), F.sha2(v.cast("binary"), 256))))
    # the digests are made inside the generator, so no filter or join computes them again
    read = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(digests).alias("line", "digest")).filter("digest IS NOT NULL")
    read = read.withColumn("unit", F.when(F.col("line") == 0, "document").otherwise("line"))
    return read.join(known.select("digest", "license"), "digest").select("doc_id", "unit", "line", "license", "digest")


def oracle() -> str:
    """The same over ``documents`` as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda rows, names: "(VALUES " + ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows) + f") v({names})"

    def form(expr: str) -> str:
        out = f"trim(regexp_replace(regexp_replace(lower(coalesce({expr}, '')), {quote(COPYRIGHT)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for pattern, common in SPELLINGS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(common.replace('$', chr(92)))}, 'g')"
        return out

    parts = ", ".join(f"(SELECT unnest([{', '.join(quote(x) for x in p)}]) AS p{k})" for k, p in enumerate((SUBJECTS, VERBS, TERMS)))
    known = f"SELECT license, p0 || p1 || p2 || name AS text FROM {table(NAMES, 'license, name')}, {parts} UNION ALL SELECT license, text FROM {table(TEXTS, 'license, text')}"
    return f"""
WITH known AS (SELECT DISTINCT license, sha256({form("text")}) AS digest FROM ({known}) UNION ALL SELECT license, digest FROM {table([(a, d) for a, _, d in DIGESTS], 'license, digest')}),
l AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, 'document' AS unit, 0::INTEGER AS line, t FROM l
      UNION ALL SELECT doc_id, 'line', unnest(range(1, len(parts) + 1))::INTEGER, unnest(parts) FROM l WHERE len(parts) > 1),
c AS (SELECT doc_id, unit, line, {form("t")} AS t FROM u)
SELECT doc_id, unit, line, license, sha256(t) AS digest FROM c JOIN known ON sha256(c.t) = known.digest WHERE c.t <> ''
"""
