"""Licence scans by canonical digest, with built-in functions only.

A text is made canonical: A-Z in lower case, copyright lines removed, punctuation turned to spaces, white space collapsed,
equivalent spellings made one. The SHA-256 of the whole canonical text is joined with the digests of known licences, each with and without
the titles that it goes by; each of its lines is looked up among the digests of known one-line notices. The known texts are a fixed table of this module (or one
that the caller gives), which bounds what is broadcast.

Defined cases: null and empty texts, and texts that are nothing but copyright lines, have an empty canonical text, which is no
licence; rows with the same id are scanned apart only if their texts differ; an empty table gives an empty result; only the
id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import LOWER, UPPER, col, text_of

# The texts of common licences, copyright lines left out, and the notices that name a licence in one line.
LICENCES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
# Longer texts lie in files, as they are published.
LICENCES |= {x.stem: x.read_text(encoding="utf-8") for x in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
# The titles that stand above a licence's text.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT Licence", "Expat License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
# Spellings that count as equal.
SPELLINGS = {
    "licence": "license", "acknowledgement": "acknowledgment", "organisation": "organization", "authorisation": "authorization", "recognise": "recognize",
    "favour": "favor", "honour": "honor", "merchantibility": "merchantability", "non infringement": "noninfringement", "non commercial": "noncommercial",
    "sub license": "sublicense", "http ": "https ", "copyright owner": "copyright holder",
}

#: ASCII punctuation and the usual typographic quotes and dashes.
PUNCTUATION = "[!-/:-@\\[-`{-~‐-―‘-‟]"
BLANKS = "[ \\t\\x0B\\f\\r]+"
#: A line, without punctuation, that states who holds the copyright and since when.
COPYRIGHT = "(?m)^ ?(?:(?:portions )?copyright (?:c |by |year |yyyy |[^\\n]*[0-9]{4})[^\\n]*|(?:copyright )?©[^\\n]*|c [0-9]{4}[^\\n]*|all rights reserved) ?$"


def canonical(text: Column) -> Column:
    """The canonical text; its lines still stand apart, each with single spaces."""
    same = F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), PUNCTUATION, " "), BLANKS, " ")
    same = F.regexp_replace(same, COPYRIGHT, "")
    for other, one in SPELLINGS.items():
        same = F.replace(same, F.lit(other), F.lit(one))
    return same


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def titled(licences: dict[str, str], titles: dict[str, list[str]]) -> dict[str, list[str]]:
    """Each licence's text, by itself and under each of its titles."""
    return {k: [x, *(f"{t}\n{x}" for t in titles.get(k, []))] for k, x in licences.items()}


def known(spark, texts: dict[str, list[str]]) -> DataFrame:
    """(digest, licence, n_chars): the digests of the canonical known texts. Of licences with the same text, the first by
    name counts."""
    rows = spark.createDataFrame([(name, x) for name, xs in texts.items() for x in xs], "licence string, text string")
    rows = rows.select(whole(canonical(F.col("text"))).alias("text"), "licence")
    return rows.groupBy(F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars")).agg(F.min("licence").alias("licence"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", licences: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of df: its id, canonical_sha256, licence (of the whole text, or null), notices (the licences that
    its lines name, sorted, or null) and n_notices (how many lines do)."""
    licences = titled(LICENCES, TITLES) if licences is None else licences
    notices = NOTICES if notices is None else notices
    both = {k: [*licences.get(k, []), *notices.get(k, [])] for k in {**licences, **notices}}
    # The known texts are a fixed table, so the size of what is broadcast, and of the map below, is known.
    texts = F.broadcast(known(df.sparkSession, both).select("digest", "licence"))
    lines = known(df.sparkSession, notices).orderBy("digest").collect()
    named = F.create_map(*(F.lit(x) for row in lines for x in (row.digest, row.licence)))
    longest = max((row.n_chars for row in lines), default=0) + 2
    own = df.select(col(id_col).alias("id"), canonical(text_of(text_col)).alias("lines"))
    own = own.select(
        "id",
        F.sha2(whole(F.col("lines")), 256).alias("digest"),
        F.filter(F.split("lines", "\n"), lambda x: (F.length(x) > 1) & (F.length(x) <= longest)).alias("lines"),
    )
    # Lines are looked up in place: a join on exploded lines would need a shuffle to bring them together again.
    own = own.select("id", "digest", F.filter(F.transform("lines", lambda x: F.try_element_at(named, F.sha2(F.trim(x), 256))), lambda x: x.isNotNull()).alias("found"))
    return own.join(texts, "digest", "left").select(
        F.col("id").alias(id_col),
        F.col("digest").alias("canonical_sha256"),
        "licence",
        F.when(F.size("found") > 0, F.array_join(F.array_sort(F.array_distinct("found")), ",")).alias("notices"),
        F.size("found").cast("long").alias("n_notices"),
    )
