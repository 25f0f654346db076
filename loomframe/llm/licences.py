"""Licence scan: lines, runs of paragraphs and whole texts against licence templates by the Dice coefficient of word bigrams.

All of it is DataFrame functions. A unit's words are its runs of a-z and 0-9 after
A-Z are lower-cased; its bigrams are the distinct pairs of neighbouring words. With
a and b bigrams, 2 min(a, b) / (a + b) bounds the coefficient, so a template is only
compared with units of t b / (2 - t) to (2 - t) b / t bigrams. That bound is an
equi-join on the number of bigrams with a table of a few thousand rows, whose size
depends on the templates alone.

The bound also says how many of a template's bigrams a unit must hold. Anchors are
words chosen so that too few bigrams are left without one of them: a text that
holds no anchor of any template can't match and isn't cut into units, and a unit
that holds none isn't cut into bigrams.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "MIT notice": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
        Public License for more details. You should have received a copy of the GNU Affero General Public License along with
        this program. If not, see https://www.gnu.org/licenses/.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
        Public License for more details. You should have received a copy of the GNU Lesser General Public License along with
        this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
        02110-1301 USA""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
        POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
        but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
        the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
        of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
        for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be
        an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE
        SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer
        to https://unlicense.org""",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


#: Numbers of paragraphs in a row that are compared as one unit, beside single ones.
RUNS = (2, 3, 4, 5, 6)


def template_bigrams(text: str) -> list[str]:
    words = "".join(c if c in LOWER + "0123456789" else " " for c in text.translate(str.maketrans(UPPER, LOWER))).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, least: float) -> tuple[int, int]:
    """The numbers of bigrams with which a coefficient of ``least`` can be reached against n."""
    return ceil(least * n / (2 - least) - 1e-9), floor((2 - least) * n / least + 1e-9)


def anchors(grams: list[str], least: float) -> set[str]:
    """Words of four letters or more, and bigrams where none is left, of which each unit that reaches ``least`` holds at least one."""
    needed = ceil(least * (max(1, size_bounds(len(grams), least)[0]) + len(grams)) / 2 - 1e-9)
    left, chosen = set(grams), set()
    while len(left) >= needed:
        touched: dict[str, int] = {}
        for gram in left:
            for word in {w for w in gram.split(" ") if len(w) > 3}:
                touched[word] = touched.get(word, 0) + 1
        chosen.add(anchor := max(sorted(touched), key=lambda w: touched[w] + 2 * len(w)) if touched else max(sorted(left), key=len))
        left = {gram for gram in left if gram != anchor and anchor not in gram.split(" ")}
    return chosen


def bigrams(text: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    words = F.filter(F.split(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.when(F.size(words) > 1, F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))).otherwise(F.array().cast("array<string>"))


def licence_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per unit and template with a coefficient of at least ``least``: doc_id, unit, unit_no, licence, dice.

    Units are the lines, the paragraphs (parted by lines without text) of several lines, each 2 to 6 of more paragraphs in
    a row ("paragraphs 2" and so on), and the whole text if it has several paragraphs; unit_no counts from 0, for runs
    that of the first paragraph. Very long texts are taken whole. Null, empty and wordless texts match nothing; null ids and repeated rows
    stay as they are. Several templates may match a unit; ties are all returned. Without templates: no rows.
    """
    spark = docs.sparkSession
    rows = []
    for name, text in sorted(templates.items()):
        grams = template_bigrams(text)
        low, high = size_bounds(len(grams), least)
        rows += [(n, name, grams) for n in range(max(1, low), high + 1) if grams]
    table = spark.createDataFrame(rows, "n int, licence string, template array<string>")
    sizes = [n for n, _, _ in rows]
    shortest = min(sizes, default=1)
    text = F.col(text_column).cast("string")
    unit = lambda kind: lambda x, k: F.struct(F.lit(kind).alias("unit"), k.cast("int").alias("unit_no"), x.alias("part"))
    part = F.col("_text")
    lines = F.transform(F.split(part, "\n"), unit("line"))
    paragraphs = F.split(part, "\n[ \t\r]*\n")
    several = F.filter(F.transform(paragraphs, unit("paragraph")), lambda u: F.contains(u["part"], F.lit("\n")))
    whole = F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), part.alias("part")))).otherwise(F.array().cast("array<struct<unit:string,unit_no:int,part:string>>"))
    run = lambda w: F.when(F.size("_parts") > w, F.transform(F.sequence(F.lit(0), F.size("_parts") - w), lambda k: F.struct(F.lit(f"paragraphs {w}").alias("unit"), k.alias("unit_no"), F.array_join(F.slice("_parts", k + 1, w), "\n\n").alias("part")))).otherwise(F.array().cast("array<struct<unit:string,unit_no:int,part:string>>"))
    words = sorted(set().union(*[anchors(grams, least) for _, _, grams in {name: (0, name, g) for _, name, g in rows}.values()])) if rows else []

    words = [w for w in words if not any(other != w and other in w for other in words)]  # who holds the longer one holds the shorter

    def holds(plain: Column) -> Column:
        # lower() maps more letters than A-Z, so it finds no fewer anchors
        def found(lower: Column) -> Column:
            held = F.lit(False)
            for word in words:
                here = [F.contains(lower, F.lit(w)) for w in word.split(" ")]
                held = held | (here[0] & here[1] & plain.rlike("(?i)" + word.replace(" ", "[^A-Za-z0-9]+")) if " " in word else here[0])
            return held

        # as a column, lower() would be put into each of the terms and evaluated there
        return F.coalesce(F.exists(F.array(F.lower(plain)), found), F.lit(False))

    docs = docs.select(F.col(id_column).cast("long").alias("_id"), text.alias("_text")).filter(holds(F.col("_text")))
    docs = docs.select("_id", "_text", paragraphs.alias("_parts"))
    units = docs.select(F.col("_id").alias("doc_id"), F.explode(F.concat(lines, several, *map(run, RUNS), whole)).alias("u")).select("doc_id", "u.unit", "u.unit_no", "u.part")
    # n bigrams take n + 1 words, and these at least 2 n + 1 characters
    units = units.filter(F.length("part") >= 2 * shortest + 1).filter(holds(F.col("part")))
    grams = units.withColumn("grams", bigrams(F.col("part"))).withColumn("n", F.size("grams")).select("doc_id", "unit", "unit_no", "grams", "n")
    found = grams.join(F.broadcast(table), "n")
    dice = 2.0 * F.size(F.array_intersect("grams", "template")) / (F.col("n") + F.size("template"))
    return found.withColumn("dice", dice).filter(F.col("dice") >= least).select("doc_id", "unit", "unit_no", "licence", "dice")


def licence_sql(templates: dict[str, str] = TEMPLATES, least: float = 0.8) -> str:
    """The same in DuckDB's SQL, without the size bounds."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, template_bigrams(text)))}])" for name, text in sorted(templates.items()))
    return f"""
    WITH t(licence, template) AS (VALUES {values}),
    p AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n') AS paragraphs FROM documents WHERE text IS NOT NULL),
    u AS (
      SELECT doc_id, 'line' AS unit, unnest(range(len(lines))) AS unit_no, unnest(lines) AS part FROM p
      UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(len(paragraphs))), unnest(paragraphs) AS part FROM p) WHERE contains(part, chr(10))
      UNION ALL SELECT doc_id, 'paragraphs ' || w, k, array_to_string(paragraphs[k + 1 : k + w], chr(10) || chr(10)) FROM (SELECT doc_id, paragraphs, w, unnest(range(len(paragraphs) - w + 1)) AS k FROM p, (VALUES {', '.join(f'({w})' for w in RUNS)}) AS v(w) WHERE len(paragraphs) > w)
      UNION ALL SELECT doc_id, 'text', 0, text FROM p WHERE len(paragraphs) > 1),
    w AS (SELECT doc_id, unit, unit_no, list_filter(string_split(regexp_replace(translate(part, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM u),
    g AS (SELECT doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
    d AS (
      SELECT doc_id, unit, CAST(unit_no AS INTEGER) AS unit_no, licence, 2.0::DOUBLE * len(list_intersect(grams, template)) / (len(grams) + len(template)) AS dice FROM g CROSS JOIN t)
    SELECT * FROM d WHERE dice >= {least}::DOUBLE"""
