"""Scan for license texts: MinHash bands over overlapping windows, then exact containment.

Words are runs of a-z and 0-9 of the lower-cased text; shingles are five words.
A text's shingle hashes are cut into windows of WINDOW shingles, every STRIDE.
Each window has BANDS least hashes, each a band of one row. A template has its
windows at every place, so wherever WINDOW + STRIDE - 1 of its shingles stand in
a text as they are, one window of the text equals one of the template's, and all
bands collide: the probability is 1. Where windows agree to a Jaccard similarity
of j, one collides with probability 1 - (1 - j)**BANDS, and each further window
of the template adds a chance. Templates too short for that are looked up by
windows of a single shingle, where a shared shingle collides with probability 1.

Band values that no template has are dropped within the row. What is left names
the templates to verify, each once: the share of a template's shingles that the
text has, compared as words, must be CONTAINED of a hundred or more.

All of it is DataFrame functions. The templates are constants, so band values and
shingles are literals of the plan. A row stays in its task, and its words go no
further than the row; only (document, license) pairs that hold are shuffled.

Rows: a null or empty text has no windows and no result. Rows with a null doc_id
come out with it, together; rows that repeat a doc_id count as one. An empty table
gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW = 8
STRIDE = 4
BANDS = 4
CONTAINED = 80
#: Maps into which the band values of the templates are cut.
PARTS = 64

# Notices, leading sentences, headers and texts of widespread licenses. Quotation marks do not count; Boost's and the Unlicense's disclaimers are left out.
TEMPLATES = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-licensed": "Licensed under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "licensed under the GNU General Public License, version 3",
    "gpl-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0-text": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-text": "This is free and unencumbered software released into the public domain",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib-full": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "boost-1.0-full": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "unlicense-full": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-2.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-sa-text": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nd-text": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nc-sa-text": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-nd-text": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "spdx-apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "spdx-bsd-2-clause": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx-bsd-3-clause": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-gpl-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl-2.0-or-later": "SPDX-License-Identifier: GPL-2.0-or-later",
    "spdx-gpl-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx-gpl-3.0-or-later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-lgpl-3.0-or-later": "SPDX-License-Identifier: LGPL-3.0-or-later",
    "spdx-agpl-3.0-or-later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx-mpl-2.0": "SPDX-License-Identifier: MPL-2.0",
}

#: Odd multipliers of the least hashes, one for each band.
MULTIPLIERS = tuple(0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 62) | 1 for k in range(BANDS))


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles(words: Column) -> Column:
    """Shingles of an array of words, as text."""
    n = F.size(words)
    none = F.array().cast("array<string>")
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(SHINGLE)]))).otherwise(none)


def hashes(words: Column) -> Column:
    n = F.size(words)
    none = F.array().cast("array<bigint>")
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))).otherwise(none)


def least(grams: Column, band: int) -> Column:
    """A window's least hash under the permutation of a band."""
    turned = F.array_min(F.transform(grams, lambda h: h.bitwiseXOR(F.lit(MULTIPLIERS[band]))))
    return F.xxhash64(F.lit(band), turned)


def windows(grams: Column, stride: int) -> Column:
    """Windows of an array of hashes; one that ends with the last of them."""
    last = F.greatest(F.size(grams) - WINDOW, F.lit(0))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
    return F.when(F.size(grams) >= WINDOW, F.transform(starts, lambda s: F.slice(grams, s + 1, WINDOW))).otherwise(F.array().cast("array<array<bigint>>"))


def bands(grams: Column, stride: int) -> Column:
    return F.flatten(F.transform(windows(grams, stride), lambda w: F.array(*[least(w, k) for k in range(BANDS)])))


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lookup(spark) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Numbers of the templates by band value: of single shingles, and of windows."""
    held = spark.createDataFrame([(n, template_words(t)) for n, t in enumerate(TEMPLATES.values())], "n int, words array<string>").withColumn("g", hashes(F.col("words")))
    short = F.size("g") < WINDOW + STRIDE - 1
    none = F.array().cast("array<bigint>")
    held = held.select("n", F.when(short, F.transform("g", lambda h: F.xxhash64(F.lit(-1), h))).otherwise(none).alias("single"), F.when(short, none).otherwise(bands(F.col("g"), 1)).alias("wide"))
    single: dict[int, list[int]] = {}
    wide: dict[int, list[int]] = {}
    for r in held.collect():  # constants
        for table, column in ((single, "single"), (wide, "wide")):
            for band in set(r[column]):
                table.setdefault(band, []).append(r["n"])
    return single, wide


def named(band: Column, table: dict[int, list[int]]) -> Column:
    """The numbers of the templates with a band value. A map is searched from end to end, so it is cut into PARTS."""
    parts = [[] for _ in range(PARTS)]
    for value, numbers in table.items():
        parts[value % PARTS].append(f"{value}L, array({', '.join(map(str, numbers))})")
    maps = ", ".join(f"cast(map({', '.join(p)}) AS map<bigint, array<int>>)" for p in parts)
    return F.element_at(F.get(F.expr(f"array({maps})"), F.pmod(band, F.lit(PARTS)).cast("int")), band)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_found and n_template shingles, of the licenses that a text holds."""
    single, wide = lookup(docs.sparkSession)
    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "[^a-z0-9]+", " ")
    df = docs.select(F.col(id_col).alias("doc_id"), F.split(F.trim(text), " ").alias("w"))
    df = df.select("doc_id", "w", hashes(F.col("w")).alias("g"))
    one = F.filter(F.transform("g", lambda h: F.xxhash64(F.lit(-1), h)), lambda b: b.isin(*single))
    many = F.filter(bands(F.col("g"), STRIDE), lambda b: b.isin(*wide))
    found = F.array_distinct(F.concat(one, many))
    to_verify = F.array_distinct(F.flatten(F.transform(found, lambda b: named(b, single | wide))))
    of_template = [sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}) for w in map(template_words, TEMPLATES.values())]
    array = lambda items: f"array({', '.join(items)})"
    theirs = F.expr(array(array(f"'{s}'" for s in grams) for grams in of_template))
    names = F.expr(array(f"'{k}'" for k in TEMPLATES))

    def verified(numbers: Column) -> Column:
        row = lambda held, n: F.struct(F.get(names, n).alias("license"), F.size(F.array_intersect(F.get(theirs, n), held)).cast("long").alias("n_found"), F.size(F.get(theirs, n)).cast("long").alias("n_template"))
        held = F.array_intersect(F.flatten(theirs), shingles(F.col("w")))
        return F.when(F.size(numbers) > 0, let(held, lambda h: F.transform(numbers, lambda n: row(h, n))))

    met = df.select("doc_id", F.inline(let(to_verify, verified)))
    met = met.where(100 * F.col("n_found") >= CONTAINED * F.col("n_template"))
    return met.groupBy("doc_id", "license").agg(F.max("n_found").alias("n_found"), F.max("n_template").alias("n_template"))


def oracle() -> str:
    """The same by comparing every text with every template."""
    rows = ", ".join(f"('{k}', {template_words(t)!r})" for k, t in TEMPLATES.items())
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w}) - {SHINGLE - 2}), lambda i: array_to_string({w}[i:i + {SHINGLE - 1}], ' ')))"
    return f"""
WITH t AS (SELECT license, {grams("w")} AS s FROM (VALUES {rows}) v(license, w)),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT doc_id, unnest({grams("w")}) AS s FROM d),
u AS (SELECT license, unnest(s) AS s, len(s) AS n FROM t),
f AS (SELECT doc_id, license, CAST(count(DISTINCT s) AS BIGINT) AS n_found, CAST(n AS BIGINT) AS n_template FROM g JOIN u USING (s) GROUP BY doc_id, license, n)
SELECT doc_id, license, n_found, n_template FROM f WHERE 100 * n_found >= {CONTAINED} * n_template
"""
