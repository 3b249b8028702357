"""Licence scan (DataFrame functions only): MinHash retrieval of templates, exact verification.

Templates and texts are cut into five-word shingles (lower case, runs of ASCII letters and digits).
A template of m shingles has the size class c, the power of two at or above m; texts are read in
overlapping windows of 2c shingles that start at every c-th, so one window holds any occurrence
whole. A window's MinHash signature has ``BANDS`` bands of one row. A window that holds at least 0.8
of a template (m > c/2) has a Jaccard similarity of at least 0.4c / 2.1c = 0.19 with it and shares
none of the 64 bands with a probability below 0.81^64 < 2e-6. Retrieved windows are verified by exact
shingle containment.

Only windows with enough template shingles can pass the verification; the others are left out before
their signatures are made: first texts without any word of a set that every match must touch, then
places whose shingle is in no template of the class, then, from class ``COUNTED`` on, windows with
fewer such places than the shortest template of the class needs (inside the scan, exact). No text is
shuffled: what leaves the scan are windows near a template, and the template table, whose size is
fixed by the list below, is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS, COUNTED = 5, 0.8, 64, 64

# Notices by which texts state their licence.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
}

_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}"
_OLD = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; {}"
_LATER = "either version {} of the License, or (at your option) any later version."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. {}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# The headers and short bodies that the licences give, and SPDX lines of five words or more.
HEADERS = {
    "AGPL-3.0": [
        _FREE.format("Affero General Public License", _LATER.format(3)),
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may "
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied. See the License for the specific language governing permissions and limitations under the License.",
        "under the terms of the Apache License",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        _BSD.format(""),
        _BSD.format(
            "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
            "this software without specific prior written permission. "
        ),
        "under the terms of the BSD License",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY-4.0": ["SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
        "public domain worldwide. This software is distributed without any warranty.",
        "has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL-2.0": [
        _OLD.format("General Public License", _LATER.format(2)),
        _FREE.format("General Public License", _LATER.format(2)),
        "SPDX-License-Identifier: GPL-2.0",
    ],
    "GPL-3.0": [_FREE.format("General Public License", _LATER.format(3)), "SPDX-License-Identifier: GPL-3.0"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; " + _LATER.format("2.1"),
        "SPDX-License-Identifier: LGPL-2.1",
    ],
    "LGPL-3.0": [_FREE.format("Lesser General Public License", _LATER.format(3)), "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under the MIT License.",
        "under the terms of the MIT License",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ],
}

TEMPLATES = {k: NOTICES.get(k, []) + HEADERS.get(k, []) for k in sorted({*NOTICES, *HEADERS})}


def _shingles(text: str) -> list[str]:
    w = re.findall(r"[0-9a-z]+", text.lower())
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def template_rows(templates: dict[str, list[str]]) -> list[tuple[int, str, int, list[str]]]:
    """(number, licence, size class, distinct shingles); texts under five words are not templates."""
    rows = []
    for name in sorted(templates):
        for text in templates[name]:
            if s := _shingles(text):
                rows.append((len(rows), name, 1 << (len(s) - 1).bit_length(), s))
    return rows


def anchor_words(rows: list[tuple[int, str, int, list[str]]], least: float) -> list[str]:
    """Words of which every text that holds ``least`` of some template has one: per template its
    longest words, until fewer shingles are without one than a match needs."""
    words: list[str] = []
    for _, _, _, own in rows:
        bare = [s for s in own if not set(s.split()) & set(words)]
        while len(bare) >= least * len(own):
            words.append(max(sorted({w for s in bare for w in s.split()}), key=len))
            bare = [s for s in bare if words[-1] not in s.split()]
    return words


def _signature(shingles: Column) -> Column:
    """MinHash: for each band the smallest of the seeded hashes."""
    seeds = F.array(*[F.lit(j) for j in range(BANDS)])
    return F.transform(seeds, lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(j, s))))


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] = TEMPLATES, least: float = CONTAINMENT
) -> DataFrame:
    """One row per (document, licence) found: ``id_col``, license, containment (the best over windows
    and templates of the licence, rounded to 6 digits), n_windows (verified windows).

    Null texts and texts under five words give no row; a null id is returned as null; rows that
    repeat an id count as one document. An empty table gives an empty result; other columns are
    ignored. ``templates`` is a list of bounded size held by the caller."""
    spark = docs.sparkSession
    rows = template_rows(templates)
    table = spark.createDataFrame(rows, "t int, license string, c int, own array<string>")
    shingle_set = sorted({s for r in rows for s in r[3]})
    # split() leaves an empty word in front of or behind other characters
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^0-9a-z]+"), "")
    at = lambda i, k: F.get(F.col("words"), i + k)
    text_of = lambda i: F.concat_ws(" ", *[at(i, k) for k in range(SHINGLE)])
    n = F.size("words") - (SHINGLE - 1)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    # a shingle's first two words decide for almost all places; the whole shingle is made for the rest
    starts = sorted({" ".join(s.split()[:2]) for s in shingle_set})
    near = F.filter(places, lambda i: F.concat_ws(" ", at(i, 0), at(i, 1)).isin(starts) & text_of(i).isin(shingle_set))
    classes = {c: [r[3] for r in rows if r[2] == c] for c in sorted({r[2] for r in rows})}
    # explode(array(x)) fixes x as a value of the row; lambdas would else work it out per element
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    anchored = F.col(text_col).rlike("(?iu)" + "|".join(anchor_words(rows, least)))
    found = docs.where(anchored).select(F.col(id_col).alias("id"), once(words, "words")).where(n > 0)
    found = found.select("id", "words", once(near, "near")).where(F.size("near") > 0)

    among = lambda held: lambda i: text_of(i).isin(held)
    of_class = [F.filter("near", among(sorted({x for own in ts for x in own}))).alias(f"near_{c}") for c, ts in classes.items()]
    found = found.select("id", "words", once(F.struct(*of_class), "by")).where(F.greatest(*[F.size(f"by.near_{c}") for c in classes], F.lit(0)) > 0)

    def window_starts(c: int) -> Column:
        """The two windows of class ``c`` that hold each place; the first window starts at 0."""
        near_c = F.col(f"by.near_{c}")
        cell = lambda p: (p - p % F.lit(c)).cast("int")
        both = F.array_distinct(F.flatten(F.transform(near_c, lambda p: F.array(F.greatest(cell(p) - c, F.lit(0)), cell(p)))))
        if c >= COUNTED:
            need = least * min(map(len, classes[c])) - 1e-6
            both = F.filter(both, lambda s: F.size(F.filter(near_c, lambda p: (p >= s) & (p < s + 2 * c))) >= F.lit(need))
        return F.transform(both, lambda s: F.struct(F.lit(c).alias("c"), s.alias("start")))

    starts_of = [window_starts(c) for c in classes]
    windows = found.select("id", "words", F.explode(F.concat(*starts_of)).alias("w")).select("id", "words", "w.c", "w.start")
    inside = F.transform(F.sequence(F.col("start"), F.least(F.col("start") + 2 * F.col("c"), n) - 1), text_of)
    windows = windows.where(F.col("start") < n).select("id", "c", "start", once(F.array_distinct(inside), "window"))
    windows = windows.select("*", once(_signature(F.col("window")), "low"))
    keys = F.broadcast(table.select("license", "c", "own", _signature(F.col("own")).alias("own_low")))
    banded = F.exists(F.zip_with("low", "own_low", lambda x, y: x == y), lambda same: same)
    hits = (
        windows.join(keys, "c")
        .where(banded)
        .withColumn("containment", F.size(F.array_intersect("window", "own")) / F.size("own"))
        .where(F.col("containment") >= least)
    )
    best = hits.groupBy("id", "license", "c", "start").agg(F.max("containment").alias("containment"))
    return (
        best.groupBy("id", "license")
        .agg(F.round(F.max("containment"), 6).alias("containment"), F.count(F.lit(1)).alias("n_windows"))
        .withColumnRenamed("id", id_col)
    )


def oracle_sql(templates: dict[str, list[str]] = TEMPLATES) -> str:
    """The same in SQL from the definition: every window held against every template exactly."""
    values = ", ".join(
        f"({t}, '{name}', {c}, {len(own)}, '{s}')" for t, name, c, own in template_rows(templates) for s in own
    )
    return f"""
WITH own(t, license, c, m, shingle) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z]+') AS w FROM documents),
s AS (SELECT doc_id, len(w) - {SHINGLE - 1} AS n, unnest(range(0, len(w) - {SHINGLE - 1})) AS p, w FROM d WHERE len(w) >= {SHINGLE}),
hit AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS shingle FROM s),
near AS (SELECT doc_id, n, p, own.* FROM hit JOIN own USING (shingle)),
win AS (SELECT DISTINCT doc_id, n, t, license, c, m, shingle, unnest([greatest(p // c - 1, 0) * c, p // c * c]) AS start FROM near),
held AS (SELECT doc_id, license, c, start, t, count(DISTINCT shingle) / m AS containment FROM win GROUP BY doc_id, license, c, start, t, m)
SELECT doc_id, license, round(max(containment), 6) AS containment, count(DISTINCT (c, start)) AS n_windows
FROM held WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license
"""
