"""License scan: Dice coefficient over word bigrams against licence templates.

Every line and every paragraph (a stretch between blank lines that has several lines) is normalised to
lower-cased words and compared with the templates by Dice = 2 |A & B| / (|A| + |B|) over distinct word
bigrams. Two bounds prune before the sets are compared, and lose nothing: Dice >= t needs
t / (2 - t) <= |A| / |B| <= (2 - t) / t, and at least t |B| / (2 - t) bigrams of A among the template's.
Whole texts are scanned on Arrow buffers in one narrow pass; templates are a parameter and few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.llm import _bytes as B
from loomkg.llm._run import arrow_map

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law the author has waived all copyright to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "all-rights-reserved": "All rights reserved.",
    "proprietary": "All rights reserved. No part of this may be reproduced without permission.",
    # paragraphs of licence texts and of the standard headers of files
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "Apache-2.0 header terms": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL header disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MIT disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "SPDX MIT": "SPDX-License-Identifier: MIT",
    "SPDX Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX GPL-2.0": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(text: str) -> np.ndarray:
    buf, offs = B.flat(pa.array([text], pa.large_string()))
    s, e, _ = B.spans(buf, offs, B.WORDS)
    return np.unique(B.rolled(B.hashes(buf, B.WORDS, s, e), 2))


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float) -> None:
        sets = {k: bigrams(v) for k, v in sorted(texts.items())}
        sets = {k: v for k, v in sets.items() if len(v)}
        self.names, self.sets, self.threshold = list(sets), list(sets.values()), threshold
        self.every = np.unique(np.concatenate(self.sets)) if sets else np.zeros(0, np.uint64)
        self.least = min((threshold * len(v) / (2 - threshold) for v in self.sets), default=np.inf)

    def match(self, gram: np.ndarray, unit: np.ndarray, units: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
        """(units, template, dice) of all that reach the threshold; gram, unit: bigrams and the unit of each, by unit."""
        if not len(gram) or not len(self.every):
            return []
        at = np.searchsorted(self.every, gram)
        at[at == len(self.every)] = 0
        hit = self.every[at] == gram
        hits = np.bincount(unit[hit], minlength=units)
        maybe = hits >= self.least - 1e-9
        rows = np.flatnonzero(maybe[unit])
        if not len(rows):
            return []
        order = rows[np.lexsort((gram[rows], unit[rows]))]
        g, u = gram[order], unit[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (u[1:] != u[:-1])]
        g, u = g[new], u[new]
        size = np.bincount(u, minlength=units)
        out, t = [], self.threshold
        for i, b in enumerate(self.sets):
            fits = (size >= t / (2 - t) * len(b) - 1e-9) & (size <= (2 - t) / t * len(b) + 1e-9) & maybe
            if not fits.any():
                continue
            mine = fits[u]
            pos = np.searchsorted(b, g[mine])
            pos[pos == len(b)] = 0
            both = np.bincount(u[mine][b[pos] == g[mine]], minlength=units)
            dice = 2 * both / np.maximum(size + len(b), 1)
            ok = np.flatnonzero(fits & (dice >= t))
            if len(ok):
                out.append((ok, i, dice[ok]))
        return out


def scan(texts: pa.Array, templates: Templates) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]]:
    """(text index, kind, number of the unit in its text, template index, dice) of all matches, by kind."""
    buf, offs = B.flat(texts)
    s, e, first = B.spans(buf, offs, B.WORDS)
    if len(s) < 2:
        return []
    pair = B.rolled(B.hashes(buf, B.WORDS, s, e), 2)
    own = B.owners(first)
    feed = np.flatnonzero(buf == 10)
    out = []
    for kind in ("line", "paragraph"):
        if kind == "line":
            cut = feed
        else:
            # the last feed of each run of two or more within a text
            text = np.searchsorted(offs, feed, side="right")
            tied = (np.diff(feed) == 1) & (text[1:] == text[:-1])
            cut = feed[np.r_[False, tied] & ~np.r_[tied, False]] if len(feed) else feed
        unit = np.searchsorted(cut, s)
        same = (unit[1:] == unit[:-1]) & (own[1:] == own[:-1])
        key = unit + own
        new = np.r_[True, (key[1:] != key[:-1])]
        number = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        for ok, i, dice in templates.match(pair[same], number[:-1][same], int(number[-1]) + 1):
            if kind == "paragraph":
                # a paragraph of one line is a line
                lo, hi = s[at[ok]], e[np.r_[at[1:], len(s)][ok] - 1]
                ok, dice = (x[np.searchsorted(feed, lo) < np.searchsorted(feed, hi)] for x in (ok, dice))
            doc = own[at[ok]]
            place = unit[at[ok]] - np.searchsorted(cut, offs[doc])
            out.append((doc, kind, place, np.full(len(ok), i), dice))
    return out


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.7) -> DataFrame:
    """(id, unit, position, license, dice) of every line or paragraph of every text that reaches the threshold.

    position counts the lines, or the stretches between blank lines, from 0. Several templates may match one
    unit. Null and empty texts and units of one word match nothing; a null id stays null; repeated rows are each
    reported; other columns are not read; an empty table gives no rows.
    """
    known = Templates(TEMPLATES if templates is None else templates, threshold)

    def of(b: pa.RecordBatch) -> pa.RecordBatch | None:
        got = scan(b.column(1), known)
        if not got:
            return None
        doc = np.concatenate([g[0] for g in got])
        kinds = [g[1] for g in got for _ in g[0]]
        names = [known.names[i] for g in got for i in g[3]]
        return pa.record_batch([b.column(0).take(pa.array(doc)), pa.array(kinds, pa.string()), pa.array(np.concatenate([g[2] for g in got]).astype(np.int64)), pa.array(names, pa.string()), pa.array(np.concatenate([g[4] for g in got]).astype(float))], ["k", "unit", "position", "license", "dice"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = arrow_map(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")), of, f"k {kind}, unit string, position bigint, license string, dice double", 1)
    return out.select(F.col("k").alias(id_col), "unit", "position", "license", F.round("dice", 6).alias("dice"))


def oracle(threshold: float = 0.7) -> str:
    """The same by brute force in SQL: every unit against every template."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = "regexp_extract_all(" + low + ", '[0-9a-z\\x{{80}}-\\x{{10ffff}}]+')"
    words = words.replace("{{", "{").replace("}}", "}")
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    lines, parts = "string_split(text, chr(10))", "regexp_split_to_array(text, '\\n{2,}')"
    return f"""
WITH u AS (
  SELECT doc_id, 'line' AS unit, generate_subscripts({lines}, 1) - 1 AS position, unnest({lines}) AS x FROM documents
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', generate_subscripts({parts}, 1) - 1, unnest({parts}) AS x FROM documents) WHERE contains(trim(x, chr(10)), chr(10))),
a AS (SELECT doc_id, unit, position, {grams} AS g FROM (SELECT *, {words.replace("{}", "x")} AS w FROM u)),
t AS (SELECT license, {grams} AS g FROM (SELECT license, {words.replace("{}", "x")} AS w FROM (VALUES {values}) v(license, x))),
d AS (SELECT doc_id, unit, position, license, 2.0 * len(list_intersect(a.g, t.g)) / (len(a.g) + len(t.g)) AS dice FROM a, t WHERE len(a.g) BETWEEN 1 AND 3 * len(t.g))
SELECT doc_id, unit, position::BIGINT AS position, license, round(dice::DOUBLE, 6) AS dice FROM d WHERE dice >= {threshold}
"""
