"""Operator 8: license scans by sparse TF-IDF cosine, then inheritance from the nearest ancestor directory.

Texts are read in units: lines, and sentences within lines. Candidates are each
unit with a cue word, alone and with the unit before or after it, and the run of
units around it that are worded like the templates, however long; files named as
licence files are compared whole, too. Templates are the published notices and
short licences, and titles, one-line grants and SPDX tags made from each name.
Words and word pairs are weighted by the inverse document frequency among the
templates (unknown ones weigh the most), vectors have length one. A candidate's
license is that of the highest cosine at `threshold` or above; among templates
within `MARGIN` of it, those whose version number the candidate has come first.
The best candidate is the file's own license. A file without one inherits
from the licence file in the nearest directory above it, by joins on paths:
distinct directories are joined with the licensed ones among their ancestors,
and files with their directory.

Defined results: null and empty texts have no license of their own; a null path
is in no directory; of several licence files in one directory the smallest path
counts; ties go to the first name; each input row gives one output row; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_batches, written

WARRANTY = "This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)


def gnu(name: str, version: str, thing: str, end: str = "either version {version} of the License, or (at your option) any later version") -> str:
    """The standard notice of a GNU licence."""
    return f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {end.format(version=version)}. {WARRANTY.format(thing=thing, name=name)} You should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."


#: The published notices and short licences by SPDX identifier.
NOTICES = {
    "AGPL-3.0": gnu("GNU Affero General Public License", "3", "program"),
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": BSD + AS_IS,
    "BSD-3-Clause": BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + AS_IS,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty. CC0 Public Domain Dedication.",
    "GPL-2.0": gnu("GNU General Public License", "2", "program"),
    "GPL-3.0": gnu("GNU General Public License", "3", "program"),
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1": gnu("GNU Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": gnu("GNU Lesser General Public License", "3", "library"),
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Titles by identifier, as licence texts and one-line grants have them.
TITLES = {
    "AGPL-3.0": ("GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License, version 3", "AGPLv3"),
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0"),
    "CC0-1.0": ("Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "CC0 1.0"),
    "GPL-2.0": ("GNU General Public License Version 2, June 1991", "GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License Version 3, 29 June 2007", "GNU General Public License, version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License, version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License Version 3, 29 June 2007", "GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0"),
    "Unlicense": ("Unlicense",),
}
GRANTS = ("{}", "Licensed under the {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Licensed under {}.")
CUE = re.compile(r"licen[cs]|copyright|permission (?:is|to)|redistribution and|public domain|released under|creative commons|\bCC[ -]?(?:BY|0)\b|spdx|[GM]PLv?[ -]?[123]", re.I)
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)s?([-._].*)?$"
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Ends of units: of lines, and of sentences within a line.
END = re.compile(r"\n|(?<=[.!?;:])\s")
DIGIT = re.compile("[0-9]")
THRESHOLD, MARGIN = 0.55, 0.08
#: Share of a unit's words that the templates have, for the unit to belong to a run.
LIKE = 0.75


def terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(zip(words, words[1:], strict=False))


def templates() -> list[tuple[str, str]]:
    """(identifier, text) of notices, titles, one-line grants and SPDX tags."""
    rows = list(NOTICES.items())
    for name, titles in TITLES.items():
        rows += [(name, g.format(t)) for t in titles for g in GRANTS]
        rows += [(name, f"SPDX-License-Identifier: {name}{form}") for form in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return rows


@lru_cache(maxsize=1)
def index() -> tuple[list, dict, dict, float, frozenset]:
    """Templates as (identifier, version numbers), postings (term -> [(template, weight)]), idf, the idf of unknown terms, and the templates' words."""
    rows = [(name, WORD.findall(t.lower())) for name, t in templates()]
    df = Counter(x for _, w in rows for x in terms(w))
    idf = {x: math.log((1 + len(rows)) / (1 + n)) + 1 for x, n in df.items()}
    postings: dict = {}
    for k, (_, w) in enumerate(rows):
        v = {x: n * idf[x] for x, n in terms(w).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        for x, value in v.items():
            postings.setdefault(x, []).append((k, value / size))
    version = lambda name: {v for x in re.findall(r"[0-9]+(?:[.][0-9]+)?", name) for v in (x, x.removesuffix(".0"))}
    vocabulary = frozenset(x for _, w in rows for x in w)
    return [(name, version(name)) for name, _ in rows], postings, idf, math.log(1 + len(rows)) + 1, vocabulary


def best(words: list[str]) -> tuple[float, str]:
    """The highest cosine and its license; versions decide among templates that are nearly as near."""
    rows, postings, idf, unknown, _ = index()
    dots, size = {}, 0.0
    for x, n in terms(words).items():
        w = n * idf.get(x, unknown)
        size += w * w
        for k, v in postings.get(x, ()):
            dots[k] = dots.get(k, 0.0) + w * v
    if not dots:
        return 0.0, ""
    size, most = math.sqrt(size), max(dots.values())
    numbers = {w for w in words if DIGIT.search(w)}
    has = lambda k: any(v in numbers or f"v{v}" in numbers for v in rows[k][1])
    near = [(-has(k), -d, rows[k][0]) for k, d in dots.items() if d >= most - MARGIN * size]
    _, d, name = min(near)
    return -d / size, name


def units(text: str) -> list[str]:
    return END.split(text)


def candidates(text: str):
    """The words of each unit with a cue, alone and with a neighbour, and of the run of units worded like the templates around it."""
    vocabulary = index()[4]
    parts = units(text)
    words: dict[int, list[str]] = {}

    def of(i: int) -> list[str]:
        if i not in words:
            words[i] = WORD.findall(parts[i].lower())
        return words[i]

    def alike(i: int) -> bool:
        w = of(i)
        return not w or sum(x in vocabulary for x in w) >= LIKE * len(w)

    end = 0
    for i, part in enumerate(parts):
        if not CUE.search(part):
            continue
        yield of(i)
        for a, z in ((i - 1, i), (i, i + 1)):
            if a >= 0 and z < len(parts) and of(a) and of(z):
                yield of(a) + of(z)
        if i < end:
            continue  # in the run before
        first = i
        while first > end and alike(first - 1):
            first -= 1
        end = i + 1
        while end < len(parts) and alike(end):
            end += 1
        if end - first > 1:
            yield [w for k in range(first, end) for w in of(k)]


def own_license(text: str | None, whole: bool, threshold: float) -> tuple[str | None, float]:
    if not text or not CUE.search(text):
        return None, 0.0
    found = [best(w) for w in candidates(text)] + ([best(WORD.findall(text.lower()))] if whole else [])
    score, name = min(((-s, n) for s, n in found), default=(0.0, ""))
    return (name if -score >= threshold else None), round(-score, 6)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def licenses(df: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: key, path, license, score, origin ('own', 'inherited' or null), license_path."""

    def scan(rows: dict) -> dict:
        found = [own_license(t, bool(p and re.match(FILE_NAME, p.rsplit("/", 1)[-1])), threshold) for t, p in zip(rows["text"], rows["path"], strict=True)]
        return {"key": rows["key"], "path": rows["path"], "own": [x[0] for x in found], "score": [x[1] for x in found]}

    kind = df.schema[key].dataType.simpleString()
    seen = map_batches(df.select(df[key].alias("key"), df[path].alias("path"), df[text].alias("text")), scan, f"key {kind}, path string, own string, score double")
    seen = written(seen.withColumn("dir", directory(F.col("path"))), "licenses")
    is_file = F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE_NAME)
    by_dir = seen.where(is_file & F.col("own").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "own")).alias("f"))
    by_dir = by_dir.select(F.col("dir").alias("above"), "f.path", "f.own")
    parts = F.split("dir", "/")
    # "" is the root, an ancestor of every directory
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    dirs = seen.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(by_dir, "above").groupBy("dir").agg(F.max_by(F.struct("path", "own"), F.length("above")).alias("n"))
    out = seen.join(nearest, "dir", "left")
    inherited = F.col("own").isNull() & F.col("n").isNotNull()
    return out.select(
        F.col("key").alias(key), F.col("path"), F.coalesce("own", "n.own").alias("license"), "score",
        F.when(F.col("own").isNotNull(), "own").when(inherited, "inherited").alias("origin"), F.when(F.col("own").isNotNull(), F.col("path")).when(inherited, F.col("n.path")).alias("license_path"),
    )
