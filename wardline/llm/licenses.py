"""License scans: TF-IDF cosine of licence notices to templates, then inheritance from the nearest ancestor directory.

Every file is compared as a whole with the full licence texts, its header (leading comment, else first paragraph) with the
standard headers and the notices, and every line with the notices. Terms weigh log((1 + files) / (1 + files with the term)),
counted over all files for the terms of the templates; a term of no template weighs as one that no file has. A file's own
licence is that of the whole with a cosine of MIN_WHOLE or more, else that of the header against standard headers with
MIN_HEADER or more, else that of its best line or header against the notices with MIN_COSINE or more (the first template of equals). A licence file is one named so, or one
of which the notice makes at least half the words; it speaks for its directory. A file without a licence of its own takes
that of the nearest directory above it that has one: every file is joined with its ancestor directories, deepest first.

Vectors are sparse and stay in the task; files are joined with directories by paths only. Null texts and empty ones have no
licence of their own; a null path has no directories. Where several licence files of a directory differ, the best cosine
counts, then the template's order. Repeated files give one row each, by path. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text import stage

MIN_COSINE = 0.55
MIN_WHOLE = 0.8
MIN_HEADER = 0.75
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Short notices of well-known licences.
TEMPLATES = {
    "MIT": "Released under the MIT License. Licensed under the MIT license.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License. Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential.",
}
# A template may have several notices; each sentence group is a vector of its own.
NOTICES = [(name, part) for name, text in TEMPLATES.items() for part in re.split(r"(?<=[a-z0-9]\.) (?=[A-Z])", text)]

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_LONG = ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0")
TEXTS = {
    "MIT": _GRANT + _MIT_AS_IS, "BSD-3-Clause": _BSD + _BSD_3 + _BSD_AS_IS, "BSD-2-Clause": _BSD + _BSD_AS_IS, "ISC": _ISC,
    **{name: (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8") for name in _LONG},
}


def _gnu(kind: str, version: int) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the "
        f"Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this program.")


HEADERS = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": _gnu("General", 3), "GPL-2.0": _gnu("General", 2), "LGPL-3.0": _gnu("Lesser General", 3), "AGPL-3.0": _gnu("Affero General", 3),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": TEXTS["MIT"], "BSD-3-Clause": TEXTS["BSD-3-Clause"], "BSD-2-Clause": TEXTS["BSD-2-Clause"], "ISC": TEXTS["ISC"],
}
ORDER = list(dict.fromkeys([*TEMPLATES, *TEXTS, *HEADERS]))
COMMENT = re.compile(r"^\s*(?:#+!?|//+!?|/\*+!?|\*+/?|--+|;+|%+|<!--|\(\*|\"\"\"|''')")


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


def header_of(lines: list[str]) -> list[str]:
    """The leading comment (blank lines in it included if the comment goes on), else the first paragraph."""
    first = next((i for i, line in enumerate(lines) if line.strip()), len(lines))
    if first < len(lines) and COMMENT.match(lines[first]):
        closed = "*/" if lines[first].lstrip().startswith("/*") else "-->" if lines[first].lstrip().startswith("<!--") else None
        end = first
        while end < len(lines) and (closed or COMMENT.match(lines[end])):
            end += 1
            if closed and closed in lines[end - 1]:
                break
        return [COMMENT.sub("", line) for line in lines[first:end]]
    end = first
    while end < len(lines) and lines[end].strip():
        end += 1
    return lines[first:end]


def template_terms() -> list[str]:
    return sorted({t for _, part in NOTICES for t in terms(part)})


def idf_of(files: DataFrame) -> tuple[dict[str, float], float]:
    """Weights of the templates' terms, and that of any other term."""
    vocabulary = sorted(set(template_terms()).union(*[terms(t) for t in (*TEXTS.values(), *HEADERS.values())]))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, counts = frozenset(vocabulary), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts[""] += 1
                counts.update(wanted.intersection(TERM.findall((text or "").lower())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    rows = files.select("text").mapInArrow(job, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r["term"]: r["n"] for r in rows}  # at most one row per template term
    n = df.pop("", 0)
    return {t: math.log((1 + n) / (1 + df.get(t, 0))) + 0.1 for t in vocabulary}, math.log(1 + n) + 0.1


class Matcher:
    """Cosines of a line to all notices (or to other templates); lines with less than two rare template terms are passed over, as none can reach MIN_COSINE."""

    def __init__(self, idf: dict[str, float], other: float, templates: list[tuple[str, str]] = NOTICES, least: float = MIN_COSINE):
        vocabulary = {t for _, part in templates for t in terms(part)}
        idf = {t: w for t, w in idf.items() if t in vocabulary}
        self.idf, self.other, self.least = idf, other, least
        self.terms = sorted(idf)
        self.place = {t: i for i, t in enumerate(self.terms)}
        self.vectors = np.zeros((len(templates), len(self.terms)))
        for k, (_, part) in enumerate(templates):
            for t, n in terms(part).items():
                self.vectors[k, self.place[t]] = n * idf[t]
        self.vectors /= np.linalg.norm(self.vectors, axis=1, keepdims=True)

    def best(self, line: str) -> tuple[float, int, int] | None:
        """(cosine, place of the notice, terms of the line) of the best notice; None if it is under the least cosine."""
        return self.best_of(terms(line))

    def best_of(self, found: Counter) -> tuple[float, int, int] | None:
        known = [(self.place[t], n * self.idf[t]) for t, n in found.items() if t in self.place]
        square = sum(w * w for _, w in known)
        rest = sum((n * self.other) ** 2 for t, n in found.items() if t not in self.place)
        if not known or square < self.least**2 * (square + rest):  # the cosine is at most sqrt(square / (square + rest))
            return None
        at, weights = zip(*known, strict=True)
        cosines = self.vectors[:, at] @ np.array(weights) / math.sqrt(square + rest)
        k = int(cosines.argmax())
        return (float(cosines[k]), k, sum(found.values())) if cosines[k] >= self.least else None


def own_licences(files: DataFrame) -> DataFrame:
    """path, key and the licence found in the file itself (null if none), its cosine and whether it is a licence file."""
    idf, other = idf_of(files)
    names = [n for n, _ in NOTICES]
    texts, headers = list(TEXTS.items()), list(HEADERS.items())

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices, whole, header = Matcher(idf, other), Matcher(idf, other, texts, MIN_WHOLE), Matcher(idf, other, headers, MIN_HEADER)

        def licence(text: str) -> tuple[str | None, float | None, bool]:
            lines = text.split("\n")
            counts = terms(text)
            got = whole.best_of(counts)
            if got:
                return texts[got[1]][0], got[0], True
            best, size = None, sum(counts.values())
            head = terms("\n".join(header_of(lines)))
            got = header.best_of(head)
            if got:
                return headers[got[1]][0], got[0], 2 * got[2] >= size
            for found in (notices.best_of(head), *(notices.best(line) for line in lines if line)):
                if found and (best is None or (found[0], -found[1]) > (best[0], -best[1])):
                    best = found
            return (names[best[1]], best[0], 2 * best[2] >= size) if best else (None, None, False)

        for batch in batches:
            out = [licence(text or "") for text in batch.column("text").to_pylist()]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("path"), pa.array(a, pa.string()), pa.array(b, pa.float64()), pa.array(c, pa.bool_())],
                names=["key", "path", "own", "cosine", "mostly"])

    found = files.select("key", "path", "text").mapInArrow(job, "key long, path string, own string, cosine double, mostly boolean")
    return found.withColumn("licence_file", F.col("own").isNotNull() & (F.col("mostly") | F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False)))).drop("mostly")


def ancestors(path: Column) -> Column:
    """The directories above a path, as (depth, directory); the root is the empty directory."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")))


def scan(files: DataFrame) -> DataFrame:
    """`files` has key, path, text. One row per file: key, path, licence, origin (own, inherited or null), cosine, directory."""
    own = stage(own_licences(files))
    order = F.array_position(F.lit(ORDER), F.col("own"))
    directories = own.filter("licence_file and path is not null").withColumn(
        "directory", F.regexp_replace("path", "/?[^/]*$", "")).groupBy("directory").agg(
        F.max_by(F.struct(F.col("own").alias("licence"), "cosine"), F.struct("cosine", -order)).alias("d"))
    directories = stage(directories.select(F.col("directory").alias("_dir"), F.col("d.licence").alias("from_dir"), F.col("d.cosine").alias("dir_cosine")))
    open_paths = own.filter("own is null and path is not null").select("path").distinct()
    nearest = open_paths.select("path", F.explode(ancestors(F.col("path"))).alias("a")).join(
        directories, F.col("a.directory") == F.col("_dir")).groupBy("path").agg(
        F.max(F.struct("a.depth", "_dir", "from_dir", "dir_cosine")).alias("n"))
    nearest = stage(nearest.withColumnRenamed("path", "_path"))
    out = own.join(nearest, (F.col("path") == F.col("_path")) & F.col("own").isNull(), "left")
    return out.select(
        "key", "path", F.coalesce("own", "n.from_dir").alias("licence"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").alias("origin"),
        F.coalesce("cosine", "n.dir_cosine").alias("cosine"), F.col("n._dir").alias("directory"))
