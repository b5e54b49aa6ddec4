"""License scans in DataFrame functions only: MinHash bands over overlapping windows retrieve templates, shingle containment decides.

A window is a run of three shingles (of as many as the template has, if these are fewer), at every place of a text and of a template; long templates
use every k-th place. A band is a hash function of its own, its key the smallest hash of the window's shingles. A window of a text retrieves a
template if they share a key in any of the ten bands: with certainty if the windows are equal, so a whole notice, or any three
shingles in a row at a place of a template that is used, cannot be missed; with probability 1 - (1 - J)^10 at a Jaccard similarity J, which is
0.999 where two of the three shingles are the same (J = 1/2). The containment of the retrieved templates is then counted
exactly on all shingles. Everything happens inside the document's row: no shuffle, no join.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dialoom.functions.text import let

SHINGLE, WINDOW, BANDS = 3, 3, 10
PLACES = 64             # windows of a template at most
MOST_KEYS = 1 << 16     # band keys of all templates together: they are constants of the plan
# fixed values: usual notices and short texts of public licenses
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met",
    "CC BY": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC BY-NC": "Licensed under CC BY-NC 4.0",
    "CC BY-SA": "Licensed under CC BY-SA 4.0",
    "GPL": "This work is licensed under the GNU General Public License",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "MIT": "Released under the MIT License",
    "MIT header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                  "files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
        AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY,
        OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0 text": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You
        may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL text": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        https://www.gnu.org/licenses/.""",
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words_: Column) -> Column:
    """Hashes of all runs of three words; a shorter text has none."""
    return F.when(F.size(words_) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(words_) - SHINGLE), lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(SHINGLE)]))).otherwise(
        F.array().cast("array<bigint>"))


def minima(shingles_: Column, length: int, band: Column) -> Column:
    """The smallest hash of a band in every window of ``length`` shingles (1 to 3); windows at the end may be shorter."""
    def with_next(a: Column, b: Column, by: int) -> Column:
        return F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b), F.lit(1))), lambda x, y: F.least(x, y))       # least passes over the missing ones

    one = F.transform(shingles_, lambda x: F.xxhash64(x, band))
    if length == 1:
        return one
    if length == 2:
        return let(one, lambda m: with_next(m, m, 1))
    return let(one, lambda m: with_next(with_next(m, m, 1), m, 2))


def band_keys(shingles_: Column, lengths: list[int], keep=None) -> Column:
    """The keys of all bands and windows; with ``keep`` only those that it holds for."""
    def of(length: int, band: Column) -> Column:
        keys = minima(shingles_, length, band)
        return keys if keep is None else F.filter(keys, keep)

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.concat(*[of(n, b) for n in lengths])))


def _templates(spark: SparkSession, notices: dict[str, str] | DataFrame) -> tuple[Column, list[int], list[int]]:
    """(all templates as a constant, all band keys, the window lengths). The number of keys is checked."""
    rows = spark.createDataFrame(sorted(notices.items()), "name string, text string") if isinstance(notices, dict) else notices.select("name", "text")
    rows = rows.select("name", F.explode(F.array(shingles(words(F.col("text"))))).alias("s"))
    found = [r.asDict() for r in rows.limit(MOST_KEYS // BANDS + 1).collect()]
    short = [r["name"] for r in found if not r["s"]]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    for r in found:
        shingles_ = r.pop("s")
        r["shingles"] = list(dict.fromkeys(shingles_))
        r["length"] = min(WINDOW, len(shingles_))
        places = len(shingles_) - r["length"] + 1
        step = -(-places // PLACES)
        r["windows"] = [shingles_[i:i + r["length"]] for i in range(0, places, step)]
    lengths = sorted({r["length"] for r in found}) or [WINDOW]
    windows = spark.createDataFrame([(r["name"], w) for r in found for w in r.pop("windows")], "name string, w array<bigint>")
    bands = F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform("w", lambda x: F.xxhash64(x, b))))
    keys = {r["name"]: r["keys"] for r in windows.select("name", F.explode(bands).alias("k")).groupBy("name").agg(F.sort_array(F.collect_set("k")).alias("keys")).collect()}
    every = sorted({k for ks in keys.values() for k in ks})
    if len(every) > MOST_KEYS:
        raise ValueError(f"{len(every)} band keys of templates do not belong into a plan: scan for parts of the templates one after the other")
    listed = [{"name": r["name"], "shingles": r["shingles"], "keys": keys[r["name"]]} for r in found]
    return F.from_json(F.lit(json.dumps(listed)), "array<struct<name:string,shingles:array<bigint>,keys:array<bigint>>>"), every or [0], lengths


def license_notices(docs: DataFrame, notices: dict[str, str] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                    containment: float = 0.75) -> DataFrame:
    """(id, license, n_shingles, n_matched) of every document and retrieved template of whose distinct shingles it holds this share.

    ``notices`` maps names to texts or is a table (name, text) of distinct names; it is a bounded collection, see MOST_KEYS. Only id and text are looked at. Null and
    empty texts, and texts of fewer than three words, hold nothing. Ids may be null or repeated: every row is judged by itself. An empty
    table gives an empty table; without templates nothing is found.
    """
    templates, every, lengths = _templates(docs.sparkSession, NOTICES if notices is None else notices)
    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # one row in, one row out: behind a generator a result is a column, which the optimiser does not put into the lambdas again
    rows = rows.select("id", F.explode(F.array(shingles(F.col("w")))).alias("s")).filter(F.size("s") > 0)
    rows = rows.select("id", "s", F.explode(F.array(F.array_distinct(band_keys(F.col("s"), lengths, keep=lambda k: k.isin(every))))).alias("hits")).filter(F.size("hits") > 0)
    retrieved = F.filter(templates, lambda t: F.arrays_overlap(t["keys"], F.col("hits")))
    checked = F.transform(retrieved, lambda t: F.struct(t["name"].alias("license"), F.size(t["shingles"]).alias("n_shingles"),
                                                        F.size(F.array_intersect(t["shingles"], F.col("s"))).alias("n_matched")))
    found = rows.select("id", F.inline(checked)).filter(F.col("n_matched") >= containment * F.col("n_shingles"))
    return found.withColumnRenamed("id", id_col)
