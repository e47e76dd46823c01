"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

Built-in functions only. Units of a file are its lines, its leading comment as a whole and by paragraphs and, for a file
that is named like a licence, its paragraphs and whole text too. A unit's terms are words, version numbers and SPDX tags;
a term weighs its number of occurrences times its inverse document frequency over all units of all files. Several
templates stand for a licence: usual statements, notices, titles, bodies and tags.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import common
from tallyframe.llm.urls import LOWER, UPPER

# Texts of licences, as their authors publish them.

MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
BSD_BODY = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
ISC_BODY = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
APACHE_NOTICE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
ASF_NOTICE = "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
APACHE_OPENING = (
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
)
GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.",
    "You should have received a copy of the GNU {kind} along with this program. If not, see https://www.gnu.org/licenses/",
)
FSF_OPENING = "Copyright (C) 2007 Free Software Foundation, Inc. https://fsf.org/ Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
)

#: The GNU licences by name, version and date of publication.
GNU = (
    ("GPL-3.0", "General Public License", "3", "29 June 2007"), ("GPL-2.0", "General Public License", "2", "June 1991"),
    ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007"),
)

#: Identifiers in SPDX tags, by licence.
TAGS = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "BSD-2-Clause": ("BSD-2-Clause",), "BSD-3-Clause": ("BSD-3-Clause",), "ISC": ("ISC",), "MPL-2.0": ("MPL-2.0",), "Unlicense": ("Unlicense",),
    "CC-BY-4.0": ("CC-BY-4.0",), "CC-BY-NC-4.0": ("CC-BY-NC-4.0",), **{name: (name, f"{name}-only", f"{name}-or-later", f"{name}+") for name, *_ in GNU},
}

TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", APACHE_NOTICE[0]), ("Apache-2.0", " ".join(APACHE_NOTICE)), ("Apache-2.0", ASF_NOTICE), ("Apache-2.0", " ".join([ASF_NOTICE, APACHE_NOTICE[1]])),
    ("Apache-2.0", APACHE_OPENING[0]), ("Apache-2.0", " ".join(APACHE_OPENING[:2])), ("Apache-2.0", APACHE_OPENING[2]),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", MIT_BODY[0]), ("MIT", " ".join(MIT_BODY)),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", BSD_BODY[3]),
    ("BSD-3-Clause", " ".join(BSD_BODY)), ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", " ".join([*BSD_BODY[:3], BSD_BODY[4]])),
    ("ISC", "ISC License"), ("ISC", ISC_BODY[0]), ("ISC", " ".join(ISC_BODY)),
    *[(name, " ".join(x.format(kind=kind, version=version) for x in GPL_NOTICE[:n])) for name, kind, version, _ in GNU for n in (1, 2, 3)],
    *[(name, f"GNU {kind.upper()} Version {version}, {date}") for name, kind, version, date in GNU],
    *[(name, f"GNU {kind.upper()} Version {version}, {date} {FSF_OPENING}") for name, kind, version, date in GNU if version == "3"],
    *[(name, f"This work is licensed under the GNU {kind}, version {version}.") for name, kind, version, _ in GNU],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."), ("MPL-2.0", MPL_NOTICE), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", UNLICENSE[0]), ("Unlicense", " ".join(UNLICENSE)),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    *[(name, f"SPDX-License-Identifier: {tag}") for name, tags in TAGS.items() for tag in tags],
)

#: The least cosine of a match, and names of licence files.
LEAST, NAMED = 0.8, r"(?i)^(licen[cs]e|copying|unlicense)([-_.].*)?$"

#: A term: an SPDX tag, a version number with dots, or a run of letters and digits, all in lower case.
TAG, TERM = r"spdx-license-identifier:[\x20\t]*", r"spdx-license-identifier:[a-z0-9.+-]+|[0-9]+(?:\.[0-9]+)+|[a-z0-9]+"

#: A line of a comment, what it begins or ends with, and what lies between paragraphs.
COMMENT, MARKS, BETWEEN = r"^[\x20\t]*(//|/\*|\*|#|--|;|%|<!--|\"{3}|'{3})", r"^[\x20\t]*(//+|/\*+|\*+/?|#+!?|--+|;+|%+|<!--|\"{3}|'{3})|(\*+/|-->|\"{3}|'{3})[\x20\t\r]*$", r"\n[\x20\t\r\n]*\n"


def words(text: Column) -> Column:
    """The terms in order, repeats included."""
    return F.regexp_extract_all(F.regexp_replace(F.translate(text, UPPER, LOWER), TAG, "spdx-license-identifier:"), F.lit(TERM), F.lit(0))


def terms_of(text: str) -> Counter[str]:
    """The terms of a template and how often it has each."""
    return Counter(re.findall(TERM, re.sub(TAG, "spdx-license-identifier:", text.translate(str.maketrans(UPPER, LOWER)))))


def units(text: Column, whole: Column) -> Column:
    """What is compared: lines; the leading comment and its paragraphs; of licence files also paragraphs and all."""
    lines = F.split(text, "\n")
    said = F.filter(F.transform(lines, lambda x, i: F.when((F.trim(x) != "") & ~x.rlike(COMMENT), i)), lambda i: i.isNotNull())
    comment = F.transform(F.slice(lines, 1, F.coalesce(F.get(said, F.lit(0)), F.size(lines))), lambda x: F.regexp_replace(x, MARKS, ""))
    header = F.array_join(comment, "\n")
    none = F.array().cast("array<string>")
    more = lambda t, when: F.when(when, F.concat(F.array(t), F.split(t, BETWEEN))).otherwise(none)
    return F.concat(lines, more(header, F.trim(header) != ""), more(text, whole))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST, keep: list[str] | None = None) -> DataFrame:
    """Add `license`, `score`, `found_in` to each file.

    A file's own licence is that of the unit and template with the highest cosine of `least` or more, of equals the
    first by name; `found_in` is then its own path. Others inherit from the nearest directory above them that has a licence file with
    a licence of its own (of several the one with the highest score, then the least path); `found_in` is that file's
    path. Where there is none all three are null. A null text is empty; a null path is in no directory and inherits
    nothing; repeated rows are treated alike and each count in frequencies; no rows give no rows. Columns called like a
    result are replaced, others pass (or only `keep`).

    Frequencies stay a table. A unit can reach `least` only if it has one of a template's heaviest terms, which
    together weigh more than a match can go without; only such units are scored, each distinct list of terms once.
    """
    spark, own = files.sparkSession, ["license", "score", "found_in"]
    kept = common.without(files, own).columns if keep is None else keep
    rows = files.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{path_col}`").alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    name, above = F.regexp_extract("path", "[^/]*$", 0), F.regexp_extract("path", "^(.*)/", 1)
    rows = rows.withColumn("whole", F.coalesce(name.rlike(NAMED), F.lit(False))).withColumn("dir", above)
    terms = F.transform(units(F.col("text"), F.col("whole")), words)
    # Units with terms are counted under the term "".
    seen = rows.select(F.explode(F.filter(terms, lambda t: F.size(t) > 0)).alias("t")).select(F.explode(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("word"))
    counts = common.written(seen.groupBy("word").agg(F.count("*").alias("n")), "frequencies")
    sets = [(t, name, terms_of(text)) for t, (name, text) in enumerate(templates)]
    every = sorted({w for _, _, ws in sets for w in ws})
    held = {r["word"]: r["n"] for r in counts.filter(F.col("word").isin("", *every)).collect()}
    total = held.get("", 0)
    idf = {w: math.log((1 + total) / (1 + held.get(w, 0))) + 1 for w in every}
    norms = [sum((n * idf[w]) ** 2 for w, n in ws.items()) for _, _, ws in sets]
    needed: set[str] = set()
    for (_, _, ws), norm in zip(sets, norms):
        rest = norm
        for w in sorted(ws, key=lambda w: (-ws[w] * idf[w], w)):
            needed.add(w)
            rest -= (ws[w] * idf[w]) ** 2
            if rest < (least**2 - 1e-5) * norm:
                break
    near = F.filter(terms, lambda t: F.exists(t, lambda w: w.isin(*sorted(needed))))
    # A list of terms goes by its digest, so that its terms don't each carry all of them.
    near = F.array_distinct(F.transform(near, lambda t: F.array_sort(t)))
    near = F.transform(near, lambda t: F.struct(F.unhex(F.md5(F.array_join(t, " "))).alias("key"), t.alias("words")))
    rows = common.written(rows.withColumn("near", near).drop("text").withColumn("row", F.monotonically_increasing_id()), "scanned")
    asked = rows.select("row", F.explode("near.key").alias("key"))
    said = rows.select(F.explode("near").alias("s")).groupBy("s.key").agg(F.first("s.words").alias("words")).select("key", F.explode("words").alias("word"))
    said = common.written(said.groupBy("key", "word").agg(F.count("*").cast("double").alias("times")), "said")
    known = spark.createDataFrame(list(idf.items()), "word string, idf double")
    inside = said.join(F.broadcast(known), "word").select("key", "word", (F.col("times") * F.col("idf")).alias("weight"))
    outside = said.filter(~F.col("word").isin(*every)).join(counts, "word").select("key", (F.col("times") * (F.log((1 + total) / (1 + F.col("n"))) + 1)).alias("weight"))
    norm = inside.select("key", "weight").unionAll(outside).groupBy("key").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    has = spark.createDataFrame([(w, t, name, n * idf[w], norm) for (t, name, ws), norm in zip(sets, norms) for w, n in ws.items()], "word string, t int, license string, own double, own_norm double")
    dots = inside.join(F.broadcast(has), "word").groupBy("key", "t", "license", "own_norm").agg(F.sum(F.col("weight") * F.col("own")).alias("dot"))
    less = -F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("own_norm")), 6)
    best = dots.join(norm, "key").select("key", less.alias("less"), "license").filter(F.col("less") <= -least).groupBy("key").agg(F.min(F.struct("less", "license")).alias("best"))
    found = asked.join(best, "key").groupBy("row").agg(F.min("best").alias("best"))
    return inherited(common.written(rows.drop("near").join(found, "row", "left"), "matched"), kept)


def inherited(rows: DataFrame, kept: list[str]) -> DataFrame:
    """`rows` (k0.., path, dir, whole, best) with the columns that `scan` adds."""
    # One licence for each directory; then, for each directory with files that have none, the nearest above it.
    owners = rows.filter("whole AND best IS NOT NULL").groupBy("dir").agg(F.min(F.struct("best.less", "path", "best.license")).alias("owner"))
    dirs = rows.filter("best IS NULL AND path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    steps = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))).alias("s"))
    steps = steps.select("dir", F.col("s.depth").alias("depth"), F.col("s.up").alias("up")).dropDuplicates(["dir", "up"])
    nearest = steps.join(owners.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct("depth", "owner")).alias("n")).select("dir", "n.owner")
    out = rows.join(nearest, "dir", "left")
    given = F.col("best").isNull() & F.col("path").isNotNull()
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        F.coalesce("best.license", F.when(given, F.col("owner.license"))).alias("license"),
        F.coalesce(-F.col("best.less"), F.when(given, -F.col("owner.less"))).alias("score"),
        F.when(F.col("best").isNotNull(), F.col("path")).otherwise(F.when(given, F.col("owner.path"))).alias("found_in"),
    )
