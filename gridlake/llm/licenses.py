"""Licences of files: TF-IDF cosine to templates, then nearest-ancestor inheritance along directories.

Units of a text are its lines and sentences, its paragraphs (the first is a file's header) and, for
a file named as a licence file, the whole text.  Every unit that could reach the least cosine is
compared with every template: names and identifiers of each licence, its usual statements and its
notice or permission text.  A term weighs its count, times its rarity over all documents, times its
rarity over the licences, so that words that all licences share tell nothing.

A first scan counts, for every term, the documents that hold it.  A second scan keeps the units that
may reach the cosine, by bounds that lose nothing: a unit needs one of a template's first terms by
weight, the rest of the template being too short (prefix filter); the terms that some template has
must make up enough of the unit's length, other terms being counted at their least weight; and the
terms shared with one template must make up enough of that one's length.  Equal units are scored once, by
joins on terms.  The second scan is the only Python stage; a task holds one batch of texts.

A file's own licence is its best unit's.  A file that is a licence file (by name, or because named
units make up enough of its words) licenses its directory, and a file without a licence takes that of
its nearest licensed ancestor directory: distinct directories are expanded to their ancestors and
joined by path, so work grows with directories, not files.

The driver gets and spreads the templates' terms only; the list of templates bounds them.

Defined results: null and empty texts name no licence; a null path is in no directory; among
equal scores the first licence by name wins, among licence files of a directory the best score and
then the first path; repeated rows are separate files; an empty table gives no rows; texts of any
length are read whole; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.staging import stage
from .arrow import forget, give_back, slices, texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH = 4 << 20

# Identifiers and names of licences.
NAMES = (
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("ISC", "ISC License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
)
# How a name or an identifier is stated.
STATED = ("{name}", "Licensed under the {name}.", "This work is licensed under the {name}.", "Released under the {name}.")
STATED_ID = ("SPDX-License-Identifier: {id}", "License: {id}", "Licensed under {id}.")
# Notices and permissions of licences.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_NOTICE = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD_SOURCE = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
NOTICES = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", _BSD_SOURCE),
    ("BSD-3-Clause", f"{_BSD_SOURCE} {_BSD_NAMES}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work. Dedicated to the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_NOTICE),
    ("MIT", f"MIT License {_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)
TEMPLATES = (
    *((i, form.format(name=name)) for i, name in NAMES for form in STATED),
    *((i, form.format(id=i)) for i, _ in NAMES for form in STATED_ID),
    *NOTICES,
)
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)(\.[a-z]+)?$"
#: least cosine of a named licence, and least share of words of a text that is a licence file
COSINE, SHARE = 0.6, 0.5
#: weight of a term that every licence has
PLAIN = 0.1


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), F.lit("([a-z0-9]+)"))


def document_frequencies(files: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df``: in how many texts each term occurs."""
    held = files.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    return held.groupBy("term").agg(F.count("*").alias("df"))


class Models(NamedTuple):
    """Weights of the templates' terms, bounded by the list of templates."""

    rows: list[tuple[int, str, str, float, float]]  # template, license, term, weight, length of the template
    first: frozenset[str]  # a unit without any of these reaches no template
    weights: dict[str, float]  # of one occurrence of a template's term
    shared: list[tuple[str, float]]  # rarity of a term over the licences
    unshared: float  # and of a term that no licence has
    documents: int


def rarity(documents: int, df: float) -> float:
    return math.log((documents + 1.0) / (df + 1.0)) + 1.0


def learn_models(spark: SparkSession, frequencies: DataFrame, documents: int, templates=TEMPLATES, least: float = COSINE) -> Models:
    said = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, said string")
    said = [(r.template, r.license, r.terms) for r in said.select("template", "license", terms(F.col("said")).alias("terms")).collect()]
    holders = defaultdict(set)
    for _, name, found in said:
        for term in found:
            holders[term].add(name)
    known = spark.createDataFrame([(t,) for t in holders], "term string")
    df = {r.term: r.df for r in frequencies.join(F.broadcast(known), "term").collect()}
    licenses = len({name for _, name, _ in said})
    shared = {t: math.log((licenses + 1.0) / (len(h) + 1.0)) + PLAIN for t, h in holders.items()}
    rows, first = [], set()
    single = {t: rarity(documents, df.get(t, 0)) * w for t, w in shared.items()}
    for template, name, found in said:
        weights = {t: n * single[t] for t, n in Counter(found).items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        rest = length * length
        for term, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            if rest < (least * length) ** 2 * (1 - 1e-9):
                break
            first.add(term)
            rest -= weight * weight
        rows += [(template, name, t, w, length) for t, w in weights.items()]
    return Models(rows, frozenset(first), single, sorted(shared.items()), math.log(licenses + 1.0) + PLAIN, documents)


LINE = re.compile(r"\n|(?<=[.!?])\s+", re.ASCII)
PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*", re.ASCII)
TERM = re.compile("[a-z0-9]+")
LICENSE_FILE = re.compile(FILE_NAME)
UNITS = "array<struct<kind:int,words:int,unit:string,terms:array<string>>>"


class Reader:
    """Units of texts that may reach a template."""

    def __init__(self, models: Models, least: float):
        self.models, self.least = models, least * least * (1 - 1e-9)
        self.shares = defaultdict(list)
        for template, _, term, weight, length in models.rows:
            self.shares[term].append((template, (weight / length) ** 2))

    def may_reach(self, found: list[str]) -> bool:
        if self.models.first.isdisjoint(found):
            return False
        known, inside, outside = [], 0.0, 0.0
        for term, n in Counter(found).items():
            weight = self.models.weights.get(term)
            if weight is None:
                outside += (n * self.models.unshared) ** 2
            else:
                inside += (n * weight) ** 2
                known.append(term)
        if inside < self.least * (inside + outside):
            return False
        shared = defaultdict(float)
        for term in known:
            for template, share in self.shares[term]:
                shared[template] += share
        return max(shared.values()) >= self.least

    def units(self, text: str, path: str | None) -> list[tuple[int, int, str, list[str]]]:
        low = text.lower().replace("licence", "license")
        if self.models.first.isdisjoint(TERM.findall(low)):
            return []
        parts = [(0, p) for p in LINE.split(low)] + [(1, p) for p in PARAGRAPH.split(low)]
        if path is not None and LICENSE_FILE.search(path):
            parts.append((2, low))
        out = []
        for kind, part in parts:
            found = TERM.findall(part)
            if self.may_reach(found):
                out.append((kind, len(part.split()), hashlib.md5(" ".join(found).encode()).hexdigest(), found))
        return out


def _reading(models: Models, least: float, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        reader = Reader(models, least)
        for batch in slices(batches, 0, BATCH):
            values = texts(batch.column(0))
            found = [reader.units(t, p) for t, p in zip(values, batch.column(3).to_pylist())]
            named = ("kind", "words", "unit", "terms")
            columns = [
                *batch.columns[1:],
                pa.array([len(t.split()) if u else 0 for t, u in zip(values, found)], pa.int32()),
                pa.array([[dict(zip(named, u)) for u in us] for us in found], schema.field("units").type),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
        give_back()

    return run


def read_units(source: DataFrame, models: Models, least: float = COSINE) -> DataFrame:
    """``row, doc_id, path, words`` and ``units``: lines and sentences (kind 0), paragraphs (1) and the whole of a
    licence file (2) that may name a licence; ``words`` of the text, 0 without units.
    """
    out = T.StructType.fromDDL(f"row long, doc_id long, path string, words int, units {UNITS}")
    rows = source.select("text", F.monotonically_increasing_id().alias("row"), "doc_id", "path")
    return rows.mapInArrow(_reading(models, least, to_arrow_schema(out)), out)


def score_units(said: DataFrame, frequencies: DataFrame, models: Models, least: float = COSINE) -> DataFrame:
    """``unit, license, score`` of each distinct unit (``unit, terms``) that reaches ``least``."""
    spark = said.sparkSession
    shared = F.broadcast(spark.createDataFrame(models.shared, "term string, shared double"))  # a row per template term
    rows = F.broadcast(spark.createDataFrame(models.rows, "template int, license string, term string, model double, model_length double"))
    distinct = said.groupBy("unit").agg(F.first("terms").alias("terms"))
    counts = distinct.select("unit", F.explode("terms").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("tf"))
    rare = F.log((models.documents + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0
    weight = F.col("tf") * rare * F.coalesce("shared", F.lit(models.unshared))
    weighted = counts.join(frequencies, "term", "left").join(shared, "term", "left").select("unit", "term", weight.alias("weight"))
    length = weighted.groupBy("unit").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = weighted.join(rows, "term").groupBy("unit", "template", "license", "model_length")
    dots = dots.agg(F.sum(F.col("weight") * F.col("model")).alias("dot"))
    scored = dots.join(length, "unit").withColumn("score", F.round(F.col("dot") / F.col("length") / F.col("model_length"), 9))
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("b"))
    return best.select("unit", "b.license", (-F.col("b.score")).alias("score")).where(F.col("score") >= least)


def _ancestors(directory: Column) -> Column:
    """``directory, depth`` of a directory and all above it; the root is the empty path."""
    parts = F.split(directory, "/")
    upper = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    return F.transform(
        F.sequence(F.lit(0), upper),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("ancestor"), n.alias("depth")),
    )


def scan_licenses(files: DataFrame, path: Column, share: float = SHARE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, path, own_license, own_score, license, how`` of every file.

    ``how`` is ``own``, ``inherited`` or ``none``; ``path`` is a column of ``files`` with ``/`` between
    directories.
    """
    source = files.select(
        F.col(id_col).cast("long").alias("doc_id"), path.cast("string").alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    frequencies = stage(document_frequencies(source), "frequencies")
    models = learn_models(files.sparkSession, frequencies, source.count(), templates)
    scanned = read_units(source, models)
    scanned = stage(scanned.withColumn("directory", F.regexp_replace("path", r"/?[^/]*$", "")), "licenses")
    said = scanned.select("row", F.inline("units"))
    known = stage(score_units(said.select("unit", "terms"), frequencies, models), "statements")
    found = said.select("row", "kind", "words", "unit").distinct().join(known, "unit")
    named = [F.sum(F.when(F.col("kind") == kind, F.col("words")).otherwise(0)) for kind in (0, 1, 2)]
    own = found.groupBy("row").agg(
        F.min(F.struct((-F.col("score")).alias("score"), "license")).alias("best"), F.greatest(*named).alias("named")
    )
    own = own.select("row", F.col("best.license").alias("own_license"), (-F.col("best.score")).alias("own_score"), "named")
    judged = scanned.drop("units").join(own, "row", "left")
    holders = judged.where(
        F.col("own_license").isNotNull()
        & F.col("directory").isNotNull()
        & (F.col("path").rlike(FILE_NAME) | (F.col("named") >= F.col("words") * share))
    )
    licensed = holders.groupBy("directory").agg(
        F.min(F.struct((-F.col("own_score")).alias("score"), "path", "own_license")).alias("b")
    )
    licensed = licensed.select(F.col("directory").alias("ancestor"), F.col("b.own_license").alias("inherited"))
    above = judged.where("directory IS NOT NULL").select("directory").distinct()
    above = above.select("directory", F.inline(_ancestors(F.col("directory"))))
    nearest = above.join(licensed, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "inherited")).alias("n"))
    nearest = nearest.select("directory", F.col("n.inherited").alias("inherited"))
    out = judged.join(nearest, "directory", "left")
    how = F.when(F.col("own_license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), how.alias("how")
    )
