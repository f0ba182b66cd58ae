"""License scans: TF-IDF cosine of headers and licence files to templates, inherited along paths.

Each line of a file, each run of as many words as a template has (over line ends too) and the file as a
whole are compared with notices, headers, titles and texts of licences by the cosine of sparse TF-IDF
vectors. Document frequencies of the templates' words are counted over all files; a word that no template
has weighs as a word of no file. The best line or run over ``NEAR`` is the file's header; a template that
is part of a longer one yields where the longer one is found. A file is a licence file if the whole of it
is as near to a template, if the title of a licence is among its first ``OPENING`` words, or if a
third of its lines are notices. Other files without header inherit from the nearest directory above them
that has a licence file: each distinct directory looks up its ancestors by a join, and files join on
their directory.

Defined results: null and empty texts have no words and can only inherit; a null path has no directory
and inherits nothing; several licence files of one directory: the nearest to its template counts, then
the least path; repeated rows are reported one by one; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewflow.llm.quality import tokens
from reviewflow.llm.words import hashes_of, slices
from reviewflow.session import scratch_dir

NEAR = 0.75
#: Share of a file's lines that are notices, from which on it is a licence file.
FILE_SHARE = 1 / 3
#: Words from the start of a licence file within which its title begins.
OPENING = 20
#: Words of candidate runs compared at once.
AT_ONCE = 1 << 18

_GNU = ("This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} "
        "as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) "
        "any later version.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_TITLE = "GNU {} Version {} Copyright (C) {} Free Software Foundation, Inc."
# Names of licences, usual notices and headers, and the opening words of their texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
                   "file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
                "the GNU General Public License as published by the Free Software Foundation, either "
                "version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                     "International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", _GNU.format("program", ";", "General Public License", ";", "2")),
    ("LGPL-2.1", _GNU.format("library", ";", "Lesser General Public License", ";", "2.1")),
    ("LGPL-3.0", _GNU.format("program", ":", "Lesser General Public License", ",", "3")),
    ("AGPL-3.0", _GNU.format("program", ":", "Affero General Public License", ",", "3")),
    # Short licences as a whole.
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without "
            "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software. THE "
            "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
            "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
            "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may "
                                 "be used to endorse or promote products derived from this software without "
                                 "specific prior written permission. ")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
            "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
            "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
            "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
            "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
            "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]
#: Where the titles of long licences begin, which open their whole texts.
TITLES = len(TEMPLATES)
TEMPLATES += [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS "
                   "FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", _TITLE.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")),
    ("GPL-2.0", _TITLE.format("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991")),
    ("LGPL-3.0", _TITLE.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")),
    ("LGPL-2.1", _TITLE.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999")),
    ("AGPL-3.0", _TITLE.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007")),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or "
                "legal entity"),
]
OWN = "row long, license string, similarity double, line int, is_file boolean"


class Model(NamedTuple):
    names: list[str]
    terms: np.ndarray  # hashes of the templates' words, in order
    idf: np.ndarray
    other: float  # weight of a word that no template has
    weights: np.ndarray  # terms x templates, columns of length 1
    sizes: list[int]  # words of each template
    within: np.ndarray  # templates x templates: the first is a part of the second


def _words(texts: pa.Array):
    """Hash, file and line of each run of letters and digits, in small letters."""
    words = tokens(pc.ascii_lower(pc.fill_null(texts, "")))
    first = words.raw[words.begin]
    some = (first >= 128) | (first - 97 < 26) | (first - 48 < 10)
    breaks = np.flatnonzero(words.raw == 10)
    return hashes_of(words)[some], words.rows[some], np.searchsorted(breaks, words.begin[some])


def vocabulary() -> tuple[np.ndarray, list[np.ndarray]]:
    hashed, row, _ = _words(pa.array([text for _, text in TEMPLATES]))
    terms = np.unique(hashed)
    return terms, [np.searchsorted(terms, hashed[row == i]) for i in range(len(TEMPLATES))]


def _term_of(terms: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Place of each word among the terms, or -1."""
    at = np.minimum(np.searchsorted(terms, hashed), len(terms) - 1)
    return np.where(terms[at] == hashed, at, -1)


def _frequencies(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(len(terms), np.int64), 0
    for batch in slices(batches):
        hashed, row, _ = _words(batch.column("text"))
        term = _term_of(terms, hashed)
        own = np.unique(row[term >= 0] * len(terms) + term[term >= 0])
        df += np.bincount(own % len(terms), minlength=len(terms))
        n += batch.num_rows
    yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(len(terms) + 1, dtype=np.int32)),
                                      "n": pa.array(np.r_[df, n])})


def fit(files: DataFrame) -> Model:
    """Weights of the templates' words from how many of all files have them."""
    terms, templates = vocabulary()
    counted = np.zeros(len(terms) + 1)
    for r in files.select("text").mapInArrow(partial(_frequencies, terms=terms), "term int, n long") \
            .groupBy("term").agg(F.sum("n").alias("n")).collect():
        counted[r["term"]] = r["n"]
    n = counted[-1]
    idf = np.log((1 + n) / (1 + counted[:-1])) + 1
    weights = np.zeros((len(terms), len(templates)))
    for i, own in enumerate(templates):
        weights[:, i] = np.bincount(own, minlength=len(terms)) * idf
    spelled = [f" {' '.join(map(str, own))} " for own in templates]
    within = np.array([[len(a) < len(b) and a in b for b in spelled] for a in spelled])
    return Model([name for name, _ in TEMPLATES], terms, idf, float(np.log(1 + n) + 1),
                 weights / np.linalg.norm(weights, axis=0), [len(own) for own in templates], within)


def cosines(m: Model, part: np.ndarray, term: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Best template of each part and its cosine."""
    best, near = np.zeros(parts, np.int64), np.zeros(parts)
    known = term >= 0
    key, times = np.unique(part[known] * len(m.terms) + term[known], return_counts=True)
    p, t = key // len(m.terms), key % len(m.terms)
    value = times * m.idf[t]
    norm = np.sqrt(np.bincount(p, value ** 2, parts) + np.bincount(part[~known], minlength=parts) * m.other ** 2)
    if len(p):
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        dots = np.add.reduceat(value[:, None] * m.weights[t], first, axis=0)
        best[p[first]] = dots.argmax(axis=1)
        near[p[first]] = dots.max(axis=1) / norm[p[first]]
    return best, near


def windows(m: Model, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, template and cosine of the runs of a template's number of words that are near to it."""
    first, template, near = [], [], []
    squares = np.r_[0, np.cumsum(np.where(term >= 0, m.idf[term], m.other) ** 2)]
    for i, size in enumerate(m.sizes):
        if size > len(term):
            continue
        dots = np.r_[0, np.cumsum(np.r_[m.weights[:, i] * m.idf, 0][term])]
        dot = dots[size:] - dots[:-size]
        # A word that occurs again makes a run longer, so this leaves out no run that is near.
        at = np.flatnonzero((dot > 1e-6) & (dot ** 2 >= (NEAR ** 2 - 1e-6) * (squares[size:] - squares[:-size]))
                            & (row[size - 1:] == row[:len(row) - size + 1]))
        for a in range(0, len(at), max(1, AT_ONCE // size)):
            some = at[a:a + max(1, AT_ONCE // size)]
            own = term[some[:, None] + np.arange(size)]
            part = np.broadcast_to(np.arange(len(some))[:, None], own.shape)
            known = own >= 0
            key, times = np.unique(part[known] * len(m.terms) + own[known], return_counts=True)
            norm = np.bincount(key // len(m.terms), (times * m.idf[key % len(m.terms)]) ** 2, len(some))
            cosine = dot[some] / np.sqrt(norm + (~known).sum(axis=1) * m.other ** 2)
            keep = cosine >= NEAR
            first.append(some[keep])
            template.append(np.full(int(keep.sum()), i))
            near.append(np.minimum(cosine[keep], 1))
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    first, template, near = (np.concatenate(x) for x in (first, template, near))
    keep = np.ones(len(first), bool)
    for i, j in np.argwhere(m.within):
        keep &= (template != i) | ~np.isin(row[first], row[first[template == j]])
    return first[keep], template[keep], near[keep]


def headers(batch: pa.RecordBatch, m: Model) -> pa.RecordBatch:
    """Header of each file, by line, by run of words and as a whole."""
    hashed, row, line = _words(batch.column("text"))
    term, n = _term_of(m.terms, hashed), batch.num_rows
    whole, whole_near = cosines(m, row, term, n)
    new = np.r_[True, (row[1:] != row[:-1]) | (line[1:] != line[:-1])] if len(row) else np.zeros(0, bool)
    part = np.cumsum(new) - 1
    owner, at = row[new], line[new]
    template, near = cosines(m, part, term, len(owner))
    notices = np.bincount(owner[near >= NEAR], minlength=n)
    lines = np.bincount(owner, minlength=n)
    is_file = (whole_near >= NEAR) | ((notices > 0) & (notices >= lines * FILE_SHARE))
    license_, similarity, where = np.full(n, None, object), np.zeros(n), np.full(n, -1)
    order = np.lexsort((at, -near, owner))
    first = order[np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0])] if len(order) else order
    similarity[owner[first]] = near[first]
    base = np.zeros(n, np.int64)
    base[owner[::-1]] = at[::-1]
    where[owner[first]] = at[first] - base[owner[first]]
    names = np.array(m.names, object)
    license_[owner[first]] = names[template[first]]
    chosen = np.full(n, -1)
    chosen[owner[first]] = template[first]
    start, kind, found = windows(m, row, term)
    begin = np.searchsorted(row, np.arange(n))
    title = (kind >= TITLES) & (start - begin[row[start]] < OPENING)
    order = np.lexsort((start, -found, ~title, row[start]))
    top = order[np.flatnonzero(np.r_[True, np.diff(row[start][order]) != 0])] if len(order) else order
    own = row[start[top]]
    top = top[title[top] | (found[top] > similarity[own] + 1e-6)
              | (chosen[own] >= 0) & m.within[chosen[own], kind[top]]]
    own = row[start[top]]
    is_file[own[title[top]]] = True
    license_[own], similarity[own] = names[kind[top]], found[top]
    where[own] = line[start[top]] - base[own]
    settled = np.zeros(n, bool)
    settled[own[title[top]]] = True
    better = (whole_near > similarity) & ~settled
    license_[better], similarity[better], where[better] = names[whole[better]], whole_near[better], 0
    license_[similarity < NEAR] = None
    where[similarity < NEAR] = -1
    return pa.RecordBatch.from_pydict({
        "row": batch.column("row"), "license": pa.array(license_, pa.string()),
        "similarity": pa.array(similarity), "line": pa.array(where.astype(np.int32)),
        "is_file": pa.array(is_file)})


def directory(path):
    """The path without its last part, null for a null path."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(
        F.when(F.col(path).isNotNull(), F.lit("")))


def scan(files: DataFrame, key: str = "path") -> DataFrame:
    """License of every file (``key``, path and text): key, path, license, similarity, how (header, file,
    inherited or null), the licence file it comes from, and the line."""
    spark = files.sparkSession
    files = files.select(*dict.fromkeys([key, "path", "text"]))
    sent = spark.sparkContext.broadcast(fit(files))
    names = [F.col(c).alias(f"in_{c}") for c in files.columns if c != "text"]
    # The texts go through once, beside what the row keeps of them.
    rows = files.select(F.monotonically_increasing_id().alias("row"), "text", *names)
    kept = [f"in_{c}" for c in files.columns if c != "text"]
    schema = ", ".join([OWN, *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)])

    def run(batches):
        for batch in slices(batches):
            found = headers(batch, sent.value)
            yield pa.RecordBatch.from_arrays([*found.columns, *(batch.column(c) for c in kept)],
                                             names=[*found.schema.names, *kept])

    folder = scratch_dir(spark, "licenses")
    rows.mapInArrow(run, schema).withColumn("dir", directory("in_path")).write.parquet(folder)
    own = spark.read.parquet(folder)
    # One licence per directory that has a licence file.
    held = own.where("is_file and license is not null and dir is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("similarity")).alias("s"), "in_path", "license")).alias("top"))
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))),
                        lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))
    dirs = own.where("dir is not null").select("dir").distinct()
    upward = dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "up"))
    licensed = held.select(F.col("dir").alias("up"), "top")
    inherited = upward.join(licensed, "up").groupBy("dir").agg(F.max_by("top", "depth").alias("top"))
    joined = own.join(inherited, "dir", "left")
    how = F.when(F.col("license").isNotNull(), F.when(F.col("is_file"), "file").otherwise("header")) \
        .when(F.col("top").isNotNull(), "inherited")
    return joined.select(
        *[F.col(f"in_{c}").alias(c) for c in files.columns if c != "text"],
        F.coalesce("license", "top.license").alias("license"),
        F.when(F.col("license").isNotNull() | F.col("top").isNotNull(),
               F.when(F.col("license").isNotNull(), F.col("similarity")).otherwise(-F.col("top.s")))
        .alias("similarity"),
        how.alias("how"), F.when(how == "inherited", F.col("top.in_path")).alias("from_path"),
        F.when(F.col("line") >= 0, F.col("line")).alias("line"))


def placed(docs: DataFrame) -> DataFrame:
    """Documents as files: a directory by source, below it directories of 1000 and of 100 ids; every tenth
    document lies in the upper one, three of ten in the middle one."""
    id_ = F.col("doc_id")
    middle = F.concat(F.lit("/"), F.floor(id_ / 1000).cast("string"))
    lower = F.concat(F.lit("/"), F.floor(id_ / 100).cast("string"))
    place = F.when(F.pmod(id_, F.lit(10)) == 0, "").when(F.pmod(id_, F.lit(10)) < 4, middle).otherwise(
        F.concat(middle, lower))
    return docs.select("doc_id", F.concat("source", place, F.lit("/"), id_.cast("string")).alias("path"), "text")
