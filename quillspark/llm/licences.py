"""License scans, with DataFrame operations only.

Headers of files are compared with header templates, and whole licence files with licence
texts as well, by sparse TF-IDF cosine: a text's weighted terms join the templates' terms by
term, products are summed per text and template, and a text stands for the template of
highest cosine at or above ``threshold``.  A file without a match of its own inherits from the
nearest ancestor directory that holds a licence file with a match: paths explode into their
ancestor directories, which join the licence directories by path, and the deepest wins.

Headers: every line, and every two to ``WINDOW`` neighbouring lines as one (sentences run over
line ends), wherever they stand, since one file may hold several joined ones.  Those whose
cosine can't reach the threshold by an exact bound are left out where a file is read; no word
or phrase is asked for.  Equal lines are scored once.  Document frequencies are counted over
the templates, so the corpus is shuffled by line only.

Defined cases: null or empty texts have no header; null paths have no ancestors; a tie
between templates goes to the first by name; repeated rows keep one result row each, extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_table, written

# Sentences that stand for public licences, by SPDX identifier; "#" parts variants.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "BSD-3-Clause#name": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0#name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0#name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "CC0 1.0 Universal public domain dedication.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy.",
    "MIT#name": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Proprietary#long": "No part of this work may be reproduced without permission. Copyright, all rights reserved.",
}
TEMPLATES |= {
    "AGPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0#header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-2.0#header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0#header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1#header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
}
# Whole licence texts, for licence files.
_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NO_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_HOLDERS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
TEXTS = {
    "BSD-2-Clause#text": _REDISTRIBUTE + _HOLDERS,
    "BSD-3-Clause#text": _REDISTRIBUTE + _NO_NAME + _HOLDERS,
    "ISC#text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT#text": _PERMIT + _AS_IS,
    "Unlicense#text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS,
}
#: Frequent words, most frequent first; a line of these alone is left out where that provably can't reach the threshold.
COMMON = "the of and to in a is for that on with as by this be or are from at it an not no you can may all any 1 2 3 0 4 under part work either later free form person public use file terms version option http www org software published".split()
#: Neighbouring lines that are also read as one, for sentences that run over line ends.
WINDOW = 3
PARTING = r"[^\p{L}\p{N}]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda uses it."""
    return F.transform(F.array(value), body)[0]


def terms(text: Column) -> Column:
    """Lower-case words and numbers of a line, neighbouring pairs included."""
    pairs = lambda words: F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    none = F.array().cast("array<string>")
    return _let(F.filter(F.split(F.lower(text), PARTING), lambda w: w != ""), lambda words: F.concat(words, F.when(F.size(words) > 1, pairs(words)).otherwise(none)))


def _vectors(rows: DataFrame, key: str) -> DataFrame:
    """key, term and term frequency of the rows' ``line``."""
    return rows.select(key, F.explode(terms(F.col("line"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def template_vectors(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, float]:
    """Unit vectors of the templates with each term's inverse document frequency, and the idf of unknown terms.

    A few hundred rows, bounded by the templates given.
    """
    rows = small_table(spark, "licence string, line string", sorted(templates.items()))
    tf = _vectors(rows, "licence")
    n = len(templates)
    idf = tf.groupBy("term").agg((F.log((F.lit(1.0) + n) / (F.count("*") + 1)) + 1).alias("idf"))
    weighted = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, "licence").select("licence", "term", "idf", (F.col("w") / F.col("norm")).alias("w")), math.log(1.0 + n) + 1


def match(tf: DataFrame, key: str, templates: dict[str, str], threshold: float) -> DataFrame:
    """key, licence and cosine of the texts (key, term, tf) that reach the threshold."""
    vectors, unknown = template_vectors(tf.sparkSession, templates)
    idf = F.broadcast(vectors.groupBy("term").agg(F.max("idf").alias("idf"), F.collect_list(F.struct("licence", "w")).alias("in")))  # the templates' terms
    weighted = tf.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    # each text's norm, and its products with the templates: both are sums over its terms
    parts = weighted.select(key, (F.col("w") * F.col("w")).alias("square"), F.explode(F.concat(F.array(F.struct(F.lit("").alias("licence"), F.lit(0.0).alias("p"))), F.coalesce(F.transform("in", lambda x: F.struct(x.licence.alias("licence"), (x.w * F.col("w")).alias("p"))), F.array().cast("array<struct<licence:string,p:double>>")))).alias("x"))
    sums = parts.groupBy(key, "x.licence").agg(F.sum("x.p").alias("dot"), F.sum("square").alias("squares"))
    best = sums.groupBy(key).agg(
        F.max(F.when(F.col("licence") == "", F.col("squares"))).alias("squares"),
        F.min(F.when(F.col("licence") != "", F.struct((-F.round("dot", 9)).alias("minus"), F.col("licence").alias("licence")))).alias("best"),
    )
    cosine = F.round(-F.col("best.minus") / F.sqrt("squares"), 6)
    return best.select(key, F.substring_index("best.licence", "#", 1).alias("licence"), cosine.alias("cosine")).where(F.col("cosine") >= threshold)


def match_lines(lines: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """line, licence and cosine of different lines that reach the threshold."""
    return match(_vectors(lines.select("line").distinct(), "line"), "line", templates, threshold)


class Bound(NamedTuple):
    """Exact bounds of a text's cosines: none that reaches the threshold is left out."""

    reaches: Callable[[Column], Column]  #: whether a text can reach the threshold
    marked: Callable[[Column], Column]  #: a line with what bounds the windows it is in
    fits: Callable[[Column], Column]  #: whether a window of marked lines can reach the threshold


def bound_of(spark: SparkSession, templates: dict[str, str], threshold: float) -> Bound | None:
    """Bounds for these templates, null without any term.

    Frequent words are chosen so that in no template the terms made of them alone weigh
    ``threshold`` or more: without any other template word (a hot line has one) the cosine stays
    below. A line's gain is the sum of its terms' greatest products with any template, rounded
    up; a window's dot product is at most its lines' gains and one pair at each line end, and its
    norm at least that of the unknown terms of any of its lines. For texts that pass these,
    products with each template are whole, and each unknown term counts once in the norm.
    """
    vectors, unknown = template_vectors(spark, templates)
    found = vectors.collect()
    if not found:
        return None
    names = {n: i for i, n in enumerate(sorted({r.licence for r in found}))}
    least = (threshold - 1e-5) * abs(threshold - 1e-5)
    common: set[str] = set()
    for word in COMMON:
        more = common | {word}
        sums = dict.fromkeys(names, 0.0)
        for r in found:
            if more.issuperset(r.term.split()):
                sums[r.licence] += r.w * r.w
        if max(sums.values()) < least:
            common = more
    rare = sorted({w for r in found for w in r.term.split()} - common)
    weights: dict[str, dict] = {r.term: {"idf": r.idf, "p": [0.0] * len(names)} for r in found}
    for r in found:
        weights[r.term]["p"][names[r.licence]] = r.w * r.idf
    known = sorted(weights)
    table = F.from_json(F.lit(json.dumps(weights)), "map<string, struct<idf: double, p: array<double>>>")  # a literal after optimisation

    def reaches(text: Column) -> Column:
        def bound(every: Column, own: Column) -> Column:
            counted = F.transform(F.array_distinct(own), lambda t: F.struct(F.size(F.filter(own, lambda x: x == t)).cast("double").alias("tf"), F.element_at(table, t).alias("x")))
            return _let(counted, lambda c: passes(every, c))

        def passes(every: Column, c: Column) -> Column:
            dots = F.aggregate(c, F.array_repeat(F.lit(0.0), len(names)), lambda sums, y: F.zip_with(sums, y.x.p, lambda s, w: s + w * y.tf))
            square = F.aggregate(c, F.lit(0.0), lambda s, y: s + F.pow(y.tf * y.x.idf, F.lit(2.0)))
            others = F.size(F.array_distinct(every)) - F.size(c)
            return F.array_max(dots) >= (threshold - 1e-5) * F.sqrt(square + others * (unknown * unknown))

        return _let(terms(text), lambda every: _let(F.filter(every, lambda t: t.isin(known)), lambda own: F.coalesce(bound(every, own), F.lit(False))))

    gains: dict[str, float] = {}
    for r in found:
        gains[r.term] = max(gains.get(r.term, 0.0), r.w * r.idf)
    levels: dict[int, list[str]] = {}
    for term, gain in sorted(gains.items()):
        levels.setdefault(math.ceil(math.log(gain, 1.25)), []).append(term)
    edge = max((g for t, g in gains.items() if " " in t), default=0.0)  # of a pair over a line end

    def gain_of(term: Column) -> Column:
        out = F.lit(0.0)
        for level in sorted(levels, reverse=True):
            out = F.when(term.isin(levels[level]), 1.25**level * (1 + 1e-9)).otherwise(out)
        return out

    def marked(line: Column) -> Column:
        def mark(every: Column, own: Column) -> Column:
            gain = F.aggregate(own, F.lit(0.0), lambda s, t: s + gain_of(t))
            others = F.size(F.array_distinct(every)) - F.size(F.array_distinct(own))
            return F.struct(line.alias("line"), F.exists(own, lambda t: t.isin(rare)).alias("hot"), gain.alias("gain"), others.alias("others"))

        return _let(terms(line), lambda every: _let(F.filter(every, lambda t: t.isin(known)), lambda own: mark(every, own)))

    def fits(window: Column) -> Column:
        dot = F.aggregate(window.gain, edge * (F.size(window) - 1), lambda s, g: s + g)
        return F.exists(window.hot, lambda x: x) & (dot >= (threshold - 1e-5) * unknown * F.sqrt(F.array_max(window.others)))

    return Bound(reaches, marked, fits)


def candidates(text: Column, spark: SparkSession, templates: dict[str, str], threshold: float) -> Column:
    """The different lines, and windows of up to ``WINDOW`` lines, that can reach the threshold."""
    bound = bound_of(spark, templates, threshold)
    if bound is None:
        return F.array().cast("array<string>")
    lines = F.filter(F.transform(F.split(text, r"[\n\r]+"), lambda x: F.trim(x)), lambda x: x.rlike(r"[\p{L}\p{N}]"))

    def windows(m: Column) -> Column:
        sizes = lambda i: F.sequence(F.lit(1), F.least(F.lit(WINDOW), F.size(m) - i + 1))
        from_line = lambda i: F.filter(F.transform(sizes(i), lambda k: F.slice(m, i, k)), bound.fits)
        joined = F.transform(F.flatten(F.transform(F.sequence(F.lit(1), F.size(m)), from_line)), lambda w: F.array_join(w.line, " "))
        return F.when(F.exists(m, lambda x: x.hot), F.array_distinct(F.filter(joined, bound.reaches)))

    return _let(F.transform(lines, bound.marked), windows)


def scan(files: DataFrame, threshold: float = 0.5, templates: dict[str, str] | None = None, texts: dict[str, str] | None = None, licence_names: str = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$") -> DataFrame:
    """doc_id, path, own licence, licence in effect, how it came ('header', 'inherited', null) and the directory it came from.

    ``files`` has doc_id, path and text.  ``templates`` are headers; licence files are compared
    whole with these and ``texts`` (given templates alone stand for both).
    """
    texts = TEXTS if texts is None and templates is None else texts or {}
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.coalesce(F.col("path").cast("string").rlike(licence_names), F.lit(False))
    whole = bound_of(spark, templates | texts, threshold)
    held = F.when(named & whole.reaches(text), text) if whole else F.lit(None).cast("string")
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), candidates(text, spark, templates, threshold).alias("lines"), held.alias("whole"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "licence-rows")
    found = rows.select("row", F.posexplode("lines").alias("pos", "line"))
    matched = found.join(match_lines(found, templates, threshold), "line").select("row", "pos", "licence", "cosine")
    wholes = match(_vectors(rows.where("whole is not null").select("row", F.col("whole").alias("line")), "row"), "row", templates | texts, threshold)
    matched = matched.unionByName(wholes.withColumn("pos", F.lit(-1)))
    own = matched.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "pos", "licence")).alias("m")).select("row", F.col("m.licence").alias("own"), (-F.col("m.minus")).alias("cosine"))
    rows = rows.drop("lines", "whole").join(own, "row", "left")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    is_licence = F.col("path").rlike(licence_names) & F.col("own").isNotNull()
    folders = rows.where(is_licence).groupBy(folder.alias("folder")).agg(F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("own").alias("licence"))).alias("m")).select("folder", F.col("m.licence").alias("inherited"))
    # different folders of files without a licence meet the licence folders among their ancestors
    bare = rows.where("own is null and path is not null").select(folder.alias("of")).distinct()
    parts = F.split("of", "/")
    ancestors = bare.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    nearest = ancestors.join(folders, "folder").groupBy("of").agg(F.max(F.struct(F.length("folder").alias("n"), "folder", "inherited")).alias("m")).select("of", "m.folder", "m.inherited")
    rows = rows.withColumn("_of", F.when(F.col("own").isNull(), folder)).join(nearest, F.col("_of") == F.col("of"), "left")
    how = F.when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited")
    return rows.select("doc_id", "path", "own", "cosine", F.coalesce("own", "inherited").alias("licence"), how.alias("how"), F.when(F.col("own").isNull(), F.col("folder")).alias("folder"))
