"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import small, text_of, written
from quire.llm.quality import let

_FREE = "is free software: you can redistribute it and/or modify it under the terms of the"
_LATER = "as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_NO_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
_GNU = (
    ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3"),
    ("GPL-2.0", "program", "General Public License", "2"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    ("LGPL-3.0", "program", "Lesser General Public License", "3"), ("LGPL-2.1", "program", "Lesser General Public License", "2.1"),
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Fixed values: (license, text) of templates: the names, notices and marked phrases of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    *[(name, f"This {what} {_FREE} GNU {kind} {_LATER.format(version)}") for name, what, kind, version in _GNU],
    *[(name, f"This {what} {_FREE} GNU {kind} {_LATER.format(version)} {_NO_WARRANTY.format(kind)}") for name, what, kind, version in _GNU],
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MIT", f"MIT License Copyright (c) {_MIT}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: A line is compared if it has a word of this pattern.
MARK = r"(?i:licen[sc]|copyright|spdx|redistribut|public domain|permission is hereby|free software|creative commons)|\bCC[ -]?(?:BY|0)\b|\bGPL"
#: The same where lines are joined: line ends and comment marks may stand between its words.
_GAP = r"[\s#*/;%>|-]+"
BLOCK_MARK = MARK.replace("public domain", f"public{_GAP}domain").replace("permission is hereby", f"permission{_GAP}is{_GAP}hereby").replace("free software", f"free{_GAP}software").replace("creative commons", f"creative{_GAP}commons").replace("[ -]?", f"(?:{_GAP})?")
#: Lines without a word, and ends of lines where a comment starts or stops, part blocks.
_EMPTY = r"(?m)^[ \t#*/;%<>!|-]*$"
_COMMENT = r"[ \t]*(?:[#*;%]|//|/\*|--|<!--)"
_EDGE = rf"(?m)^({_COMMENT}.*|.*(?:\*/|-->)[ \t]*)\n(?!{_COMMENT})|^(?!{_COMMENT})(.+)\n(?={_COMMENT})"
#: The mark in terms of a text, where a space parts them.
TERM_MARK = r"licen[sc]|copyright|spdx|redistribut|public domain|permission is hereby|free software|creative commons|\bcc (?:by|0)|\bcc0|\bgpl"
#: Terms of a window over a longer block; windows of a width start every quarter of it.
WINDOWS = (8, 16, 32, 64)
#: Least cosine of a match.
LEAST = 0.6
#: Files whose whole content is a license, by name.
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense)(?:[-.][^/]*)?$"


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"), F.lit(0))


def template_weights(spark: SparkSession) -> DataFrame:
    """(term, idf, [(template, license, weight)]): unit vectors of the templates' TF-IDF, by term.

    The document frequencies are those of the templates, which the weights and
    so the results depend on alone; the table has a row per template term.
    """
    n = len(TEMPLATES)
    listed = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for k, (name, text) in enumerate(TEMPLATES)])
    rows = spark.range(1).select(F.inline(listed))
    tf = rows.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0).alias("idf"))
    w = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    w = w.withColumn("w", F.col("w") / norm)
    return w.groupBy("term").agg(F.first("idf").alias("idf"), F.sort_array(F.collect_list(F.struct("template", "license", "w"))).alias("postings"))


def windows(found: Column) -> Column:
    """The marked windows over an array of terms, as texts; of widths that the array doesn't reach there are none."""

    def of_width(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(found), F.lit(width // 4))
        return F.when(F.size(found) > width, F.transform(starts, lambda k: F.array_join(F.slice(found, k, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.filter(F.concat(*map(of_width, WINDOWS)), lambda x: x.rlike(TERM_MARK)))


def stated_units(files: DataFrame, id_col: str, text_col: str, path: Column) -> DataFrame:
    """(doc_id, path, part, no, unit) of what may state a license in whole texts.

    Parts are 0, the marked lines; 1, the marked blocks of several lines: runs
    of lines with words that are all comments or all not; 2, whole licence
    files; 3, marked windows over the terms of marked blocks, whatever their
    length, for notices inside longer lines and paragraphs.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"), text_of(text_col).alias("text"))
    rows = rows.withColumn("named", F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)))
    units = lambda part, values: F.transform(values, lambda x, i: F.struct(F.lit(part).alias("part"), i.alias("no"), x.alias("unit")))
    lines = F.filter(units(0, F.split("text", r"[\n\r]")), lambda s: s["unit"].rlike(MARK))
    parted = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), _EMPTY, ""), _EDGE, "$1$2\n\n")
    every = F.filter(units(1, F.split(parted, r"\n\n+")), lambda s: s["unit"].rlike(BLOCK_MARK))
    blocks = F.filter(every, lambda s: s["unit"].contains("\n"))
    inside = units(3, F.flatten(F.transform(every, lambda s: let(terms(s["unit"]), windows))))
    whole = F.when(F.col("named"), units(2, F.array("text"))).otherwise(F.array().cast("array<struct<part:int,no:int,unit:string>>"))
    rows = rows.select("doc_id", "path", F.when(F.col("named") | F.col("text").rlike(BLOCK_MARK), F.concat(lines, blocks, whole, inside)).alias("hits"))
    return rows.select("doc_id", "path", F.explode("hits").alias("hit")).select("doc_id", "path", "hit.part", "hit.no", "hit.unit")


def scan_licenses(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The license of each file: of its own text, else of the nearest directory above.

    Every line and every block of joined lines that may state a license, every
    window over such a block, and every licence file as a whole, is compared with every template that shares
    a term, by cosine of TF-IDF vectors; terms that no template has count with
    the greatest idf. The best of a file decides, of equal cosines the unit
    that stands first (lines before blocks), and in a unit the template that does. A directory has the license of the
    licence files in it (the best match; of equal ones, the path that sorts
    first), and where it has none the license that is stated by files directly
    in it if they all agree. A file without its own takes that of the nearest
    directory above it that has one.

    Returns a row per input row: ``doc_id``, ``path``, ``license``, ``how``
    ("own", "inherited" or null), ``score`` and ``from_path`` (the directory).
    Null and empty texts state nothing but inherit; a null path has no
    directories. Repeated rows are given the same license. An empty table gives
    an empty result; other columns aren't read.
    """
    spark = files.sparkSession
    weights = F.broadcast(template_weights(spark))
    top = 1.0 + F.log(F.lit(1.0 + len(TEMPLATES)))
    # equal units are compared once, whatever number of files has them; a digest stands for them in groups
    stated = stated_units(files, id_col, text_col, path).withColumn("key", F.unhex(F.sha2("unit", 256)))
    stated = written(stated, "stated")
    units = stated.groupBy("key").agg(F.first("unit").alias("unit"))
    each = units.select("key", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    each = each.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", top))
    norms = each.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = each.select("key", F.col("w").alias("own"), F.explode("postings").alias("p")).groupBy("key", "p.template", "p.license").agg(F.sum(F.col("own") * F.col("p.w")).alias("dot"))
    scored = dots.join(norms, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    best = F.max_by(F.struct("license", "score"), F.struct("score", -F.col("template"))).alias("best")
    found = small(written(scored.groupBy("key").agg(best), "units"), 200)
    own = stated.select("doc_id", "path", "part", "no", "key").join(found, "key").groupBy("doc_id", "path").agg(F.max_by(F.col("best"), F.struct(F.col("best.score"), -F.col("part"), -F.col("no"))).alias("best"))
    own = written(own.select("doc_id", "path", F.col("best.license").alias("own_license"), F.col("best.score").alias("own_score")), "own")

    parent = F.regexp_replace("path", "/?[^/]*$", "")
    here = own.filter("path is not null").withColumn("dir", parent)
    named = here.filter(F.col("path").rlike(LICENSE_FILE)).groupBy("dir").agg(F.min_by("own_license", F.struct(-F.col("own_score"), "path")).alias("named"))
    agreed = here.groupBy("dir").agg(F.min("own_license").alias("low"), F.max("own_license").alias("high"))
    agreed = agreed.join(named, "dir", "left").select("dir", F.coalesce("named", F.when(F.col("low") == F.col("high"), F.col("low"))).alias("dir_license"))
    dirs = small(written(agreed.filter("dir_license is not null"), "dirs"), 200)

    rows = files.select(F.col(id_col).alias("doc_id"), path.alias("path"))
    paths = rows.select(parent.alias("below")).filter("below is not null").distinct()
    parts = F.split("below", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))
    nearest = paths.select("below", F.explode(above).alias("up")).select("below", "up.depth", "up.dir").join(dirs, "dir")
    nearest = nearest.groupBy("below").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("nearest"))
    nearest = small(written(nearest, "nearest"), 200)

    mine = own.toDF("_doc_id", "_path", "own_license", "own_score")
    out = rows.join(mine, rows["doc_id"].eqNullSafe(mine["_doc_id"]) & rows["path"].eqNullSafe(mine["_path"]), "left").withColumn("below", parent).join(nearest, "below", "left")
    has = F.col("own_license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("own_license", "nearest.dir_license").alias("license"),
        F.when(has, "own").when(F.col("nearest").isNotNull(), "inherited").alias("how"),
        F.col("own_score").alias("score"), F.when(~has, F.col("nearest.dir")).alias("from_path"),
    )


def document_path(files: DataFrame) -> Column:
    """A path for documents that have none: source, language and hundreds of ids as directories."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    return F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("_")), part("doc_id"))
