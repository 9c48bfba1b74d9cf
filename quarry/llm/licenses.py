"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a text that speaks of a licence is compared with each template: the cosine of their
TF-IDF vectors, whose inverse frequencies come from the templates (a word of no template weighs as one
of a template's rarest).  So is, with notices, titles and whole texts, a document's header block (the
paragraphs of its leading comment, or else its first paragraphs, that speak of a licence) and the whole
text of a licence file (named so, or not a comment and begun with such a paragraph).  The best template at or above `least` is the document's own licence; ties go
to the name that sorts first.  A document without one inherits from the nearest directory above it
that has a licence file.  A licence file gives its licence if it is named so or begins with it; if a directory
has several, that of the path that sorts first counts.

Only lines, blocks and licence files that a cue selects are exploded into words; the texts that hold a cue are dealt out once, before
that, so the shuffles carry these and paths, never other texts or single words.  The templates are a fixed small table.  Built-in functions only.

Edge cases: null and empty texts have no licence of their own and may inherit; texts are searched
whole; rows with a null path neither give nor inherit; rows with the same path are joined as one file
but returned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from .license_texts import TEXTS

#: Licences with their SPDX ids, as titles and headings write them.
TITLES = [
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"), ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"), ("GPL-2.0", "GNU General Public License Version 2, June 1991"), ("GPL-2.0", "GNU General Public License version 2"), ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "GNU General Public License version 3"), ("ISC", "ISC License"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"), ("MIT", "MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
SPDX = [(name, f"SPDX-License-Identifier: {name}{end}") for name, ends in (("AGPL-3.0", ("", "-only", "-or-later")), ("CC-BY-4.0", ("",)), ("CC-BY-NC-4.0", ("",)), ("CC-BY-SA-4.0", ("",)), ("GPL-2.0", ("", "-only", "-or-later")), ("GPL-3.0", ("-only", "-or-later")), ("ISC", ("",)), ("LGPL-2.1", ("", "-only", "-or-later")), ("LGPL-3.0", ("", "-only", "-or-later")), ("MPL-2.0", ("",))) for end in ends]
_GNU = "This {0} is free software{4} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
_FREE = [(name, what, kind, version) for name, what, kind, version in (("AGPL-3.0", "program", "Affero ", "3"), ("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"))]
#: Notices that stand in headers, first sentence and whole.
NOTICES = [("Apache-2.0", _APACHE), ("MPL-2.0", _MPL)] + [(name, (_GNU + rest).format(what, kind, version, "", ":")) for name, what, kind, version in _FREE for rest in ("", _GNU_REST)]
#: Fixed texts: how notices name their licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    *TITLES,
    *SPDX,
    *NOTICES,
]
#: What header blocks and licence files are compared with; the weights of words are of these.
BLOCKS = TITLES + NOTICES + TEXTS
CUE = r"(?i)licen[sc]e|copyright|spdx|redistribution"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LEAST = 0.6
#: Paths of licence files, and how a comment begins and its lines do.
NAMED = r"(?i)(?:licen[sc]e|copying|notice)[^/]*$"
COMMENT = r"^(?:/\*|<!--|\"\"\"|[\"']{3}|#|//|--|;|%)"
COMMENTED = r"^\s*(?:#|//|--|;|%|\*|$)"
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|\"\"\"|[\"']{3})"


def template_weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], float]:
    """(template, licence, word, weight) with vectors of length 1, and the weight of an unknown word."""
    words = [Counter(re.findall(WORD, text.lower())) for _, text in templates]
    seen = Counter(w for found in words for w in found)
    idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in seen.items()}
    rows = []
    for k, ((name, _), found) in enumerate(zip(templates, words)):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in found.items()))
        rows += [(k, name, w, n * idf[w] / norm) for w, n in sorted(found.items())]
    return rows, math.log((1 + len(templates)) / 2) + 1


def _scored(units: DataFrame, least: float) -> DataFrame:
    """row, line, license and score of every template that a unit (row, line, said) comes near.

    Lines are compared with TEMPLATES and blocks, whose numbers are negative, with BLOCKS.  Every step groups by row and more, so rows that
    come dealt out by row are not dealt again.
    """
    spark = units.sparkSession
    weights, idf, unknown = [], [], {}
    for block, against in ((False, TEMPLATES), (True, BLOCKS)):
        found, unknown[block] = template_weights(against)
        weights += [(block, *row) for row in found]
        seen = Counter(w for _, text in against for w in set(re.findall(WORD, text.lower())))
        idf += [(block, w, math.log((1 + len(against)) / (1 + n)) + 1) for w, n in seen.items()]
    templates = F.broadcast(spark.createDataFrame(weights, "block boolean, template int, license string, word string, weight double"))
    idf = F.broadcast(spark.createDataFrame(idf, "block boolean, word string, idf double"))
    words = units.select("row", "line", (F.col("line") < 0).alias("block"), F.explode(F.regexp_extract_all(F.lower("said"), F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("row", "line", "block", "word").agg(F.count("*").alias("n")).join(idf, ["block", "word"], "left")
    counted = counted.withColumn("value", F.col("n") * F.coalesce("idf", F.when(F.col("block"), unknown[True]).otherwise(unknown[False])))
    known = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "value")))  # no more than the templates have words
    vectors = counted.groupBy("row", "line", "block").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), known.alias("known"))
    each = vectors.select("row", "line", "block", "norm", F.explode("known").alias("w")).select("row", "line", "block", "norm", "w.*")
    dots = each.join(templates, ["block", "word"]).groupBy("row", "line", "norm", "template", "license").agg(F.sum(F.col("value") * F.col("weight")).alias("dot"))
    return dots.select("row", "line", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= least)


def _blocks(text: Column, named: Column) -> Column:
    """The header block and, of a licence file, the whole text."""
    body = F.regexp_replace(text, r"\A\s*+(?:#![^\n]*+\n\s*+)?+", "")
    lines = F.split(body, "\n")
    end = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(COMMENTED))), False).cast("int")
    run = F.array_join(F.when(end == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(end - 1, F.lit(0)))), "\n")
    head = F.when(body.startswith("/*"), F.substring_index(body, "*/", 1)).when(body.startswith("<!--"), F.substring_index(body, "-->", 1))
    head = head.when(body.startswith('"""'), F.substring_index(body, '"""', 2)).when(body.startswith("'''"), F.substring_index(body, "'''", 2))
    comment = F.rlike(body, F.lit(COMMENT))
    paragraphs = F.split(F.when(comment, F.regexp_replace(head.otherwise(run), MARKS, "")).otherwise(body), r"\n[ \t\r]*+\n")
    silent = F.array_position(F.transform(paragraphs, lambda x: F.rlike(x, F.lit(CUE))), False).cast("int")
    first = F.when(silent == 0, paragraphs).otherwise(F.slice(paragraphs, F.lit(1), F.greatest(silent - 1, F.lit(0))))
    block = F.array_join(F.when(comment, F.filter(paragraphs, lambda x: F.rlike(x, F.lit(CUE)))).otherwise(first), " ")
    return F.filter(F.array(block, F.when(named | (~comment & (silent != 1)), body)), lambda x: x.isNotNull() & (x != ""))


def own_licenses(documents: DataFrame, row: str, text: str = "text", least: float = LEAST, path: str | None = None) -> DataFrame:
    """row, line (its number; 0 for a block), license and score of the best licence line or block of each text that has one."""
    named = F.coalesce(F.rlike(F.col(path), F.lit(NAMED)), F.lit(False)) if path else F.lit(False)
    # the texts that speak of a licence are dealt out once, by row; rows alike count once
    chosen = documents.where(F.col(text).rlike(CUE)).select(F.col(row).alias("row"), F.col(text).alias("text"), named.alias("named")).dropDuplicates(["row"])
    unit = lambda x, line: F.struct(line.cast("int").alias("line"), x.alias("said"))
    lines = F.filter(F.transform(F.split("text", "\n"), unit), lambda u: F.rlike(u["said"], F.lit(CUE)))
    # block and whole text are told apart by -1 and -2 until the best is known
    blocks = F.transform(_blocks(F.col("text"), F.col("named")), lambda x, k: unit(x, -1 - k))
    scored = _scored(chosen.select("row", F.explode(F.concat(lines, blocks)).alias("u")).select("row", "u.*"), least)
    # the best line and licence of a text: a row a text, so no group grows
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", "line")).alias("best"))
    return best.select("row", F.greatest(F.col("best.line"), F.lit(0)).alias("line"), F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def _parents(path: Column) -> Column:
    """The directories above a path, nearest first; the last is the root (the empty string)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(documents: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: float = LEAST) -> DataFrame:
    """The `keep` columns with license, score, origin (own or inherited) and license_path; null without any."""
    rows = documents.select(F.struct(*keep).alias("kept"), F.col(path).alias("path"), F.col(text).alias("text")).withColumn("row", F.struct("path", F.xxhash64("text").alias("hash")))
    own = written(own_licenses(rows, "row", "text", least, "path"), "licenses")
    # a null path would not join as part of a struct comparison, so compare null-safely
    light = rows.select("kept", F.col("row").alias("__row"))
    judged = light.join(own, F.col("__row").eqNullSafe(F.col("row")), "left").select("kept", F.col("__row.path").alias("path"), "license", "score")
    folder = lambda p: F.element_at(_parents(F.col(p)), 1)
    files = own.select("row.path", "license", "score", "line").where(F.col("path").isNotNull() & ((F.col("line") == 0) | F.rlike("path", F.lit(NAMED))))
    files = files.select(folder("path").alias("folder"), F.struct("path", "license", "score").alias("file")).groupBy("folder").agg(F.min("file").alias("file"))
    # what is above a file is above all files of its directory
    above = rows.where("path is not null").select(_parents(F.col("path")).alias("parents")).distinct().select(F.element_at("parents", 1).alias("__folder"), F.posexplode("parents").alias("depth", "folder"))
    nearest = above.join(files, "folder").groupBy("__folder").agg(F.min(F.struct("depth", "file")).alias("found")).select("__folder", F.col("found.file").alias("file"))
    joined = judged.join(nearest, F.col("license").isNull() & (folder("path") == F.col("__folder")), "left")
    return joined.select(
        "kept.*",
        F.coalesce("license", "file.license").alias("license"),
        F.coalesce("score", "file.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("file").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("file.path")).alias("license_path"),
    )
