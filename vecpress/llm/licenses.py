"""Licence scans with DataFrame functions alone: sparse TF-IDF cosine of lines to templates, then
inheritance from the nearest directory above that has a licence file.

A line's vector holds its terms that aren't stop words. Terms of the templates weigh by the number
of lines of the whole corpus that hold them; any other term weighs as an unseen one and only makes
the line longer. A line without a template's term has cosine 0 with all templates, so such lines
are left out before terms are exploded; all others of a text are scored. The templates' table and
the weights of their terms don't grow with the corpus, so they are sent to all tasks.

Larger units are scored besides lines: sentences (which may wrap over lines, or stand within a long
one), blocks of adjacent lines that mostly hold words of notices, and whole licence files. Their
templates are licence texts, standard headers and titles too, and their terms weigh by the number
of licences that hold them. A unit needs a word of ``ANCHOR``, as each of its templates has.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecpress.session import materialize

# notices that headers and licence files hold: fixed values
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License: permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("ISC", "Released under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# the GNU licences' header: name and version differ
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program. If not, see https://www.gnu.org/licenses/.",
)
_GNU_NAMES = [
    ("GPL-2.0", "GNU General Public License", "2", "Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "Version 3, 19 November 2007"),
]
HEADERS = [
    *[(lic, " ".join(_GNU[:n]).format(name, version)) for lic, name, version, _ in _GNU_NAMES for n in (1, 2)],
    *[(lic, f"{name} {title}") for lic, name, _, title in _GNU_NAMES],
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]
ANCHOR = r"(?i)licen[sc]|copying|gnu|redistribut|public domain|permission|\bcc[ -]?(?:by|0)"
#: A sentence starts with a capital letter; marks of comments may stand before it.
SENTENCE = r"(?<=[.!?:;][^\p{L}\p{N}]{1,12})(?=[A-Z])"
#: Share of a line's words that notices hold, from which the line belongs to a block.
KNOWN = 0.6
STOP_WORDS = "a an and any are as at be by for form free from in into is it may not of on or person program software source subject terms the this to under use with without work you".split()
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying)(\.[a-z]+)?$"


def terms_of(text: str) -> Counter:
    return Counter(t for t in re.findall(TERM, text.lower()) if t not in STOP_WORDS)


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small table made of literals, within the JVM."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])))


def line_scores(docs: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """``doc_id, line_no, license, score``: lines whose best template has a cosine of at least ``least``."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, text in templates for t in terms_of(text)})
    some = "|".join(re.escape(t).replace(r"\-", "-") for t in vocabulary)
    n_lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    lines = docs.filter("text is not null").select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("line", F.lower("line")).filter(F.col("line").rlike(rf"(?<![a-z0-9])(?:{some})(?![a-z0-9])"))
    words = F.filter(F.regexp_extract_all("line", F.lit(f"({TERM})"), F.lit(1)), lambda w: ~w.isin(STOP_WORDS))
    tf = lines.select("doc_id", "line_no", F.explode(words).alias("term")).groupBy("doc_id", "line_no", "term").agg(F.count("*").alias("tf"))
    tf = materialize(tf, "terms")
    unseen = F.log(F.lit(1.0 + n_lines)) + 1
    known = F.broadcast(_rows(spark, [{"term": t} for t in vocabulary]))
    df = tf.join(known, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = known.join(df, "term", "left").select("term", (F.log(F.lit(1.0 + n_lines) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf"))
    in_templates = _rows(spark, [{"template": k, "license": lic, "term": t, "n": n} for k, (lic, text) in enumerate(templates) for t, n in sorted(terms_of(text).items())])
    weights = in_templates.join(F.broadcast(idf), "term").select("template", "license", "term", (F.col("n") * F.col("idf")).alias("w"))
    norms = weights.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    weights = weights.join(F.broadcast(norms), "template")
    weighted = tf.join(F.broadcast(idf), "term", "left").withColumn("w_line", F.col("tf") * F.coalesce("idf", unseen))
    length = weighted.groupBy("doc_id", "line_no").agg(F.sqrt(F.sum(F.col("w_line") * F.col("w_line"))).alias("norm"))
    dots = weighted.join(F.broadcast(weights), "term").groupBy("doc_id", "line_no", "template", "license", "t_norm").agg(F.sum(F.col("w_line") * F.col("w")).alias("dot"))
    scored = dots.join(length, ["doc_id", "line_no"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6))
    best = scored.groupBy("doc_id", "line_no").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b"))
    return best.select("doc_id", "line_no", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score")).filter(F.col("score") >= least)


@cache
def unit_templates() -> list[tuple[str, str]]:
    """Notices that name one licence, headers and titles, then whole texts."""
    # the first sentence of both BSD licences tells nothing apart
    notices = [t for t in TEMPLATES if not t[1].startswith("Redistribution")]
    texts = resources.files("vecpress.llm").joinpath("license_texts")
    return [*notices, *HEADERS, *[(lic, texts.joinpath(f"{lic}.txt").read_text("utf-8")) for lic in TEXTS]]


def _table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A larger table from one literal, within the JVM."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def unit_scores(docs: DataFrame, least: float) -> DataFrame:
    """``doc_id, line_no, license, score`` of sentences, blocks and licence files of ``docs(doc_id, text, is_file)``; line_no is a unit's first line."""
    spark = docs.sparkSession
    templates = [(lic, terms_of(text)) for lic, text in unit_templates()]
    of_term: dict[str, set] = {}
    for lic, terms in templates:
        for t in terms:
            of_term.setdefault(t, set()).add(lic)
    n = len({lic for lic, _ in templates})
    idf = {t: math.log((1 + n) / (1 + len(of_term[t]))) + 1 for t in sorted(of_term)}
    unseen = math.log(1 + n) + 1
    rows = []
    for k, (lic, terms) in enumerate(templates):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in terms.items()))
        rows += [{"template": k, "license": lic, "term": t, "w": c * idf[t] / norm} for t, c in sorted(terms.items())]
    weights = F.broadcast(_table(spark, rows, "template int, license string, term string, w double"))
    weight_of = F.broadcast(_table(spark, [{"term": t, "idf": v} for t, v in idf.items()], "term string, idf double"))
    notices = sorted({w for _, text in unit_templates() if len(text) < 3000 for w in re.findall(TERM, text.lower())})

    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), F.lit(1))
    rows_with = docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(ANCHOR)).withColumn("row", F.monotonically_increasing_id())
    lines = rows_with.select("row", "doc_id", "is_file", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("n", F.size(words("line"))).withColumn("known", F.size(F.filter(words("line"), lambda w: w.isin(notices))))
    lines = lines.withColumn("blank", F.col("n") == 0).withColumn("notice", (F.col("n") > 0) & (F.col("known") >= KNOWN * F.col("n")))
    order = Window.partitionBy("row").orderBy("line_no")
    lines = lines.withColumn("par", F.sum(F.col("blank").cast("int")).over(order)).withColumn("run", F.sum((~F.col("blank") & ~F.col("notice")).cast("int")).over(order))
    lines = materialize(lines.filter("not blank").drop("n", "known", "blank"), "notice-lines")

    def joined(some: DataFrame, kind: int, *by: str) -> DataFrame:
        got = some.groupBy("row", "doc_id", *by).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("of"))
        key = [F.col(c).cast("long") if c in by else F.lit(0).cast("long").alias(c) for c in ("par", "run")]
        return got.select("row", "doc_id", F.lit(kind).alias("kind"), *key, F.col("of")[0]["line_no"].alias("line_no"), F.array_join("of.line", "\n").alias("unit"))

    inside = Window.partitionBy("row", "par").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sentences = joined(lines, 0, "par").select("row", "doc_id", "kind", "par", "line_no", F.posexplode(F.split("unit", SENTENCE, -1)).alias("run", "unit"))
    before = F.coalesce(F.sum(F.length("unit") - F.length(F.replace("unit", F.lit("\n")))).over(inside), F.lit(0))
    sentences = sentences.select("row", "doc_id", "kind", "par", F.col("run").cast("long").alias("run"), (F.col("line_no") + before).cast("int").alias("line_no"), "unit")
    units = sentences.unionByName(joined(lines.filter("notice"), 1, "par", "run")).unionByName(joined(lines.filter("notice"), 2, "run")).unionByName(joined(lines.filter("is_file"), 3))

    key = ["row", "doc_id", "kind", "par", "run", "line_no"]
    terms = F.filter(words("unit"), lambda w: ~w.isin(STOP_WORDS))
    tf = units.filter(F.col("unit").rlike(ANCHOR)).select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighted = materialize(tf.join(weight_of, "term", "left").withColumn("w_unit", F.col("tf") * F.coalesce("idf", F.lit(unseen))), "unit-terms")
    length = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w_unit") * F.col("w_unit"))).alias("norm"))
    dots = weighted.join(weights, "term").groupBy(*key, "template", "license").agg(F.sum(F.col("w_unit") * F.col("w")).alias("dot"))
    scored = dots.join(length, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.groupBy(*key).agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b"))
    return best.select("doc_id", "line_no", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("score")).filter(F.col("score") >= least)


def scan(docs: DataFrame, path: str | Column = "path", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6) -> DataFrame:
    """``doc_id, path, license, origin, score, line_no, from_dir`` for each row of ``docs(doc_id, text)``.

    A document's own licence is that of its line, sentence, block or, in a licence file, whole text with
    the highest score (ties: lines, then the first licence by name, then the first line): origin ``header``. Without one, the document takes the licence of the
    nearest directory above it that holds a licence file with a licence of its own (several: highest
    score, then first by name): origin ``inherited``. Else the licence is null and the origin ``none``.
    Null and empty texts have no licence of their own; a null path inherits nothing; rows with equal
    doc_id count as one text; rows without a doc_id have no licence of their own. Other columns are
    ignored, and an empty table gives no row.
    """
    path = F.col(path) if isinstance(path, str) else path
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    is_file = F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE), F.lit(False))
    lines = line_scores(src.select("doc_id", "text"), templates, least).withColumn("larger", F.lit(False))
    lines = lines.unionByName(unit_scores(src.select("doc_id", "text", is_file.alias("is_file")), least).withColumn("larger", F.lit(True)))
    own = lines.groupBy("doc_id").agg(F.min(F.struct(-F.col("score"), F.col("larger"), F.col("license"), F.col("line_no"))).alias("b"))
    own = materialize(own.select("doc_id", (-F.col("b.col1")).alias("score"), "b.license", "b.line_no"), "headers")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = src.select("doc_id", "path", folder.alias("dir")).join(own, "doc_id", "left")
    files = rows.filter(F.col("license").isNotNull() & F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE))
    held = files.groupBy("dir").agg(F.min(F.struct(-F.col("score"), F.col("license"))).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.license").alias("above"))
    # each directory once, with all directories above it
    dirs = src.filter("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("from_dir"))
    nearest = above.distinct().join(held, "from_dir").groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("n"), F.col("from_dir"), F.col("above"))).alias("b"))
    nearest = materialize(nearest.select("dir", "b.from_dir", "b.above"), "inherited")
    out = rows.join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    inherits = ~mine & F.col("above").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "above").alias("license"),
        F.when(mine, "header").when(inherits, "inherited").otherwise("none").alias("origin"),
        "score",
        F.col("line_no").cast("long").alias("line_no"),
        F.when(inherits, F.col("from_dir")).alias("from_dir"),
    )


def document_path() -> Column:
    """Documents of the test tables carry no path: one is made of source and id. Every hundredth
    document is its directory's licence file, every thousandth that of the directory above."""
    k, h = F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)")
    return F.when(F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source", k, F.lit("LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat_ws("/", "source", k, h, F.lit("LICENSE"))).otherwise(F.concat_ws("/", "source", k, h, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.6) -> str:
    """The same scan of ``documents`` for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    stop = ", ".join(map(quote, STOP_WORDS))
    rows = ", ".join(f"({k}, {quote(lic)}, {quote(t)}, {n})" for k, (lic, text) in enumerate(templates) for t, n in sorted(terms_of(text).items()))
    return rf"""
WITH src AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN concat_ws('/', source, (doc_id // 1000)::VARCHAR, 'LICENSE')
    WHEN doc_id % 100 = 0 THEN concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR, 'LICENSE')
    ELSE concat_ws('/', source, (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR, doc_id::VARCHAR || '.txt') END AS path
  FROM documents
), templates(template, license, term, n) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM src WHERE text IS NOT NULL
), total AS (SELECT count(*)::DOUBLE AS n FROM lines),
tf AS (
  SELECT doc_id, line_no, term, count(*) AS tf
  FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines)
  WHERE term NOT IN ({stop}) GROUP BY ALL
), idf AS (
  SELECT term, ln((1.0 + (SELECT n FROM total)) / (1 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM templates) LEFT JOIN (SELECT term, count(*) AS df FROM tf GROUP BY term) USING (term)
), weights AS (SELECT template, license, term, n * idf AS w FROM templates JOIN idf USING (term)),
norms AS (SELECT template, sqrt(sum(w * w)) AS t_norm FROM weights GROUP BY template),
weighted AS (SELECT tf.*, tf * coalesce(idf, ln(1.0 + (SELECT n FROM total)) + 1) AS w_line FROM tf LEFT JOIN idf USING (term)),
lengths AS (SELECT doc_id, line_no, sqrt(sum(w_line * w_line)) AS norm FROM weighted GROUP BY ALL),
dots AS (SELECT doc_id, line_no, template, license, sum(w_line * w) AS dot FROM weighted JOIN weights USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, line_no, license, round(dot / (norm * t_norm), 6) AS score FROM dots JOIN lengths USING (doc_id, line_no) JOIN norms USING (template)),
own AS (
  SELECT doc_id, license, score, line_no FROM scored WHERE score >= {least}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license, line_no) = 1
), placed AS (
  SELECT src.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, score, line_no FROM src LEFT JOIN own USING (doc_id)
), held AS (
  SELECT dir AS from_dir, license AS above FROM placed WHERE license IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENSE_FILE}')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1
), nearest AS (
  SELECT p.dir, h.from_dir, h.above FROM (SELECT DISTINCT dir FROM placed WHERE path IS NOT NULL) p
  JOIN held h ON p.dir = h.from_dir OR starts_with(p.dir, h.from_dir || '/') OR h.from_dir = ''
  QUALIFY row_number() OVER (PARTITION BY p.dir ORDER BY length(h.from_dir) DESC) = 1
)
SELECT doc_id, path, coalesce(license, above) AS license,
  CASE WHEN license IS NOT NULL THEN 'header' WHEN above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  score, CAST(line_no AS BIGINT) AS line_no, CASE WHEN license IS NULL THEN from_dir END AS from_dir
FROM placed LEFT JOIN nearest USING (dir)
"""
