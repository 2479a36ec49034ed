"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Native: DataFrame functions only. A file's header is its leading comment block, or its first paragraph if it starts with
no comment; of a licence file (``LICENSE_FILE``) all of the text counts. Compared with every template are the header
or licence file as a whole, and its windows of ``SIZES`` consecutive lines (notices are wrapped, and stand among other
lines; texts of whole licences end with the notice they want to see used). Lines without words and copyright lines are
left out first. A vector has term counts times ``ln((1 + N) / (1 + df)) + 1``, where df is the number of all files that
have the term; words of no template count as unseen ones. A file's own licence is that of the template of the largest
cosine, if that is ``LEAST`` or more. A file without one inherits from the nearest directory above it that has a licence
file with a licence; of several in one directory, the one with the largest cosine, then the smallest path.

Few windows are scored, by two bounds that lose none. Prefix filter: terms of a template that carry enough of its norm
are such that without one of them the cosine stays below ``LEAST``; the rarest of them are taken. Length filter: foreign
words lengthen a window's vector, and soon no template can be close enough. Both are evaluated within the row. What
passes is scored once per distinct text, so a notice that a third of all files have is scored once.

Inheritance is found once per distinct directory, by an equi-join of its ancestors' paths with the licensed
directories, and then joined to the files. The templates are a parameter of a few thousand terms at most, so their
tables are broadcast; document frequencies are counted for template terms only, pre-aggregated where the texts lie.

Defined cases: null and empty texts have no licence of their own; ties go to the smaller template id; a null path has
no directory above it; rows are scanned each for themselves, also where files or paths repeat or are null; very long
lines are compared whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cobordia.session import settle, table

#: Standard wording, without copyright lines. Fixed values.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version "
    "{version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} "
    "along with this program. If not, see <https://www.gnu.org/licenses/>."
)
TEXTS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
    "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations '
    "under the License.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "GPL-2.0": _GNU.format(name="General Public License", version="2"),
    "GPL-3.0": _GNU.format(name="General Public License", version="3"),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
    "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0": _GNU.format(name="Lesser General Public License", version="3"),
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software. " + _WARRANTY,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
    "https://mozilla.org/MPL/2.0/.",
}
NAMES = {
    "Apache-2.0": "the Apache License, Version 2.0", "BSD-2-Clause": "the BSD 2-Clause License", "BSD-3-Clause": "the BSD 3-Clause License", "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "GPL-2.0": "the GNU General Public License, version 2", "GPL-3.0": "the GNU General Public License, version 3",
    "ISC": "the ISC License", "LGPL-3.0": "the GNU Lesser General Public License, version 3", "MIT": "the MIT License", "MPL-2.0": "the Mozilla Public License, version 2.0",
}
LEADS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This work is licensed under {}.")
#: Templates (licence, text): whole texts and headers, and one-line notices of each licence's name.
TEMPLATES = [*TEXTS.items()] + [(k, lead.format(name)) for k, name in NAMES.items() for lead in LEADS]

LICENSE_FILE, LEAST, CLASSES = r"(?i)^(licen[cs]e|copying|notice)(\.[a-z]+)?$", 0.8, 4
#: Windows: numbers of lines, and from how many lines to how many lines they start.
SIZES = {1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 8: 2, 12: 3, 16: 4, 24: 6, 32: 8}
WORD = "[a-z0-9]+"
COMMENT, RIGHTS = r"^\s*(#|//|--|;|%|\*|$)", r"^[^a-z0-9(©]*(copyright\s*(\(c\)|©|[0-9]|by )|\(c\)|©|all rights reserved)"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def header(text: Column) -> Column:
    """Lines of the leading comment block, or of the first paragraph."""
    t = F.regexp_replace(text, r"^\s+", "")
    lines = F.split(t, "\n")
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT)), F.lit(True)).cast("int")

    def block(first: str, last: str) -> Column:
        return F.split(F.substring_index(F.substr(t, F.lit(len(first) + 1)), last, 1), "\n")

    found = F.when(t.startswith("/*"), block("/*", "*/")).when(t.startswith("<!--"), block("<!--", "-->")).when(t.startswith('"""'), block('"""', '"""'))
    found = found.when(t.rlike(r"^(#|//|--|;|%|\*)"), F.when(code > 0, F.slice(lines, F.lit(1), code - 1)).otherwise(lines))
    return found.otherwise(F.split(F.element_at(F.split(t, r"\n[ \t\r]*\n", 2), 1), "\n"))


class Model:
    """The templates' weights, and the terms and word classes of the two bounds; all of it is of the parameter's size."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], total: int, least: float) -> None:
        self.unseen = log(1 + total) + 1
        counts = {f"{licence} {n}": (licence, Counter(re.findall(WORD, body.lower()))) for n, (licence, body) in enumerate(templates)}
        self.idf = {t: log((1 + total) / (1 + df.get(t, 0))) + 1 for _, c in counts.values() for t in c}
        self.rows, self.lengths, self.prefix = [], [], set()
        for template, (licence, c) in counts.items():
            weight = {t: n * self.idf[t] for t, n in c.items()}
            square = sum(w * w for w in weight.values())
            self.lengths.append((template, licence, sqrt(square)))
            self.rows += [(template, t, w) for t, w in weight.items()]
            left = square
            for t in sorted(weight, key=lambda t: (df.get(t, 0), -weight[t], t)):
                if left < least * least * square * (1 - 1e-9):
                    break
                self.prefix.add(t)
                left -= weight[t] ** 2
        ranked = sorted(self.idf, key=lambda t: (-self.idf[t], t))
        each = -(-len(ranked) // CLASSES) if ranked else 1
        self.classes = [(self.idf[ranked[k]], ranked[k : k + each]) for k in range(0, len(ranked), each)]
        #: a window's foreign words are at most so many times the square of its known words' summed weights
        self.foreign = (1 - least * least) / (least * least) / self.unseen**2 * (1 + 1e-9)


def _line_bounds(words: Column, model: Model) -> Column:
    """Of each line (its terms): foreign words, the most that its known words can weigh, and whether it has a prefix term."""

    def count(line: Column, own: list[str]) -> Column:
        return F.size(F.filter(line, lambda t: F.array_contains(F.array(*map(F.lit, own)), t)))

    def of_line(line: Column) -> Column:
        known = [count(line, own) for _, own in model.classes]
        most = sum((n * F.lit(idf) for n, (idf, _) in zip(known[1:], model.classes[1:], strict=True)), known[0] * F.lit(model.classes[0][0]))
        foreign = F.size(line) - sum(known[1:], known[0])
        has = F.arrays_overlap(line, F.array(*map(F.lit, sorted(model.prefix))))
        return F.struct(foreign.cast("double").alias("foreign"), most.cast("double").alias("most"), has.cast("double").alias("has"))

    return F.transform(words, of_line)


def _windows(words: Column, lines: Column, model: Model) -> Column:
    """Texts of the windows of ``words`` (terms of each line) that a template may be close to, by ``_line_bounds``. Both
    are columns of a projection below, so that no window computes them again."""
    n = F.size(words)

    def starts(size: int, step: int) -> Column:
        at = F.when(n > size, F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(step)))
        return F.coalesce(F.transform(at, lambda i: F.struct(i.cast("int").alias("at"), F.lit(size).alias("n"))), F.array().cast("array<struct<at:int,n:int>>"))

    spans = [F.array(F.struct(F.lit(1).alias("at"), n.alias("n")))] + [starts(size, step) for size, step in SIZES.items()]

    def total(span: Column, name: str) -> Column:
        return F.aggregate(F.slice(lines, span["at"], span["n"]), F.lit(0.0), lambda a, x: a + x[name])

    def close(span: Column) -> Column:
        return (total(span, "has") > 0) & (total(span, "foreign") <= total(span, "most") * total(span, "most") * F.lit(model.foreign))

    texts = F.transform(F.filter(F.flatten(F.array(*spans)), close), lambda s: F.array_join(F.flatten(F.slice(words, s["at"], s["n"])), " "))
    return F.when(n > 0, F.array_distinct(texts))


def _scored(spark: SparkSession, texts: DataFrame, model: Model, least: float) -> DataFrame:
    """Distinct (body) of terms -> (body, own, cosine) of those close enough to a template."""
    texts = settle(texts.distinct().withColumn("id", F.monotonically_increasing_id()))
    idf = F.broadcast(spark.createDataFrame(list(model.idf.items()), "term string, idf double"))
    weights = F.broadcast(spark.createDataFrame(model.rows, "template string, term string, tw double"))
    lengths = F.broadcast(spark.createDataFrame(model.lengths, "template string, own string, tlen double"))
    terms = texts.select("id", F.explode(F.split("body", " ")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    terms = settle(terms.join(idf, "term", "left").select("id", "term", (F.col("tf") * F.coalesce("idf", F.lit(model.unseen))).alias("w")))
    norm = terms.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    dots = terms.join(weights, "term").groupBy("id", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("len") * F.col("tlen")), 6)
    x = dots.join(norm, "id").join(lengths, "template").withColumn("cosine", cosine).filter(F.col("cosine") >= least)
    best = x.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template", "own")).alias("b"))
    return texts.join(best, "id").select("body", "b.own", "b.template", (-F.col("b.c")).alias("cosine"))


def license_scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``files``: (file, path, text) -> one row per file: file, path, own, cosine, license, source_dir."""
    spark, templates = files.sparkSession, TEMPLATES if templates is None else templates
    files = files.select("file", "path", "text")
    vocabulary = sorted({t for _, body in templates for t in re.findall(WORD, body.lower())})
    seen = files.select(F.explode(F.array_intersect(_terms(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("term"))
    df = {r["term"]: r["df"] for r in seen.groupBy("term").agg(F.count("*").alias("df")).collect()} if vocabulary else {}  # of the templates' terms
    model = Model(templates, df, files.count(), least)

    named = F.element_at(F.split("path", "/"), -1)
    x = files.withColumn("is_file", F.coalesce(named.rlike(LICENSE_FILE), F.lit(False))).withColumn("dir", F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1))
    if model.prefix:
        wanted = F.arrays_overlap(_terms(F.col("text")), F.array(*map(F.lit, sorted(model.prefix))))
        x = x.withColumn("lines", F.when(wanted, F.when(F.col("is_file"), F.split("text", "\n")).otherwise(header(F.col("text")))))
        x = x.withColumn("words", F.transform(F.filter("lines", lambda line: ~F.lower(line).rlike(RIGHTS)), _terms))
        x = x.withColumn("words", F.filter("words", lambda line: F.size(line) > 0)).withColumn("bounds", _line_bounds(F.col("words"), model))
        x = x.withColumn("windows", _windows(F.col("words"), F.col("bounds"), model))
    else:
        x = x.withColumn("windows", F.lit(None).cast("array<string>"))
    # a row's number is that of the settled row
    x = settle(x.select("file", "path", "dir", "is_file", "windows", F.monotonically_increasing_id().alias("row")))
    texts = x.select("row", F.explode("windows").alias("body"))
    hits = texts.join(settle(_scored(spark, texts.select("body"), model, least)), "body")
    best = hits.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "template", "own")).alias("b"))
    x = settle(x.drop("windows").join(best, "row", "left").select("file", "path", "dir", "is_file", "b.own", (-F.col("b.c")).alias("cosine")))

    licensed = x.filter("is_file and own is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("b")).select(F.col("dir").alias("above"), F.col("b.own").alias("inherited"))
    steps = F.split("dir", "/")
    above = x.filter("dir is not null").select("dir").distinct().select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/")))).alias("above"))
    nearest = Window.partitionBy("dir").orderBy(F.length("above").desc())
    found = above.distinct().join(licensed, "above").withColumn("rank", F.row_number().over(nearest)).filter("rank = 1").select("dir", "above", "inherited")
    x = x.join(found, "dir", "left")
    source = F.when(F.col("own").isNull(), F.col("above"))
    return x.select("file", "path", "own", "cosine", F.coalesce("own", "inherited").alias("license"), source.alias("source_dir"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree source/lang/folder, every 64th a licence file of its language's folder and
    every other 8th one of its own folder."""
    folder = F.concat(F.col("source"), F.lit("/"), F.col("lang"))
    inner = F.concat(folder, F.lit("/"), F.pmod(F.floor(F.col("doc_id") / 8), F.lit(512)).cast("string"))
    path = F.when(F.col("doc_id") % 64 == 0, F.concat(folder, F.lit("/LICENSE"))).when(F.col("doc_id") % 8 == 0, F.concat(inner, F.lit("/LICENSE")))
    path = path.otherwise(F.concat(inner, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), path.alias("path"), "text")
    return license_scan(docs).withColumnRenamed("file", "doc_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Every window of every file is weighed; of distinct texts those stay in which template terms have 0.64 of the squared norm.
OP3_SQL = r"""
WITH tpl(template, licence, body) AS (VALUES {templates}),
files AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 64 = 0 THEN source || '/' || lang || '/LICENSE'
    WHEN doc_id % 8 = 0 THEN source || '/' || lang || '/' || (floor(doc_id / 8)::BIGINT % 512)::VARCHAR || '/LICENSE'
    ELSE source || '/' || lang || '/' || (floor(doc_id / 8)::BIGINT % 512)::VARCHAR || '/' || doc_id::VARCHAR || '.txt' END AS path FROM documents),
model AS (SELECT template, term, count(*) AS ttf FROM (SELECT template, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM tpl) GROUP BY ALL),
n AS (SELECT count(*) AS total FROM files),
idf AS (SELECT term, ln((1 + any_value(total)) / (1 + count(row))) + 1 AS idf FROM (SELECT DISTINCT term FROM model) LEFT JOIN
  (SELECT DISTINCT row, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM files) USING (term), n GROUP BY term),
weights AS (SELECT template, term, ttf * idf AS tw FROM model JOIN idf USING (term)),
tl AS (SELECT template, any_value(licence) AS licence, sqrt(sum(tw * tw)) AS tlen FROM weights JOIN tpl USING (template) GROUP BY template),
cut AS (SELECT row, path LIKE '%/LICENSE' AS is_file, text, regexp_replace(text, '^\s+', '') AS t FROM files),
kinds AS (SELECT row, t, is_file, text, CASE WHEN is_file THEN 0 WHEN t[1:2] = '/*' THEN 1 WHEN t[1:4] = '<!--' THEN 2 WHEN t[1:3] = '\"\"\"' THEN 3 WHEN regexp_matches(t, '^(#|//|--|;|%|\*)') THEN 4 ELSE 5 END AS kind FROM cut),
every AS (SELECT row, kind, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT row, kind, string_split(CASE kind WHEN 0 THEN text WHEN 1 THEN string_split(t[3:], '*/')[1] WHEN 2 THEN string_split(t[5:], '-->')[1]
    WHEN 3 THEN string_split(t[4:], '\"\"\"')[1] WHEN 5 THEN regexp_split_to_array(t, '\n[ \t\r]*\n')[1] ELSE t END, chr(10)) AS l FROM kinds)),
head AS (SELECT e.* FROM every e LEFT JOIN (SELECT row, min(pos) AS code FROM every WHERE kind = 4 AND NOT regexp_matches(line, '^\s*(#|//|--|;|%|\*|$)') GROUP BY row) c USING (row) WHERE code IS NULL OR pos < code),
lines AS (SELECT row, row_number() OVER (PARTITION BY row ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY row) AS n, w FROM (SELECT row, pos, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM head
    WHERE NOT regexp_matches(lower(line), '^[^a-z0-9(©]*(copyright\s*(\(c\)|©|[0-9]|by )|\(c\)|©|all rights reserved)')) WHERE len(w) > 0),
sizes(size, step) AS (VALUES {sizes}),
whole AS (SELECT row, array_to_string(flatten(list(w ORDER BY k)), ' ') AS body FROM lines GROUP BY row),
part AS (SELECT row, array_to_string(flatten(list(w) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN CURRENT ROW AND {more} FOLLOWING)), ' ') AS body, k, n, {size} AS size, {step} AS step FROM lines),
spans AS (SELECT row, body FROM whole UNION ALL {parts}),
texts AS (SELECT row_number() OVER () AS id, body FROM (SELECT DISTINCT body FROM spans)),
w AS (SELECT id, term, tf * coalesce(idf, ln(1 + total) + 1) AS w, idf IS NOT NULL AS known FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(string_split(body, ' ')) AS term FROM texts) GROUP BY ALL) LEFT JOIN idf USING (term), n),
norm AS (SELECT id, sqrt(sum(w * w)) AS len FROM w GROUP BY id HAVING coalesce(sum(w * w) FILTER (known), 0) >= 0.6399 * sum(w * w)),
scored AS (SELECT id, template, any_value(licence) AS licence, round(sum(w * tw) / (any_value(len) * any_value(tlen)), 6) AS cosine FROM w JOIN norm USING (id) JOIN weights USING (term) JOIN tl USING (template) GROUP BY id, template),
hits AS (SELECT row, template, licence, cosine FROM spans JOIN texts USING (body) JOIN scored USING (id) WHERE cosine >= 0.8),
own AS (SELECT row, first(licence ORDER BY cosine DESC, template) AS own, max(cosine) AS cosine FROM hits GROUP BY row),
x AS (SELECT row, doc_id, path, regexp_extract(path, '^(?:(.*)/)?[^/]*$', 1) AS dir, own, cosine FROM files LEFT JOIN own USING (row)),
lic AS (SELECT dir AS above, first(own ORDER BY cosine DESC, path, own) AS inherited FROM x WHERE own IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir),
up AS (SELECT DISTINCT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS above FROM (SELECT DISTINCT dir FROM x) d, range(0, 4) r(k) WHERE k <= len(string_split(dir, '/'))),
near AS (SELECT dir, first(above ORDER BY length(above) DESC) AS above, first(inherited ORDER BY length(above) DESC) AS inherited FROM up JOIN lic USING (above) GROUP BY dir)
SELECT doc_id, path, own, cosine, coalesce(own, inherited) AS license, CASE WHEN own IS NULL THEN above END AS source_dir FROM x LEFT JOIN near USING (dir)
"""


def _sql() -> str:
    part = re.search(r"part AS \((.*)\),\n", OP3_SQL).group(1)
    parts = " UNION ALL ".join(f"SELECT row, body FROM ({part.format(more=s - 1, size=s, step=p)}) WHERE n > size AND k + size <= n AND k % step = 0" for s, p in SIZES.items())
    sql = OP3_SQL.replace(f"part AS ({part}),\n", "").replace("{parts}", parts).replace("{sizes}", ", ".join(f"({s}, {p})" for s, p in SIZES.items()))
    return sql.replace("{templates}", ", ".join(f"({_quoted(f'{k} {n}')}, {_quoted(k)}, {_quoted(body)})" for n, (k, body) in enumerate(TEMPLATES))).replace('\\"', '"')


QUERIES = {"op3_licenses": op3_licenses}
SQL = {"op3_licenses": _sql()}
