"""License scans in DataFrame functions only: MinHash over text windows, then exact containment."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, numbered, written

SHINGLE = 5
#: Windows of two neighbouring shingles, one at each place, so that each overlaps the next, and MinHash
#: bands of one row. A shingle of a template stands in two windows of a text; it is the minimum of
#: neither in a band with probability 1/3, and so in no band with 3^-BANDS = 6e-6; of an occurrence
#: of n shingles all are missed with far less. (Minima over windows of 32 shingles took 9.5
#: microseconds a shingle in built-in functions, three times the limit for native operators.)
BANDS = 11
LEAST = 0.8
#: Shingles of all templates up to which a text asks for them by arrays of its own, without a join.
ROW_VALUES = 20_000

#: Notices and opening or closing sentences of common licenses.
TEMPLATES = [
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("mit-notice", "Released under the MIT License."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    (
        "apache-2.0-header",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so",
    ),
    (
        "bsd-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "mit-license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-license",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        'IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib-license",
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held '
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software. This notice may not be removed or altered from "
        "any source distribution.",
    ),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

_SPLIT = r"[^\p{L}\p{N}]+"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once a row: a name for it inside one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: what reads it is never merged with it across
    the generator, neither a derived filter nor a function that would compute it for every element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits. A text that starts with another character has an
    empty first word, which no template shares."""
    return F.split(F.lower(text), _SPLIT)


def shingle_hashes(text: Column) -> Column:
    """64-bit hashes of all runs of SHINGLE words, in order; of a shorter text none."""

    def all_of(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<bigint>"))

    return _let(words(F.coalesce(text, F.lit(""))), all_of)


def _masks() -> list[int]:
    """The hash functions: a shingle's hash under mask c is its exclusive or with c, so a minimum is
    that of a random order, as the hashes themselves are random."""
    rng = random.Random(1)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(BANDS)]


def _bands(a: Column, b: Column) -> Column:
    """The band values of a window of two shingles."""
    return F.array(*[F.least(a.bitwiseXOR(F.lit(c)), b.bitwiseXOR(F.lit(c))) for c in _masks()])


def _next(sh: str) -> Column:
    """Every shingle's neighbour; the last has itself."""
    return F.concat(F.slice(F.col(sh), F.lit(2), F.size(sh)), F.slice(F.col(sh), F.size(sh), F.lit(1)))


#: A template: its name, number of distinct shingles, their hashes and their words.
TEMPLATE = "struct<license:string,of:int,own:array<bigint>,runs:array<string>>"


def _retrieved(templates: list[dict]) -> Column:
    """The templates that some band of some window of `sh` retrieves, with nothing but arrays of the row's own.

    A band's minima over all windows are met with that band's table; what stays are hashes of
    templates' shingles, and templates that hold one are candidates.
    """
    every = sorted({x for t in templates for x in t["own"]})

    def hits(c: int) -> Column:
        mask = F.lit(c)
        least = F.zip_with("sh", _next("sh"), lambda a, b: F.least(a.bitwiseXOR(mask), b.bitwiseXOR(mask)))
        known = F.from_json(F.lit(json.dumps([x ^ c for x in every])), "array<bigint>")
        return F.transform(F.array_intersect(least, known), lambda v: v.bitwiseXOR(mask))

    lists = F.from_json(F.lit(json.dumps(templates)), f"array<{TEMPLATE}>")
    of = lambda found: F.filter(lists, lambda t: F.arrays_overlap(t["own"], found))
    return _let(F.array_distinct(F.concat(*map(hits, _masks()))), lambda found: F.when(F.size(found) > 0, of(found)).otherwise(F.array().cast(f"array<{TEMPLATE}>")))


def _occurrence(sh: Column, text: Column, t: Column, least: float) -> Column:
    """The best occurrence of template t in a text with shingles sh: license, containment, first_word, last_word; null if none.

    One expression, so that what it makes on the way is gone before the next template is looked at.
    """
    reach = t["of"] + SHINGLE
    result = "struct<license:string,containment:double,first_word:int,last_word:int>"

    def best_of(shared: Column) -> Column:
        positions = F.filter(F.sequence(F.lit(0), F.size(sh) - 1), lambda i: F.array_contains(shared, F.get(sh, i)))
        return _let(positions, lambda at: F.array_max(F.transform(at, lambda p, i: start(at, p, i))))

    def start(at: Column, p: Column, i: Column) -> Column:
        inside = F.filter(F.slice(at, i + 1, reach), lambda q: q < p + reach)
        made = lambda q: F.struct(F.size(F.array_distinct(F.transform(q, lambda v: F.get(sh, v)))).alias("n"), (-p).alias("first"), F.element_at(q, -1).alias("last"))
        return _let(inside, made)

    def exact(best: Column) -> Column:
        # the words decide: equal hashes of different words count for nothing
        inside = F.slice(words(text), F.lit(1) - best["first"], best["last"] + best["first"] + SHINGLE)
        share = _let(inside, lambda w: F.size(F.array_intersect(t["runs"], _runs(w))) / F.size(t["runs"]))
        return F.struct(t["license"].alias("license"), share.alias("containment"), (-best["first"]).alias("first_word"), (best["last"] + SHINGLE - 1).alias("last_word"))

    enough = lambda n: n >= F.ceil(t["of"] * F.lit(least) - 1e-9)
    none = F.lit(None).cast(result)
    return _let(F.array_intersect(sh, t["own"]), lambda shared: F.when(enough(F.size(shared)), _let(best_of(shared), lambda b: F.when(enough(b["n"]), exact(b)).otherwise(none))).otherwise(none))


def template_table(spark: SparkSession, templates=None) -> tuple[DataFrame, DataFrame]:
    """(value, license) for every band value of a template's windows, and the templates themselves:
    license, of (its shingles), own (their hashes), runs (their words). As large as the list of
    templates, which is part of the program."""
    rows = [(n, t) for n, t in (TEMPLATES if templates is None else templates)]
    body = F.regexp_replace("body", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")  # no empty first or last word
    t = spark.createDataFrame(rows, "license string, body string").select("license", shingle_hashes(body).alias("sh"), _runs(words(body)).alias("runs"))
    t = t.where(F.size("sh") > 0)
    # a window's minimum is one of its two shingles
    x = t.select("license", F.explode("sh").alias("x"))
    table = x.select("license", F.explode(_bands(F.col("x"), F.col("x"))).alias("value")).distinct()
    return table, t.select("license", F.size(F.array_distinct("sh")).alias("of"), F.array_distinct("sh").alias("own"), F.array_distinct("runs").alias("runs"))


def _runs(w: Column) -> Column:
    """The words of all shingles, in order, each as one string."""
    n = F.size(w) - (SHINGLE - 1)
    run = lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " ")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), run)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates=None, least: float = LEAST) -> DataFrame:
    """Which licenses a text contains: doc_id, license, containment, first_word, last_word.

    docs: doc_id, text. Overlapping windows of shingles ask the table of the templates' windows by
    their MinHash bands, and only the licenses that a band retrieves are
    compared. An occurrence starts at a shingle of the template and is as long as the template; its
    containment is the exact share of the template's distinct shingles in it. At `least` or more
    it is a match, once the shingles' words agree. One row per row of docs and license: its best
    occurrence (highest containment, then first), by positions of words from 0.

    Up to ROW_VALUES shingles of all templates a text asks by arrays of its own: nothing is shuffled,
    and what it holds in memory grows with its length alone, however many licenses it repeats (and
    with the candidates, of which there are as many as templates at most). Beyond, (row, band value) alone
    meets the table, which is broadcast up to BROADCAST_ROWS rows, and texts of rows with candidates
    are joined back once, from a written table that numbers the rows. Null, empty and short texts match nothing; null
    ids and repeated rows are scanned like others and give a row each; texts are read whole; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    table, known = (written(x) for x in template_table(spark, templates))
    if (known.agg(F.sum("of")).first()[0] or 0) <= ROW_VALUES:
        all_of = [r.asDict() for r in known.select("license", "of", "own", "runs").collect()]
        d = _once(docs.select("doc_id", "text"), "sh", shingle_hashes(docs["text"])).where(F.size("sh") > 0)
        d = _once(d, "near", _retrieved(all_of)).where(F.size("near") > 0)
        m = d.select("doc_id", F.explode(F.transform("near", lambda t: _occurrence(F.col("sh"), F.col("text"), t, least))).alias("m"))
    else:
        rows = numbered(docs.select("doc_id", "text"), "row")
        d = _once(rows, "sh", shingle_hashes(rows["text"])).where(F.size("sh") > 0)
        w = d.select("row", F.explode(F.arrays_zip(F.col("sh").alias("a"), _next("sh").alias("b"))).alias("w"))
        asks = _once(w, "bands", _bands(F.col("w.a"), F.col("w.b"))).select("row", F.explode("bands").alias("value"))
        small = table.count() <= BROADCAST_ROWS
        near = asks.join(F.broadcast(table) if small else table, "value").select("row", "license").distinct()
        t = d.join(near, "row").join(known, "license").select("doc_id", "text", "sh", F.struct("license", "of", "own", "runs").alias("t"))
        m = t.select("doc_id", _occurrence(F.col("sh"), F.col("text"), F.col("t"), least).alias("m"))
    return m.where(F.col("m").isNotNull() & (F.col("m.containment") >= F.lit(least) - 1e-9)).select("doc_id", "m.*")


def plain_words(text: str) -> list[str]:
    """The same words in Python, for tests and reports."""
    return re.split(r"[\W_]+", (text or "").lower())
