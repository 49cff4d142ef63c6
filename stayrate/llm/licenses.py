"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Texts are cut into sentences, their words into five-word shingles hashed to 64 bits. Windows of ``WINDOW`` shingles,
each half over the next, have one minimum per band, each band under another hash of the shingles. A window that shares
the part J of its shingles with a template's window agrees in some of the 8 bands with probability 1 - (1 - J)^8:
certainly for a copy, 0.99999 at J = 0.8, 0.996 at J = 0.5. In a longer sentence a short template would be a part of
any such window; template sentences of up to ``WINDOW`` shingles therefore have windows of one shingle as well, so one
more band finds them wherever they stand. A run of 11 shingles of a longer one holds a whole window of the text, a run
of 8 three quarters of one. Templates that are retrieved count only if the whole text,
in whatever sentences, holds at least 0.8 of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm.common import whole_text
from stayrate.session import stage

WORDS, WINDOW, STEP, LEAST = 5, 8, 4, 0.8
BANDS = 8

# License notices by name
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
        the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Sentences end at a mark before white space; words are runs of ASCII letters and digits and of other alphabets.
SENTENCE = r"[.!?;:][ \t\r\n]+"
BETWEEN = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; the optimizer would else copy its expression into inner lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shingles(sentence: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the array of shingle hashes; null for a sentence of fewer than five words."""
    words = F.filter(F.split(F.lower(sentence), BETWEEN), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) >= WORDS, _let(
        F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: F.xxhash64(*[w[i + k] for k in range(WORDS)])), use)))


def _lowest(shingles: Column, step: int, use: Callable[[int, Column], Column]) -> Column:
    """Array over the bands of ``use`` of the minima of all windows, each window ``step`` shingles after the last.

    Band k orders the shingles by their hash under k. With step 1, for templates, the last band has only sentences
    that fit into one window.
    """
    n = F.size(shingles)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - WINDOW) / step), F.lit(0)).cast("int"))
    def band(k: int, all_starts: Column) -> Column:
        return use(k, _let(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))), lambda ordered: F.transform(
            all_starts, lambda i: F.array_min(F.slice(ordered, F.greatest(F.least(i * step, n - WINDOW), F.lit(0)) + 1, F.lit(WINDOW))))))
    single = use(BANDS, shingles if step > 1 else F.when(n <= WINDOW, shingles).otherwise(F.array().cast("array<bigint>")))
    return _let(starts, lambda x: F.array(*[band(k, x) for k in range(BANDS)], single))


def template_index(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(band, low, license) of all windows of the templates, and (license, shingle, size); both as small as the templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    parts = rows.select("license", F.explode(F.split("text", SENTENCE)).alias("sentence"))
    both = _shingles(F.col("sentence"), lambda s: F.array(F.struct(s.alias("shingles"), _lowest(s, 1, lambda k, x: x).alias("bands"))))
    parts = stage(parts.select("license", F.inline(both)), "templates")
    low = parts.select("license", F.posexplode("bands").alias("band", "lows")).select("license", "band", F.explode("lows").alias("low")).distinct()
    shingles = parts.select("license", F.explode("shingles").alias("shingle")).distinct()
    sizes = shingles.groupBy("license").agg(F.count("*").alias("size"))
    return low, shingles.join(sizes, "license")


def matches(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, h (hash of the text), license, containment: verified templates of each distinct document.

    A template that some sentence retrieves counts if the whole text holds at least 0.8 of its distinct shingles.
    """
    low, shingles = template_index(documents.sparkSession, templates or TEMPLATES)
    # the templates are a parameter of a few thousand words, checked here, so their index can go to every task
    known = low.collect()
    if len(known) > 1_000_000:
        raise ValueError("the templates are too many to send to every task")
    values = [sorted({r["low"] for r in known if r["band"] == b}) for b in range(BANDS + 1)]
    texts = documents.select("doc_id", whole_text().alias("text"))
    rows = texts.select("doc_id", F.xxhash64("text").alias("h"), F.explode(F.split("text", SENTENCE)).alias("sentence"))
    every = sorted(r["shingle"] for r in shingles.select("shingle").distinct().collect())
    def hits(s: Column) -> Column:
        found = _lowest(s, STEP, lambda k, x: F.filter(x, lambda v: v.isin(values[k]) if values[k] else F.lit(False)))
        part = F.filter(s, lambda v: v.isin(every) if every else F.lit(False))
        return F.filter(F.array(F.struct(part.alias("shingles"), found.alias("hits"))), lambda r: (F.size(r["shingles"]) > 0) | F.exists(r["hits"], lambda x: F.size(x) > 0))
    # of each sentence what the templates hold as well: shingles, and minima that retrieve templates
    found = stage(rows.select("doc_id", "h", F.inline(_shingles(F.col("sentence"), hits))), "windows")
    retrieved = found.select("doc_id", "h", F.posexplode("hits").alias("band", "lows")).select("doc_id", "h", "band", F.explode("lows").alias("low"))
    retrieved = retrieved.join(F.broadcast(low), ["band", "low"]).select("doc_id", "h", "license", F.lit(None).cast("long").alias("shingle"), F.lit(None).cast("long").alias("size"))
    held = found.select("doc_id", "h", F.explode("shingles").alias("shingle")).join(F.broadcast(shingles), "shingle").select("doc_id", "h", "license", "shingle", "size")
    # a retrieval is a row without a shingle beside those of the whole text
    both = held.unionByName(retrieved).distinct().groupBy("doc_id", "h", "license").agg(
        (F.count("shingle") / F.max("size")).alias("containment"), (F.count("*") > F.count("shingle")).alias("retrieved"))
    per = both.filter("retrieved").drop("retrieved")
    return per.filter(F.col("containment") >= LEAST)


def license_report(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_licenses, licenses (names, sorted, joined by commas), containment (the largest, else 0).

    Whole texts are scanned; a missing or empty text holds nothing. Rows that repeat a doc_id with another text stay
    apart, equal rows get equal results. An empty table gives no rows; other columns are ignored.
    """
    per = matches(documents, templates).groupBy("doc_id", "h").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("license")), ",").alias("names"), F.max("containment").alias("most"))
    per = per.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h")
    rows = documents.select("doc_id", F.xxhash64(whole_text()).alias("h"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_licenses"), F.coalesce("names", F.lit("")).alias("licenses"),
                      F.coalesce("most", F.lit(0.0)).alias("containment"))


def license_sql(templates: dict[str, str] | None = None) -> str:
    """DuckDB SQL for :func:`license_report`: exact containment of every template in every document."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted((templates or TEMPLATES).items()))
    def shingles(name: str, key: str, source: str) -> str:
        return f"""{name}_words AS (SELECT {key}, list_filter(string_split_regex(lower(s), '{BETWEEN}'), lambda x: x <> '') AS w
            FROM (SELECT {key}, unnest(string_split_regex(text, '{SENTENCE}')) AS s FROM {source})),
        {name} AS (SELECT DISTINCT {key}, array_to_string(w[i : i + {WORDS - 1}], ' ') AS shingle
            FROM (SELECT {key}, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM {name}_words WHERE len(w) >= {WORDS}))"""
    return f"""WITH templates(license, text) AS (VALUES {rows}), {shingles("ts", "license", "templates")},
        sizes AS (SELECT license, count(*) AS size FROM ts GROUP BY license),
        {shingles("ds", "doc_id", "documents")},
        held AS (SELECT doc_id, license, count(*) / first(size) AS containment FROM ds JOIN ts USING (shingle) JOIN sizes USING (license)
            GROUP BY doc_id, license HAVING count(*) >= {LEAST} * first(size)),
        per AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, max(containment) AS most FROM held GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(most, 0.0) AS containment
    FROM documents d LEFT JOIN per USING (doc_id)"""
