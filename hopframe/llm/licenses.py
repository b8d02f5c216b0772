"""License scans: MinHash bands over overlapping windows of word shingles retrieve templates, exact shingle containment
decides. DataFrame functions only; documents are never shuffled.

A template of n shingles is looked for in windows of c shingles, c the largest power of 4 up to n, that start every c/4.
For each hash function the template's minimum is the value of one of its shingles; a document that holds a share of 0.8
of them holds that one with a chance of 0.8, and then a window within the passage that has it as its own minimum. With
one row a band and 12 bands, a passage is missed with a chance under 1e-4; templates of up to 3 shingles, of which all
must be there, are never missed.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices and the opening passages of widely used public licenses and their standard headers.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice-2", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-clause-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
)
WIDTH, PERCENT, HASHES = 5, 80, 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _template_shingles(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return list(dict.fromkeys(" ".join(words[i : i + WIDTH]) for i in range(len(words) - WIDTH + 1)))


def anchors(shingles: list[str], percent: int = PERCENT) -> set[str]:
    """Words of which every document that holds percent of the shingles has one: they stand in more shingles than may be
    missing. Long words first, as they are rare."""
    missing = len(shingles) - math.ceil(percent * len(shingles) / 100)
    left, chosen = set(shingles), set()
    while len(shingles) - len(left) <= missing:
        counts: dict[str, int] = defaultdict(int)
        for s in left:
            for w in set(s.split()):
                counts[w] += 1
        best = max(counts, key=lambda w: (len(w) >= 7, counts[w], len(w), w))
        chosen.add(best)
        left = {s for s in left if best not in s.split()}
    return chosen


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("([a-z0-9]+)"), 1)


def _shingles(words: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(words) - (WIDTH - 1))
    return F.when(F.size(words) >= WIDTH, F.transform(at, lambda i: F.array_join(F.slice(words, i, WIDTH), " "))).otherwise(F.array().cast("array<string>"))


def _rehashed(hashes: Column, i: int) -> Column:
    return F.transform(hashes, lambda x: F.xxhash64(x, F.lit(i)))


def _looked_up(keys: Column, lists: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.element_at(lists, k)))


def _block_minima(values: str, length: int) -> Column:
    """Minima of runs of length values. values is a column's name: an expression would be evaluated for every run."""
    n = F.size(values)
    runs = F.transform(F.sequence(F.lit(0), F.ceil(n / length).cast("int") - 1), lambda j: F.array_min(F.slice(values, j * length + 1, length)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<long>"))


def _window_minima(values: str, length: int) -> Column:
    """Minima of all windows of length values, or of all values if they are fewer."""
    n = F.size(values)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), lambda j: F.array_min(F.slice(values, j, length)))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<long>"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text_col: str = "text", id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(doc_id, license_id, n_shingles, n_found): a row for each template of which a document's whole text holds at
    least percent of the distinct 5-word shingles. Words are runs of a-z and 0-9 after lower-casing A-Z.

    Templates are a bounded list of texts of 5 words or more (ValueError else). Only documents with one of the
    templates' anchor words are cut into shingles: no other can match. Null and empty texts give no row; equal rows give
    equal rows. Extra columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    shingles = {name: _template_shingles(text) for name, text in templates}
    if short := [name for name, s in shingles.items() if not s]:
        raise ValueError(f"templates of fewer than {WIDTH} words: {short}")
    if len(shingles) < len(templates):
        raise ValueError("template names repeat")
    table = spark.createDataFrame([(i, name, s) for i, (name, s) in enumerate(shingles.items())], "template int, license_id string, parts array<string>")
    known = sorted({w for s in shingles.values() for w in anchors(s, percent)})
    # the templates' minima, by the same functions that hash the documents
    hashed = F.transform("parts", lambda x: F.xxhash64(x))
    minima = table.select("template", F.size("parts").alias("n"), F.array(*[F.array_min(_rehashed(hashed, i)) for i in range(HASHES)]).alias("low"), hashed.alias("all")).collect()
    wanted: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for r in minima:
        length = 4 ** int(math.log(r["n"], 4) + 1e-9)
        for i in range(HASHES) if length > 1 else [0]:
            for value in [r["low"][i]] if length > 1 else r["all"]:
                wanted[length, i][value].append(r["template"])

    found = docs.where(F.col(text_col).rlike("(?i)" + "|".join(known))).select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("words"))
    found = found.select("doc_id", _shingles(F.col("words")).alias("parts"))
    found = found.withColumn("h", F.transform("parts", lambda x: F.xxhash64(x)))
    found = found.withColumns({f"h{i}": _rehashed(F.col("h"), i) for length, i in wanted if length > 1})
    found = found.withColumns({f"h{i}_{length // 4}": _block_minima(f"h{i}", length // 4) for length, i in wanted if length > 4})
    hits = []
    for (length, i), by_value in sorted(wanted.items()):
        low = F.col("h") if length == 1 else _window_minima(f"h{i}" if length == 4 else f"h{i}_{length // 4}", 4)
        among = F.array_intersect(low, F.array(*[F.lit(v).cast("long") for v in by_value]))
        names = F.create_map(*[x for v, ts in by_value.items() for x in (F.lit(v).cast("long"), F.array(*[F.lit(t) for t in ts]))])
        hits.append(_looked_up(among, names))
    found = found.select("doc_id", "parts", F.explode(F.array_distinct(F.concat(*hits))).alias("template"))
    pairs = found.join(F.broadcast(table.withColumnRenamed("parts", "wanted")), "template")
    n, common = F.size("wanted"), F.size(F.array_intersect("wanted", "parts"))
    return pairs.select("doc_id", "license_id", n.cast("long").alias("n_shingles"), common.cast("long").alias("n_found")).where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """DuckDB SQL for scan() over the table documents, by brute force."""
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in templates)
    cut = "list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')))"
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
WITH t AS (SELECT name, {words.format("body")} AS ws FROM (VALUES {values}) v(name, body)),
ts AS (SELECT name, unnest({cut}) AS g FROM t),
tn AS (SELECT name, count(*) AS n FROM ts GROUP BY name),
d AS (SELECT doc_id, {words.format("text")} AS ws FROM documents),
ds AS (SELECT doc_id, unnest({cut}) AS g FROM d WHERE len(ws) >= 5)
SELECT ds.doc_id, ts.name AS license_id, tn.n::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM ds JOIN ts ON ds.g = ts.g JOIN tn ON tn.name = ts.name
GROUP BY ds.doc_id, ts.name, tn.n HAVING count(*) * 100 >= tn.n * {PERCENT}
"""
