"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Templates are license notices (license_id, text).  Texts are lower-cased and cut into words of letters and digits;
windows and templates are compared as sets of three-word shingles.  A window holds a template when it contains at
least ``containment`` of the template's shingles.

1. A window that holds a template holds one of a few words, chosen so that the shingles without any of them are too
   few in every template.  Texts without these words are settled by a substring search.
2. Of the other texts the shingles that occur in templates are placed; no other shingle can count.
3. Templates of up to 2^c shingles are sought in windows of 2^(c+1) shingles, every 2^c, so every stretch of a template's
   length lies whole in one.  BANDS bands of one minimum each meet those of the templates.  In the worst case, a template of
   2^(c-1) + 1 shingles at 75 % containment in a window of nothing but template shingles, the Jaccard similarity is
   0.176 and the chance that no band meets 0.824^96 < 1e-8.
4. Each retrieved pair of window and template is verified by the exact count.
5. Versions of one license are rivals: templates of one window size of which one holds enough of the other to pass for
   it.  Of rivals in one window those with the largest exact containment are reported, all of them on a tie.

Main path: DataFrame functions only.  Null and empty texts hold nothing; a null doc_id is reported as null; repeated
rows are reported once; texts of any length are read whole; an empty table gives no rows; only doc_id and text are read,
whatever else there is.  Templates of fewer than three words match nothing, and an empty list finds nothing.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import stored

K, BANDS = 3, 96

#: Public license notices (fixed values).
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies"),
    "Unlicense-notice": "This is free and unencumbered software released into the public domain",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
        "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so"),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "BSD-3-Clause-ending": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission"),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(w: str) -> str:
    """Expression for (place, hash) of each shingle of a column of words."""
    return f"transform(sequence(0, size({w}) - {K}), i -> named_struct('at', i, 'h', xxhash64({w}[i], {w}[i + 1], {w}[i + 2])))"


def telling_words(templates: dict[str, str], containment: float) -> list[str]:
    """Words such that in every template fewer than the required shingles are without any of them."""
    left = _shingles(templates)
    need = {k: -(-len(s) * containment // 1) for k, s in left.items()}
    chosen: list[str] = []
    while open_ := [k for k in left if left[k] and len(left[k]) >= need[k]]:
        gain = Counter(w for k in open_ for s in left[k] for w in set(s))
        word = max(gain, key=lambda w: (min(len(w), 7), gain[w], w))  # long words are rare in other texts
        chosen.append(word)
        left = {k: {s for s in v if word not in s} for k, v in left.items()}
    return chosen


def _shingles(templates: dict[str, str]) -> dict[str, set[tuple]]:
    cut = {k: [w for w in re.split(r"[\W_]+", t.lower()) if w] for k, t in templates.items()}
    return {k: {tuple(w[i:i + K]) for i in range(len(w) - K + 1)} for k, w in cut.items()}


def rivals(templates: dict[str, str], containment: float = 0.75) -> list[tuple[str, str]]:
    """Ordered pairs of templates that may pass for each other: of one window size, and one holds enough of the other."""
    sets = {k: s for k, s in _shingles(templates).items() if s}
    size = {k: (len(s) - 1).bit_length() for k, s in sets.items()}
    return sorted((a, b) for a in sets for b in sets
                  if a != b and size[a] == size[b] and len(sets[a] & sets[b]) >= containment * min(len(sets[a]), len(sets[b])))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license_id, shingles (distinct), class: the table is as long as the list of templates."""
    rows = spark.createDataFrame(sorted(templates.items()), "license_id string, template string")
    rows = rows.withColumn("w", words(F.col("template"))).where(f"size(w) >= {K}")
    rows = rows.select("license_id", F.array_distinct(F.expr(_hashes("w"))["h"]).alias("shingles"))
    return rows.withColumn("class", F.expr("cast(ceil(log2(size(shingles))) as int)"))


def _bands(hashes: str) -> Column:
    return F.expr(f"transform(sequence(1, {BANDS}), b -> named_struct('band', b, 'least', array_min(transform({hashes}, h -> xxhash64(h, b)))))")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.75) -> DataFrame:
    """doc_id, license_id, containment (the largest of its windows), n_windows that hold it."""
    templates = NOTICES if templates is None else templates
    templates = {k: t for k, t in templates.items() if _shingles({k: t})[k]}
    spark = docs.sparkSession
    if not templates:
        return docs.select("doc_id", F.lit("").alias("license_id"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows")).limit(0)
    table = template_table(spark, templates)
    low = F.lower("text")
    telling = [F.contains(low, F.lit(w)) for w in telling_words(templates, containment)]
    some = docs.select("doc_id", "text").where(F.greatest(*telling) if len(telling) > 1 else telling[0])
    placed = some.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("w", words(F.col("text"))).where(f"size(w) >= {K}")
    placed = placed.select("row", "doc_id", F.explode(F.expr(_hashes("w"))).alias("s")).select("row", "doc_id", "s.*")
    known = table.select(F.explode("shingles").alias("h")).distinct()
    # the template side is broadcast throughout: the list of templates is a parameter held by the driver
    placed = placed.join(F.broadcast(known), "h", "left_semi")
    sizes = F.array(*[F.lit(r[0]) for r in table.select("class").distinct().orderBy("class").collect()])
    windows = placed.withColumn("class", F.explode(sizes)).withColumn(
        "window", F.explode(F.expr("array(at div cast(pow(2, class) as int), at div cast(pow(2, class) as int) - 1)")))
    windows = windows.groupBy("row", "doc_id", "class", "window").agg(F.collect_set("h").alias("held"))
    windows = stored(windows, "license-windows")
    keys = windows.select("row", "class", "window", F.explode(_bands("held")).alias("k")).select("row", "class", "window", "k.*")
    wanted = table.select("license_id", "class", F.explode(_bands("shingles")).alias("k")).select("license_id", "class", "k.*")
    found = keys.join(F.broadcast(wanted), ["class", "band", "least"]).select("row", "class", "window", "license_id").distinct()
    pairs = found.join(windows, ["row", "class", "window"]).join(F.broadcast(table.select("license_id", "shingles")), "license_id")
    share = F.size(F.array_intersect("held", "shingles")) / F.size("shingles")
    held = pairs.withColumn("containment", share).where(F.col("containment") >= containment).select("row", "doc_id", "class", "window", "license_id", "containment")
    best = held.groupBy("row", "doc_id", "class", "window").agg(F.collect_list(F.struct("license_id", "containment")).alias("found"))
    against = F.create_map(*[x for k in templates for x in (F.lit(k), F.array(*[F.lit(b) for a, b in rivals(templates, containment) if a == k]).cast("array<string>"))])
    beaten = F.filter("found", lambda t: ~F.exists("found", lambda o: F.array_contains(against[t["license_id"]], o["license_id"]) & (o["containment"] > t["containment"])))
    held = best.select("row", "doc_id", "window", F.explode(beaten).alias("t")).select("row", "doc_id", "window", "t.*")
    return held.groupBy("doc_id", "license_id").agg(
        F.max("containment").alias("containment"), F.countDistinct("row", "window").alias("n_windows"))
