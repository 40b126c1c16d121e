"""Operator 2: licence notices found by MinHash bands over overlapping windows, in DataFrame functions only.

Texts become arrays of word-shingle hashes. For each template size there are windows a little longer than the template,
an eighth of it apart, so that a notice which holds `share` of a template's shingles gives some window a Jaccard index
of at least share / (1 + 1/8 + 1 - share) with it (0.6 at 0.8). With 24 bands of 2 minima such a window shares a band
with its template with a chance above 0.9999. What collides is verified by exact containment of the template's shingles. Shingles of
no template are left out of the windows: they cannot match, and without them the index can only rise.

Two filters before lose nothing. A text that holds 0.8 of a template's shingles must hold one of any words that stand
in more than 0.2 of them, so texts without such words are passed over; and windows without a single shingle of any
template are not built. Templates are a parameter; their shingles and bands are tables, which are broadcast only if there
are at most `broadcast_shingles` shingles, and joined by a shuffle otherwise.

Templates with fewer words than a shingle are one shingle of their own length, and are sought among the texts' shingles
of that length. Some notices are nearly contained in others (the headers of GPL-2.0, GPL-3.0, LGPL and AGPL). With
`best_only`, a match gives way to one of another license in the same place that holds more shingles, if that license's
notice alone would have matched it; forms of one license (names that differ in their last part, as -header) do not
compete, and ties stay.

Defined results: null and empty texts match nothing. Rows that repeat a doc_id are scanned each and reported together. A null doc_id is reported as null. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.pii import let

#: Short notices by SPDX name, as they are commonly put into texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-line": "Released under the terms of the MIT License",
    "MIT-short": "Released under the MIT License",
    "MIT-notice": "Licensed under the MIT License",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC0-1.0": "has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-line": "Licensed under CC0 1.0",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "All-rights-reserved": "Unauthorized copying of this file, via any medium, is strictly prohibited. All rights reserved",
    "All-rights-reserved-short": "All rights reserved",
}

#: The last part of a name that tells a form of a license and not another license.
FORM = re.compile(r"-(header|line|short|notice)$")
NOT_WORD = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def word_arrays(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.regexp_replace(text, NOT_WORD, " ")), " "), lambda w: w != "")


def hashes(words: Column, width: int) -> Column:
    """Hash of the shingle at each word; one of the whole where there are fewer words."""

    def of(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, each).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))

    return let(words, of)  # bound once, not once for each shingle


def gate(templates: dict[str, list[str]], share: float, width: int) -> str:
    """A pattern of words of which every text that holds `share` of any template's shingles has at least one."""
    chosen: set[str] = set()
    for words in templates.values():
        n = max(1, len(words) - width + 1)
        covers = {w: {i for i in range(n) if w in words[i : i + width]} for w in set(words)}
        covered: set[int] = set()
        for w in sorted(covers, key=lambda w: (w not in chosen, -len(w), w)):
            if len(covered) > (1 - share) * n + 1e-9:
                break
            if covers[w] - covered:
                covered |= covers[w]
                chosen.add(w)
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(chosen))})(?![\p{{L}}\p{{N}}])"


def bands_of(window: Column, bands: int, rows: int) -> Column:
    """Band hashes of a window's shingle hashes."""

    def minimum(j: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(j))))

    return F.array(*[F.xxhash64(F.lit(b), *[minimum(b * rows + r) for r in range(rows)]) for b in range(bands)])


def shingles_of(words: list[str], width: int) -> set[tuple[str, ...]]:
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def rivals(templates: dict[str, list[str]], share: float, width: int) -> dict[str, list[str]]:
    """For each template, those of other licenses whose notices alone hold `share` of its shingles."""
    out = {}
    for name, words in templates.items():
        need, n = shingles_of(words, width), min(width, len(words))
        more = [k for k, w in templates.items() if FORM.sub("", k) != FORM.sub("", name) and len(need & shingles_of(w, n)) >= share * len(need) - 1e-9]
        if more:
            out[name] = sorted(more)
    return out


def unbeaten(good: DataFrame, against: dict[str, list[str]]) -> DataFrame:
    """Matches without a rival that holds more shingles in the same place; rows may repeat a match."""
    names = sorted({*against, *(k for more in against.values() for k in more)})
    stop = F.col("start") + F.col("n") + F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    some = good.where(F.col("license").isin(names)).select("doc_id", "row", F.struct("license", "n", "start", stop.alias("stop"), "both").alias("hit"))
    # stretches of a text, so that what is compared at once is bounded however often a notice stands in it
    reach = F.sequence(F.floor(F.col("hit.start") / 256), F.floor((F.col("hit.stop") - 1) / 256))
    held = some.select("doc_id", "row", "hit", F.explode(reach).alias("stretch")).groupBy("doc_id", "row", "stretch").agg(F.collect_set("hit").alias("hits"))
    table = F.create_map(*[x for k, more in sorted(against.items()) for x in (F.lit(k), F.array(*map(F.lit, more)))])
    each = held.select("doc_id", "row", "hits", F.explode("hits").alias("hit")).withColumn("others", F.coalesce(table[F.col("hit.license")], F.array().cast("array<string>")))

    def beats(o: Column) -> Column:
        both = F.least(o["stop"], F.col("hit.stop")) - F.greatest(o["start"], F.col("hit.start"))
        return F.array_contains("others", o["license"]) & (o["both"] > F.col("hit.both")) & (2 * both >= F.col("hit.n"))

    kept = each.withColumn("beaten", F.exists("hits", beats)).groupBy("doc_id", "row", "hit").agg(F.max("beaten").alias("beaten")).where("NOT beaten")
    return good.where(~F.col("license").isin(names)).select("doc_id", "license", "n", "start", "both").union(kept.select("doc_id", "hit.license", "hit.n", "hit.start", "hit.both"))


def scan(
    spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8, width: int = 5, bands: int = 24, rows: int = 2,
    best_only: bool = False, broadcast_shingles: int = 100_000, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, license, containment (the best), n_windows and first_word of each template found in each document."""
    words = {k: w for k, t in (TEMPLATES if templates is None else templates).items() if (w := template_words(t))}
    if not words:
        return spark.createDataFrame([], "doc_id long, license string, containment double, n_windows long, first_word long")
    of = {k: min(width, len(w)) for k, w in words.items()}
    widths = sorted(set(of.values()))
    known = spark.createDataFrame([(k, of[k], w) for k, w in sorted(words.items())], "license string, width int, words array<string>")
    needed = F.coalesce(*[F.when(F.col("width") == k, F.array_distinct(hashes(F.col("words"), k))) for k in widths])
    known = known.select("license", "width", needed.alias("needed"))
    known = known.withColumn("n", F.size("needed")).withColumn("bands", bands_of(F.col("needed"), bands, rows))
    sizes = {(of[k], len(shingles_of(w, width))) for k, w in words.items()}
    # broadcast only as far as the number of the templates' shingles is known to be small
    small = sum(len(shingles_of(w, width)) for w in words.values()) <= broadcast_shingles
    sent = F.broadcast if small else (lambda df: df.hint("merge"))
    every = known.select("width", F.explode("needed").alias("h")).distinct()
    t = F.col(text).cast("string")
    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("_t")).where(F.col("_t").rlike(gate(words, share, width)))
    some = some.withColumn("row", F.monotonically_increasing_id())
    placed = lambda w, k: F.transform(hashes(w, k), lambda h, i: F.struct(F.lit(k).alias("width"), i.alias("at"), h.alias("h")))
    each = some.select("doc_id", "row", F.explode(let(word_arrays(F.col("_t")), lambda w: F.concat(*[placed(w, k) for k in widths]))).alias("s"))
    each = each.select("doc_id", "row", "s.*").join(sent(every), ["width", "h"], "left_semi")
    # the windows of each size that hold a place: those from the last that starts there or before, back to its reach
    spots = []
    for k, n in sorted(sizes):
        step = max(1, n // 8)
        last = F.floor(F.col("at") / step)
        first = F.greatest(F.lit(0), F.floor((F.col("at") - (n + step)) / step) + 1)
        spots.append(F.when(F.col("width") == k, F.transform(F.sequence(first, last), _spot(n, step))).otherwise(F.array().cast("array<struct<n:int,start:bigint>>")))
    spread = each.select("doc_id", "row", "width", "h", F.explode(F.concat(*spots)).alias("w"))
    at = spread.groupBy("doc_id", "row", "width", "w").agg(F.collect_set("h").alias("window"))
    at = at.select("doc_id", "row", "width", F.col("w.n").alias("n"), F.col("w.start").alias("start"), "window")
    found = at.select("doc_id", "row", "width", "n", "start", "window", F.explode(bands_of(F.col("window"), bands, rows)).alias("band"))
    index = known.select("license", "width", "n", "needed", F.explode("bands").alias("band"))  # templates x bands rows
    hits = found.join(sent(index), ["width", "n", "band"]).select("doc_id", "row", "license", "n", "start", F.size(F.array_intersect("window", "needed")).alias("both"))
    good = hits.where(F.col("both") >= F.lit(share) * F.col("n") - 1e-9)
    if best_only and (against := rivals(words, share, width)):
        good = unbeaten(good, against)
    return good.groupBy("doc_id", "license").agg(
        F.max(F.col("both") / F.col("n")).alias("containment"), F.countDistinct("start").alias("n_windows"), F.min("start").cast("long").alias("first_word"),
    )


def _spot(n: int, step: int):
    return lambda s: F.struct(F.lit(n).alias("n"), (s * step).alias("start"))
