"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Whole texts are cut into terms. Wherever two neighbouring terms of a template stand side by side, there is something to score:
the sentences and lines that hold such a pair, longer ones in overlapping ``WINDOWS``, and, across line breaks, the
stretches that lie to the pair as the template does. So the templates alone decide what is looked at. A candidate and a
template are vectors of term counts times the templates' inverse document frequency (unknown terms weigh like a term of one
template). The template with the highest cosine of at least ``THRESHOLD`` gives a file its licence. A file named like a
licence file, or so marked, gives its licence to its directory; files without one take that of the nearest directory above them.

Different candidates are scored once, however many files hold them. All steps are DataFrame operations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, light

THRESHOLD = 0.6
#: Words and steps of the windows over longer candidates: for a notice, and for a paragraph of a licence.
WINDOWS = ((12, 4), (40, 20))
#: Stretches of a template's size with fewer terms than ``SHORT`` need ``SURE``: two words of three are met by chance.
SHORT, SURE = 8, 0.85
LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)([-_.][^/]*)?$"

#: Notices as their licences word them, one template a line.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "This project is licensed under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "GNU General Public License Version 3, 29 June 2007",
        "GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3",
        "GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "GNU General Public License Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "AGPL-3.0": (
        "GNU Affero General Public License Version 3, 19 November 2007",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", "BSD 2-Clause Simplified License", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        "SPDX-License-Identifier: Unlicense",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Eclipse Public License v 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal",),
    "Proprietary": ("All rights reserved", "Copyright. All rights reserved"),
}
_SPLIT_TERMS = "[^a-z0-9]+"


def _terms(text: str) -> list[str]:
    return [t for t in re.split(_SPLIT_TERMS, text.lower()) if t]


def model(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float]], dict[str, float], float]:
    """((term, template, licence, unit weight) …), idf per term, idf of unknown terms."""
    bags = [(name, Counter(_terms(t))) for name, texts in templates.items() for t in texts]
    df = Counter(term for _, bag in bags for term in bag)
    idf = {term: math.log((1 + len(bags)) / (1 + n)) + 1 for term, n in df.items()}
    rows = []
    for i, (name, bag) in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(t, i, name, n * idf[t] / norm) for t, n in bag.items()]
    return rows, idf, math.log((1 + len(bags)) / 2) + 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def anchors(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """(template, place) per pair of neighbouring terms, of which one at least has more than three characters."""
    places: dict[str, set[tuple[int, int]]] = {}
    for i, terms in enumerate(_terms(t) for ts in templates.values() for t in ts):
        for k, pair in enumerate(zip(terms, terms[1:])):
            if max(map(len, pair)) > 3:
                places.setdefault(" ".join(pair), set()).add((i, k))
    return {t: sorted(p) for t, p in sorted(places.items())}


def _masses(templates: dict[str, tuple[str, ...]]) -> list[dict[str, float]]:
    """Squared unit weight per term, for each template."""
    found: dict[int, dict[str, float]] = {}
    for term, i, _, w in model(templates)[0]:
        found.setdefault(i, {})[term] = w * w
    return [found[i] for i in sorted(found)]


def _needed(size: int, threshold: float) -> float:
    """Squared weight of a template that a stretch must share: a cosine is at most its root (Cauchy-Schwarz)."""
    return (max(threshold, SURE) if size < SHORT else threshold) ** 2 - 1e-6


def _split_up(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _SPLIT_TERMS, -1), "")


def _pairs(terms: Column) -> Column:
    return F.zip_with(terms, F.slice(terms, F.lit(2), F.size(terms)), lambda a, b: F.concat(a, F.lit(" "), b))


def _windows(terms: Column) -> Column:
    def of(size: int, step: int) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(terms) - size) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(terms, k * step + 1, F.lit(size)))

    return F.array_distinct(F.concat(*[of(*w) for w in WINDOWS]))


def candidates(text: Column, threshold: float = THRESHOLD) -> Column:
    """struct<notices, laid>, both array<array<string>>: the terms, in windows, of each sentence or line that holds a pair of a
    template's terms; and of each stretch that lies to a pair as a template does and shares enough of its terms to be
    close to it. Empty for null texts."""
    at = anchors()
    kind = "struct<notices:array<array<string>>,laid:array<array<string>>>"
    none = F.struct(F.array().alias("notices"), F.array().alias("laid")).cast(kind)
    sizes = [len(_terms(t)) for ts in TEMPLATES.values() for t in ts]
    # by template: its size, and the squared weight of each of its terms and what they must add up to
    known = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(_needed(n, threshold)).alias("need"), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in mass.items()]).alias("mass")) for n, mass in zip(sizes, _masses(TEMPLATES))])
    placed = F.create_map(*[x for t, p in at.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(sizes[i]).alias("n"), F.lit(k).alias("k")) for i, k in p]))])

    def around(terms: Column) -> Column:
        hit = F.filter(F.transform(_pairs(terms), lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: x["t"].isin(*at))

        def of(x: Column) -> Column:
            fits = F.filter(placed[x["t"]], lambda p: (p["k"] <= x["i"]) & (x["i"] - p["k"] + p["n"] <= F.size(terms)))
            cutouts = F.transform(fits, lambda p: F.struct(known[p["i"]].alias("of"), F.slice(terms, x["i"] - p["k"] + 1, p["n"]).alias("terms")))
            near = F.filter(cutouts, lambda c: F.aggregate(c["of"]["mass"], F.lit(0.0), lambda s, m: s + F.when(F.array_contains(c["terms"], m["t"]), m["m"]).otherwise(0.0)) >= c["of"]["need"])
            return F.transform(near, lambda c: c["terms"])

        def told(hits: Column) -> Column:
            pieces = F.transform(F.split(text, r"\n|(?<=[.!?;])\s+", -1), _split_up)
            lines = F.filter(pieces, lambda p: F.exists(_pairs(p), lambda t: t.isin(*at)))
            found = F.struct(F.flatten(F.transform(lines, _windows)).alias("notices"), F.array_distinct(F.flatten(F.transform(hits, of))).alias("laid"))
            return F.when(F.size(hits) > 0, found.cast(kind)).otherwise(none)

        return _let(hit, told)

    return F.when(text.isNotNull(), _let(_split_up(text), around)).otherwise(none)


def classify(notices: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(terms, licence, score) for the distinct ``terms`` arrays that reach the threshold; ties go by name."""
    spark = notices.sparkSession
    weights, idf, unknown = model(templates)
    table = spark.createDataFrame([(t, i, name, w) for t, i, name, w in weights], "term string, template int, licence string, weight double")
    idfs = spark.createDataFrame(list(idf.items()), "term string, idf double")
    distinct = notices.select("terms").distinct()
    counted = distinct.select("terms", F.explode("terms").alias("term")).groupBy("terms", "term").agg(F.count(F.lit(1)).alias("n"))
    # both tables are the templates', whose size is fixed
    weighed = counted.join(F.broadcast(idfs), "term", "left").select("terms", "term", (F.col("n") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    norms = weighed.groupBy("terms").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(table), "term").groupBy("terms", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "terms").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("l"))).alias("best")
    return scored.groupBy("terms").agg(best).select("terms", F.col("best.l").alias("licence"), (-F.col("best.s")).alias("score"))


def scan(files: DataFrame, id_col: str = "id", path_col: str = "path", text_col: str = "text", is_license_file: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, path, licence, score, origin, origin_path): one row per file.

    ``origin`` is `own`, `inherited` or null; ``origin_path`` is the licence file a licence was inherited from.
    ``is_license_file`` (a condition on the input) adds to files whose name says so. Null and empty texts have no
    licence of their own; a null path inherits none. Of several licence files in a directory the highest score
    counts, then the first path. Repeated rows stay repeated; other columns are ignored.
    """
    named = F.coalesce(F.col(path_col).rlike(LICENSE_FILE), F.lit(False))
    marked = named | F.coalesce(is_license_file, F.lit(False)) if is_license_file is not None else named
    text = F.col(text_col)
    rows = files.select(F.col(id_col).alias("id"), F.regexp_replace(F.col(path_col), "/+", "/").alias("path"), marked.alias("gives"), F.xxhash64(text).alias("h"), F.length(text).alias("n"), F.inline(F.array(candidates(text, threshold))))
    rows = cut(rows)
    with_notice = rows.where("size(notices) + size(laid) > 0").select("h", "n", "notices", "laid").distinct()
    listed = with_notice.select("h", "n", F.explode("notices").alias("terms"), F.lit(True).alias("line"))
    listed = listed.unionByName(with_notice.select("h", "n", F.explode("laid").alias("terms"), F.lit(False).alias("line")))
    by_text = listed.join(classify(listed.select("terms"), threshold), "terms").where(F.col("line") | (F.size("terms") >= SHORT) | (F.col("score") >= SURE))
    # the best candidate names the licence; its score is that of a line or sentence, where one reaches the threshold
    shown = F.coalesce(F.max(F.when(F.col("line"), F.col("score"))), F.max("score")).alias("shown")
    ranked = by_text.groupBy("h", "n", "licence").agg(F.max("score").alias("top"), shown)
    best = F.min(F.struct((-F.col("top")).alias("s"), F.col("licence").alias("l"), F.col("shown").alias("shown"))).alias("best")
    own = ranked.groupBy("h", "n").agg(best).select("h", "n", F.col("best.l").alias("licence"), F.col("best.shown").alias("score"))
    held = cut(rows.drop("notices", "laid").join(own, ["h", "n"], "left").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")))

    given = F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), F.col("licence").alias("l"))).alias("g")
    sources = held.where("gives and licence is not null and path is not null").groupBy("dir").agg(given)
    sources = sources.select(F.col("dir").alias("above"), F.col("g.l").alias("given"), F.col("g.s").alias("minus"), F.col("g.p").alias("from_path"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    ancestors = held.where("licence is null and path is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = F.max(F.struct(F.length("above").alias("d"), F.col("given"), F.col("minus"), F.col("from_path"))).alias("x")
    # a row for each directory with a licence; the root is above all others
    inherited = ancestors.join(light(sources), "above").groupBy("dir").agg(nearest).select("dir", "x.given", "x.minus", "x.from_path")
    done = held.join(inherited, "dir", "left")
    mine = F.col("licence").isNotNull()
    return done.select(
        "id",
        "path",
        F.coalesce("licence", "given").alias("licence"),
        F.coalesce(F.col("score"), -F.col("minus")).alias("score"),
        F.when(mine, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.when(~mine, F.col("from_path")).alias("origin_path"),
    )
