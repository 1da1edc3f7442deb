"""Scores against a plain cosine; inheritance along directories; odd rows."""

import math
import re
from collections import Counter

import pytest

from tessera.llm import license as lic
from tessera.llm import queries


def cosine(text):
    rows, idf, unknown = lic.model()
    bag = Counter(lic._terms(text))
    weights = {t: n * idf.get(t, unknown) for t, n in bag.items()}
    norm = math.sqrt(sum(w * w for w in weights.values()))
    dots = Counter()
    for term, template, name, w in rows:
        dots[template, name] += w * weights.get(term, 0)
    score, name = max((round(d / norm, 6), n) for (_, n), d in dots.items())
    return name, score


@pytest.mark.parametrize("notice,want", [("Released under the MIT License.", "MIT"), ("# Licensed under the Apache License, Version 2.0 (the License)", "Apache-2.0"), ("All rights reserved", "Proprietary"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("GNU GENERAL PUBLIC LICENSE", "GPL-3.0")])
def test_notices(spark, notice, want):
    df = spark.createDataFrame([(1, "a/x.py", f"code here\n{notice}\nmore code")], "id long, path string, text string")
    r = lic.scan(df).first()
    assert r.licence == want and (want, r.score) == cosine(notice)


def test_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy"),
        (2, "a/b/c.py", "x"),
        (3, "a/b/d.py", "# Licensed under the Apache License, Version 2.0"),
        (4, "z/q.py", None),
        (5, None, "All rights reserved."),
        (6, "a/b/COPYING", "GNU General Public License, version 3"),
        (7, "a/b/e/f.c", ""),
        (8, "top.c", "the licence of things is not clear"),
        (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy"),
        (9, "ab/x.c", "y"),
        (10, "a//g.c", "y"),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").selectExpr("*", "1 as licence", "2 as dir")
    got = [(r.id, r.licence, r.origin, r.origin_path) for r in lic.scan(df).collect()]
    assert len(got) == len(rows) and got.count((1, "MIT", "own", None)) == 2
    by = {g[0]: g[1:] for g in got}
    assert by[2] == ("GPL-3.0", "inherited", "a/b/COPYING") and by[7] == by[2] and by[10] == ("MIT", "inherited", "a/LICENSE")
    assert by[3] == ("Apache-2.0", "own", None) and by[5] == ("Proprietary", "own", None)
    assert by[4] == by[8] == by[9] == (None, None, None)
    assert lic.scan(df.where("false")).count() == 0


def test_long_line_is_scanned_whole(spark):
    filler = [f"filler{i} " for i in range(6000)]
    text = "".join(filler[:3000]) + "licensed under the apache license version 2 0 " + "".join(filler[3000:])
    df = spark.createDataFrame([(1, "a", text)], "id long, path string, text string")
    assert lic.scan(df, threshold=0.5).first().licence == "Apache-2.0"


def own(text):
    """(licence, score) of a text by scoring every line, window and stretch there is."""
    at, templates = lic.anchors(), [t for ts in lic.TEMPLATES.values() for t in ts]
    sizes = [len(lic._terms(t)) for t in templates]
    found = []
    for piece in re.split(r"\n|(?<=[.!?;])\s+", text or ""):
        terms = lic._terms(piece)
        if any(" ".join(p) in at for p in zip(terms, terms[1:])):
            for size, step in lic.WINDOWS:
                last = max(0, math.ceil((len(terms) - size) / step))
                found += [(True, terms[k * step : k * step + size]) for k in range(last + 1)]
    terms = lic._terms(text or "")
    for i in range(len(terms) - 1):
        for template, k in at.get(" ".join(terms[i : i + 2]), ()):
            if i >= k and i - k + sizes[template] <= len(terms):
                found.append((False, terms[i - k : i - k + sizes[template]]))
    by = {}
    for line, terms in found:
        name, score = cosine(" ".join(terms))
        if score >= lic.THRESHOLD and (line or len(terms) >= lic.SHORT or score >= lic.SURE):
            by.setdefault(name, []).append((line, score))
    if not by:
        return None, None
    name = min(by, key=lambda n: (-max(s for _, s in by[n]), n))
    return name, max((s for line, s in by[name] if line), default=max(s for _, s in by[name]))


def test_whole_table(spark, sf):
    """Licence, score and origin of every document, by scoring everything and by walking up the folders."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op7_license(spark, sf).collect()}
    mine = {i: own(d.text) for i, d in docs.items()}
    folders = {}
    for i, r in rows.items():
        if mine[i][0]:
            folders.setdefault(r.path.rpartition("/")[0], []).append((-mine[i][1], r.path, mine[i][0]))
    assert len({n for n, _ in mine.values()}) > 3 and len(rows) == len(docs)
    for i, r in rows.items():
        name, score, origin, source = *mine[i], "own", None
        if not name:
            folder, origin = r.path.rpartition("/")[0], None
            while folder and folder not in folders:
                folder = folder.rpartition("/")[0]
            if folder:
                minus, source, name = min(folders[folder])
                score, origin = -minus, "inherited"
        assert (r.licence, r.origin, r.origin_path) == (name, origin, source) and r.score == pytest.approx(score, abs=2e-6)
    assert any(r.origin == "inherited" for r in rows.values())
