"""Notices that lines and cue words do not catch: wrapped headers, long lines, templates word for word."""

from tessera.llm import license as lic

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
MPL = """# This Source Code Form is subject to the terms of the Mozilla Public
# License, v. 2.0. If a copy of the MPL was not distributed with this
# file, You can obtain one at http://mozilla.org/MPL/2.0/."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation"""
LONG = "filler " * 300


def test_stretches_across_lines_and_in_long_ones(spark):
    texts = [(MIT, "MIT"), (MPL, "MPL-2.0"), (GPL, "GPL-3.0"), (LONG + "released under the mit license " + LONG, "MIT"), (LONG + "all rights reserved " + LONG, "Proprietary"), ("all rights of the people are under the general law", None)]
    df = spark.createDataFrame([(i, f"{i}/x", t) for i, (t, _) in enumerate(texts)], "id long, path string, text string")
    got = {r.id: (r.licence, r.origin) for r in lic.scan(df).collect()}
    assert got == {i: (want, want and "own") for i, (_, want) in enumerate(texts)}


def test_no_template_is_gated_out(spark):
    wrapped = [(name, "\n".join(t.split())) for name, ts in lic.TEMPLATES.items() for t in ts]
    df = spark.createDataFrame([(i, f"{i}/x", t) for i, (_, t) in enumerate(wrapped)], "id long, path string, text string")
    got = {r.id: r.licence for r in lic.scan(df).collect()}
    assert got == {i: name for i, (name, _) in enumerate(wrapped)}


def test_every_template_has_a_pair():
    held = {i for places in lic.anchors().values() for i, _ in places}
    assert held == set(range(sum(map(len, lic.TEMPLATES.values()))))
