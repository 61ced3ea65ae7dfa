import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import license_rules as rules
from tidemill.llm import threshold_topk as top
from tidemill.llm.license_rules import SENTENCES, license_scan

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5):
    """Each query against each other row."""
    sound = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            sound.setdefault((i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)))
    found = []
    for q, qv in sound:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in sound if i != q and len(v) == len(qv))
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(found)


def search(spark, rows, **options):
    found = top.exact_topk(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 50 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def test_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "x") for i in range(320)]
    rows += [(1000 + i, rows[7][1], "copy") for i in range(20)] + [(2000 + i, [0.0] * 6, "zero") for i in range(9)]
    rows += [(4000, None, ""), (4050, [1.0, None, 1.0, 1.0, 1.0, 1.0], ""), (4100, [float("nan")] * 6, ""), (4150, [float("inf")] * 6, ""), (4200, [], "")]
    rows += [(None, [9.0] * 6, ""), (5000, [0.5, 0.25], "short"), (5050, [1.0, -1.0], "short"), rows[50], rows[3]]
    for options in ({}, {"candidates": 40, "per_block": 3}):
        assert search(spark, rows, **options) == brute(rows)


def test_few_and_no_rows(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0], "")]) == []
    assert search(spark, [(0, [1.0], ""), (1, [2.0], ""), (50, [-1.0], "")]) == [(0, 1, 1, 131072), (0, 2, 50, -65536), (50, 1, 0, -65536), (50, 2, 1, -131072)]


@pytest.mark.parametrize("spread", [3, 300, 2**28])
def test_queries_stop_only_when_nothing_can_beat_them(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread, (200, 5))
    x[40:80] = x[40]
    ids, q = np.arange(200) * 3, x[::9]
    own = ids[::9]
    query, found, score = top.threshold_topk(ids, x, own, q, 5)
    for i in range(len(q)):
        expected = sorted((-int(q[i] @ x[j]), int(ids[j])) for j in range(200) if ids[j] != own[i])[:5]
        assert sorted((-int(s), int(ids[f])) for n, f, s in zip(query, found, score) if n == i) == expected


def test_large_components_take_part(spark):
    """Finite components of any size count, and their scores are compared exactly."""
    rows = [(0, [1.0, 1.0]), (1, [1e17, 0.0]), (2, [1e17, 1 / 256]), (3, [-1e300, 5.0]), (4, [1e200, 1e200]), (5, [3.0, 0.0])]
    found = top.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=9).collect()
    exact = {i: sum(256 * int(256 * x) if abs(x) < 1e15 else 256 * 256 * int(x) for x in v) for i, v in rows[1:]}
    order = sorted(exact, key=lambda i: (-exact[i], i))
    assert [r.id for r in sorted(found, key=lambda r: r.rank)] == order == [4, 2, 1, 5, 3]
    assert {r.id: r.score for r in found} == {i: min(max(s, -(1 << 63)), (1 << 63) - 1) for i, s in exact.items()}


def test_a_clear_winner_needs_few_rows():
    """The lists are not read to their ends."""
    x = np.concatenate([np.full((5, 4), 1000), np.random.default_rng(1).integers(-3, 3, (500, 4))])
    q = np.full((1, 4), 10)
    query, found, _ = top.threshold_topk(np.arange(505), x, np.array([-1]), q, 5)
    assert sorted(found) == [0, 1, 2, 3, 4]


# -- licences ------------------------------------------------------------------------

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0"""


@pytest.mark.parametrize(
    ("text", "licenses"),
    [(None, ""), ("", ""), ("no permission here", ""), (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + "\n" + NAMES, "BSD-3-Clause"),
     (APACHE, "Apache-2.0"), ("x.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
     ("Released under the MIT License!! and more", "MIT"), ("They say Released under the MIT License.", ""),
     ("\n".join(reversed(BSD.split("\n"))), ""), (MIT + "\n" + APACHE, "Apache-2.0,MIT")],
)
def test_rules(spark, text, licenses):
    row = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.licenses == licenses and row.n_licenses == len([x for x in licenses.split(",") if x])


def test_no_known_sentence_is_left_out_unread():
    for sentence in (*rules.SENTENCES.values(), *rules.MORE_SENTENCES.values()):
        assert re.search(rules.ANCHOR, sentence.upper())
    for wording in rules.SHORT.values():
        assert re.search(rules.ANCHOR, "released under " + re.sub(r"\([^()]*\)\??", "", wording))


def test_sentences_without_the_word_license(spark):
    cases = [("Released under CC BY 4.0.", "CC-BY-4.0"), ("This is free and unencumbered software released into the public domain.", "Unlicense")]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.licenses for r in license_scan(rows).orderBy("doc_id").collect()] == [name for _, name in cases]


def test_known_sentences_are_normalised():
    assert all(s == " ".join(s.split()) == s.lower() and not s.endswith(".") for s in SENTENCES.values())


def test_license_scan_of_odd_tables(spark):
    schema = "doc_id long, text string, licenses int, n int"
    assert license_scan(spark.createDataFrame([], schema)).count() == 0
    long = "word. " * 100_000 + "\nReleased under the MIT License."
    out = license_scan(spark.createDataFrame([(None, long, 1, 2), (1, long, 1, 2), (1, long, 1, 2)], schema))
    assert out.columns == ["doc_id", "n", "sentence_ids", "licenses", "n_licenses"]
    assert [r.licenses for r in out.collect()] == ["MIT"] * 3


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful."""
GPL2 = GPL.replace(":", ";").replace("Foundation,", "Foundation;").replace("version 3", "version 2")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Copyright (c) 2020 Jane Doe
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def commented(text):
    return "\n".join(f" * {line}".rstrip() for line in text.split("\n"))


def test_real_notices(spark):
    cases = [
        (GPL, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), (commented("x.c\n\n" + GPL), "GPL-3.0-or-later"),
        (GPL.replace("This program is free", "Foo is free"), "GPL-3.0-or-later"), (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
        ("MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + MIT, "MIT"), ("Copyright 2020 Jane Doe\n" + MIT, "MIT"), (commented("MIT License\n\n" + MIT), "MIT"),
        (BSD + "\n" + NAMES.replace("the copyright holder", "Foo Inc"), "BSD-3-Clause"), (MPL, "MPL-2.0"), (ISC, "ISC"),
        ("This project is licensed under the MIT License.", "MIT"), ("The code is released under the terms of the Apache License, Version 2.0.", "Apache-2.0"),
        ("Nobody said it is licensed under the MIT License.", ""),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in license_scan(rows).collect()}
    assert [got[i] for i in range(len(cases))] == [licences for _, licences in cases]
