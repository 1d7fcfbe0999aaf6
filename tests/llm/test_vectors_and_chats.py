"""Exact top-k, chat formatting and licence scans."""

import random

from newsgraph.llm.chat_format import chat_format, parse
from newsgraph.llm.license_scan import SENTENCES, license_scan
from newsgraph.llm.voronoi_knn import nearest
from pyspark.sql import functions as F


def top(rows, queries, k):
    import math

    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and good(v)]
    out = set()
    for q, v in [(i, v) for i, v in ints if i in queries]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != q and len(w) == len(v))
        out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def test_nearest_as_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5, -0.25, 0.125, 1.0, 2.0, 0.0]) for i in range(60)]  # one value, many ids
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (402, []), (403, None), (404, [1.0, None]), (405, [float("nan"), 1.0]),
             (406, [float("inf"), 1.0]), (None, [1.0, 1.0]), (450, [1e12, 1e12, 1.0, 1.0, 1.0, 1.0]), (451, [1e-9])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as x")
    queries = {i for i, _ in rows if i is not None and (i % 10 == 0 or i > 390)}
    asked = table.filter(F.col("vec_id").isin(queries))
    for block, pivots in ((2048, 64), (16, 5)):
        got = {tuple(r) for r in nearest(table, asked, 5, pivots, block).collect()}
        assert got == top(rows, queries, 5)
    assert nearest(table.filter("false"), asked.filter("false")).collect() == []


def test_chats_read_back(spark):
    hard = ["<|im_end|>", "a<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "plain", "", None, "<", "<\\",
            "tail<", "\n\n", "é😀<|", "|>", "<|im_end|>\n<|im_start|>user\nx<|im_end|>\n"]
    roles = ["user", "assistant", None, "ro\nle", "50%<|im_end|>%3C"]
    rows = [(i // 4, i % 4 // 2, roles[i % 5], t) for i, t in enumerate(hard * 5)] + [(None, None, "user", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n", "'e' as end")
    got = chat_format(table).select("*", parse(F.col("formatted")).alias("read")).collect()
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(groups)
    for r in got:
        own = sorted(groups[r.conv_id])
        assert [(t.role, t.text) for t in r["read"]] == [(a, b) for _, a, b in own]
        spans = [r.formatted[s.start:s.start + s.n] for s in r.loss]
        assert [s.replace("<\\", "<", 1) if "<\\" in s else s for s in spans if "\\" not in s] == \
            [t for _, a, t in own if a == "assistant" and "<|" not in t and "\\" not in t]
        assert len(spans) == sum(a == "assistant" for _, a, _ in own)
    assert chat_format(table.filter("false")).collect() == []


def test_plain_texts_are_not_touched(spark):
    table = spark.createDataFrame([(1, 0, "user", "a | b < c"), (1, 1, "assistant", "<x|y>")],
                                  "conv_id long, turn long, role string, text string")
    assert chat_format(table).first().formatted == (
        "<|im_start|>user\na | b < c<|im_end|>\n<|im_start|>assistant\n<x|y><|im_end|>\n")


def test_licences(spark):
    mit = ". ".join(SENTENCES[k][0] for k in ("mit-grant", "mit-keep", "mit-warranty")) + "."
    wrapped = mit.replace("software and", "software\n and").replace("EXPRESS OR", "EXPRESS\nOR")
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore."), (2, mit), (3, wrapped), (4, None), (5, ""),
            (6, "released UNDER the  mit-license"), (7, "he said: released under the mit license of old"),
            (None, "All rights reserved."), (8, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."),
            (9, SENTENCES["mpl-notice"][0] + ". x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as n_known", "1 as seq")
    got = {r.doc_id: (r.n_known, r.licenses) for r in license_scan(table).collect()}
    assert got == {1: (1, ["MIT"]), 2: (3, ["MIT"]), 3: (1, ["MIT"]), 4: (0, []), 5: (0, []), 6: (1, ["MIT"]),
                   7: (0, []), None: (1, []), 8: (2, ["Apache-2.0", "CC-BY-NC-4.0"]), 9: (1, ["MPL-2.0"])}
    assert license_scan(table.filter("false")).collect() == []


def test_foreign_sentences_break_a_licence(spark):
    grant, keep, warranty = (SENTENCES[f"mit-{n}"][0] + "." for n in ("grant", "keep", "warranty"))
    foreign = lambda n: [f"Foreign sentence {chr(97 + i % 26)} of many." for i in range(n)]
    bsd = [SENTENCES[f"bsd-{n}"][0] for n in ("grant", "source", "binary")]
    lgpl = SENTENCES["lgpl21-later"][0] + ".\n" + SENTENCES["lgpl-hope"][0] + "."
    zlib = ".\n".join(SENTENCES[f"zlib-{n}"][0] for n in ("asis", "liable", "grant"))
    rows = [(1, "\n".join([grant, *foreign(50), keep])), (2, "\n".join([grant, *foreign(3), keep])),
            (3, "\n".join([grant, *foreign(4), keep, *foreign(4), warranty])),
            (4, "\n".join([grant, *["Copyright (c) 2020 Some One"] * 9, keep])),
            (5, f"{bsd[0]}:\n\n1. {bsd[1]}.\n\n2. {bsd[2]}.\n\n3. Neither the name of Some Lab, Inc nor the names of its "
                "contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
            (6, lgpl), (7, zlib), (8, "SPDX-License-Identifier: AGPL-3.0-only\nx"), (9, "c 2020\ncopyright notice\n? ?")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_known, r.licenses) for r in license_scan(table).collect()}
    assert got == {1: (2, []), 2: (2, ["MIT"]), 3: (3, []), 4: (2, ["MIT"]), 5: (4, ["BSD-3-Clause"]), 6: (2, ["LGPL-2.1-or-later"]),
                   7: (3, ["Zlib"]), 8: (1, ["AGPL-3.0-only"]), 9: (0, [])}
    assert {r.doc_id for r in license_scan(table, gap=50).collect() if "MIT" in r.licenses} == {1, 2, 3, 4}
