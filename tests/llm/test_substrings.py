"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from newsgraph.llm.repeats import Unit
from newsgraph.llm.substring_dedup import WORDS, substring_dedup
from newsgraph.llm.suffix_dedup import BYTES, suffix_dedup

SCHEMA = "doc_id long, text string, path string, hash int, doc string"


def corpus(seed, words=400):
    """Documents with shared passages, copies, periodic texts, and awkward rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randint(2, 6)))
    passages = [[word() for _ in range(rng.randint(30, 120))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            parts += rng.choice(passages)[rng.randint(0, 20):] if rng.random() < 0.5 else [word() for _ in range(rng.randint(5, 80))]
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    texts += ["ab " * 200, "xy" * 300, "z" * 900, texts[0], texts[1], " ".join(passages[0]), "", "   ", "é" * 150,
              " ".join(word() for _ in range(words * 20)) + " " + texts[2]]
    rows = [(i, t, "p", 1, "d") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "p", 1, "d"), (4, texts[9], None, None, None)]  # a repeated row, and an id with another text
    rows += [(None, texts[5], "p", 1, "d"), (500, None, "p", 1, "d"), (-7, texts[6], "p", 1, "d")]
    return rows


def words_expected(rows, window):
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    least = {}
    for d, w in texts:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if least[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return Counter(out)


def bytes_expected(rows, window):
    texts = [(d, (t or "").encode()) for d, t, *_ in rows]
    seen = Counter(b[i:i + window] for d, b in texts if d is not None for i in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1 if d is not None else 0):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\x01" * window
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))),
                    bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("unit", [WORDS, Unit(True, 12, (4, 12), True)])
def test_words_as_brute_force(spark, unit):
    rows = corpus(1)
    got = Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in
                  substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), unit).collect())
    assert got == words_expected(rows, unit.window)


@pytest.mark.parametrize("unit", [BYTES, Unit(False, 40, (12, 30, 40), False)])
def test_bytes_as_brute_force(spark, unit):
    rows = corpus(2, 100)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in
                  suffix_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), unit).collect())
    assert got == bytes_expected(rows, unit.window)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).collect() == [] and suffix_dedup(empty).collect() == []


def test_digests_of_queries(spark, tmp_path):
    from newsgraph.llm.substring_dedup import op1_substring_dedup

    rows = corpus(3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in op1_substring_dedup(spark, str(tmp_path)).collect())
    assert got == Counter({(d, n, g, hashlib.sha256(k.encode()).hexdigest()): c
                           for (d, n, g, k), c in words_expected(rows, 50).items()})
