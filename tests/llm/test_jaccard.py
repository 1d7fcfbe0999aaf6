"""Jaccard join against brute force, on families of near copies and very small sets."""

import random
import re

import pytest

from newsgraph.llm.jaccard_join import bands_of, components, distance, one_of_each, partitions


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(d), root(e)
                parent[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d) if d is not None and s else d) for d, s in sets), key=str)


def families(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) + rng.choice("aeiou")
    rows = []
    for size in (1, 3, 5, 6, 8, 9, 11, 14, 20, 30, 45, 90, 160, 400):
        for _ in range(4):
            base = [word() for _ in range(size)]
            for _ in range(rng.randint(1, 7)):
                own = list(base)
                for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 40), size // 25])):
                    at = rng.randrange(len(own))
                    if rng.random() < 0.5:
                        own[at] = word()
                    elif rng.random() < 0.5:
                        own = own[:at] + own[at + 1:] or ["x"]
                    else:
                        own.insert(rng.choice([0, len(own)]), word())
                rows.append(" ".join(own).title() if rng.random() < 0.2 else "  ".join(own))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "One"), (None, rows[0][1]), (5, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_brute_force(spark, seed):
    rows = families(seed)
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as class").repartition(4)
    got = sorted((tuple(r) for r in components(table).collect()), key=str)
    assert got == expected(rows)


def test_one_of_each_keeps_columns(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other words"), (None, "a b c d e f"), (4, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as label")
    got = one_of_each(table)
    assert got.columns == table.columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 3, 4, None]


def test_empty_table(spark):
    assert components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bands_cover_linked_sizes():
    for a in range(4, 3000):
        for b in {a, a + 1, a * 100 // 80}:
            if a * 100 >= b * 80:
                shared = set(bands_of(a)) & set(bands_of(b))
                assert shared and all((a + b) // 9 <= distance(j) < partitions(j)[0] for j in shared)
