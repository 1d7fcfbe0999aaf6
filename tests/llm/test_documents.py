"""Line dedup, decontamination, language ID and packing on small awkward tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from newsgraph.llm import decontaminate as D, language_id as L, line_dedup as LD, packing as P

LINE = "A line that is long enough to count as a repeated one, truly"


def test_lines(spark):
    rows = [(i, f"own {i}\n  {LINE if i % 2 else LINE.upper()}\t\nshort") for i in range(4)]
    rows += [(9, LINE + "\n" + LINE), (9, LINE), (None, LINE), (7, None), (8, ""), (20, "x" * 39 + "é"), (21, "tail\n")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "1 as doc").repartition(3)
    got = {(r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in LD.line_dedup(table).collect()}
    want = {(i, 3, 1, f"own {i}\nshort") for i in range(4)}
    want |= {(9, 2, 0, LINE + "\n" + LINE), (9, 1, 0, LINE), (None, 1, 0, LINE), (7, 1, 0, ""), (8, 1, 0, ""),
             (20, 1, 0, "x" * 39 + "é"), (21, 2, 0, "tail\n")}
    assert got == want
    kept = LD.without_repeated_lines(table)
    assert kept.columns == table.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(d, k if d != 7 else None) for d, _, _, k in want}


def test_lines_at_the_bounds(spark):
    exact = "y" * 39 + "é"  # 40 code points
    rows = [(i, exact) for i in range(5)] + [(10 + i, "z" * 39) for i in range(6)] + [(20 + i, "w" * 40) for i in range(4)]
    rows += [(20, "w" * 40)]  # four ids in five rows
    got = {(r.doc_id, r.n_dropped) for r in LD.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1) for i in range(4)} | {(4, 0)} | {(10 + i, 0) for i in range(6)} | {(20 + i, 0) for i in range(4)}


def test_benchmark(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    items = [(1, " ".join(words)), (2, "Zwölf Boxkämpfer"), (3, None), (4, "--"), (None, "nameless item here"), (10, " ".join(words[2:]))]
    docs = [(1, "x " + ", ".join(words[:10]).upper() + " y"), (2, " ".join(words)), (3, " ".join(words[:9])),
            (4, "die zwölf-boxkämpfer!"), (5, None), (6, ""), (None, "zwölf boxkämpfer"), (7, "a nameless ITEM, here"),
            (8, "zwölf"), (9, "boxkämpfer. zwölf")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'i' as item", "0 as n")
    want = {(1, 10, ("1",)), (2, 12, ("1", "10")), (3, 0, ()), (4, 2, ("2",)), (5, 0, ()), (6, 0, ()), (None, 2, ("2",)),
            (7, 3, ()), (8, 0, ()), (9, 0, ())}
    for block in (D.BLOCK_WINDOWS, 3):
        found = D.benchmark_hits(table, bench, block_windows=block).collect()
        got = {(r.doc_id, len({w for h in r.hits or () for w in range(h.start, h.start + h.n)}), tuple(r["items"] or ()))
               for r in found}
        assert got == want
    clean = D.clean_documents(table, bench)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {3, 5, 6, 8, 9}
    none = bench.filter("false")
    assert D.clean_documents(table, none).count() == len(docs)


def test_language(spark):
    rng = random.Random(5)
    syllables = {"aa": "ba ko li mu", "bb": "sch ein ung tz", "cc": "ção ñe ll ous"}
    rows = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choices(syllables[lang].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(8, 40)))
        rows.append((i, text, lang))
    rows += [(1000, None, "aa"), (1001, "123 -- 4", "bb"), (1002, "", None), (None, "ba ko li mu ba", "aa"), (5, rows[5][1], None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5 as score", "1 as h")
    model = L.train(table)
    got = L.predict(table, model).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    held = {r.doc_id for r in table.filter(L.held_out()).collect()}
    assert held == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    right = [by_id[i].lang_pred == lang for i, _, lang in rows[:600] if i in held]
    assert len(right) > 100 and np.mean(right) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert (model.table == 0).mean() > 0.5  # sparse
    other = L.predict(table.drop("lang", "score"), model).collect()
    assert {(r.doc_id, r.lang_pred) for r in other} == {(r.doc_id, r.lang_pred) for r in got}


def test_no_language_is_left_out(spark, monkeypatch):
    """More languages than the full sample is meant for: all are learnt, from fewer documents each."""
    monkeypatch.setattr(L, "MAX_LANGUAGES", 2)
    rng = random.Random(5)
    syllables = {"aa": "ba ko li mu", "bb": "sch ein ung tz", "cc": "fjo rd yv kk", "dd": "xe qu zi nh"}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang].split(), k=3)) for _ in range(30)), lang)
            for i, lang in enumerate(rng.choices(list(syllables), weights=(1, 1, 1, 7), k=300))]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(table, per_language=40)
    assert model.languages == sorted(syllables)
    got = {r.doc_id: r.lang_pred for r in L.predict(table.drop("lang"), model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_language_without_labels(spark):
    table = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[-2:] for r in L.predict(table, L.train(table)).collect()] == [("und", 0.0)]


def test_packing(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé'XY.!1", k=rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 30, 300, 3000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (3, rows[3][1]), (502, "İΣ <|endoftext|> \x1c\u0085 ﬁ")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as offset").repartition(3)
    tokenizer = Tokenizer.from_file(P.tokenizer_path())
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in rows}
    got = P.packing(table).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        copies = 2 if d == 3 else 1
        assert sum(n for _, n in own) == copies * len(ids[d])
    for own in sequences.values():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at <= P.CAPACITY
    total = sum(len(ids[d]) for d, _ in rows)
    assert len(sequences) <= total / P.CAPACITY * 1.03 + 3
    assert P.packing(table.filter("false")).collect() == []


def test_packing_does_not_follow_partitions(spark):
    rows = [(i, f"word {i} and another") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(50)
    got = P.packing(table).collect()
    assert {r.doc_id for r in got} == set(range(300)) and len(got) == 300
    total = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) == -(-total // P.CAPACITY)
    pieces = P.token_pieces(table, P.tokenizer_path(), keep_ids=True)
    again = P.packed(pieces, block=7).collect()  # rests of several tasks
    loads = defaultdict(int)
    for r in again:
        assert len(r.ids) == r.length
        loads[r.sequence_id] += r.length
    assert len(again) == 300 and max(loads.values()) <= P.CAPACITY and len(loads) < 50


@pytest.mark.parametrize("sizes", [[5], [8, 7, 6, 5, 4], [10] * 9 + [1] * 5])
def test_differencing(sizes):
    place = P.near_equal(np.array(sizes), 12)
    loads = np.bincount(place, weights=sizes)
    assert loads.max() <= 12 and len(place) == len(sizes)


def test_differencing_is_near_equal():
    place, load = P.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert load <= 16 and sorted(np.bincount(place, weights=[8, 7, 6, 5, 4])) in ([14, 16], [15, 15])


def test_kept_ids(spark):
    got = P.token_pieces(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), P.tokenizer_path(), keep_ids=True).first()
    assert got["ids"][-1] == 1 and len(got["ids"]) == got.length and re.fullmatch(r"\d+", str(got.ids_crc32))


def dense_differencing(sizes, windows):
    """Each partial partition with a place for every window, as the method is written down."""
    heap = [(-(s if windows > 1 else 0), rank, [s] + [0] * (windows - 1), [[i]] + [[] for _ in range(windows - 1)])
            for rank, (s, i) in enumerate(sorted(((int(s), i) for i, s in enumerate(sizes)), key=lambda x: -x[0]))]
    count = len(heap)
    while len(heap) > 1:
        heap.sort(key=lambda x: x[:2])
        (_, _, a, items), (_, _, b, others) = heap[:2]
        both = sorted(zip([x + y for x, y in zip(a, b[::-1])], [x + y for x, y in zip(items, others[::-1])]), key=lambda x: -x[0])
        a, items = map(list, zip(*both))
        count += 1
        heap = [*heap[2:], (a[-1] - a[0], count, a, items)]
    place = {i: w for w, items in enumerate(heap[0][3]) for i in items}
    return [place[i] for i in range(len(sizes))], heap[0][2][0]


def test_differencing_holds_only_windows_in_use(monkeypatch):
    rng = np.random.default_rng(8)
    cases = [(rng.integers(1, most, rng.integers(1, 40)), int(rng.integers(1, 44))) for most in (4, 30, 513) for _ in range(40)]
    expected = [dense_differencing(*case) for case in cases]
    monkeypatch.setattr(P.np, "full", None)  # no dense array per item
    for case, (place, load) in zip(cases, expected):
        got = P.differencing(*case)
        assert got[0].tolist() == place and got[1] == load


def test_parts_go_to_the_merges_alone():
    from newsgraph.llm.wordcodes import WordCodes, tokenizer_path

    text = "Straße déjà-vu 12 it's o'clock x2y ... naïve_case ÀÉ ½ «quoted» end.".encode()
    other = "ﬁ Ωmega 漢字 <|endoftext|> İx".encode()
    codes = WordCodes(tokenizer_path())
    full = codes.tokenizer
    whole = [np.array(full.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in (text, other)]
    assert codes([text, other, text]) == [whole[0], whole[1], whole[0]]
    codes.forget()
    codes.tokenizer = None  # its patterns are not run again over parts that are cut already
    assert codes([text, b"", text]) == [whole[0], b"", whole[0]]
