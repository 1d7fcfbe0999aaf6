"""Different texts whose polynomial hashes modulo a power of two agree are different all the same."""

import numpy as np
import pytest

from newsgraph.llm.jaccard_join import components, one_of_each
from newsgraph.llm.substring_dedup import substring_dedup
from newsgraph.llm.suffix_dedup import suffix_dedup
from newsgraph.llm.textkit import Rolling, byte_symbols


def thue_morse(length, one, other):
    word = [0]
    while len(word) < length:
        word += [1 - x for x in word]
    return [(one, other)[x] for x in word[:length]]


@pytest.mark.parametrize("length", [256, 1024, 4096])
def test_hashes(length):
    pair = [byte_symbols(np.frombuffer("".join(thue_morse(length, *letters)).encode(), np.uint8)) for letters in ("ab", "ba")]
    hashes = [Rolling(p).of(np.array([0]), np.array([length]))[0] for p in pair]
    assert hashes[0] != hashes[1] and hashes[0] == Rolling(pair[0]).windows(length)[0]
    # the same sequence has one hash wherever it stands
    both = Rolling(np.concatenate([pair[1], pair[0], pair[1]]))
    assert both.of(np.array([0, length, 2 * length]), np.array([length, 2 * length, 3 * length])).tolist() == [
        hashes[1], hashes[0], hashes[1]]


def texts():
    word, complement = ("".join(thue_morse(256, *letters)) for letters in ("ab", "ba"))
    rng = np.random.default_rng(4)
    rest = " ".join("".join(rng.choice(list("cdefgh"), 6)) for _ in range(70))
    # words that collide, alone and among shared ones, and word sequences of the same kind
    return [word, complement, f"{rest} {word}", f"{complement} " * 60, f"{word} " * 60,
            " ".join(thue_morse(256, "ax", "by")), " ".join(thue_morse(256, "by", "ax"))]


def test_operators(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    windows = [{tuple(w[i:i + 50]) for i in range(len(w) - 49)} for w in (t.split() for _, t in rows)]
    assert not any(a & b for i, a in enumerate(windows[:5]) for b in windows[:i])
    removed = {r.doc_id: r.n_removed for r in substring_dedup(docs).collect()}
    assert {d: n for d, n in removed.items() if d < 5} == dict.fromkeys(range(5), 0)

    data = [t.encode() for _, t in rows]
    strings = {}
    for d, b in enumerate(data):
        for i in range(len(b) - 199):
            strings.setdefault(b[i:i + 200], []).append((d, i))
    want = []
    for d, b in enumerate(data):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if len(strings[b[i:i + 200]]) > 1:
                gone[i:i + 200] = b"\1" * 200
        want.append(sum(gone))
    assert {r.doc_id: r.n_removed for r in suffix_dedup(docs).collect()} == dict(enumerate(want))

    component = {r.doc_id: r.component_id for r in components(docs).collect()}
    assert {d: c for d, c in component.items() if d < 5} == {d: d for d in range(5)}


def test_one_of_each_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", 9, "k"), (2, "a b c d e f", 8, "l"), (None, "a b c d e f", 7, "m"), (3, None, 6, "n"), (1, "a b c d e f", 5, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, _keep string")
    assert sorted(map(tuple, one_of_each(docs).collect()), key=repr) == sorted((r for r in rows if r[0] != 2), key=repr)
    assert one_of_each(docs.limit(0)).collect() == []
