"""Operators 11 to 13 against brute force, round trips and odd tables."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.fs as fs
import pytest
import zstandard
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from newsgraph.llm import prefix_trie as PT, token_files as TF, vector_codes as VC
from newsgraph.llm.wordcodes import WordCodes, tokenizer_path


# ---- vector codes ------------------------------------------------------------

@pytest.mark.parametrize("leaves", [1, 3, 2048])
def test_trie_finds_the_nearest_entries(monkeypatch, leaves):
    monkeypatch.setattr(VC, "LEAVES", leaves)
    rng = np.random.default_rng(leaves)
    for spread, size in ((2, 4), (40, 3), (3, 1)):
        parts, place = VC.distinct(rng.integers(-spread, spread, (500, size)))
        book = rng.integers(-spread, spread, (7, size))
        entry, error = VC.nearest(parts, book)
        full = ((parts[:, None] - book[None]) ** 2).sum(2)
        assert (entry == full.argmin(1)).all() and (error == full.min(1)).all()
        assert sorted(x.tobytes() for x in VC.sorted_bytes(parts)) == [x.tobytes() for x in VC.sorted_bytes(parts)]


def by_hand(rows, entries, rounds):
    kept = [(k, np.floor(256 * np.array(v, float)).astype(int).reshape(16, -1), label) for k, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted({k: v for k, v, _ in sorted(kept, key=lambda r: (r[0], r[1].tolist()), reverse=True)}.items())[:entries]
    books = [[v[j].tolist() for _, v in seeds] for j in range(16)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for j in range(16):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(v[j], books[j])[1]].append(v[j])
            for i, members in groups.items():
                books[j][i] = [int(sum(x)) // len(members) for x in zip(*members)]
    coded = []
    for k, v, label in kept:
        found = [near(v[j], books[j]) for j in range(16)]
        coded.append((k, "".join(f"{i:02x}" for _, i in found), int(sum(d for d, _ in found)), label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((k, c, e, sum(r[2] for r in coded if r[3] == label), digest) for k, c, e, label in coded)


SHAPE = "vec_id long, embedding array<double>, label int, code string, _extra int"


def test_codes_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.choice([-.5, -.25, 0, .1, .3], 32).tolist(), None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(60)]
    rows += [(7, rows[3][1], 1)] * 9 + [(100, None, 1), (101, [None] + [.1] * 31, 1), (102, [float("nan")] * 32, 2), (103, [float("inf")] * 32, 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE).repartition(5)
    for entries in (4, 64):
        got = sorted(map(tuple, VC.compressed(table, entries=entries).collect()))
        assert got == by_hand(rows, entries, 2)


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert VC.compressed(empty).collect() == [] and VC.compressed(empty).columns[0] == "vec_id"
    nameless = spark.createDataFrame([(None, [.5] * 16, 1, "", 1)], SHAPE)
    assert [tuple(r) for r in VC.compressed(nameless).collect()] == [(None, None, None, None, None)]
    # shorter vectors go on with zeros; a row without an id has a code
    short = spark.createDataFrame([(1, [.5] * 16, 1, "", 1), (2, [.5] * 3, 1, "", 1), (None, [.5] * 16, 2, "", 1)], SHAPE)
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in VC.compressed(short, rounds=0).collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: ("00" * 3 + "01" * 13, 0, 0), None: ("00" * 16, 0, 0)}
    with pytest.raises(PythonException):
        VC.vector_codes(spark.createDataFrame([(1, [1e9] * 16, 1, "", 1)], SHAPE), np.zeros((16, 1, 1), np.int64)).collect()


# ---- token files -------------------------------------------------------------

TEXTS = ["", None, "Hello, world", "a" * 5000, "x y z " * 3000, "ÄÖ ß Привет 你好 İ", "don't <|endoftext|> stop 's 12½ ..,,", "\x85 \x1c b"]


def tokens_of(text, tokenizer=[]):
    tokenizer = tokenizer or tokenizer.append(Tokenizer.from_file(tokenizer_path())) or tokenizer
    return tokenizer[0].encode(text or "", add_special_tokens=False).ids + [2]


def test_words_with_little_memory(monkeypatch):
    monkeypatch.setattr("newsgraph.llm.wordcodes.MEMORY_BYTES", 500)
    codes = WordCodes(tokenizer_path())
    for _ in range(2):
        for text, code in zip(TEXTS, codes([(t or "").encode() for t in TEXTS])):
            assert np.frombuffer(code, "<u4").tolist() == tokens_of(text)[:-1]


@pytest.mark.parametrize("file_bytes", [200, 1 << 25])
def test_files_read_back(spark, tmp_path, file_bytes):
    rows = [(i * 3 - 9, TEXTS[i % len(TEXTS)], 5) for i in range(40)] + [(6, "again", 5), (6, "again", 5), (None, "no id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    folder = str(tmp_path / "tokens")
    files = TF.write_token_files(docs, folder, file_bytes=file_bytes).orderBy("part").collect()
    assert (len(files) > 3) == (file_bytes == 200) and sum(f.documents for f in files) == 42
    got = TF.read_token_files(spark, folder).orderBy("start").collect()
    want = sorted((i, tokens_of(t)) for i, t, _ in rows if i is not None)
    assert sorted((r.doc_id, r.ids) for r in got) == want and [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    some = spark.createDataFrame([(6,), (0,), (6,), (5,), (None,), (10**9,), (-9,)], "doc_id long")
    assert sorted(r.doc_id for r in TF.read_token_files(spark, folder, some).collect()) == [-9, 0, 6, 6, 6]
    # any zstandard decoder reads a whole file
    plain = zstandard.ZstdDecompressor().stream_reader(open(f"{folder}/{files[0].name}", "rb"), read_across_frames=True).read()
    assert len(plain) == 2 * files[0].tokens


def test_only_requested_frames_are_read_and_checked(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    [file] = TF.write_token_files(spark.createDataFrame([(i, f"text {i} " * 50) for i in range(9)], "doc_id long, text string"), folder).collect()
    path = f"{folder}/{file.name}"
    opened = TF.TokenFile.open(fs.LocalFileSystem(), path)
    place = int(opened.table["packed"][:4].sum()) + int(opened.table["packed"][4]) // 2
    with open(path, "r+b") as f:
        f.seek(place)
        byte = f.read(1)
        f.seek(place)
        f.write(bytes([byte[0] ^ 255]))
    assert [i for i, _ in TF.TokenFile.open(fs.LocalFileSystem(), path).read(np.array([0, 3, 5, 8]))] == [0, 3, 5, 8]
    with pytest.raises(TF.BrokenFile):
        list(TF.TokenFile.open(fs.LocalFileSystem(), path).read(np.array([4])))
    for size in (os.path.getsize(path) - 3, 4, 0):
        with open(path, "r+b") as f:
            f.truncate(size)
        with pytest.raises(TF.BrokenFile):
            TF.TokenFile.open(fs.LocalFileSystem(), path)


def test_no_documents_no_files(spark, tmp_path):
    folder = str(tmp_path / "tokens")
    assert TF.write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder).collect() == []
    assert TF.read_token_files(spark, folder).collect() == []
    assert TF.read_token_files(spark, folder, spark.range(3).toDF("doc_id")).collect() == []


# ---- prefix trie -------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, key string"


def trie_by_hand(rows, every=5, heads=9):
    own = defaultdict(list)
    for c, _, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        seqs[c] = tuple(own.get(c - int(np.fmod(c, every)), [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved = lambda n: (len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0

    def below(node):
        stack, out = [node], []
        while stack:
            out.append(stack.pop())
            stack += children[out[-1]]
        return out
    out = []
    for node, convs in members.items():
        under = below(node)
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                    sum(not children[n] for n in under), sum(map(saved, under)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], TURNS).repartition(4)
    nodes = PT.prefix_trie(PT.rebuilt(PT.conversation_turns(table))).drop("key")
    return sorted(map(tuple, nodes.collect()), key=repr)


def test_trie_by_hand(spark, monkeypatch):
    monkeypatch.setattr(PT, "PIECE", 3)
    monkeypatch.setattr(PT, "TASK_ROWS", 7)
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(-6, 40), 10**12, 10**12 + 3]:
        for t in rng.permutation(int(rng.integers(1, 7))).tolist():
            rows.append((c, None if t == 0 and c % 3 else t, ["user", None, ""][t % 3], ["a", "äb", None][int(rng.integers(0, 3))]))
    rows += [(c, t, "u", "same") for c in range(100, 160, 5) for t in range(3)]  # copies
    rows += [(200, t, "u", f"only {t}") for t in range(150)]                     # a long one that no other shares
    rows += [(c, t, "u", "deep") for c in (305, 310) for t in range(12)] + [(310, 12, "u", "more")]  # one begins with the other
    rows += [(None, 1, "u", "no id")]
    assert trie(spark, rows) == trie_by_hand(rows)


def test_trie_of_few_rows(spark):
    assert trie(spark, []) == []
    # no base and few turns: a conversation without turns is a member of the root alone
    lonely = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(lonely, 0, "user", "gone")]
    assert trie(spark, rows) == trie_by_hand(rows) and len(trie(spark, rows)) == 1
    # role and text do not run together
    rows = [(5, 1, "ab", "c"), (10, 1, "a", "bc")]
    assert trie(spark, rows) == trie_by_hand(rows)
