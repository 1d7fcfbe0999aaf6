"""Token ids of whole texts, word by word, with a bounded memory of words."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

#: Bytes that a worker's memory of words may take, about. When half is full, the words of the half
#: before are forgotten, unless they were met since.
MEMORY_BYTES = 80 << 20
#: What a word takes beside its letters and ids.
_ENTRY = 150
#: Words that go to the tokenizer in one call.
_CALL = 4096
#: Text that is looked at together; one longer text stands alone.
GROUP_BYTES = 1 << 20


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in their order, in lists of about GROUP_BYTES."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= GROUP_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


class WordCodes:
    """Token ids of texts as bytes (unsigned, little-endian, 4 each), with a memory of words.

    Texts of Latin letters are cut as the tokenizer cuts them before its merges, and each part
    is looked up. Beyond those, case, normal form and white space may follow rules that
    the pattern here does not know: such texts are split at ASCII white space, where the
    tokenizer splits too, and their words go to it as they are.
    """

    #: Fixed by the vocabulary file: its pattern of parts, for characters below U+0250 in lower case.
    PATTERN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
    ODD = re.compile("[\x1c-\x1f\x85İɐ-\U0010ffff]")
    #: Two characters in a row that are one part together, unlike a single point or comma.
    MARKS = re.compile(r"[.,_](?:(?<=_)|[^\w\s]|(?<=[^\w\s][.,]))")
    #: Fixed by the vocabulary file: the mark at the end of a part's last token.
    PART_END = "</w>"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        #: For parts, which are cut and in normal form already: the same merges, no patterns before them.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.size = 0
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(self.PART_END)]] = True

    def forget(self) -> None:
        self.known, self.before, self.size = {}, {}, 0

    def _keep(self, words: list[str], codes: list[bytes]) -> None:
        self.known.update(zip(words, codes))
        self.size += sum(map(len, words)) + sum(map(len, codes)) + _ENTRY * len(words)

    def _encode(self, words: list[str]) -> None:
        for low in range(0, len(words), _CALL):
            some = words[low:low + _CALL]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self._keep(some, [_bytes(e.ids) for e in found])

    def _encode_parts(self, parts: list[str]) -> None:
        """Parts go to the tokenizer as one text; each ends with the token that carries the mark."""
        for low in range(0, len(parts), _CALL):
            some = parts[low:low + _CALL]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                self._encode(some)
                continue
            data, cut = ids.tobytes(), (4 * ends).tolist()
            self._keep(some, [data[i:j] for i, j in zip([0, *cut[:-1]], cut)])

    def _learn(self, plain: set[str], other: set[str]) -> None:
        """Plain words are put together from their parts, all others go to the tokenizer whole."""
        met = [w for words in (plain, other) for w in words if w in self.before]
        self._keep(met, [self.before[w] for w in met])
        plain, other = plain.difference(met), other.difference(met)
        cut = {w: self.PATTERN.findall(w) for w in plain if not w.isalpha()}
        single = {p for parts in cut.values() for p in parts}.union(w for w in plain if w not in cut)
        self._encode_parts(sorted(p for p in single if p not in self.known))
        several = [w for w, parts in cut.items() if len(parts) > 1]
        self._keep(several, [b"".join([self.known[p] for p in cut[w]]) for w in several])
        self._encode(sorted(w for w in other if w not in self.known))

    def _plain(self, text: str) -> bool:
        return not self.ODD.search(text) and "<|" not in text

    def _words(self, text: str) -> list[str]:
        """The words of a plain text, each plain and in lower case."""
        text = text.lower()
        if not self.MARKS.search(text):
            return text.replace(".", " .").replace(",", " ,").split()
        return self.PATTERN.findall(text)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.size > MEMORY_BYTES // 2:
            self.before, self.known, self.size = self.known, {}, 0
        plain, other, split = set(), set(), []
        get = self.known.get
        for text in texts:
            text = text.decode("utf-8", "replace")
            is_plain = self._plain(text)
            words = self._words(text) if is_plain else re.split("[ \t\n\x0b\x0c\r]+", text)
            found = list(map(get, words))
            if None in found:
                (plain if is_plain else other).update([w for w, code in zip(words, found) if code is None])
                split.append((words, found))
            else:
                split.append((None, b"".join(found)))
        other -= plain
        if plain or other:
            self._learn(plain, other)
        code = self.known.__getitem__
        return [found if words is None else b"".join([code(w) if c is None else c for w, c in zip(words, found)])
                for words, found in split]


_CODES: dict[str, WordCodes] = {}


@contextmanager
def word_codes(path: str) -> Iterator[WordCodes]:
    """The coder of this Python worker; its words are forgotten when the task ends, so an idle worker holds none."""
    if path not in _CODES:
        _CODES[path] = WordCodes(path)
    try:
        yield _CODES[path]
    finally:
        _CODES[path].forget()


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
