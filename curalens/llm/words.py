"""Tokens of whole texts, white-space chunk by white-space chunk, for tokenizers that drop white space."""

from __future__ import annotations

import gc
import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII punctuation that may follow a word; none of it is a letter, digit or white space.
TAIL = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Memo:
    """A bounded cache in two generations: when the young one is full, it replaces the old one."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cut texts at ASCII white space (space, \\t, \\n, \\v, \\f, \\r).

    Gives the bounds of each text in ``codes``, the codes, and the distinct words they stand for.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    coded = flat.dictionary_encode()
    codes, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    full = np.asarray(pc.binary_length(words)) > 0
    if len(codes) and not full.all():
        keep = full[codes]
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return ends, codes, words


class WordTokenizer:
    """Token ids of whole texts by a tokenizers file.

    Only for files whose tokenizer drops white space, so that the ids of a text are those of its
    chunks in order. Chunks are encoded by the library once and remembered in a bounded cache.
    Unless a chunk may hold a special token, it is lower-cased (ASCII) and cut before its trailing
    punctuation first: the file lower-cases, and a run of punctuation is always cut from a letter.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo = Memo(limit)

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        if b"<|" in word or b"|>" in word:
            return (word,)
        word = word.lower()
        head = word.rstrip(TAIL)
        if head and len(head) < len(word) and (97 <= head[-1] <= 122):
            return (head, word[len(head):])
        return (word,)

    def ids_of_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        parts = [self._parts(w) for w in words]
        found: dict[bytes, bytes] = {}
        for group in parts:
            for part in group:
                if part not in found:
                    found[part] = self.memo.get(part)
        missing = [part for part, ids in found.items() if ids is None]
        if missing:
            coded = self.library.encode_batch_fast([m.decode("utf-8", "replace") for m in missing], add_special_tokens=False)
            for part, one in zip(missing, coded):
                ids = np.array(one.ids, dtype="<u4").tobytes()
                found[part] = ids
                self.memo.put(part, ids)
        return [found[g[0]] if len(g) == 1 else found[g[0]] + found[g[1]] for g in parts]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        ends, codes, words = split_words(texts)
        each = np.fromiter(map(len, self.ids_of_words(words.cast(pa.binary()).to_pylist())), np.int64, len(words)) // 4
        total = np.concatenate([[0], np.cumsum(each[codes])])
        return total[ends[1:]] - total[ends[:-1]]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ends, codes, words = split_words(texts)
        ids = np.array([*self.ids_of_words(words.cast(pa.binary()).to_pylist()), b""], dtype=object)[:-1]
        picked = ids[codes].tolist()
        return [b"".join(picked[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_loaded: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """One object per Python worker; workers are used for many tasks.

    Caches hold many small objects without cycles, so the collector of cycles runs seldom."""
    if key not in _loaded:
        gc.set_threshold(200_000, 20, 100)
        _loaded[key] = make()
    return _loaded[key]


def word_tokenizer(path: str) -> WordTokenizer:
    return once(("word", path), lambda: WordTokenizer(path))


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
