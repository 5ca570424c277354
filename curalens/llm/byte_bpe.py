"""Byte-level BPE by longest matches and adjacent-token compatibility."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from curalens.llm.common import blocks, one_array, prepare, text_of
from curalens.llm.words import Memo, once

WHITE = r"\p{White_Space}"


def _compiled(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, control separators left out."""
    inside = pattern.replace(r"[^\s", rf"[^{WHITE}")
    return regex.compile(inside.replace(r"\S", rf"[^{WHITE}]").replace(r"\s", WHITE))


class ByteBpe:
    """Encoder and decoder for a table of byte strings and their ranks.

    BPE leaves a border between two neighbouring tokens only if no merge across it comes before the
    merges that made them; that depends on the two tokens alone and is remembered per pair. A
    sequence whose neighbours all fit is the one BPE makes. So a match is read off an automaton
    (bytes as Latin-1 characters), the longest token first, and a position from which no fitting
    token leads on is given up for good: each position is left once, so time is linear.
    """

    def __init__(self, path: str, pattern: str, limit: int = 300_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.data = {rank: data for data, rank in self.ranks.items()}
        self.pattern = _compiled(pattern)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        self.size = [0] * (max(self.data) + 1)
        self.shorter = [-1] * (max(self.data) + 1)                # the longest token that begins a token
        made = set()
        for rank in sorted(self.data):
            data = self.data[rank]
            if len(data) > 1:
                for cut in range(1, len(data)):
                    pair = self.ranks.get(data[:cut], rank), self.ranks.get(data[cut:], rank)
                    if pair[0] in made and pair[1] in made and self._stays_open(*pair):
                        self.parts[rank], self.joined[pair] = pair, rank
                        break
                else:        # merges never reach it; only a match that equals it whole gets it
                    continue
            made.add(rank)
            self.size[rank] = len(data)
            self.automaton.add_word(data.decode("latin-1"), rank)
        for rank in made:
            data = self.data[rank]
            self.shorter[rank] = next((r for cut in range(len(data) - 1, 0, -1) if (r := self.ranks.get(data[:cut], -1)) in made), -1)
        self.automaton.make_automaton()
        self.open, self.pieces, self.chunks = Memo(limit), Memo(limit), Memo(limit)

    def _stays_open(self, left: int, right: int) -> bool:
        """Undo the merges beside a border, newest first; no earlier merge may cross it."""
        newest = float("inf")
        while True:
            if self.joined.get((left, right), newest) < newest:
                return False
            of_left, of_right = self.parts.get(left), self.parts.get(right)
            if of_left is None and of_right is None:
                return True
            if of_right is None or (of_left is not None and left > right):
                newest, left = left, of_left[1]
            else:            # equal ranks merge from the left, so one across the border goes first
                newest, right = right + 1, of_right[0]

    def fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.open.get(pair)
        if known is None:
            known = self._stays_open(left, right)
            self.open.put(pair, known)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end_of_text, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        longest = [-1] * end_of_text
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size[rank]] = rank                  # of one start, the short ones come first
        given_up, tokens = bytearray(end_of_text + 1), []
        at, last, rank = 0, -1, longest[0]
        while at < end_of_text:
            while rank >= 0 and (given_up[at + size[rank]] or (last >= 0 and not fits(last, rank))):
                rank = shorter[rank]
            if rank >= 0:
                tokens.append(rank)
                at, last = at + size[rank], rank
                rank = longest[at] if at < end_of_text else -1
            else:
                given_up[at] = 1
                rank = tokens.pop()
                at, last = at - size[rank], tokens[-1] if tokens else -1
                rank = shorter[rank]
        return tokens

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            known = self.pieces.get(piece)
            if known is None:
                known = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    self.pieces.put(piece, known)
            ids += known
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.data.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        """Number of ids, ids as text, decoded bytes."""
        known = self.chunks.get(chunk)
        if known is None:
            ids = self.encode(chunk)
            known = len(ids), ",".join(map(str, ids)).encode(), self.decode(ids)
            if len(chunk) <= 64:
                self.chunks.put(chunk, known)
        return known

    def summaries(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Number of ids, digest of the ids and digest of the decoded bytes of each text.

        A single space between two characters that aren't white space always begins a match, so a
        text whose spaces are all of that kind is encoded chunk by chunk, other texts as a whole.
        """
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
        ends = (np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()).tolist()
        plain = np.array([bool(w) and not (w[0].isspace() or w[-1].isspace()) for w in words], dtype=bool)
        bad = np.concatenate([[0], np.cumsum(~plain[codes])]) if len(codes) else np.zeros(1, int)
        inner = np.ones(len(codes), dtype=bool)
        inner[[a for a, b in zip(ends, ends[1:]) if b > a]] = False
        made = np.empty(len(words), dtype=object)
        for code in np.unique(codes[inner]).tolist():
            made[code] = self._chunk(" " + words[code])
        for row, (a, b) in enumerate(zip(ends, ends[1:])):
            if bad[b] > bad[a] or a == b:
                n, ids, data = zip(self._chunk(texts[row].as_py()))
            else:
                n, ids, data = zip(self._chunk(words[codes[a]]), *made[codes[a + 1:b]].tolist())
            yield sum(n), hashlib.sha256(b",".join(ids)).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return once(("byte", path, pattern), lambda: ByteBpe(path, pattern))


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Ids of every whole text: ``doc_id``, ``ids``. Null text gives no ids; other columns are ignored."""
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for block in blocks(batches):
            ids = [coder.encode(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([one_array(block.column("doc_id")), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(encode, "doc_id long, ids array<int>"))


def decode_ids(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Bytes that the ids stand for: ``doc_id``, ``data``. Null ids give empty bytes; an unknown id is an error."""
    prepare(coded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for block in blocks(batches):
            data = [coder.decode(ids or []) for ids in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([one_array(block.column("doc_id")), pa.array(data, pa.binary())], ["doc_id", "data"])

    return (coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
            .mapInArrow(decode, "doc_id long, data binary"))


def encoding_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids again, and return digests of both.

    Null and empty texts have no ids: the digests are those of an empty string. Rows repeat as in
    the input, whatever their ids; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for block in blocks(batches):
            n, ids, data = zip(*coder.summaries(one_array(block.column("text"))))
            yield pa.RecordBatch.from_arrays([one_array(block.column("doc_id")), pa.array(n, pa.int64()), pa.array(ids), pa.array(data)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
            .mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
