"""Vector best-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from curalens.llm.common import blocks, landed, one_array, prepare, text_of
from curalens.llm.words import word_tokenizer

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces_of(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id",
              window: int = 2048, end_id: int = 0) -> DataFrame:
    """Ids of every whole text, then the end id, cut into windows; only the last one may be shorter.

    ``salt`` numbers the pieces of a task; it spreads pieces evenly whatever their ids are.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer_path)
        salt = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        for block in blocks(batches):
            rows = []
            for doc_id, ids in zip(block.column("doc_id").to_pylist(), tokens.encode(one_array(block.column("text")))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at:at + 4 * window]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), salt))
                    salt += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int = 2048, max_docs: int = 2048, max_cost: int | None = None,
             weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Vector best-fit, longest first. Gives the bin and the offset of every item.

    An item needs its tokens, one document and the square of its tokens as attention cost. Of the
    bins with room in all three, the one with the smallest weighted norm of what would be left
    (``norm``) or the largest weighted product of need and room (``dot``) takes it; the oldest wins
    a tie. An item that fits in no open bin opens one. Every item must fit an empty bin.
    """
    max_cost = capacity * capacity if max_cost is None else max_cost
    full = np.array([capacity, max_docs, max_cost], dtype=float)
    share = np.asarray(weights, dtype=float)
    lengths = np.asarray(lengths, dtype=np.int64)
    if len(lengths) and (lengths.max() > capacity or int(lengths.max()) ** 2 > max_cost or max_docs < 1):
        raise ValueError("a piece is larger than an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((256, 3))
    names = np.empty(256, np.int64)          # of the open bins; full ones leave the list
    n_open = n_bins = 0
    for i in order.tolist():
        size = int(lengths[i])
        need = np.array([size, 1.0, size * size])
        left = room[:n_open] - need
        score = ((left / full) ** 2) @ share if rule == "norm" else -((room[:n_open] / full) @ (share * need / full))
        score[(left < 0).any(axis=1)] = np.inf
        best = int(np.argmin(score)) if n_open else -1
        if best < 0 or score[best] == np.inf:
            if n_open == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            best = n_open
            room[best], names[best] = full, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = names[best], capacity - int(room[best, 0])
        room[best] -= need
        if room[best].min() <= 0:            # the order of the others stays, so ties still go to the oldest
            room[best:n_open - 1], names[best:n_open - 1] = room[best + 1:n_open].copy(), names[best + 1:n_open].copy()
            n_open -= 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, max_docs: int = 2048, max_cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", room_pieces: int = 4096) -> DataFrame:
    """Place pieces into sequences. Pieces are dealt evenly over rooms of about ``room_pieces``
    and each room is packed on its own, so a task holds a room at most; a room wastes one partly
    filled sequence or so."""
    rooms = max(1, -(-pieces.count() // room_pieces))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "salt"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(rows["length"].to_numpy(), capacity, max_docs, max_cost, weights, rule)
        return rows.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return (pieces.withColumn("room", F.pmod(F.xxhash64("salt"), F.lit(rooms)))
            .groupBy("room").applyInPandas(place, PLACED))


def pack_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id",
                   window: int = 2048, **limits) -> DataFrame:
    """Pack every document whole into sequences of at most ``window`` tokens.

    Null or empty text is one end id. Each row is a document of its own, also when its id is null
    or repeated; equal lengths are placed in the order of id and piece. An empty table gives no
    rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    pieces = landed(pieces_of(docs, tokenizer_path, text_col, id_col, window), "pieces")
    return pack(pieces, capacity=window, **limits)
