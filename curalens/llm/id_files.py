"""Token ids in binary files of fixed-width bit-packed blocks.

One file holds the ids of a run of documents. Little-endian throughout:

    magic (8 bytes) | blocks | document table | block table | trailer (64 bytes)

A block is ``BLOCK_IDS`` ids of ``width`` bits each, lowest bits first in 64-bit words, then the
crc32 of those words (4 bytes). Only the last block of a file may hold fewer ids; its words are
filled up with zeros. The document table has, for every document, the number of ids before it in
the file (one more entry ends the list), then the document ids, then one byte each that is 1 where
the id is null. The block table has the byte offset of every block and of the end of the last.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from curalens.llm.common import blocks, fresh_path, one_array, prepare, text_of
from curalens.llm.words import word_tokenizer

MAGIC, BLOCK_IDS = b"IDBLOCK1", 4096
TRAILER = struct.Struct("<8sIIQQQQQQ")     # magic, width, ids in a block, ids, documents, blocks, document table, block table, 0
SEGMENT_IDS = 1 << 20
MANIFEST = "part long, file string, segment long, doc_from long, doc_to long, file_ids long, width int"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as 64-bit words: 64 ids take ``width`` words, so lane j has the same place in every group."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros((groups * 64,), np.uint64)
    lanes[:len(ids)] = ids
    lanes = lanes.reshape(groups, 64)
    words = np.zeros((groups, width), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.reshape(-1)


def unpack_bits(words: np.ndarray, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    words = words.reshape(-1, width)
    lanes = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(64):
        word, shift = divmod(lane * width, 64)
        value = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (words[:, word + 1] << np.uint64(64 - shift))
        lanes[:, lane] = value & mask
    return lanes.reshape(-1)[:n]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class IdFileWriter:
    """Writes one file from runs of documents; holds a block and the tables, not the ids."""

    def __init__(self, path: str, width: int):
        system, place = store_of(path)
        self.out, self.width = system.open_output_stream(place), width
        self.out.write(MAGIC)
        self.at, self.n_ids, self.held, self.n_held = len(MAGIC), 0, [], 0
        self.offsets, self.ends, self.doc_ids, self.nulls = [self.at], [np.zeros(1, np.int64)], [], []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents in order: their ids, where an id is null, their lengths, and all token ids one after another."""
        self.doc_ids.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.ends.append(self.n_ids + np.cumsum(lengths, dtype=np.int64))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK_IDS * BLOCK_IDS
            self._write(ids[:whole])
            self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        per_block = BLOCK_IDS // 64 * self.width
        words = pack_bits(ids, self.width).astype("<u8", copy=False)
        parts = []
        for at in range(0, len(words), per_block):
            block = words[at:at + per_block].tobytes()
            parts += [block, struct.pack("<I", zlib.crc32(block))]
            self.at += len(block) + 4
            self.offsets.append(self.at)
        self.out.write(b"".join(parts))

    def close(self) -> np.ndarray:
        """Finish the file; gives the ends of the documents, from 0."""
        if self.n_held:
            self._write(np.concatenate(self.held))
        ends = np.concatenate(self.ends)
        ids = np.concatenate(self.doc_ids) if self.doc_ids else np.zeros(0, "<i8")
        nulls = np.concatenate(self.nulls) if self.nulls else np.zeros(0, np.uint8)
        docs_at = self.at
        self.out.write(ends.astype("<i8").tobytes() + ids.tobytes() + nulls.tobytes())
        blocks_at = docs_at + 8 * len(ends) + 9 * len(ids)
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(TRAILER.pack(MAGIC, self.width, BLOCK_IDS, self.n_ids, len(ids), len(self.offsets) - 1, docs_at, blocks_at, 0))
        self.out.close()
        return ends


class IdFile:
    """Random access to one file: any run of documents or ids, only the blocks they lie in are read."""

    def __init__(self, path: str):
        system, place = store_of(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        magic, self.width, self.block_ids, self.n_ids, self.n_docs, self.n_blocks, self.docs_at, self.blocks_at, _ = TRAILER.unpack(
            self._bytes(size - TRAILER.size, TRAILER.size) if size >= TRAILER.size else b"\0" * TRAILER.size)
        if magic != MAGIC:
            raise ValueError(f"not a file of packed ids: {path}")

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def ends(self, first: int, last: int) -> np.ndarray:
        """Ids before document ``first``, then the end of each document up to ``last`` (not included)."""
        return np.frombuffer(self._bytes(self.docs_at + 8 * first, 8 * (last - first + 1)), "<i8")

    def doc_ids(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Document ids and where they are null."""
        table = self.docs_at + 8 * (self.n_docs + 1)
        return (np.frombuffer(self._bytes(table + 8 * first, 8 * (last - first)), "<i8"),
                np.frombuffer(self._bytes(table + 8 * self.n_docs + first, last - first), np.uint8) != 0)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Token ids from ``start`` up to ``stop`` (not included) of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids + 1
        offsets = np.frombuffer(self._bytes(self.blocks_at + 8 * first, 8 * (last - first + 1)), "<u8").astype(np.int64)
        data = self._bytes(int(offsets[0]), int(offsets[-1] - offsets[0]))
        words = []
        for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist()):
            block = data[a:b - 4]
            if zlib.crc32(block) != struct.unpack("<I", data[b - 4:b])[0]:
                raise ValueError("a block of packed ids is damaged")
            words.append(block)
        n = min(last * self.block_ids, self.n_ids) - first * self.block_ids
        ids = unpack_bits(np.frombuffer(b"".join(words), "<u8"), n, self.width)
        return ids[start - first * self.block_ids:stop - first * self.block_ids]

    def document(self, number: int) -> np.ndarray:
        start, stop = self.ends(number, number + 1).tolist()
        return self.ids(start, stop)


def write_id_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, file_text_bytes: int = 64 << 20,
                   text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write all ids to files in ascending document id.

    The width is the fewest bits that hold every id of the vocabulary and the end id. Texts are dealt
    in ranges of (id, row hash, row), so many rows with one id, or without an id (null ids come first), are spread as well;
    a file takes a range of about ``file_text_bytes``. A task encodes its range in order, block by block, and writes a file
    under a name of its own; the manifest names those of the attempts that counted, so a task that
    runs again leaves at most a file that nobody reads.

    Returns the manifest, one row per segment of about a million ids; ``folder/manifest`` keeps it.
    """
    spark = prepare(docs.sparkSession)
    from tokenizers import Tokenizer
    width = width_of(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_files = max(1, -(-total // file_text_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        part, writer, name = TaskContext.get().partitionId(), None, f"part-{uuid.uuid4().hex}.ids"
        for block in blocks(batches):
            writer = writer or IdFileWriter(f"{folder}/{name}", width)
            each = [ids + end for ids in tokens.encode(one_array(block.column("text")))]
            doc_ids = one_array(block.column("doc_id"))
            writer.add(doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False),
                       np.fromiter(map(len, each), np.int64, len(each)) // 4, np.frombuffer(b"".join(each), "<u4"))
        if writer:
            cuts = writer.close()
            n_docs, n_ids = len(cuts) - 1, int(cuts[-1])
            firsts = [0]
            while firsts[-1] < n_docs:
                firsts.append(max(firsts[-1] + 1, int(np.searchsorted(cuts, cuts[firsts[-1]] + SEGMENT_IDS))))
            segments = [(part, name, i, a, min(b, n_docs), n_ids, width) for i, (a, b) in enumerate(zip(firsts, firsts[1:]))]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*segments), kinds)],
                                             ["part", "file", "segment", "doc_from", "doc_to", "file_ids", "width"])

    # Equal rows are alike, so their order doesn't matter; the hash tells different texts of one id apart.
    spread = rows.withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    (spread.repartitionByRange(n_files, "doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "row")
     .select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest"))
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_id_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, in all files. Each segment is read alone,
    by the blocks that hold it, so the tasks do not depend on how large a file is.
    """
    segments = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per file: bounded by the bytes of all files over the bytes of one.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (segments.where("segment = 0").select(F.col("file").alias("_file"), F.coalesce(F.sum("file_ids").over(before), F.lit(0)).alias("file_start")))
    n_files = max(1, starts.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = IdFile(f"{folder}/{row['file']}")
                first, last = row["doc_from"], row["doc_to"]
                ends = file.ends(first, last)
                doc_ids, nulls = file.doc_ids(first, last)
                ids = file.ids(int(ends[0]), int(ends[-1])).astype("<u4", copy=False)
                file.close()
                bounds = (ends - ends[0]).tolist()
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls), pa.array(ends[:-1] + row["file_start"], pa.int64()),
                                                  pa.array(np.diff(ends), pa.int64()), pa.array(crcs, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(starts, segments.file == starts._file).select("file", "doc_from", "doc_to", "file_start")
    return placed.repartition(4 * n_files).mapInArrow(read, DOCUMENTS)


def id_file_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None, **settings) -> DataFrame:
    """Write the ids of all documents to packed files and read every document back from them.

    Null or empty text is the end id alone. Each row is a document, also when its id is null (those
    come first, with a null id) or repeated (in the order of a hash of their texts). An empty table writes no
    files and gives no rows. Other columns are ignored. ``folder`` must be on a store that tasks can
    reach; without it a new folder is made in the shared folder.
    """
    spark = prepare(docs.sparkSession)
    folder = folder or fresh_path(spark, "id_files")
    if "://" not in folder and not folder.startswith("file:"):
        store_of(folder)[0].create_dir(folder, recursive=True)
    else:
        system, place = store_of(folder)
        system.create_dir(place, recursive=True)
    write_id_files(docs, folder, tokenizer_path, end_id, **settings)
    return read_id_files(spark, folder)
