"""Near-duplicates of word shingles by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from curalens.llm.common import BLOCK_BYTES, blocks, landed, one_array, prepare, text_of
from curalens.llm.components import connected
from curalens.llm.words import split_words

#: Odd multipliers of a fixed generator; equal on every machine.
_DICE = np.random.Generator(np.random.PCG64(20240229))
COORDS = 64
_SCALE = _DICE.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)
_WORD = _DICE.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of every text, A-Z lower-cased.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    ends, codes, words = split_words(texts)
    lowered = pc.ascii_lower(words).to_numpy(zero_copy_only=False)
    hashed = pd.util.hash_array(lowered.astype(object), categorize=False)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = max(0, len(hashed) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled += _mix(hashed[k:k + n] * _WORD[k])
    rolled = _mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            out.append(_mix(np.array([(b - a) + sum(int(x) for x in _mix(hashed[a:b] * _WORD[:b - a])) & ((1 << 64) - 1)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDS minimum hashes for each set, all of which hold something."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), COORDS), np.uint32)
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(((flat * _SCALE[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _named(sets: list[np.ndarray]) -> list[int | None]:
    """A 64-bit name for each set, null for the empty one."""
    return [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None for s in sets]


def least_match(similarity: float, coords: int = COORDS, deviations: float = 4.5) -> int:
    """Equal coordinates below which a pair can't well be similar: so many deviations under the mean."""
    return int(coords * similarity - deviations * (coords * similarity * (1 - similarity)) ** 0.5)


def _equal(signs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Equal coordinates of each row with all later rows."""
    for i in range(len(signs) - 1):
        yield i, (signs[i + 1:] == signs[i]).sum(axis=1)


class _Union:
    def __init__(self, n: int):
        self.up, self.left = list(range(n)), n - 1

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.left -= 1
        return True


def _signatures(docs: DataFrame, width: int, trees: int) -> DataFrame:
    """Per document: size of its set, name of the set, 8 bits of each coordinate, the root node in each tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets = shingle_sets(one_array(block.column("text")), width)
            signs: list[bytes | None] = [None] * len(sets)
            roots: list[np.ndarray | None] = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            if full:
                low = minhashes([sets[i] for i in full])
                node = _mix(low[:, :trees].astype(np.uint64) + (np.arange(1, trees + 1, dtype=np.uint64) << np.uint64(40))).view(np.int64)
                low8 = (low & np.uint32(255)).astype(np.uint8)
                for at, i in enumerate(full):
                    signs[i], roots[i] = low8[at].tobytes(), node[at]
            yield pa.RecordBatch.from_arrays(
                [one_array(block.column("doc_id")), one_array(block.column("of")), pa.array([len(s) for s in sets], pa.int64()), pa.array(_named(sets), pa.int64()),
                 pa.array(signs, pa.binary()), pa.array(roots, pa.list_(pa.int64()))], ["doc_id", "of", "n_shingles", "name", "signs", "roots"])

    return docs.mapInArrow(sign, "doc_id long, of long, n_shingles long, name long, signs binary, roots array<long>")


def _leaves(classes: DataFrame, trees: int, limit: int, deepest: int, cut: int) -> DataFrame:
    """(leaf, name, signs): small nodes of all trees, ready for exhaustive comparison.

    A node splits its documents by the minimum hash of a coordinate. One with two to ``limit``
    documents is a leaf. A larger one branches along a further coordinate, then along two, picked by its own name.
    Documents that still share a node at the last level are near copies of each other or of a few
    leaders: they are dealt in chunks, each of which also gets the leaders and whatever isn't close to any leader.
    """
    rows = classes.select("name", F.explode("roots").alias("node"))
    done = None
    for depth in range(1, deepest + 1):
        counts = landed(rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "node_counts")
        # Merged at every size: the counts grow with the documents, so no task should have to hold them.
        rows = landed(rows.join(counts.hint("merge"), "node"), "nodes")
        has_large = bool(counts.where(F.col("n") > limit).limit(1).count())
        small = rows.where(F.col("n") <= limit).select(F.col("node").alias("leaf"), "name")
        done = small if done is None else done.union(small)
        rows = rows.where(F.col("n") > limit)
        if not has_large or depth == deepest:
            break
        picks = [F.pmod(F.xxhash64("node", F.lit(depth), F.lit(k)), F.lit(COORDS)) + 1 for k in range(min(depth, 2))]
        # Landed, as they are both counted and joined with their counts.
        rows = landed(rows.join(classes.select("name", "signs"), "name").select("name", F.explode(F.array(*[F.xxhash64(
            F.col("node"), F.lit(depth), pick, F.substring(F.hex("signs"), (pick * 2 - 1).cast("int"), F.lit(2))) for pick in picks])).alias("node")), "branches")
    done = done.join(classes.select("name", "signs").hint("merge"), "name").select("leaf", "name", "signs")
    if not has_large:
        return done
    rows = landed(rows.join(classes.select("name", "signs"), "name"), "large_nodes")
    # Every tie-break is a hash of the row, so a task that runs again gives the same rows.
    chosen = rows.groupBy("node").agg(F.min_by(F.struct("name", "signs"), F.xxhash64("name", "node")).alias("a"),
                                      F.max_by(F.struct("name", "signs"), F.xxhash64("name", "node")).alias("b"))
    leaders = landed(chosen.select(F.col("node").alias("node"), F.array("a", "b").alias("leaders")), "leaders")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), np.uint8).reshape(-1, COORDS)
            heads = np.frombuffer(b"".join(x["signs"] for pair in batch.column("leaders").to_pylist() for x in pair), np.uint8).reshape(-1, 2, COORDS)
            close = ((heads == signs[:, None, :]).sum(axis=2) >= cut).any(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "name", "signs")], pa.array(close)], ["node", "name", "signs", "close"])

    marked = landed(rows.select("node", "name", "signs").join(leaders, "node")
                    .mapInArrow(mark, "node long, name long, signs binary, close boolean"), "marked")
    shape = landed(marked.groupBy("node").agg(F.greatest(F.ceil(F.count("*") / limit), F.lit(1)).cast("int").alias("chunks"),
                                              F.ceil(F.count_if(~F.col("close")) / limit).cast("int").alias("blocks")), "large_shapes")
    # A cell is a chunk of what is close to a leader with a block of what is close to none, or two such blocks.
    # Whatever the node holds, a cell gets about two times ``limit`` documents and the leaders.
    part = F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")
    block = F.pmod(F.xxhash64("name", F.lit(1)), F.col("blocks")).cast("int")
    placed = marked.join(shape, "node").select("node", "name", "signs", "close", part.alias("part"), block.alias("block"), "chunks", "blocks")
    columns = F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1)
    near = placed.where("close").select("node", "name", "signs", F.lit(0).alias("kind"), F.col("part").alias("i"), F.explode(columns).alias("j"))
    far = placed.where("not close")
    beside = far.select("node", "name", "signs", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.col("block").alias("j"))
    among = (far.select("node", "name", "signs", "block", F.explode(columns).alias("other"))
             .select("node", "name", "signs", F.lit(1).alias("kind"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    heads = (leaders.join(shape, "node").select("node", F.explode("leaders").alias("x"), "chunks")
             .select("node", "x.name", "x.signs", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(0).alias("j")))
    cells = near.union(beside).union(among).union(heads)
    return done.union(cells.select(F.xxhash64("node", "kind", "i", "j").alias("leaf"), "name", "signs"))


def _maybe_links(leaves: DataFrame, cut: int) -> DataFrame:
    """Compare all documents of a leaf; give a spanning forest of the pairs that may be similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                names = [m["name"] for m in members]
                signs = np.frombuffer(b"".join(m["signs"] for m in members), np.uint8).reshape(len(names), COORDS)
                union = _Union(len(names))
                for i, same in _equal(signs):
                    for j in (np.flatnonzero(same >= cut) + i + 1).tolist():
                        if names[i] != names[j] and union.join(i, j):
                            a.append(names[i])
                            b.append(names[j])
                    if not union.left:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (leaves.groupBy("leaf").agg(F.collect_list(F.struct("name", "signs")).alias("members"))
            .mapInArrow(compare, "a long, b long"))


def _packed(text: bytes, words: np.ndarray) -> tuple[bytes | None, bytes | None]:
    """A deflated text or its set as bytes, whichever is shorter: no more than 8 bytes a shingle."""
    packed = zlib.compress(text, 1)
    return (packed, None) if len(packed) < words.nbytes else (None, words.tobytes())


def _unpacked(members: list[dict], width: int) -> list[np.ndarray]:
    """The sets of members, from their texts where they came as such, some megabytes of text at a time."""
    sets = [None if m["words"] is None else np.frombuffer(m["words"], np.uint64) for m in members]
    texts, at, size = [], [], 0

    def cut() -> None:
        for i, words in zip(at, shingle_sets(pa.array(texts, pa.binary()).view(pa.string()), width)):
            sets[i] = words
        texts.clear(), at.clear()

    for i, m in enumerate(members):
        if sets[i] is None:
            texts.append(zlib.decompress(m["packed"]))
            at.append(i)
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                cut()
                size = 0
    if texts:
        cut()
    return sets


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _links(blocks_of: DataFrame, width: int, percent: int, cut: int) -> DataFrame:
    """Exact links in blocks of (block, name, signs, packed, words, asks): a spanning forest of each block.

    Only pairs with a member that asks are compared, likely ones first; a pair that is connected
    already needs no comparison.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                members = list({m["name"]: m for m in batch.column("members")[row].as_py()}.values())
                sets = _unpacked(members, width)
                signs = np.frombuffer(b"".join(m["signs"] for m in members), np.uint8).reshape(len(sets), COORDS)
                size, asks = np.array([len(s) for s in sets]), np.array([m["asks"] for m in members])
                found = []
                for i, same in _equal(signs):
                    rest = np.arange(i + 1, len(sets))
                    fit = (same >= cut) & (asks[rest] | asks[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
                    found.append(np.stack([same[fit], np.full(fit.sum(), i), rest[fit]], axis=1))
                pairs = np.concatenate(found) if found else np.zeros((0, 3), int)
                union, a, b = _Union(len(sets)), [], []
                for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
                    if union.find(i) != union.find(j) and _similar(sets[i], sets[j], percent):
                        union.join(i, j)
                        a.append(members[i]["name"])
                        b.append(members[j]["name"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (blocks_of.groupBy("block").agg(F.collect_list(F.struct("name", "signs", "packed", "words", "asks")).alias("members"))
            .mapInArrow(confirm, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id",
                    trees: int = 8, limit: int = 512, deepest: int = 3, chunk: int = 512, most_shingles: int = 1 << 20) -> DataFrame:
    """Groups of documents linked by ``100 * shared >= percent * united`` distinct word shingles.

    1. Equal sets share a name and are one class from here on, however many copies there are.
    2. ``trees`` independent trees branch the classes by minwise tokens down to small nodes. A pair at
       similarity 0.85 shares a first node with probability 0.85 in each tree, so eight trees
       miss about one in four million. Large nodes branch on, along one coordinate, then along two.
    3. Nodes are compared exhaustively on signatures (a cut 4.5 deviations below the threshold),
       which leaves clusters of what may be linked. Only their texts are read again.
    4. Links are confirmed on full sets, made again where they are compared: what moves is the deflated text, or
       the set where that is shorter. A cluster is compared in one block, or in chunks of at most about
       ``chunk`` documents and ``most_shingles`` shingles that share two leaders;
       then everything outside the largest group of a chunked cluster is compared with all of it, in blocks.

    Null text counts as empty: no shingles, linked with nothing. A null id is never the smallest id;
    a group without any id has a null component. Repeated rows are classed alike. An empty table
    gives no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # One document of each class is read again: it is found by its id, or by its text if it has none.
    texts = texts.withColumn("of", F.coalesce("doc_id", F.xxhash64("text")))
    cut = least_match(percent / 100)
    # A filter of fixed size, made of the ids of the clusters, drops most other texts before they are dealt
    # by id, and likewise the signatures that large nodes don't ask for. Spark builds it at run time; where
    # it is full, more rows move and the join stays as it is.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1t")
    signed = landed(_signatures(texts, width, trees), "signatures")
    classes = landed(signed.where("name is not null").groupBy("name").agg(
        F.min("of").alias("of"), F.min("n_shingles").alias("n_shingles"), F.min("signs").alias("signs"), F.min("roots").alias("roots")), "classes")
    clusters = connected(_maybe_links(_leaves(classes, trees, limit, deepest, cut), cut)).withColumnsRenamed({"id": "name", "root": "cluster"})
    clusters = landed(clusters.join(classes.select("name", "of", "n_shingles", "signs"), "name"), "clusters")
    # Blocks are cut by documents and by shingles, so long texts make more of them.
    # The heads of a cluster, which all its blocks get, are marked here, where no texts are carried yet.
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / chunk, F.sum("n_shingles") / most_shingles)).cast("int").alias("chunks"),
                                            F.min("name").alias("x"), F.max("name").alias("y"))
    members = landed(clusters.join(sizes, "cluster").select("name", "of", "signs", "cluster", "chunks", F.expr("name in (x, y)").alias("head")), "members")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()         # rows that share an id give a class once
        for block in blocks(batches):
            sets = shingle_sets(one_array(block.column("text")), width)
            texts_of = one_array(block.column("text")).cast(pa.binary())
            same, packed, words = [], [], []
            for i, (found, name) in enumerate(zip(_named(sets), block.column("name").to_pylist())):
                same.append(found == name and name not in seen)
                if same[-1]:
                    seen.add(name)
                    text, whole = _packed(texts_of[i].as_py(), sets[i])
                    packed.append(text)
                    words.append(whole)
            out = block.drop_columns(["text"]).filter(pa.array(same, pa.bool_()))
            out = out.append_column("packed", pa.array(packed, pa.binary())).append_column("words", pa.array(words, pa.binary()))
            yield from out.to_batches()

    wanted = texts.select("of", "text").join(members.where("chunks > 0"), "of")
    sets = landed(wanted.select("name", "cluster", "chunks", "head", "signs", "text")
                  .mapInArrow(words_of, "name long, cluster long, chunks int, head boolean, signs binary, packed binary, words binary"), "sets")
    carried = ["name", "signs", "packed", "words"]
    first = sets.select(*carried, F.lit(True).alias("asks"), F.xxhash64("cluster", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int")).alias("block"))
    large = sets.where("chunks > 1")
    has_large = bool(large.limit(1).count())
    if has_large:
        heads = large.where("head").select(*carried, "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
        first = first.union(heads.select(*carried, F.lit(True), F.xxhash64("cluster", "part")))
    links = landed(_links(first, width, percent, cut), "links")
    groups = landed(connected(links), "groups")
    if has_large:
        rooted = landed(large.select("name", "cluster", "chunks").join(groups.withColumnRenamed("id", "name"), "name", "left")
                        .select("name", "cluster", "chunks", F.coalesce("root", "name").alias("root")), "rooted")
        shares = rooted.groupBy("cluster", "root").agg(F.count("*").alias("k"), F.max("chunks").alias("chunks"))
        main = shares.groupBy("cluster").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"),
                                             F.max("chunks").alias("cut"))
        main = landed(main.where(F.col("all") > F.col("most")).withColumn("minor", F.ceil((F.col("all") - F.col("most")) * F.col("cut") / F.col("all")).cast("int")), "mains")
        has_large = bool(main.limit(1).count())
    if has_large:        # some chunked cluster has more than one group
        part = F.pmod(F.xxhash64("name", F.lit(1)), F.col("chunks")).cast("int")
        side = rooted.join(main, "cluster")
        asking = side.where("root <> main").select(
            "name", F.lit(True).alias("asks"), "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"),
            F.pmod(F.xxhash64("name", F.lit(2)), F.col("minor")).cast("int").alias("j"))
        asked = side.select("name", F.lit(False).alias("asks"), "cluster", part.alias("i"),
                            F.explode(F.sequence(F.lit(0), F.col("minor") - 1)).alias("j"))
        # A row that asks and is asked in one block counts as asking: it comes last and takes the place.
        grid = asking.union(asked).groupBy("name", "cluster", "i", "j").agg(F.max("asks").alias("asks"))
        # Of the sets only those of such clusters move.
        asked_for = large.join(main.select("cluster"), "cluster", "left_semi").select(carried)
        second = grid.join(asked_for, "name").select(*carried, "asks", F.xxhash64("cluster", "i", "j").alias("block"))
        groups = landed(connected(links.union(_links(second, width, percent, cut))), "groups")
    placed = (signed.select("doc_id", "n_shingles", "name").join(groups.withColumnRenamed("id", "name"), "name", "left")
              .select("doc_id", "n_shingles", F.coalesce("root", "name").alias("group")))
    placed = landed(placed, "placed")
    least = landed(placed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least")), "least")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return (placed.join(least, "group", "left").withColumn("component_id", component)
            .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """The rows of the smallest id of each group, with all their columns as they are.

    Documents linked with nothing stay. Rows without an id stay, as they can't be told apart; rows that share an
    id stay if one of them does.
    """
    groups = near_duplicates(docs, width, percent, text_col, id_col, **settings)
    gone = landed(groups.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
                  .select(F.col("doc_id").alias("_gone")), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
