"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from curalens.llm.common import landed, prepare
from curalens.llm.components import connected


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The ordered nearest pivots of each unit vector: its permutation, cut after ``depth``."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :depth]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _sound(v: Column) -> Column:
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def _described(points: DataFrame, pivots: np.ndarray, depth: int) -> DataFrame:
    """``near``: the nearest pivots of each point."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = nearest_pivots(unit(_matrix(batch.column("v"))), pivots, depth).astype(np.int32)
                yield batch.append_column("near", pa.array(list(near), pa.list_(pa.int32())))

    kind = points.schema["v"].dataType.simpleString()
    return points.mapInArrow(describe, f"name long, kind string, v {kind}, copies long, near array<int>")


def _verified(cells: DataFrame, similarity: float, shared: int, n_pivots: int) -> DataFrame:
    """Compare the two sides of each cell. Gives links counted per point (name, n) and a spanning forest (name, other).

    Two points meet in the list of every pair of pivots they share; only the list of their two first
    shared pivots counts the pair.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, n, other = [], [], []
            for row in range(batch.num_rows):
                first, second = batch.column("first")[row].as_py(), batch.column("second")[row].as_py()
                members = batch.column("members")[row].values
                names = members.field("name").to_numpy()
                copies, side = members.field("copies").to_numpy(), members.field("side").to_numpy()
                near = _matrix(members.field("near")).astype(int)
                has = np.zeros((len(names), n_pivots), np.float32)
                np.put_along_axis(has, near, 1, axis=1)
                left = np.flatnonzero(side != 1)
                right = np.flatnonzero(side != 0)
                vectors = unit(_matrix(members.field("v")))
                between = np.arange(n_pivots) < second
                between[first] = False
                together = has[left] @ has[right].T
                linked = ((vectors[left] @ vectors[right].T >= similarity) & (together >= shared)
                          & (has[left][:, between] @ has[right][:, between].T == 0) & (names[left][:, None] != names[right][None, :]))
                own = linked if (side == 2).all() else None      # one block with itself: each pair stands there twice
                name += names[left].tolist()
                n += (linked @ copies[right]).tolist()
                other += [None] * len(left)
                if own is None:
                    name += names[right].tolist()
                    n += (linked.T @ copies[left]).tolist()
                    other += [None] * len(right)
                up: dict[int, int] = {}

                def find(x: int) -> int:
                    while up.setdefault(x, x) != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for i, j in np.argwhere(linked).tolist():
                    a, b = find(names[left[i]]), find(names[right[j]])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        name.append(int(a))
                        n.append(0)
                        other.append(int(b))
            keep = [x > 0 or o is not None for x, o in zip(n, other)]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(n, pa.int64()), pa.array(other, pa.int64())],
                                             ["name", "n", "other"]).filter(pa.array(keep, pa.bool_()))

    return cells.mapInArrow(verify, "name long, n long, other long")


def near_vectors(vectors: DataFrame, similarity: float = 0.93, vector_col: str = "embedding", label_col: str = "label",
                 id_col: str = "vec_id", pivots: int = 128, depth: int = 6, shared: int = 2, block: int = 256) -> DataFrame:
    """Links between vectors of one label with a cosine of ``similarity`` or more, and their groups.

    1. Equal vectors of one label are one point from here on, with the number of its copies.
    2. ``pivots`` points, the first in the order of a hash, are the reference points (all that the driver reads).
       Every point is described by its ``depth`` nearest pivots, in order.
    3. Inverted lists: a point is listed under (label, two of its nearest pivots), so points of one
       list share two pivots or more; ``shared`` may ask for more. A list longer than ``block``
       is dealt into a grid of pairs of blocks: none is gathered whole, none is cut off.
    4. The cosine of every pair met is verified in double precision and counted in one list only.

    ``n_links`` counts the other vectors linked directly, copies included; large groups are
    counted and never expanded into pairs. A vector that is null, empty, zero or holds null or non-finite
    components, or whose label is null, links with nothing; its component is its own id. Vectors
    of other lengths than their list's never meet, as the label is joined with the length. A null id is never a
    smallest id. Rows with equal ids are vectors of their own. An empty table gives no rows;
    other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    kind = F.when(F.col("label").isNotNull() & _sound(F.col("v")), F.concat_ws(":", F.size("v").cast("string"), "label"))
    named = landed(rows.withColumn("kind", kind).withColumn("name", F.when(F.col("kind").isNotNull(), F.xxhash64(
        "kind", F.transform("v", lambda x: x + F.lit(0).cast("float"))))), "vectors")
    points = landed(named.where("name is not null").groupBy("name").agg(
        F.min("kind").alias("kind"), F.min("v").alias("v"), F.count("*").alias("copies")), "points")
    sizes = [r.n for r in points.groupBy(F.size("v").alias("n")).count().collect()]
    groups = counts = None
    for size in sizes:       # one index for each length of vector
        own = points.where(F.size("v") == size)
        taken = own.orderBy(F.xxhash64("name"), "name").limit(pivots).collect()
        reference = unit(np.array([r.v for r in taken], dtype=float))
        described = landed(_described(own.select("name", "kind", "v", "copies"), reference, depth), "described")
        near = F.array_sort("near")
        twos = F.flatten(F.transform(near, lambda a: F.transform(F.filter(near, lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
        if len(reference) < 2:
            continue
        listed = described.select("name", "kind", F.explode(twos).alias("x")).select("name", "kind", "x.first", "x.second")
        long = landed(listed.groupBy("kind", "first", "second").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        parts = F.ceil(F.col("n") / block).cast("int")
        mine = F.pmod(F.xxhash64("name", "first"), F.col("parts")).cast("int")
        dealt = (listed.join(long, ["kind", "first", "second"]).withColumn("parts", parts).withColumn("mine", mine)
                 .select("name", "kind", "first", "second", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("met"))
                 .select("name", "kind", "first", "second", F.least("mine", "met").alias("i"), F.greatest("mine", "met").alias("j"),
                         F.when(F.col("mine") == F.col("met"), 2).when(F.col("mine") < F.col("met"), 0).otherwise(1).alias("side")))
        cells = (landed(dealt, "dealt").join(described.drop("kind"), "name").groupBy("kind", "first", "second", "i", "j")
                 .agg(F.collect_list(F.struct("name", "copies", "side", "near", "v")).alias("members")))
        found = landed(_verified(cells.select("first", "second", "members"), similarity, shared, len(reference)), "found")
        edges, sums = found.where("other is not null").select(F.col("name").alias("a"), F.col("other").alias("b")), found.where("n > 0").select("name", "n")
        groups, counts = (edges, sums) if groups is None else (groups.union(edges), counts.union(sums))
    if groups is None:
        groups = spark.createDataFrame([], "a long, b long")
        counts = spark.createDataFrame([], "name long, n long")
    linked = landed(counts.groupBy("name").agg(F.sum("n").alias("n")), "link_counts")
    roots = landed(connected(groups), "roots").withColumnRenamed("id", "name")
    facts = landed(points.select("name", "copies").join(linked, "name", "left").join(roots, "name", "left")
                   .select("name", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "name").alias("root")), "facts")
    placed = landed(named.select("vec_id", "name").join(facts, "name", "left").select("vec_id", "n_links", "root"), "placed")
    least = landed(placed.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least")), "least")
    component = F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return (placed.join(least, "root", "left").withColumn("component_id", component)
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id",
                    F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
