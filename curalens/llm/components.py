"""Connected components: edges contract inside tasks, stars join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from curalens.llm.common import landed

#: Edges that one contraction holds at a time.
CONTRACTED = 1 << 18
PAIRS = "hi long, lo long"


def star_forest(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as stars: every node but the smallest of its component points at that one."""
    nodes, codes = np.unique(np.concatenate([hi, lo]), return_inverse=True)
    a, b = codes[:len(hi)], codes[len(hi):]
    root = np.arange(len(nodes))
    while True:
        # Each root takes the smallest root it meets; then all chains of roots are shortened to one step.
        low = np.minimum(root[a], root[b])
        step = root.copy()
        np.minimum.at(step, root[a], low)
        np.minimum.at(step, root[b], low)
        while (short := step[step]).tobytes() != step.tobytes():
            step = short
        root, old = step[root], root
        if (root == old).all():
            break
    off = root != np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components in no more edges, from what one task holds."""
    held: list[np.ndarray] = []
    size = 0

    def forest() -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate(held, axis=1)
        return star_forest(both[0], both[1])

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= CONTRACTED:
            held = [np.stack(forest())]
            size = held[0].shape[1]
            if 2 * size > CONTRACTED:          # little to contract: what is here goes out
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["hi", "lo"])
                held, size = [], 0
    if size:
        hi, lo = forest()
        yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to ``(id, root)``: every id with a neighbour and the smallest id it reaches.

    Tasks contract the edges they hold before anything is shuffled. Each round then points all the smaller
    neighbours of a node at the smallest of them, lets every edge skip to the neighbour of its end, and contracts
    again, until all edges are stars. A node has at most one smaller neighbour a task, so no neighbourhood is gathered; the
    join on the middle of a star may be split, as its other side has one row.
    """
    # Edges often come out of Python tasks; they land first, so that no task runs two Python workers at a time.
    raw = landed(edges.where("a <> b").select(F.col("a").alias("hi"), F.col("b").alias("lo")), "edges")
    pairs = landed(raw.mapInArrow(_contracted, PAIRS), "forests")
    while True:
        # One pass: a node that points at two nodes, or points and is pointed at, isn't done.
        ends = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select("lo", F.lit(None).cast("long")))
        open_ends = ends.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.bool_or(F.col("v").isNull()).alias("inner"))
        if not open_ends.where("least <> most or (inner and least is not null)").limit(1).count():
            break
        pairs = pairs.mapInArrow(_contracted, PAIRS)
        near = pairs.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        small = near.select("hi", F.col("m").alias("lo")).union(near.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        small = landed(small.mapInArrow(_contracted, PAIRS), "small_stars")
        up = small.groupBy(F.col("hi").alias("_hi")).agg(F.min("lo").alias("_up"))
        skipped = small.join(up, small.lo == up._hi, "left").select("hi", F.coalesce("_up", "lo").alias("lo"))
        pairs = landed(skipped.mapInArrow(_contracted, PAIRS), "stars")
    pairs = pairs.distinct()
    roots = pairs.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(roots)
