"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from curalens.llm.common import landed, prepare, text_of


def differencing(sizes: list[int], ways: int) -> np.ndarray:
    """The part (0 to ways-1) of every item, by Karmarkar-Karp differencing.

    Every item starts as a partial partition with one filled part. The two partial partitions with
    the largest spread are combined in opposite orders, the largest part of one with the smallest
    of the other, until one is left. Sums are kept relative to the smallest part.
    """
    out = np.zeros(len(sizes), np.int64)
    if ways == 1 or len(sizes) < 2:
        return out
    joins: list[tuple[int, int]] = []        # what a filled part is made of; items come before joins
    first_join = len(sizes)
    heap = [(-int(s), i, [(int(s), i)]) for i, s in enumerate(sizes)]     # parts in falling order, empty ones left out
    heapq.heapify(heap)
    while len(heap) > 1:
        _, order, big = heapq.heappop(heap)
        _, _, small = heapq.heappop(heap)
        apart = ways - len(small)            # parts of big that meet an empty part of small
        parts = big[:apart] + small[:max(0, ways - len(big))]
        for i in range(apart, len(big)):
            (a, at), (b, bt) = big[i], small[ways - 1 - i]
            parts.append((a + b, first_join + len(joins)))
            joins.append((at, bt))
        parts.sort(key=lambda p: -p[0])
        least = parts[-1][0] if len(parts) == ways else 0
        if least:
            parts = [(s - least, t) for s, t in parts]
        spread = parts[0][0] - (parts[-1][0] if len(parts) == ways else 0)
        heapq.heappush(heap, (-spread, order, parts))
    for part, (_, tree) in enumerate(heap[0][2]):
        stack = [tree]
        while stack:
            node = stack.pop()
            if node < first_join:
                out[node] = part
            else:
                stack += joins[node - first_join]
    return out


def _packed(items: DataFrame, level: int, packet: int, groups_per_part: int) -> tuple[DataFrame, DataFrame]:
    """One level of differencing: items below ``packet`` bytes, dealt over parts, joined into packets of about that size.

    Gives what each item is in from here on (item, parent) and the items of the next level.
    """
    light = items.where(F.col("bytes") < packet)
    parts = max(1, -(-light.count() // groups_per_part))

    def join_small(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "item"], ascending=[False, True])
        ways = max(1, -(-int(rows["bytes"].sum()) // packet))
        names = [f"{level}:{rows['part'].iloc[0]}:{way}" for way in range(ways)]
        return rows.assign(parent=[names[w] for w in differencing(rows["bytes"].tolist(), ways)])[["item", "parent", "bytes"]]

    joined = landed(light.withColumn("part", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(parts))).groupBy("part")
                    .applyInPandas(join_small, "item string, parent string, bytes long"), "packets")
    packets = joined.groupBy(F.col("parent").alias("item")).agg(F.sum("bytes").alias("bytes"))
    return joined.select("item", "parent"), landed(packets.unionByName(items.where(F.col("bytes") >= packet)), "items")


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, text_col: str = "text", id_col: str = "doc_id",
                    packets_per_shard: int = 200, groups_per_part: int = 2000, rows_per_block: int = 50_000) -> DataFrame:
    """Deal documents into shards of near-equal bytes; equal texts stay together.

    1. Bytes are summed per text digest, with map-side combine, so a text of many copies is one group.
    2. Groups below ``total / (shards * packets_per_shard)`` bytes are dealt by digest over parts of about
       ``groups_per_part`` groups, and differencing joins those of a part into packets of about that size. Parts
       that hold less than a packet leave small ones; these are joined again, level by level, until no more than
       twice ``shards * packets_per_shard`` packets and larger groups are left, whatever the input.
    3. Differencing deals those to the shards in one task.
    4. Slots number the documents of a shard from 0, by counts of (shard, block) and the row
       number inside a block of about ``rows_per_block`` rows.

    A group larger than a fair share has a shard to itself, as it can't be divided. Null text counts
    as empty (size ``overhead``). Rows with null or repeated ids are documents of their own. Equal
    rows share a shard and take its slots in any order. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    text = text_of(text_col)
    keyed = landed(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
                               F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.sha2(text.cast("binary"), 256).alias("item"), F.monotonically_increasing_id().alias("_row_id")), "sized")
    items = landed(keyed.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    total, n_rows = items.agg(F.sum("bytes"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    packet = max(1, -(-(total or 0) // (shards * packets_per_shard)))
    blocks = max(1, -(-n_rows // (shards * rows_per_block)))
    items, levels = items.select("item", "bytes"), []
    while not levels or items.count() > 2 * shards * packets_per_shard:
        inside, items = _packed(items, len(levels), packet, groups_per_part)
        levels.append(inside)

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "item"], ascending=[False, True])
        return rows.assign(shard=differencing(rows["bytes"].tolist(), shards))[["item", "shard"]]

    of_item = landed(items.groupBy(F.lit(0).alias("all")).applyInPandas(deal, "item string, shard int"), "dealt")
    for inside in reversed(levels):          # from packets back to what they are made of; larger groups stand as they are
        of_item = of_item.unionByName(inside.join(of_item.withColumnRenamed("item", "parent"), "parent").select("item", "shard"))
    placed = landed(keyed.join(landed(of_item, "group_shards"), "item")
                    .select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("_row_id"), F.lit(blocks)).alias("_block")), "placed")
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
              .select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32")
    return (placed.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["shard", "_block"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_start") + F.col("_row")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
