"""Exact ranks and medians that never put a large group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.sources.landing import land


def global_row_number(df: DataFrame, value: str, ident: str, out: str = "rn") -> DataFrame:
    """Exact row number by ``value`` descending, then ``ident`` ascending. NULL values come last.

    Rows are dealt by sampled ranges of both columns, so blocks are even however the ids cluster, and a single
    value that holds a third of all rows is spread over many.
    """
    return sorted_place(df, [F.col(value).desc_nulls_last(), F.col(ident)], out)


def sorted_place(rows: DataFrame, order: list, out: str = "place") -> DataFrame:
    """The place of every row in a total order, from 1, as a global sort gives it.

    The sorted rows land once in the shared folder with their part and their place in it; the parts'
    counts, a small table, are accumulated and added. No task holds more than a part.
    """
    landed = land(rows.orderBy(*order).withColumn("_part", F.spark_partition_id())
                  .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "sorted")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = landed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return landed.join(starts, "_part").withColumn(out, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def grouped_place(rows: DataFrame, keys: list[str], order: list[str], out: str = "place", flag: Column | None = None,
                  flagged: str = "flagged_before") -> DataFrame:
    """The place of every row in its group, from 1, and with ``flag`` how many rows before it in the group have it.

    Rows land once in ranges of (keys, order). Ranges split wherever there are many rows, so a group
    with a third of all rows lies in many; what a range adds to a group is summed over the ranges, and inside a range the
    rows of a group stand side by side.
    """
    landed = land(rows.withColumn("_flag", F.lit(False) if flag is None else F.coalesce(flag, F.lit(False)))
                  .repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
                  .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "grouped")
    counts = landed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"), F.count_if("_flag").alias("_f"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)      # one row per group and range
    starts = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_f").over(before), F.lit(0)).alias("_flags"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = landed.join(starts, same).withColumn(out, F.col("_rows") + F.col("_at") - F.col("_lo") + 1)
    if flag is not None:
        inside = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn(flagged, F.col("_flags") + F.count_if("_flag").over(inside))
    return placed.drop("_flag", "_part", "_at", "_p", "_lo", "_rows", "_flags", *[f"_k{i}" for i in range(len(keys))])


def histogram_median(hist: DataFrame, keys: list[str], value: str, count: str, upper: bool = False) -> DataFrame:
    """Median per group from a table of (value, how many).

    The input has one row per group and distinct value. ``upper`` takes the
    higher of the two middle values instead of their mean.
    """
    group = Window.partitionBy(*keys)
    order = group.orderBy(value)
    at = hist.select(*keys, F.col(value).alias("_v"), F.sum(count).over(group).alias("_n"),
                     F.sum(count).over(order).alias("_hi"), F.col(count).alias("_c"))
    low_pos, high_pos = F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1")

    def holds(pos: Column) -> Column:
        return (F.col("_hi") - F.col("_c") < pos) & (pos <= F.col("_hi"))

    low = F.max(F.when(holds(low_pos), F.col("_v")))
    high = F.max(F.when(holds(high_pos), F.col("_v")))
    return at.groupBy(*keys).agg((high if upper else (low + high) / 2).alias("median"))
