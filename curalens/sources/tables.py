"""Table readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curalens import schemas


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One supplied Parquet table with its declared schema.

    Timestamps are declared as instants (session zone UTC), so filters on them
    still reach the Parquet scan.
    """
    return spark.read.schema(schemas.SUPPLIED[name]).parquet(f"{base}/{name}.parquet")


def read_feed_entries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed feed entries; the date is ``published`` or else ``updated``."""
    raw = spark.read.schema(
        "source string, link string, title string, summary string, content string, "
        "published timestamp, updated timestamp, position long").format(fmt).load(path)
    return raw.select("source", "link", "title", "summary", "content",
                      F.coalesce("published", "updated").alias("published_at"), "position")


def read_candidates_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Area, site name, URL; heading and comment rows are dropped."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="area string, name string, url string", quote="")
    return candidate_rows(raw)


def candidate_rows(raw: DataFrame) -> DataFrame:
    url = F.trim("url")
    return (raw.filter(url.startswith("http"))
            .select(F.trim("area").alias("area"), F.trim("name").alias("name"), url.alias("url")))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def copy_tables(tables: dict[str, DataFrame], target: str) -> DataFrame:
    """Write every table under ``target``, then compare row counts.

    ``errorifexists`` refuses a target that already holds a table. Returns one
    row per table; ``check_copy`` turns a mismatch into an error.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{target}/{name}")
    copied = {n: spark.read.schema(df.schema).parquet(f"{target}/{n}") for n, df in tables.items()}
    return compare_counts(tables, copied)


def compare_counts(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """One row per table: counts on both sides and whether they agree."""

    def side(tables: dict[str, DataFrame], mark: str) -> DataFrame:
        parts = [df.select(F.lit(n).alias("table_name"), F.lit(mark).alias("side")) for n, df in tables.items()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    both = side(left, "source").unionByName(side(right, "target"))
    return (both.groupBy("table_name")
            .agg(F.count_if(F.col("side") == "source").alias("source_rows"),
                 F.count_if(F.col("side") == "target").alias("target_rows"))
            .withColumn("same", F.col("source_rows") == F.col("target_rows")))


def check_copy(report: DataFrame) -> None:
    """Fail when any table differs. The report has one row per table."""
    bad = [r.table_name for r in report.filter(~F.col("same")).collect()]
    if bad:
        raise ValueError(f"row counts differ after the copy: {bad}")
