"""What the operators share: session settings, landed intermediate tables, batches for tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from curalens.session import tune, work_dir

#: Rows that reach one Python batch; blocks are put together from batches up to BLOCK_BYTES.
BLOCK_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder; it is deleted when the driver ends."""
    path = f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Join small record batches up to a size in bytes; one large batch stays alone."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks)
