"""Small configuration tables as local relations.

A local relation carries its exact size, so the planner itself decides to
broadcast it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def config_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    names = schema.fieldNames()
    data = [dict(zip(names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(schema)), schema)
