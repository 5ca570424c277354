"""Explicit schemas: no inference pass over the input files."""

from __future__ import annotations

from pyspark.sql import types as T

_T = {
    "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "date": T.DateType(), "array<float>": T.ArrayType(T.FloatType()),
    "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()),
}


def struct(spec: str) -> T.StructType:
    """``struct("id long, name string")``; every column is nullable."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _T[kind], True))
    return T.StructType(fields)


# Supplied tables.
SUPPLIED = {
    "region": struct("r_regionkey int, r_name string"),
    "nation": struct("n_nationkey int, n_name string, n_regionkey int"),
    "customer": struct("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": struct("s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
    "part": struct("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "orders": struct("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                     "o_orderdate timestamp, o_orderpriority string"),
    "lineitem": struct("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                       "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                       "l_linestatus string, l_shipdate timestamp"),
    "events": struct("event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    "documents": struct("doc_id long, text string, lang string, source string, n_chars long"),
    "embeddings": struct("vec_id long, embedding array<float>, label int"),
    "pages": struct("page_id long, url string, html string"),
    "benchmark": struct("item_id long, text string"),
    "labels": struct("doc_id long, quality int, toxic int"),
    "conversations": struct("conv_id long, turn long, role string, text string"),
}

# Domain tables of the curation workflow.
SOURCES = struct("key string, name string, kind string, rank string, mode string, enabled boolean, "
                 "assume_for_sale boolean, url_include array<string>, url_exclude array<string>, "
                 "base_url string, ordinal int")

# Stored score detail.
SCORE_DETAIL = T.StructType([
    T.StructField("gate", T.StringType()),
    T.StructField("axes", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()), T.StructField("raw", T.DoubleType()),
        T.StructField("weight", T.DoubleType()), T.StructField("reason", T.StringType())]))),
    T.StructField("flags", T.MapType(T.StringType(), T.BooleanType())),
    T.StructField("provenance_note", T.StringType()),
])
