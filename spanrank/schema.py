"""The tables of an index."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType

#: A front-matter value: its texts, and whether it was written as a list.
FM_VALUE = StructType([StructField("is_list", BooleanType()), StructField("vals", ArrayType(StringType()))])
FM = MapType(StringType(), FM_VALUE)

SECTIONS = StructType(
    [
        StructField("slot", LongType()),
        StructField("path", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("heading", StringType()),
        StructField("breadcrumb", ArrayType(StringType())),
        StructField("fm", FM),
        StructField("truncated", BooleanType()),
    ]
)
VECTORS = StructType([StructField("slot", LongType()), StructField("embedding", ArrayType(FloatType()))])
FILES = StructType([StructField("path", StringType()), StructField("hash", LongType()), StructField("len", LongType()), StructField("mtime", LongType())])
META = StructType([StructField("k", StringType()), StructField("v", StringType())])
HITS = StructType(
    [
        StructField("owner", IntegerType()),
        StructField("path", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("score", DoubleType()),
        StructField("trail", StringType()),
        StructField("pieces", IntegerType()),
    ]
)
#: Characters a unit may hold before it is divided.
BUDGET = 8000
