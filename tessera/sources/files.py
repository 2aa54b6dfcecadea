"""Parquet and JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_struct(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def fields_of(objects: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns from objects in column ``v``; a value that doesn't fit its type becomes null."""
    return objects.select(*[F.try_variant_get("v", '$["' + f.name.replace('"', '\\"') + '"]', f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one array; elements that are no objects are left out, another root is an error.

    A file is parsed as a whole by one task: use NDJSON for large ones.
    """
    roots = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("r"))
    checked = roots.select(F.when(F.schema_of_variant("r").startswith("ARRAY"), F.col("r")).otherwise(F.raise_error(F.lit("the root must be an array")).cast("variant")).alias("r"))
    items = checked.lateralJoin(spark.tvf.variant_explode(F.col("r").outer())).select(F.col("value").alias("v"))
    return fields_of(items.where(is_object(F.col("v"))), as_struct(schema))


def ndjson(spark: SparkSession, path: str, schema: T.StructType | str, lenient: bool = False) -> DataFrame:
    """One object on each line; blank lines and other values are left out. Broken JSON is an error, or with ``lenient`` left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parse = F.try_parse_json if lenient else F.parse_json
    return fields_of(lines.select(parse("value").alias("v")).where(is_object(F.col("v"))), as_struct(schema))
