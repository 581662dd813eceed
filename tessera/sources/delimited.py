"""Delimited import and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_EXPORT = {"quoteAll": "false", "escape": '"', "emptyValue": '""', "nullValue": "", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def export_table(df: DataFrame, path: str, column: str = ",", char: str = '"', codeset: str = "UTF-8", compression: str = "none") -> None:
    """EXPORT_TABLE: null is an empty field, an empty string a quoted one."""
    df.write.mode("overwrite").options(**_EXPORT | {"sep": column, "quote": char, "encoding": codeset, "compression": compression}).csv(path)


def import_table(spark: SparkSession, path: str, schema: StructType | str, column: str = ",", char: str = '"', codeset: str = "UTF-8", header: bool = False, strict: bool = True) -> DataFrame:
    """IMPORT_TABLE(_EX): always in parallel, never with inferred types; ``strict`` fails at a malformed line."""
    options = {"sep": column, "quote": char, "escape": '"', "encoding": codeset, "header": str(header).lower(), "mode": "FAILFAST" if strict else "PERMISSIVE", "multiLine": "false", "emptyValue": "", "nullValue": ""}
    formats = {k: v for k, v in _EXPORT.items() if k.endswith("Format")}
    return spark.read.schema(schema).options(**options | formats).csv(path)


def import_data(spark: SparkSession, path: str, file_schema: StructType | str, columns: list[str], indexes: list[int], **options: object) -> DataFrame:
    """IMPORT_DATA_EX: the file's columns at ``indexes`` (from 1) under the names ``columns``; others aren't parsed."""
    df = import_table(spark, path, file_schema, **options)
    return df.select(*(F.col(df.columns[i - 1]).alias(c) for c, i in zip(columns, indexes, strict=True)))


def import_blobs(spark: SparkSession, path: str) -> DataFrame:
    """LOB files: path and content."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def import_tbl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark .tbl files: fields end with a bar, so a last empty field is dropped."""
    return import_table(spark, path, f"{schema}, `__end` string", column="|", strict=False).drop("__end")
