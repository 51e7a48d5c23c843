"""Readers and writers of document columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as J


def read_json_lines(spark: SparkSession, path: str, name: str = "doc", lenient: bool = False) -> DataFrame:
    """One document a line; lines that hold none are NULL."""
    return spark.read.text(path).select(J.parse("value", lenient).alias(name))


def read_json_files(spark: SparkSession, path: str, name: str = "doc", lenient: bool = False) -> DataFrame:
    """One document a file."""
    return spark.read.text(path, wholetext=True).select(J.parse("value", lenient).alias(name))


def read_json_variant(spark: SparkSession, path: str, name: str = "doc", **options: str) -> DataFrame:
    """One document a line through Spark's own JSON reader (``singleVariantColumn``), which takes its options; it is strict."""
    return spark.read.options(singleVariantColumn=name, **options).json(path)


def read_parquet_text(spark: SparkSession, path: str, column: str, name: str = "doc") -> DataFrame:
    """A Parquet table with a text column parsed to documents beside its other columns."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c != column], J.parse(column).alias(name))


def read_wire(spark: SparkSession, path: str, column: str = "wire", name: str = "doc", tolerant: bool = False) -> DataFrame:
    """A Parquet table with a column of wire bytes; damaged ones are an error, or NULL if ``tolerant``."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in df.columns if c != column], (J.try_decode if tolerant else J.decode)(column).alias(name))


def write_json_lines(df: DataFrame, path: str, doc: str = "doc") -> None:
    """Compact text, one document a line; NULL rows are left out."""
    df.where(F.isnotnull(doc)).select(J.to_string(doc)).write.text(path)


def write_wire(df: DataFrame, path: str, doc: str = "doc", column: str = "wire") -> None:
    df.withColumn(column, J.encode(doc)).drop(doc).write.parquet(path)
