"""Exports: a choice of columns with headings, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haggle.functions.text import label
from haggle.sources.workbook import BATCH, Workbooks


def chosen(rows: DataFrame, columns: list[str] | None, allowed: list[str]) -> DataFrame:
    """The chosen columns in the order of the choice; all allowed ones without a choice."""
    columns = list(columns or allowed)
    if unknown := [c for c in columns if c not in allowed]:
        raise ValueError(f"columns that cannot be exported: {', '.join(unknown)}")
    return rows.select(*columns)


def headed(rows: DataFrame, verbose: dict[str, str] | None = None) -> DataFrame:
    """rows with headings for names."""
    return rows.withColumnsRenamed({c: label(c, verbose) for c in rows.columns})


def write_csv(rows: DataFrame, path: str, verbose: dict[str, str] | None = None) -> None:
    headed(rows, verbose).write.option("header", True).csv(path)


def write_workbooks(rows: DataFrame, path: str, verbose: dict[str, str] | None = None, batch: int = BATCH) -> None:
    """rows as workbooks with headings, one for each partition: all of them or, if a task fails for good, none."""
    rows.sparkSession.dataSource.register(Workbooks)
    headed(rows, verbose).write.format("workbook").option("batch", batch).mode("append").save(path)


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What write_workbooks has written, under the names and types of schema."""
    spark.dataSource.register(Workbooks)
    return spark.read.format("workbook").schema(schema).load(path)


def as_json(rows: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object; nulls are written out."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(name))
