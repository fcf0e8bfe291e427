"""Workbooks: read back equal, all or nothing, headings and sheets as the format says."""

import io
import os
import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from haggle.operators.export import read_workbooks, write_workbooks
from haggle.sources.workbook import read_workbook, write_workbook

SCHEMA = "a long, b double, c string, d boolean, e date, f timestamp_ntz, g decimal(20,4), h int"
ROWS = [
    (1, 0.1, "plain", True, date(2024, 2, 29), datetime(2024, 2, 29, 1, 2, 3), Decimal("123456789012345.6789"), -5),
    (2**62, 1e300, " <&> \"quoted\" \n new line\r\t", False, None, None, None, None),
    (None, float("inf"), "", None, date(1, 1, 1), datetime(2024, 1, 1, 0, 0, 0, 123456), Decimal("-0.0001"), 0),
    (-(2**53) - 1, -0.0, "_x000D_ \x00\x1f 漢字 🙂", None, None, None, None, None),
]


def test_read_back_equal(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 60, SCHEMA).repartition(3)
    write_workbooks(df, f"file://{tmp_path}/out", batch=7)
    names = sorted(os.listdir(tmp_path / "out"))
    assert names[0] == "_SUCCESS" and all(n.endswith(".xlsx") for n in names[1:]) and len(names) == 4
    back = read_workbooks(spark, f"file://{tmp_path}/out", df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    book = zipfile.ZipFile(tmp_path / "out" / names[1])
    assert book.testzip() is None and b"<is><t xml:space=\"preserve\">A</t></is>" in book.read("xl/worksheets/sheet1.xml")


def test_empty_and_headings(spark, tmp_path):
    df = spark.createDataFrame([], "order_key long, name string")
    write_workbooks(df, f"file://{tmp_path}/out", {"name": "Nimi"})
    assert read_workbooks(spark, f"file://{tmp_path}/out", df.schema).collect() == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="broken"):
        write_workbooks(df, f"file://{tmp_path}/out")
    assert not os.path.exists(tmp_path / "out")
    with pytest.raises(Exception, match="no whole export"):
        read_workbooks(spark, f"file://{tmp_path}/out", df.schema).collect()
    write_workbooks(df.where("id < 100"), f"file://{tmp_path}/out")
    with pytest.raises(Exception, match="broken"):
        write_workbooks(df, f"file://{tmp_path}/out")
    assert read_workbooks(spark, f"file://{tmp_path}/out", df.schema).count() == 100


def test_full_sheets():
    file = io.BytesIO()
    assert write_workbook(file, ["n"], iter([(k,) for k in range(10)]), batch=3, sheet_rows=5) == 10
    book = zipfile.ZipFile(file)
    assert [book.read(f"xl/worksheets/sheet{k}.xml").count(b"<row>") for k in (1, 2, 3)] == [5, 5, 3] and "xl/worksheets/sheet4.xml" not in book.namelist()
    assert [r[0] for r in read_workbook(file)] == [str(k) for k in range(10)]


def test_a_type_without_a_cell(spark, tmp_path):
    with pytest.raises(Exception, match="holds no array"):
        write_workbooks(spark.createDataFrame([([1],)], "a array<int>"), f"file://{tmp_path}/out")
