"""Readers, writers, the registry and the example tables."""

import json
import os
import zipfile

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from sheetwise.operators.setops import assert_frame_equal
from sheetwise.sources.registry import TableRegistry
from sheetwise.sources.results import DETAIL, write_report, write_results
from sheetwise.sources.tables import load_annotations, load_table, read_csv, read_jsonl, write_csv, write_jsonl
from sheetwise.sources.workbooks import read_xlsx_dir

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def make_workbook(path, rows):
    """A minimal workbook: texts alternate between shared and inline strings."""
    shared, lines = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            at = f"{chr(65 + j)}{i}"
            if v is None:
                continue
            if isinstance(v, str) and (i + j) % 2:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
            elif isinstance(v, str):
                shared.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            else:
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
        lines.append(f'<row r="{i}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="a" sheetId="1"/></sheets></workbook>')
        book.writestr("xl/sharedStrings.xml", f'<sst {NS}>{"".join(f"<si><t>{s}</t></si>" for s in shared)}</sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {NS}><sheetData>{"".join(lines)}</sheetData></worksheet>')


def test_csv_round_trip_and_missing_cells(spark, tmp_path, gdp):
    write_csv(gdp, str(tmp_path / "gdp.csv"))
    assert_frame_equal(load_table(spark, str(tmp_path / "gdp.csv")), gdp, check_types=False)
    (tmp_path / "gaps.csv").write_text('a,b\n1,nan\n2,""\n3,"x, ""y"""\n')
    assert rows_of(load_table(spark, str(tmp_path / "gaps.csv"))) == [(1, None), (2, None), (3, 'x, "y"')]
    (tmp_path / "lines.csv").write_text('a,b\n1,"two\nlines"\n')
    assert rows_of(read_csv(spark, str(tmp_path / "lines.csv"), "a int, b string", multi_line=True)) == [(1, "two\nlines")]


def test_parquet_and_unknown_extension(spark, tmp_path, gdp):
    gdp.write.parquet(str(tmp_path / "gdp.parquet"))
    assert_frame_equal(load_table(spark, str(tmp_path / "gdp.parquet")), gdp)
    with pytest.raises(ValueError):
        load_table(spark, "table.txt")


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a\n\"b\"", "x"), ("é", None)], "text string, code string")
    write_jsonl(df, str(tmp_path / "out"))
    assert_frame_equal(read_jsonl(spark, str(tmp_path / "out"), "text string, code string"), df)


def test_annotations(spark, tmp_path):
    path = tmp_path / "notes.json"
    path.write_text(json.dumps({"gdp": "in dollars", "parts": {"unit": "kg"}, "n": 3}, indent=2))
    assert rows_of(load_annotations(spark, str(path))) == [("gdp", "in dollars"), ("n", "3"), ("parts", '{"unit":"kg"}')]
    assert load_annotations(spark, None) is None
    assert load_annotations(spark, str(tmp_path / "absent.json")) is None
    (tmp_path / "broken.json").write_text("{")
    assert load_annotations(spark, str(tmp_path / "broken.json")) is None


def test_registry_loads_on_first_use_and_swaps(spark, tmp_path, gdp):
    gdp.write.parquet(str(tmp_path / "a.parquet"))
    gdp.limit(2).write.parquet(str(tmp_path / "b.parquet"))
    registry = TableRegistry(spark, keep=True)
    registry.register("countries", str(tmp_path / "a.parquet"))
    assert not registry.is_loaded("countries")
    assert registry.get("countries").count() == 11
    assert spark.sql("select count(*) from countries").first()[0] == 11
    registry.swap("countries", str(tmp_path / "b.parquet"))
    assert not registry.is_loaded("countries")
    assert registry.get("countries").count() == 2
    registry.get("countries").unpersist()


def test_workbooks(spark, tmp_path):
    make_workbook(tmp_path / "one.xlsx", [["name", "n", "x"], ["a", 1, 1.5], ["b", None, 2], ["c", 3, None]])
    make_workbook(tmp_path / "two.xlsx", [["n", "name"], [7, "z"]])
    df = load_table(spark, str(tmp_path / "one.xlsx"))
    assert dict(df.dtypes) == {"name": "string", "n": "bigint", "x": "double"}
    assert rows_of(df) == [("a", 1, 1.5), ("b", None, 2.0), ("c", 3, None)]
    both = read_xlsx_dir(spark, str(tmp_path / "*.xlsx"), "name string, n int, x double")
    assert rows_of(both.drop("source_path")) == [("a", 1, 1.5), ("b", None, 2.0), ("c", 3, None), ("z", 7, None)]
    assert both.select("source_path").distinct().count() == 2


def test_workbooks_of_different_columns(spark, tmp_path):
    make_workbook(tmp_path / "a.xlsx", [["name", "n"], ["a", 1]])
    make_workbook(tmp_path / "b.xlsx", [["n", "extra"], [2, "x"]])
    both = read_xlsx_dir(spark, str(tmp_path / "*.xlsx"))
    assert sorted(both.columns) == ["extra", "n", "name", "source_path"]
    assert rows_of(both, "name", "n", "extra") == sorted([("a", "1", None), (None, "2", "x")], key=repr)


def test_nan_of_parquet_is_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "nan"), (2, float("nan"), ""), (3, 4.0, "x")], "k int, v double, t string")
    df.write.parquet(str(tmp_path / "nan.parquet"))
    assert rows_of(load_table(spark, str(tmp_path / "nan.parquet"))) == [(1, 2.0, "nan"), (2, None, ""), (3, 4.0, "x")]
    known = load_table(spark, str(tmp_path / "nan.parquet"), nan_is_missing=False).filter("v > 3")
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,3.0)]" in known._jdf.queryExecution().executedPlan().toString()


def test_results_are_appended_by_run(spark, tmp_path):
    detail = spark.createDataFrame([(1,) + (None,) * 12], DETAIL)
    write_results(detail, str(tmp_path / "r"), "run1")
    write_results(detail, str(tmp_path / "r"), "run2")
    assert rows_of(spark.read.parquet(str(tmp_path / "r")), "query_id", "run_id") == [(1, "run1"), (1, "run2")]
    with pytest.raises(ValueError):
        write_results(spark.createDataFrame([(None,) * 13], DETAIL), str(tmp_path / "r"), "run3")


def test_report(spark, tmp_path):
    metrics = spark.createDataFrame(
        [("general", 4, 3, 0.75), ("text2analysis", 0, 0, 0.0)], "cohort string, n_queries long, n_executable long, rate double"
    )
    write_report(metrics, str(tmp_path / "report"))
    part = next(f for f in os.listdir(tmp_path / "report") if f.startswith("part-"))
    assert (tmp_path / "report" / part).read_text().split("\n")[:-1] == [
        "general: 4 questions",
        "general: 3 of them ran",
        "text2analysis: no questions",
        "----------",
        "general: share that ran 0.75",
        "text2analysis: share that ran 0.0",
    ]
