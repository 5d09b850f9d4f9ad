import datetime

import pytest

from lustra.sources import (
    ROW_ORDER,
    dataset_metadata,
    read_csv,
    read_table,
    readers,
    with_row_order,
    write_table,
)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_null_tokens_and_types(spark, tmp_path, values):
    path = write(
        tmp_path / "t.CSV",
        "i,f,t,flag,gap_flag,empty,day\n"
        "1,1.5,a,True,true,,2024-01-01\n"
        "-2,NA,null,FALSE,,  ,2024-01-02\n"
        "+3,1e2,#N/A,true,false,NaN,None\n",
    )
    df = read_table(spark, path)
    assert df.dtypes == [
        ("i", "bigint"),
        ("f", "double"),
        ("t", "string"),
        ("flag", "boolean"),
        ("gap_flag", "string"),
        ("empty", "double"),
        ("day", "string"),
    ]
    assert values(df, "i", "f", "t", "flag") == [
        (-2, None, None, False),
        (1, 1.5, "a", True),
        (3, 100.0, None, True),
    ]


def test_one_bad_cell_keeps_the_column_text(spark, tmp_path):
    path = write(tmp_path / "t.csv", "n\n1\n2\nabc\n")
    assert read_table(spark, path).dtypes == [("n", "string")]


def test_csv_records_that_span_lines_are_found_out(spark, tmp_path, values):
    text = 'a,b\n1,"two\nlines, ""quoted"""\n2,plain\n'
    path = write(tmp_path / "t.csv", text)
    assert values(read_csv(spark, path)) == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    assert read_csv(spark, path, multi_line=False).count() == 3


def test_json_lines_and_arrays(spark, tmp_path, values):
    lines = write(tmp_path / "l.json", '{"a": 1, "day": "2024-01-01"}\n{"a": null, "day": null}\n')
    array = write(tmp_path / "a.json", '\n [\n {"a": 1, "day": "2024-01-01"},\n {"a": null, "day": null}]')
    single = write(tmp_path / "s.json", '{\n"a": 1,\n"day": "x"}')
    assert read_table(spark, lines).dtypes == [("a", "bigint"), ("day", "string")]
    assert values(read_table(spark, lines)) == values(read_table(spark, array))
    assert values(read_table(spark, single)) == [(1, "x")]


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, str(tmp_path / "t.txt"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        write_table(spark.range(1), str(tmp_path / "t.xlsx"))


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip_keeps_values_and_nulls(spark, tmp_path, values, fmt):
    df = spark.createDataFrame(
        [
            (1, 1.5, 'a "b", c\nd', True, datetime.date(2024, 1, 1)),
            (2, None, None, False, datetime.date(2024, 1, 2)),
            (2**60 + 1, -2.0, " spaced ", True, None),
        ],
        "i bigint, f double, t string, flag boolean, day date",
    )
    path = str(tmp_path / f"out.{fmt}")
    write_table(df, path, metadata=True)
    back = read_table(spark, path).selectExpr("i", "f", "t", "flag", "cast(day as date) as day")
    assert back.dtypes == df.dtypes
    assert values(back) == values(df)
    record = spark.read.json(path + ".metadata").first()
    assert (record["rows"], record["columns"], record["column_names"]) == (3, 5, df.columns)


def test_metadata_record(make):
    row = dataset_metadata(make("a int, b string", (1, "x"))).first()
    assert (row["rows"], row["columns"], row["column_names"]) == (1, 2, ["a", "b"])


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_row_order_follows_the_files(spark, tmp_path, fmt):
    """Part files are written in order; small splits make Spark read a file in pieces."""
    folder = str(tmp_path / f"with space {fmt}.{fmt}")
    ordered = spark.range(0, 30_000, 1, 3).selectExpr("id", "repeat('x', 20) as pad")
    write_table(ordered, folder)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "50000")
    try:
        df = read_table(spark, folder, row_order=True)
        assert df.rdd.getNumPartitions() > (1 if fmt == "parquet" else 3)
        found = [r["id"] for r in df.orderBy(*ROW_ORDER).select("id").collect()]
    finally:
        spark.conf.set(setting, before)
    assert found == list(range(30_000))
    assert df.select(*ROW_ORDER).distinct().count() == 30_000


def test_row_order_is_taken_at_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).coalesce(1).write.parquet(path)
    df = with_row_order(spark.read.parquet(path), "parquet").filter("id > 5")
    assert [r[ROW_ORDER[1]] for r in df.orderBy("id").collect()] == [6, 7, 8, 9]


def test_csv_files_are_read_by_name(spark, tmp_path, values):
    write(tmp_path / "t.csv" / "1.csv", "a,b\n1,x\n")
    write(tmp_path / "t.csv" / "2.csv", 'b,a\n"y\nz",2\n')
    write(tmp_path / "t.csv" / "3.csv", "")
    df = read_table(spark, str(tmp_path / "t.csv"), row_order=True)
    assert df.columns[:2] == ["a", "b"]
    assert [tuple(r)[:2] for r in df.orderBy(*ROW_ORDER).collect()] == [(1, "x"), (2, "y\nz")]
    assert values(read_csv(spark, str(tmp_path / "t.csv"))) == [(1, "x"), (2, "y\nz")]


def test_csv_rows_longer_than_the_header_are_an_error(spark, tmp_path, values):
    with pytest.raises(ValueError, match="1 rows have more cells"):
        read_csv(spark, write(tmp_path / "t.csv", "a,b\n1,2\n3,4,5\n"))
    short = write(tmp_path / "s.csv", 'a,b,c\n1,"x,y",2\n3,"x,y"\n4\n')
    assert values(read_csv(spark, short)) == [(1, "x,y", 2), (3, "x,y", None), (4, None, None)]


def test_csv_repeated_names_stay_apart(spark, tmp_path):
    assert read_csv(spark, write(tmp_path / "t.csv", "a,a,b\n1,2,3\n")).first()[:] == (1, 2, 3)


def test_malformed_json_is_an_error(spark, tmp_path):
    path = write(tmp_path / "t.json", '{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_table(spark, path, "json").collect()


def test_json_columns_come_in_file_order(spark, tmp_path):
    lines = write(tmp_path / "l.json", '{"z": 1, "a": 2}\n{"m": 0, "b": 3, "z": 4}\n')
    assert read_table(spark, lines).columns == ["z", "a", "m", "b"]
    array = write(tmp_path / "a.json", '[{"z": 1, "a": 2},\n{"m": 0, "z": 4}]')
    assert read_table(spark, array).columns == ["z", "a", "m"]


@pytest.mark.parametrize("row", ['1,5" x,y 6"', '1,"5, x",y', "1,x,", "1,,,", '1,"a ""b"", c","d"', '"1","x\ny",z'])
def test_the_parser_tells_overlong_rows(spark, tmp_path, row):
    with pytest.raises(ValueError, match="1 rows have more cells"):
        read_csv(spark, write(tmp_path / "t.csv", f"a,b\n1,x\n{row}\n"))


@pytest.mark.parametrize(("row", "cells"), [("1", (1, None)), ('"1"', (1, None)), ('1,5" x', (1, '5" x')), ('1,"5, x"', (1, "5, x"))])
def test_rows_that_are_no_longer_than_the_header_are_read(spark, tmp_path, values, row, cells):
    assert values(read_csv(spark, write(tmp_path / "t.csv", f"a,b\n2,y\n{row}\n"))) == sorted([cells, (2, "y")], key=str)


def test_single_column_files(spark, tmp_path):
    assert read_csv(spark, write(tmp_path / "t.csv", "a\n1\n2\n")).count() == 2
    with pytest.raises(ValueError, match="1 rows have more cells"):
        read_csv(spark, write(tmp_path / "u.csv", "a\n1\n2,3\n"))


def test_long_file_lists_are_not_broadcast(spark, tmp_path, monkeypatch):
    for i in range(4):
        write(tmp_path / "t.csv" / f"{i}.csv", f"a,b\n{i},x\n{i},y\n")
    monkeypatch.setattr(readers, "BROADCAST_BYTES", 10)
    setting, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(setting, "-1")
    try:
        df = read_table(spark, str(tmp_path / "t.csv"), row_order=True)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r)[:2] for r in df.orderBy(*ROW_ORDER).collect()] == [(i, c) for i in range(4) for c in "xy"]
    finally:
        spark.conf.set(setting, before)
