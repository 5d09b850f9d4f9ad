from dataclasses import replace

import pytest

from lustra import QualityRun, read_table, session
from lustra.operators import ValidationError, encoding, fit_fill, fit_numeric_cleaner, fit_outliers
from lustra.operators.lookup import build_lookup
from lustra.plans import normalize_spec, run
from lustra.session import materialize
from lustra.streaming import apply_models, write_stream

PEOPLE = """name,age,city,salary
Alice,25,New York,50000
Bob,,Los Angeles,60000
Charlie,abc,Chicago,-2000
David,40,,70000
Alice,25,New York,50000
 Eve ,30, Boston ,55000
,,,
Frank,28,San Francisco,
John,35,Seattle,65000
Mary,,Portland,58000
"""
EXPECTED = [
    ("Alice", 25.0, "New York", 50000.0),
    ("Bob", 30.0, "Los Angeles", 60000.0),
    ("Charlie", 30.0, "Chicago", 59000.0),
    ("David", 40.0, "Boston", 70000.0),
    ("Eve", 30.0, "Boston", 55000.0),
    ("Frank", 28.0, "San Francisco", 59000.0),
    ("John", 35.0, "Seattle", 65000.0),
    ("Mary", 30.0, "Portland", 58000.0),
]
CLEANING = {"remove_duplicates": {"subset": None, "keep": "first"}, "handle_missing": {"strategy": "fill"}}


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(PEOPLE)
    return str(path)


def test_ten_row_fixture(spark, people, tmp_path, values):
    out = str(tmp_path / "out.parquet")
    result = QualityRun({"cleaning": CLEANING}).process(spark, people, out)
    assert values(result.data) == EXPECTED
    assert values(read_table(spark, out)) == EXPECTED
    assert result.summary.first().asDict() == {
        "initial_rows": 10,
        "initial_columns": 4,
        "initial_missing": 8,
        "initial_duplicates": 1,
        "final_rows": 8,
        "final_columns": 4,
        "missing_values_handled": 8,
        "duplicates_removed": 2,
        "outliers_handled": 0,
        "numeric_columns_validated": 2,
        "text_columns_cleaned": 2,
        "type_coercions": 2,
    }
    steps = {r["step"]: r["rows"] for r in result.steps.collect()}
    assert steps["input"] == 10 and steps["drop_empty_rows"] == 9
    assert steps["remove_duplicates"] == 8


def test_keep_last_follows_the_file_order(spark, people, values):
    spec = {"cleaning": {"remove_duplicates": {"subset": ["name"], "keep": "last"}}}
    result = QualityRun(spec).process(spark, people)
    assert result.data.columns == ["name", "age", "city", "salary"]
    assert len(values(result.data)) == 8


def test_forward_fill_in_file_order(spark, people):
    spec = {"cleaning": {"handle_missing": {"strategy": "forward_fill"}}}
    rows = QualityRun(spec).process(spark, people).data.collect()
    assert {r["name"]: r["age"] for r in rows}["Bob"] == 25.0
    assert {r["name"]: r["age"] for r in rows}["Mary"] == 35.0


def test_sample_shaped_table(spark):
    """A hundred people and copies of the first five, with gaps, outliers and a bad salary."""
    base = spark.range(1, 101).selectExpr(
        "id",
        "case when id between 51 and 53 then concat('  PERSON_', id, ' ') "
        "else concat('Person_', id) end as name",
        "cast(case when id between 11 and 16 then null when id = 41 then 200 "
        "else 18 + id * 7 % 62 end as double) as age",
        "cast(case when id between 21 and 26 then null when id = 42 then 5000000 "
        "when id = 43 then -50000 else 30000 + id * 1193 % 120000 end as double) as salary",
        "case when id = 31 then null else element_at(array('Sales','IT','HR','Finance',"
        "'Marketing'), cast(id % 5 + 1 as int)) end as department",
        "cast(date_add(date'2020-01-01', cast(id as int)) as string) as join_date",
        "concat('user', id, '@example.com') as email",
    )
    people = base.union(base.filter("id <= 5"))
    spec = {
        "cleaning": {**CLEANING, "outliers": {"columns": ["age", "salary"]}, "standardize_text": {"columns": ["name"]}},
        "preprocessing": {
            "normalize": {"enabled": True, "columns": ["age"], "method": "minmax"},
            "encode_categorical": {"enabled": True, "columns": ["department"], "method": "onehot"},
            "datetime_features": {"enabled": True, "columns": ["join_date"]},
        },
    }
    result = QualityRun(spec).run(people, order_by="id")
    summary = result.summary.first()
    assert (summary["initial_rows"], summary["initial_duplicates"], summary["initial_missing"]) == (105, 5, 13)
    assert (summary["final_rows"], summary["duplicates_removed"]) == (100, 5)
    assert summary["type_coercions"] == 1 and summary["outliers_handled"] == 2
    data = result.data
    assert data.filter("salary < 0 or salary is null or age not between 0 and 1").count() == 0
    assert data.filter("name <> lower(trim(name))").count() == 0
    # The missing one of IT takes the smallest of the equally frequent departments.
    assert data.filter("department_IT").count() == 19
    assert data.filter("department_Finance").count() == 21
    assert data.filter("join_date_year = 2020").count() == 100


def test_bookkeeping_columns_are_never_data(spark, people):
    spec = {
        "cleaning": {**CLEANING, "outliers": True},
        "preprocessing": {"feature_selection": {"enabled": True, "columns": ["age", "city"]}},
    }
    result = QualityRun(spec).process(spark, people)
    assert result.data.columns == ["age", "city"]
    assert {b.column for b in result.models["outliers"].bounds} == {"age", "salary"}


def test_outliers_wins_over_the_older_name_and_their_defaults_differ(make):
    df = make("n double, m double", *[(float(i), 1.0) for i in range(9)], (500.0, 1.0))
    capped = QualityRun({"cleaning": {"outliers": True, "remove_outliers": True}}).run(df)
    assert capped.data.count() == 10 and "remove_outliers" not in capped.models
    named = QualityRun({"cleaning": {"remove_outliers": {"columns": ["n"]}}}).run(df)
    assert named.data.count() == 9
    assert named.summary.first()["outliers_handled"] == 1
    nothing = QualityRun({"cleaning": {"remove_outliers": True}}).run(df)
    assert nothing.data.count() == 10


def test_zero_repair_runs_before_numeric_cleaning(make, values):
    df = make("size string, price double", ("0", 0.0), ("4", -1.0), ("6", 5.0))
    spec = {
        "cleaning": {
            "handle_invalid_zeros": {"size": {"strategy": "median"}, "flag_invalid": True},
        }
    }
    result = QualityRun(spec).run(df)
    assert values(result.data) == [(4.0, None, True), (5.0, 0.0, False), (6.0, 5.0, True)]


def test_validation_modes(make):
    df = make("n int", 1, None)
    checks = {"not_null": {"enabled": True, "columns": ["n"]}}
    lenient = QualityRun({"validation": checks, "pipeline": {"validate_before_cleaning": True}})
    result = lenient.run(df)
    # The empty row is gone after cleaning.
    assert result.validation_before.first()["status"] == "failed"
    assert result.validation.first()["status"] == "passed"
    strict = {"validate_before_cleaning": True, "strict_validation": True}
    with pytest.raises(ValidationError):
        QualityRun({"validation": checks, "pipeline": strict}).run(df)


def test_stages_can_be_switched_off(make, values):
    df = make("t string", " A ", " A ")
    spec = {"pipeline": {"cleaning": False, "preprocessing": {"enabled": False}}, "cleaning": CLEANING}
    result = QualityRun(spec).run(df)
    assert values(result.data) == [(" A ",), (" A ",)]
    assert result.summary.first()["text_columns_cleaned"] == 0


def test_spec_rules():
    normal = normalize_spec({"cleaning": {"outliers": True, "handle_missing": {}, "remove_duplicates": None}})
    cleaning = normal["cleaning"]
    assert cleaning["outliers"] == {"enabled": True}
    assert cleaning["handle_missing"] == {"enabled": True}
    assert cleaning["remove_duplicates"] == {"enabled": False}
    assert cleaning["clean_numeric"] == {"enabled": True}
    assert normalize_spec({"preprocessing": {"normalize": {"columns": ["a"]}}})["preprocessing"] == {
        "normalize": {"enabled": False, "columns": ["a"]}
    }
    for bad in (
        {"clean": {}},
        {"cleaning": {"strip_whitespace": True}},
        {"cleaning": {"handle_missing": {"domain_aware": {}}}},
    ):
        with pytest.raises(ValueError, match="unknown"):
            normalize_spec(bad)


def test_empty_description_still_cleans_numbers(make, values):
    result = QualityRun().run(make("price string", " 1 ", "-2", "3", " "))
    assert values(result.data) == [(None,), (1.0,), (3.0,)]


def test_fitted_models_on_a_stream(spark, tmp_path, values):
    schema = "price string, size double"
    train = spark.createDataFrame([("1", 1.0), ("2", None), ("x", 3.0), ("4", 90.0), ("5", 4.0)], schema)
    cleaner = fit_numeric_cleaner(train)
    cleaned = cleaner.transform(train)
    fill = fit_fill(cleaned)
    cap = fit_outliers(fill.transform(cleaned), ["size"], cap=True)
    models = [cleaner, fill, cap]

    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    train.write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    query = write_stream(apply_models(stream, models), sink)
    assert query.awaitTermination(60) and query.exception() is None
    assert values(spark.read.parquet(sink)) == values(apply_models(train, models))


def test_reports_count_only_tables_that_can_differ(make):
    df = make("id int, t string, n int", (1, " a ", 0), (1, "a", 0), (2, None, 5), (3, "b", 7))
    spec = {
        "cleaning": {
            "handle_invalid_zeros": {"n": {"strategy": "drop"}},
            "handle_missing": {"strategy": "fill"},
            "standardize_text": {"columns": ["t"]},
        },
        "preprocessing": {"feature_selection": {"enabled": True, "columns": ["n"], "action": "drop"}},
    }
    result = QualityRun(spec).run(df)
    steps = {r["step"]: r["rows"] for r in result.steps.collect()}
    assert [s.name for s in result.stages] == list(steps)
    assert list(steps.values()) == [4, 4, 2, *[2] * (len(steps) - 3)]
    # The steps that keep all rows take the count of the one before.
    plan = result.steps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == sum(s.drops for s in result.stages)
    summary = result.summary.first()
    assert (summary["initial_rows"], summary["initial_missing"], summary["initial_duplicates"]) == (4, 1, 0)
    assert (summary["final_rows"], summary["final_columns"], summary["duplicates_removed"]) == (2, 2, 2)


def test_a_fit_does_not_repeat_the_join_of_the_model_before_it(make, monkeypatch):
    """With lookups that are too large to broadcast, the table after the encoding is written once."""
    written = []
    monkeypatch.setattr(run, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    large = lambda *args, **options: replace(build_lookup(*args, **options), broadcastable=False)
    monkeypatch.setattr(encoding, "build_lookup", large)
    df = make("t string, g string, n double", ("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 5.0))
    spec = {
        "pipeline": {"cleaning": False},
        "preprocessing": {
            "encode_categorical": {"enabled": True, "columns": ["t"], "method": "label"},
            "aggregate_features": {
                "enabled": True,
                "aggregations": {"m": {"group_by": "g", "column": "n", "function": "mean"}},
            },
        },
    }
    result = QualityRun(spec).run(df)
    assert written == ["encode_categorical"]
    assert sorted((r["t"], r["m_mean"]) for r in result.data.collect()) == [(0, 2.0), (0, 5.0), (1, 2.0)]


def test_a_run_drops_its_tables(spark, tmp_path, monkeypatch):
    """Everything a run writes lies in one folder, which goes with the result; the output stays."""
    scratch = tmp_path / "shared"
    monkeypatch.setattr(session, "scratch_dir", lambda spark: str(scratch))
    source, output = str(tmp_path / "in.csv"), str(tmp_path / "out.parquet")
    (tmp_path / "in.csv").write_text(PEOPLE)
    spec = {
        "cleaning": {
            "handle_invalid_zeros": {"age": {"strategy": "neighborhood_mean", "group_by": "city"}},
            "remove_duplicates": {"keep": "first"},
            "handle_missing": {"strategy": "forward_fill"},
        },
        "preprocessing": {"encode_categorical": {"enabled": True, "columns": ["city"], "method": "label"}},
    }
    with QualityRun(spec).process(spark, source, output) as result:
        rows = result.data.count()
        assert result.summary.first()["final_rows"] == rows
        assert len(list(scratch.iterdir())) == 1
    assert list(scratch.iterdir()) == []
    assert read_table(spark, output).count() == rows
    result.close()
    strict = {
        "cleaning": {"remove_duplicates": {"keep": "first"}},
        "validation": {"not_null": {"enabled": True, "columns": ["age"]}},
        "pipeline": {"strict_validation": True},
    }
    with pytest.raises(ValidationError):
        QualityRun(strict).process(spark, source)
    assert list(scratch.iterdir()) == []
