import datetime

import pytest

from lustra.operators import datetime_features, fit_dates
from lustra.plans.run import QualityRun


def days(df, column):
    return [None if r[0] is None else r[0].date().isoformat() for r in df.select(column).collect()]


@pytest.mark.parametrize(
    ("cells", "form", "found"),
    [
        (["01/31/2020", "02/03/2020"], "M/d/yyyy[ H:mm[:ss]]", ["2020-01-31", "2020-02-03"]),
        (["31/01/2020", "02/03/2020"], "d/M/yyyy[ H:mm[:ss]]", ["2020-01-31", "2020-03-02"]),
        (["02/03/2020", "1/2/2020 7:05"], "M/d/yyyy[ H:mm[:ss]]", ["2020-02-03", "2020-01-02"]),
        (["2020-01-31", "2020-02-03T10:00:00"], "ISO", ["2020-01-31", "2020-02-03"]),
        (["31.1.2020 10:00:01", "3.2.2020"], "d.M.yyyy[ H:mm[:ss]]", ["2020-01-31", "2020-02-03"]),
        (["JAN 31, 2020", "may 3, 2020"], "MMM d, yyyy", ["2020-01-31", "2020-05-03"]),
        (["January 31, 2020", "May 3, 2020"], "MMMM d, yyyy", ["2020-01-31", "2020-05-03"]),
        (["31 January 2020", "3 May 2020"], "d MMMM yyyy", ["2020-01-31", "2020-05-03"]),
        (["20200131", "20200203"], "yyyyMMdd", ["2020-01-31", "2020-02-03"]),
    ],
)
def test_the_form_of_most_cells_is_taken(make, cells, form, found):
    df = make("d string", *cells, "unknown", " ", None)
    model = fit_dates(df, ["d"])
    assert days(model.transform(df), "d") == [*found, None, None, None]
    assert [tuple(r) for r in model.report(df).collect()] == [("d", form, len(cells) + 1, 1)]


def test_each_column_has_its_form_and_one_pass_counts_all(make):
    df = make("a string, b string, c date", ("1/31/2020", "31-12-2020", datetime.date(2020, 5, 6)))
    found = datetime_features(df, ["a", "b", "c", "unknown"]).collect()[0].asDict()
    assert (found["a_month"], found["b_day"], found["c_dayofweek"]) == (1, 31, 2)


def test_all_or_nothing_leaves_a_column_with_lost_cells(make):
    df = make("a string, b string", ("1/31/2020", "1/31/2020"), ("no", "2/1/2020"))
    with pytest.warns(UserWarning, match="1 cells do not parse"):
        kept = datetime_features(df, ["a", "b"], all_or_nothing=True)
    assert "a_year" not in kept.columns and kept.columns == ["a", "b", "b_year", "b_month", "b_day", "b_dayofweek"]


def test_columns_without_values_and_empty_tables(make):
    df = make("a string", None, "")
    model = fit_dates(df, ["a"])
    assert days(model.transform(df), "a") == [None, None] and model.report(df).first()["cells"] == 0
    empty = df.filter("false")
    assert fit_dates(empty, ["a"]).transform(empty).count() == 0


def test_a_run_keeps_the_model(make):
    spec = {"preprocessing": {"datetime_features": {"enabled": True, "columns": ["d"]}}}
    result = QualityRun(spec).run(make("d string, n int", ("1/31/2020", 1), ("x", 2)))
    assert result.models["datetime_features"].lost == {"d": 1}
    assert sorted(r["d_day"] or 0 for r in result.data.collect()) == [0, 31]
