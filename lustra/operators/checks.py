"""Data-quality checks. Each returns a report table with one row per finding.

Report columns: ``check``, ``column``, ``expected``, ``found``, ``failed_rows``, ``status``
and ``action``. Reports are lazy; a check costs at most one aggregate over its columns.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException, PySparkException, PythonException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types
from lustra.functions.numbers import as_number, quiet_nan
from lustra.functions.text import quoted

REPORT_SCHEMA = (
    "check string, column string, expected string, found string, "
    "failed_rows bigint, status string, action string"
)
PASSED, FAILED = "passed", "failed"
MISSING = "MISSING"
# The report wording and the share of rows behind the coercion hint.
HINT_NUMERIC, HINT_BOOL, NO_HINT = (
    "can be coerced to numeric",
    "can be coerced to bool",
    "validation failed",
)
COERCIBLE_SHARE = 0.8

# An expected name that contains the word accepts these column types.
TYPE_FAMILIES: dict[str, tuple[type[T.DataType], ...]] = {
    "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType),
    "object": (T.StringType,),
    "datetime": (T.TimestampType, T.TimestampNTZType),
    "bool": (T.BooleanType,),
}
TEXT_SYNONYMS = ("string", "str", "object")


class ValidationError(Exception):
    """A check failed and the caller asked for failures to be raised."""


def type_matches(data_type: T.DataType, expected: str) -> bool:
    """Exact Spark type name, or an expected name that contains a matching family."""
    if data_type.simpleString() == expected:
        return True
    lowered = expected.lower()
    if lowered in TEXT_SYNONYMS:
        return isinstance(data_type, T.StringType)
    return any(
        word in lowered and isinstance(data_type, family)
        for word, family in TYPE_FAMILIES.items()
    )


def _row(
    check: str,
    column: str | None,
    expected: str | Column,
    found: str | Column,
    failed_rows: int | Column | None,
    status: str | Column,
    action: str | Column,
) -> Column:
    """One report row; plain values become literals."""

    def col(value: Any, kind: str) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    return F.struct(
        col(check, "string").alias("check"),
        col(column, "string").alias("column"),
        col(expected, "string").alias("expected"),
        col(found, "string").alias("found"),
        col(failed_rows, "bigint").alias("failed_rows"),
        col(status, "string").alias("status"),
        col(action, "string").alias("action"),
    )


def _count_row(check: str, column: str, expected: str, failed: Column) -> Column:
    """A report row for a number of failing rows."""
    status = F.when(failed > 0, F.lit(FAILED)).otherwise(F.lit(PASSED))
    return _row(check, column, expected, failed.cast("string"), failed, status, status)


def _report(df: DataFrame, aggregates: Sequence[Column], rows: Sequence[Column]) -> DataFrame:
    """All counts of a check in one aggregate, laid out as report rows."""
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame([], REPORT_SCHEMA)
    base = df.agg(*aggregates) if aggregates else spark.range(1)
    return base.select(F.inline(F.array(*rows)))


def check_data_types(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Compare column types with expected names. Only mismatches that may be coercible are read."""
    types = data_types(df)
    aggregates, rows = [], []
    for column, expected in schema.items():
        expected = str(expected)
        if column not in types:
            rows.append(_row("data_types", column, expected, MISSING, None, FAILED, NO_HINT))
            continue
        found = types[column].simpleString()
        if type_matches(types[column], expected):
            rows.append(_row("data_types", column, expected, found, None, PASSED, PASSED))
            continue
        action: str | Column = NO_HINT
        lowered = expected.lower()
        if "int" in lowered or "float" in lowered:
            number = as_number(column, types[column])
            if isinstance(types[column], T.BooleanType):
                number = quoted(column).cast("int")
            if number is not None:
                name = f"n{len(aggregates)}"
                aggregates.append(F.count(number).alias(name))
                enough = F.col(name) > F.col("rows") * COERCIBLE_SHARE
                action = F.when(enough, F.lit(HINT_NUMERIC)).otherwise(F.lit(NO_HINT))
        elif "bool" in lowered:
            action = HINT_BOOL
        rows.append(_row("data_types", column, expected, found, None, FAILED, action))
    if aggregates:
        aggregates.append(F.count(F.lit(1)).alias("rows"))
    return _report(df, aggregates, rows)


def _comparable(data_type: T.DataType, limit: Any) -> bool:
    """Whether values of a column can be held against a limit."""
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return isinstance(limit, (int, float, Decimal))
    if isinstance(data_type, T.StringType):
        return isinstance(limit, str)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        if isinstance(limit, str):
            try:
                datetime.fromisoformat(limit)
            except ValueError:
                return False
            return True
        return isinstance(limit, date)
    return False


def _range_parts(
    df: DataFrame, ranges: Mapping[str, Mapping[str, Any]]
) -> tuple[list[Column], list[Column]]:
    types = data_types(df)
    aggregates, rows = [], []
    for column, limits in ranges.items():
        if column not in types:
            rows.append(_row("value_ranges", column, "exists", MISSING, None, FAILED, NO_HINT))
            continue
        value = quiet_nan(quoted(column), types[column])
        if isinstance(types[column], T.BooleanType):
            value = value.cast("int")
        for bound, fails in (("min", lambda v, x: v < x), ("max", lambda v, x: v > x)):
            limit = limits.get(bound)
            if limit is None:
                continue
            expected = f"{bound} {limit}"
            if not _comparable(types[column], limit):
                found = types[column].simpleString()
                rows.append(_row("value_ranges", column, expected, found, None, FAILED, NO_HINT))
                continue
            name = f"range{len(aggregates)}"
            aggregates.append(F.count_if(fails(value, F.lit(limit))).alias(name))
            rows.append(_count_row("value_ranges", column, expected, F.col(name)))
    return aggregates, rows


def _not_null_parts(df: DataFrame, columns: Sequence[str]) -> tuple[list[Column], list[Column]]:
    types = data_types(df)
    aggregates, rows = [], []
    for column in columns:
        if column not in types:
            rows.append(_row("not_null", column, "exists", MISSING, None, FAILED, NO_HINT))
            continue
        name = f"null{len(aggregates)}"
        is_null = quiet_nan(quoted(column), types[column]).isNull()
        aggregates.append(F.count_if(is_null).alias(name))
        rows.append(_count_row("not_null", column, "no nulls", F.col(name)))
    return aggregates, rows


def check_value_ranges(df: DataFrame, ranges: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Inclusive limits; null passes. Too small and too large are separate findings.

    A limit that the column's type cannot be compared with is a failure of its own.
    """
    return _report(df, *_range_parts(df, ranges))


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _report(df, *_not_null_parts(df, columns))


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each value, per column; nulls equal each other.

    Values are counted with map-side combine, so a value that fills a third of the column
    is one row per map task by the time it is shuffled.
    """
    types = data_types(df)
    reports = []
    for column in columns:
        if column not in types:
            missing = _row("unique", column, "exists", MISSING, None, FAILED, NO_HINT)
            reports.append(_report(df, [], [missing]))
            continue
        value = quiet_nan(quoted(column), types[column]).alias("value")
        extra = F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra")
        counted = df.select(value).groupBy("value").count()
        row = _count_row("unique", column, "unique", F.col("extra"))
        reports.append(_report(counted, [extra], [row]))
    if not reports:
        return _report(df, [], [])
    return reduce(DataFrame.unionByName, reports)


def _refusal(df: DataFrame, condition: Column) -> str | None:
    """Why a column is no condition on the table, if so."""
    try:
        (outcome,) = df.select(condition).schema
    except AnalysisException as error:
        return f"raised {type(error).__name__}: {error.getCondition()}"
    if isinstance(outcome.dataType, (T.BooleanType, T.NullType)):
        return None
    return f"not a condition: {outcome.dataType.simpleString()}"


def _failure_counts(df: DataFrame, conditions: Sequence[Column]) -> list[int | str]:
    """Rows on which each condition is false, or how it broke.

    All conditions share one aggregate. If that breaks on some value, it is split in halves until the conditions that break
    stand alone, so one of them costs passes in the logarithm of their number, and the others keep their counts.
    """
    if not conditions:
        return []
    try:
        return list(df.agg(*[F.count_if(~c).alias(f"custom{i}") for i, c in enumerate(conditions)]).first())
    except PySparkException as error:
        # Without a condition it is the cluster that failed, not a value.
        if not error.getCondition() and not isinstance(error, PythonException):
            raise
        if len(conditions) == 1:
            return [f"raised {type(error).__name__}: {error.getCondition() or 'PYTHON_EXCEPTION'}"]
    half = len(conditions) // 2
    return _failure_counts(df, conditions[:half]) + _failure_counts(df, conditions[half:])


def check_custom(df: DataFrame, validations: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Own checks: ``{name, function, args}``.

    ``function`` is a callable that takes the table, or a boolean column that must not be
    false. All column checks share one aggregate, which runs at once. A callable may return a truth value, or a
    boolean column to be counted in the same way. An exception is a failure, and so is a column
    that cannot be resolved, is not boolean, or breaks on a value of the table; the other checks are not touched by it.
    """
    outcomes: list[tuple[str, Any, str | None]] = []
    for rule in validations:
        name, function = rule.get("name", "unknown"), rule.get("function")
        outcome: Any = function
        action = None
        if not isinstance(function, Column):
            if not callable(function):
                action = "function is not callable"
            else:
                try:
                    outcome = function(df, **rule.get("args", {}))
                except Exception as error:
                    action = f"raised {type(error).__name__}: {error}"
        if action is None and isinstance(outcome, Column):
            action = _refusal(df, outcome)
        outcomes.append((name, outcome, action))
    counts = iter(_failure_counts(df, [o for _, o, action in outcomes if action is None and isinstance(o, Column)]))
    rows = []
    for name, outcome, action in outcomes:
        if action is None and isinstance(outcome, Column):
            counted = next(counts)
            if not isinstance(counted, str):
                rows.append(_count_row("custom", name, "true", F.lit(counted)))
                continue
            action = counted
        status = FAILED if action is not None or not outcome else PASSED
        found = None if action else str(bool(outcome)).lower()
        rows.append(_row("custom", name, "true", found, None, status, action or status))
    return _report(df, [], rows)


def _section(spec: Mapping[str, Any], name: str) -> Mapping[str, Any] | None:
    """The section if it is switched on. Checks are off unless they say ``enabled``."""
    section = spec.get(name) or {}
    if isinstance(section, bool):
        return {}
    return section if section.get("enabled", False) else None


def validate(df: DataFrame, spec: Mapping[str, Any], fail_fast: bool = False) -> DataFrame:
    """Run the enabled checks: types, ranges, nulls, uniqueness, own checks.

    Ranges and nulls share one pass. The default reports everything; ``fail_fast`` raises
    ValidationError at the first check that fails, in the order above.
    """
    steps: list[Callable[[], DataFrame]] = []
    types = _section(spec, "data_types")
    if types is not None:
        steps.append(lambda: check_data_types(df, types.get("schema", {})))
    ranges = (_section(spec, "value_ranges") or {}).get("ranges", {})
    filled = (_section(spec, "not_null") or {}).get("columns", [])
    if fail_fast:
        steps.append(lambda: check_value_ranges(df, ranges))
        steps.append(lambda: check_not_null(df, filled))
    else:
        steps.append(lambda: _ranges_and_nulls(df, ranges, filled))
    unique = _section(spec, "unique")
    if unique is not None:
        steps.append(lambda: check_unique(df, unique.get("columns", [])))
    custom = _section(spec, "custom")
    if custom is not None:
        steps.append(lambda: check_custom(df, custom.get("validations", [])))

    reports = []
    for run in steps:
        report = run()
        if fail_fast:
            raise_on_failure(report)
        reports.append(report)
    return reduce(DataFrame.unionByName, reports)


def _ranges_and_nulls(
    df: DataFrame, ranges: Mapping[str, Mapping[str, Any]], columns: Sequence[str]
) -> DataFrame:
    range_aggregates, range_rows = _range_parts(df, ranges)
    null_aggregates, null_rows = _not_null_parts(df, columns)
    return _report(df, range_aggregates + null_aggregates, range_rows + null_rows)


def raise_on_failure(report: DataFrame) -> None:
    """Raise ValidationError if the report holds a failure; it has one row per rule."""
    failures = report.filter(F.col("status") == FAILED).collect()
    if failures:
        lines = [
            f"{r['check']} {r['column']}: expected {r['expected']}, found {r['found']}"
            for r in failures
        ]
        raise ValidationError("\n".join(lines))
