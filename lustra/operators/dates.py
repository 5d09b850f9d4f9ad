"""Dates out of text, and their parts as features.

Text columns without a given format are read in the form that most of their cells have. All forms of all columns
are counted in one aggregate; the form is then the same for the whole column, and cells that do not
have it become null and are counted in the report.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.columns import data_types
from lustra.functions.text import quoted, trim_text
from lustra.operators.cleaning import known_columns

ISO = "ISO"
_TIME = r"( \d{1,2}:\d{2}(:\d{2})?)?"
# The forms that are tried, by preference, each with a pattern that its cells match. Of the forms
# with the month or the day first, the month wins if no cell decides.
FORMS: dict[str, str] = {
    "M/d/yyyy[ H:mm[:ss]]": rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_TIME}$",
    "d/M/yyyy[ H:mm[:ss]]": rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}{_TIME}$",
    "M-d-yyyy[ H:mm[:ss]]": rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}{_TIME}$",
    "d-M-yyyy[ H:mm[:ss]]": rf"^\d{{1,2}}-\d{{1,2}}-\d{{4}}{_TIME}$",
    "d.M.yyyy[ H:mm[:ss]]": rf"^\d{{1,2}}\.\d{{1,2}}\.\d{{4}}{_TIME}$",
    "yyyy/M/d[ H:mm[:ss]]": rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}}{_TIME}$",
    "yyyyMMdd": r"^\d{8}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{3,} \d{1,2}, \d{4}$",
    "MMMM d yyyy": r"^[A-Za-z]{3,} \d{1,2} \d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,} \d{4}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
}
DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday}
REPORT_SCHEMA = "column string, form string, cells bigint, lost bigint"


def _iso(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?\d{4,6}(-|$)"), text.try_cast("timestamp_ntz"))


def _in_form(text: Column, form: str) -> Column:
    """The cells that have a form; the pattern spares the others a failing parse."""
    if form == ISO:
        return _iso(text)
    # Names of months are known with a capital letter.
    spelt = F.initcap(F.lower(text)) if "MMM" in form else text
    parsed = F.try_to_timestamp(spelt, F.lit(form)).cast("timestamp_ntz")
    return F.when(text.rlike(FORMS[form]), parsed)


@dataclass(frozen=True)
class DateModel:
    """The form of each column; ``""`` for columns that hold dates already, else a format that was given.

    ``cells`` and ``lost`` count the cells with a value, and those that do not have the form.
    """

    forms: Mapping[str, str] = field(default_factory=dict)
    given: str | None = None
    cells: Mapping[str, int] = field(default_factory=dict)
    lost: Mapping[str, int] = field(default_factory=dict)

    def parsed(self, column: str) -> Column:
        form = self.forms[column]
        if not form:
            return quoted(column).cast("timestamp_ntz")
        text = trim_text(column)
        if self.given is not None:
            return F.try_to_timestamp(text, F.lit(self.given)).cast("timestamp_ntz")
        return _in_form(text, form)

    def transform(self, df: DataFrame) -> DataFrame:
        """Parse the columns in place and add their parts. Monday is day 0 of the week."""
        known = [c for c in self.forms if c in df.columns]
        dates = df.select(*[self.parsed(c).alias(c) if c in known else quoted(c) for c in df.columns])
        return dates.select(
            "*", *[part(quoted(c)).alias(f"{c}_{name}") for c in known for name, part in DATE_PARTS.items()]
        )

    def report(self, df: DataFrame) -> DataFrame:
        """One row per parsed text column: its form, its cells with a value, and those that were lost."""
        rows = [(c, form, self.cells[c], self.lost[c]) for c, form in self.forms.items() if form and c in self.cells]
        return df.sparkSession.createDataFrame(rows, REPORT_SCHEMA)


def fit_dates(
    df: DataFrame, columns: Sequence[str], fmt: str | None = None, all_or_nothing: bool = False
) -> DateModel:
    """Choose a form for each text column by the number of cells that have it, in one aggregate.

    ISO text wins ties, then the order of ``FORMS``. With ``fmt`` all text columns have that format. Columns of other
    types than text, date and timestamp are skipped. ``all_or_nothing`` skips a column that would lose a cell.
    """
    types = data_types(df)
    datelike = (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    chosen = [c for c in known_columns(df, columns) if isinstance(types[c], datelike)]
    texts = [c for c in chosen if isinstance(types[c], T.StringType)]
    model = DateModel({c: "" for c in chosen})
    if not texts:
        return model
    tried = [fmt] if fmt is not None else [ISO, *FORMS]
    # Trimmed once, as every form looks at it; blank cells have no value.
    trimmed = df.select(*[F.nullif(trim_text(c), F.lit("")).alias(f"t{i}") for i, c in enumerate(texts)])
    counts = []
    for i in range(len(texts)):
        text = F.col(f"t{i}")
        counts.append(F.count(text).alias(f"n{i}"))
        for k, form in enumerate(tried):
            parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt is not None else _in_form(text, form)
            counts.append(F.count(parsed).alias(f"n{i}_{k}"))
    seen = trimmed.agg(*counts).first()
    forms, cells, lost = dict(model.forms), {}, {}
    for i, c in enumerate(texts):
        votes = [seen[f"n{i}_{k}"] for k in range(len(tried))]
        best = votes.index(max(votes))
        missed = seen[f"n{i}"] - votes[best]
        if missed and all_or_nothing:
            warnings.warn(f"column {c!r}: {missed} cells do not parse", stacklevel=2)
            del forms[c]
            continue
        forms[c], cells[c], lost[c] = tried[best], seen[f"n{i}"], missed
    return DateModel(forms, fmt, cells, lost)


def datetime_features(
    df: DataFrame, columns: Sequence[str], fmt: str | None = None, all_or_nothing: bool = False
) -> DataFrame:
    """Fit and apply in one call."""
    return fit_dates(df, columns, fmt, all_or_nothing).transform(df)
