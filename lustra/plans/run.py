"""A whole run: optional pre-check, clean, check, prepare, save.

Each step is a fit, which is a small aggregate, followed by a lazy transform. A stage that
shuffles is written to the shared folder before a later fit reads it, so that it runs once
and the fits scan only the columns they need.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.functions.columns import numeric_columns, text_columns
from lustra.operators.checks import raise_on_failure, validate
from lustra.operators.cleaning import (
    blanks_to_null,
    drop_blank_rows,
    fit_numeric_cleaner,
    standardize_text,
)
from lustra.operators.dates import fit_dates
from lustra.operators.dedup import remove_duplicates
from lustra.operators.encoding import MAX_CATEGORIES, fit_labels, fit_onehot
from lustra.operators.features import fit_group_features, select_features
from lustra.operators.missing import drop_missing, fit_fill
from lustra.operators.ordered_fill import fit_ordered_fill
from lustra.operators.outliers import DEFAULT_FACTOR, OutlierModel, fit_outliers
from lustra.operators.profile import cell_counts, merge_single_rows, missing_cells
from lustra.operators.scaling import fit_scaler
from lustra.plans.spec import ZERO_STEP, is_on, normalize_spec
from lustra.operators.zeros import fit_invalid_zeros
from lustra.session import drop_folder, materialize, run_folder
from lustra.sources import ROW_ORDER, path_format, read_table, write_table

OUTLIER_STEPS = ("outliers", "remove_outliers")
# The counters of a run.
SUMMARY_COLUMNS = (
    "initial_rows",
    "initial_columns",
    "initial_missing",
    "initial_duplicates",
    "final_rows",
    "final_columns",
    "missing_values_handled",
    "duplicates_removed",
    "outliers_handled",
    "numeric_columns_validated",
    "text_columns_cleaned",
    "type_coercions",
)
MISSING_STRATEGIES = {"forward_fill": "forward", "backward_fill": "backward"}


@dataclass
class Stage:
    """The table after one named step.

    ``shuffled`` says that computing it again would shuffle, ``drops`` that it may have fewer rows than the one before.
    """

    name: str
    data: DataFrame
    shuffled: bool = False
    drops: bool = True


@dataclass
class RunResult:
    """The prepared table and its reports. All reports are lazy tables, built on demand.

    The tables the run wrote on the way, those of its models included, lie in one folder until ``close``, or until the end of
    a ``with`` block. What was saved stays, but ``data``, the reports and models that look values up need the folder.
    """

    raw: DataFrame
    data: DataFrame
    stages: list[Stage] = field(default_factory=list)
    validation: DataFrame | None = None
    validation_before: DataFrame | None = None
    models: dict[str, Any] = field(default_factory=dict)
    folder: str | None = None

    def close(self) -> None:
        """Drop the tables of the run."""
        if self.folder:
            drop_folder(self.raw.sparkSession, self.folder)

    def __enter__(self) -> RunResult:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @cached_property
    def summary(self) -> DataFrame:
        """One row with the counters of the run."""
        return _summary(self)

    @cached_property
    def steps(self) -> DataFrame:
        """One row per cleaning step: rows after it."""
        return _row_counts(self.stages)


class QualityRun:
    """Runs one description on any number of tables."""

    def __init__(self, spec: Mapping[str, Any] | None = None) -> None:
        self.spec = normalize_spec(spec)

    def process(
        self,
        spark: SparkSession,
        input_path: str,
        output_path: str | None = None,
        input_format: str | None = None,
        output_format: str | None = None,
    ) -> RunResult:
        """Load, run in file order, and save if an output path is given.

        Text formats are parsed once and kept as Parquet in the shared folder, as the fits
        read the input several times and only some of its columns.
        """
        needs_order = self._needs_order()
        input_format = input_format or path_format(input_path)
        with run_folder(spark):
            df = read_table(spark, input_path, input_format, row_order=needs_order)
            if input_format != "parquet":
                df = materialize(df, "input")
            result = self.run(df, ROW_ORDER if needs_order else None, bookkeeping=ROW_ORDER)
            if output_path:
                write_table(result.data, output_path, output_format)
            return result

    def run(
        self,
        df: DataFrame,
        order_by: str | Sequence[str] | None = None,
        bookkeeping: Sequence[str] = (),
    ) -> RunResult:
        """Run on a table. ``order_by`` is the row order for first, last and ordered fills.

        ``bookkeeping`` names columns that only carry that order; no step treats them as
        data and they are left out of the result.
        """
        with run_folder(df.sparkSession) as folder:
            result = self._run(df, order_by, bookkeeping)
        result.folder = folder
        return result

    def _run(
        self, df: DataFrame, order_by: str | Sequence[str] | None, bookkeeping: Sequence[str]
    ) -> RunResult:
        order = [order_by] if isinstance(order_by, str) else list(order_by or ())
        hidden = [c for c in bookkeeping if c in df.columns]
        strict = self.spec["pipeline"].get("strict_validation", False)
        result = RunResult(df.drop(*hidden), df.drop(*hidden))

        if self.spec["pipeline"].get("validate_before_cleaning", False):
            result.validation_before = self._validate(result.raw, strict)

        stages = [Stage("input", df)]
        if is_on(self.spec["pipeline"], "cleaning"):
            stages = self._clean(df, order, hidden, result.models)
        cleaned = stages[-1].data

        if is_on(self.spec["pipeline"], "validation"):
            result.validation = self._validate(cleaned.drop(*hidden), strict)

        prepared = cleaned
        if is_on(self.spec["pipeline"], "preprocessing"):
            prepared = self._prepare(cleaned, order, hidden, result.models)
        result.data = prepared.drop(*hidden)
        result.stages = [Stage(s.name, s.data.drop(*hidden), drops=s.drops) for s in stages]
        return result

    def _needs_order(self) -> bool:
        """Whether some step that is on refers to the row order."""
        cleaning = self.spec["cleaning"]
        dedup, missing = "remove_duplicates", "handle_missing"
        first_or_last = {r.get("function") for r in self._aggregations().values()}
        return (
            (is_on(cleaning, dedup) and cleaning[dedup].get("keep", "first") is not False)
            or (
                is_on(cleaning, missing)
                and cleaning[missing].get("strategy") in MISSING_STRATEGIES
            )
            or bool(first_or_last & {"first", "last"})
        )

    def _aggregations(self) -> Mapping[str, Mapping[str, Any]]:
        preparing = self.spec["preprocessing"]
        if not is_on(preparing, "aggregate_features"):
            return {}
        return preparing["aggregate_features"].get("aggregations") or {}

    def _validate(self, df: DataFrame, strict: bool) -> DataFrame:
        report = validate(df, self.spec["validation"])
        if strict:
            raise_on_failure(report)
        return report

    def _clean(
        self, df: DataFrame, order: list[str], hidden: list[str], models: dict[str, Any]
    ) -> list[Stage]:
        """Cleaning steps in their fixed order. Returns the table after each of them."""
        cleaning = self.spec["cleaning"]
        stages = [Stage("input", df)]

        def add(name: str, data: DataFrame, shuffled: bool = False, drops: bool = True) -> None:
            stages.append(Stage(name, data, shuffled or stages[-1].shuffled, drops))

        def settled() -> DataFrame:
            """The latest table, written out first if a fit would otherwise repeat a shuffle."""
            latest = stages[-1]
            if latest.shuffled:
                stages[-1] = Stage(latest.name, materialize(latest.data, latest.name), drops=latest.drops)
            return stages[-1].data

        def fit_and_add(name: str, fit: Callable[[DataFrame], Any]) -> None:
            source = settled()
            model = models[name] = fit(source.drop(*hidden))
            add(name, model.transform(source), getattr(model, "shuffles", False), getattr(model, "drops", False))

        add("drop_empty_rows", blanks_to_null(drop_blank_rows(df, ignore=hidden)))
        if is_on(cleaning, ZERO_STEP):
            rules = {k: v for k, v in cleaning[ZERO_STEP].items() if k != "enabled"}
            flag = bool(rules.pop("flag_invalid", False))
            fit_and_add(ZERO_STEP, lambda d: fit_invalid_zeros(d, rules, flag))
        if is_on(cleaning, "clean_numeric"):
            columns = cleaning["clean_numeric"].get("columns")
            fit_and_add("clean_numeric", lambda d: fit_numeric_cleaner(d, columns))
        if is_on(cleaning, "remove_duplicates"):
            options = cleaning["remove_duplicates"]
            unique = remove_duplicates(
                stages[-1].data,
                options.get("subset"),
                options.get("keep", "first"),
                order,
                trimmed=True,
            )
            add("remove_duplicates", unique, shuffled=True)
        if is_on(cleaning, "handle_missing"):
            options = cleaning["handle_missing"]
            strategy, columns = options.get("strategy", "drop"), options.get("columns")
            if strategy == "drop":
                visible = columns or [c for c in df.columns if c not in hidden]
                add("handle_missing", drop_missing(stages[-1].data, visible))
            elif strategy == "fill":
                value = options.get("fill_value")
                fit_and_add("handle_missing", lambda d: fit_fill(d, columns, value))
            elif strategy in MISSING_STRATEGIES:
                direction = MISSING_STRATEGIES[strategy]
                source = settled()
                model = fit_ordered_fill(source, order, columns, direction)
                models["handle_missing"] = model
                add("handle_missing", model.transform(source), shuffled=True, drops=False)
            else:
                raise ValueError(f"unknown missing-value strategy {strategy!r}")
        if is_on(cleaning, "outliers"):
            options = cleaning["outliers"]
            columns = options.get("columns") or None
            self._treat_outliers(fit_and_add, "outliers", options, columns, True)
        elif is_on(cleaning, "remove_outliers"):
            options = cleaning["remove_outliers"]
            columns = options.get("columns") or []
            self._treat_outliers(fit_and_add, "remove_outliers", options, columns, False)
        if is_on(cleaning, "standardize_text"):
            columns = cleaning["standardize_text"].get("columns") or []
            add("standardize_text", standardize_text(stages[-1].data, columns), drops=False)
        # Checks, preparation and reports all read the cleaned table.
        settled()
        return stages

    @staticmethod
    def _treat_outliers(
        fit_and_add: Callable[..., None],
        name: str,
        options: Mapping[str, Any],
        columns: Sequence[str] | None,
        cap: bool,
    ) -> None:
        fit_and_add(
            name,
            lambda d: fit_outliers(
                d,
                columns,
                options.get("method", "iqr"),
                options.get("factor", DEFAULT_FACTOR),
                options.get("cap", cap),
                options.get("simultaneous", False),
            ),
        )

    def _prepare(
        self, df: DataFrame, order: list[str], hidden: list[str], models: dict[str, Any]
    ) -> DataFrame:
        """Selection, scaling, encoding, date parts, group features, in this order.

        As in cleaning, a fit that would repeat the join of a model before it reads a written table instead.
        """
        preparing = self.spec["preprocessing"]
        if is_on(preparing, "feature_selection"):
            options = preparing["feature_selection"]
            columns, action = list(options.get("columns") or []), options.get("action", "keep")
            if action == "keep":
                columns += [c for c in hidden if c not in columns]
            df = select_features(df, columns, action)
        latest = Stage("prepare", df)

        def fit_and_apply(name: str, fit: Callable[[DataFrame], Any]) -> None:
            nonlocal latest
            if latest.shuffled:
                latest = Stage(latest.name, materialize(latest.data, latest.name))
            model = models[name] = fit(latest.data)
            latest = Stage(name, model.transform(latest.data), getattr(model, "shuffles", False))

        if is_on(preparing, "normalize"):
            scaling = preparing["normalize"]
            method = scaling.get("method", "standard")
            fit_and_apply("normalize", lambda d: fit_scaler(d, scaling.get("columns") or [], method))
        if is_on(preparing, "encode_categorical"):
            encoding = preparing["encode_categorical"]
            method = encoding.get("method", "label")
            if method not in ("label", "onehot"):
                raise ValueError(f"unknown encoding method {method!r}")
            columns = encoding.get("columns") or []
            most = encoding.get("max_categories", MAX_CATEGORIES)
            fit_and_apply(
                "encode_categorical",
                lambda d: fit_labels(d, columns) if method == "label" else fit_onehot(d, columns, most),
            )
        if is_on(preparing, "datetime_features"):
            dates = preparing["datetime_features"]
            fit_and_apply(
                "datetime_features",
                lambda d: fit_dates(
                    d, dates.get("columns") or [], dates.get("format"), dates.get("all_or_nothing", False)
                ),
            )
        aggregations = self._aggregations()
        if aggregations:
            fit_and_apply("aggregate_features", lambda d: fit_group_features(d, aggregations, order))
        return latest.data


def _summary(result: RunResult) -> DataFrame:
    """One row of counters, each table counted in one pass.

    ``duplicates_removed`` counts every row lost in cleaning; the true count per step is in
    the step report.
    """

    def fixed(value: int) -> Column:
        return F.lit(value).cast("bigint")

    raw, stages = result.raw, result.stages
    cleaned = stages[-1].data
    was_cleaned = len(stages) > 1
    inputs = {after.name: before.data for before, after in zip(stages, stages[1:], strict=False)}
    parts = [
        # Rows, missing cells and duplicates of the input from one pass.
        cell_counts(raw)
        .withColumnsRenamed({"rows": "initial_rows", "missing_cells": "initial_missing", "duplicate_rows": "initial_duplicates"})
        .withColumn("initial_columns", fixed(len(raw.columns))),
        # No step of the preparation drops rows, so the prepared table need not be computed for its count.
        cleaned.agg(
            F.count(F.lit(1)).alias("cleaned_rows"),
            F.count(F.lit(1)).alias("final_rows"),
            fixed(len(result.data.columns)).alias("final_columns"),
            missing_cells(cleaned).alias("cleaned_missing"),
            fixed(len(numeric_columns(cleaned)) if was_cleaned else 0).alias(
                "numeric_columns_validated"
            ),
            fixed(len(text_columns(cleaned)) if was_cleaned else 0).alias("text_columns_cleaned"),
            # Kept at 0 where the step was off.
            fixed(0).alias("outliers_handled"),
            fixed(0).alias("type_coercions"),
        ),
    ]
    for name, model in result.models.items():
        if name == "clean_numeric":
            lost = model.report(inputs[name])
            total = F.sum(F.col("coerced") + F.col("negatives_nulled"))
            parts.append(lost.agg(total.alias("type_coercions")))
        elif name in OUTLIER_STEPS:
            parts.append(_outlier_count(model, inputs[name], stages, name))
    merged = merge_single_rows(parts)
    handled = F.col("initial_missing") - F.col("cleaned_missing")
    removed = F.col("initial_rows") - F.col("cleaned_rows")
    derived = {"missing_values_handled": handled, "duplicates_removed": removed}
    return merged.select(*[derived.get(c, F.col(c)).alias(c) for c in SUMMARY_COLUMNS])


def _outlier_count(
    model: OutlierModel, before: DataFrame, stages: Sequence[Stage], name: str
) -> DataFrame:
    """Capped cells, or rows the step removed."""
    if model.cap:
        return model.report(before).agg(F.sum("outliers").alias("outliers_handled"))
    after = next(s.data for s in stages if s.name == name)
    change = before.select(F.lit(1).alias("n")).unionAll(after.select(F.lit(-1).alias("n")))
    return change.agg(F.sum("n").alias("outliers_handled"))


def _row_counts(stages: Sequence[Stage]) -> DataFrame:
    """One row per step: rows after it. The difference to the row before is what it dropped.

    Only steps that can drop rows are counted; the ones that follow them have as many.
    """
    counted: list[tuple[DataFrame, list[Column]]] = []
    for i, s in enumerate(stages):
        if i == 0 or s.drops:
            counted.append((s.data, []))
        counted[-1][1].append(F.struct(F.lit(i).alias("position"), F.lit(s.name).alias("step")))
    parts = [
        data.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(F.array(*steps)), "rows") for data, steps in counted
    ]
    return reduce(DataFrame.unionByName, parts)
