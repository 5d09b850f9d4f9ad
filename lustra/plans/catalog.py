"""Named queries over the test tables, one or more per operator.

Every query takes a session and the folder of the tables and returns a table. Floating
results are rounded to six places, as sums over partitions differ in the last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lustra.operators import (
    aggregate_features,
    backward_fill,
    blanks_to_null,
    check_custom,
    check_data_types,
    check_not_null,
    check_unique,
    check_value_ranges,
    clean_numeric_columns,
    column_info,
    datetime_features,
    describe,
    drop_empty_rows,
    encode_categorical,
    fit_dates,
    fit_numeric_cleaner,
    forward_fill,
    handle_invalid_zeros,
    handle_missing_values,
    normalize,
    numeric_detection,
    preview,
    quality_profile,
    remove_duplicates,
    remove_outliers,
    select_features,
    standardize_text,
    trim_columns,
    validate,
)
from lustra.operators.checks import ValidationError
from lustra.plans.run import QualityRun, RunResult
from lustra.session import new_scratch_path
from lustra.sources import ROW_ORDER, dataset_metadata, read_table, write_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
PLACES = 6

# Orders with injected defects; the same text runs in Spark and in the SQL checks.
DIRTY_ORDERS = """
WITH base AS (
  SELECT o_orderkey AS row_ord, * FROM {orders}
  UNION ALL
  SELECT o_orderkey + 1000000000 AS row_ord, * FROM {orders} WHERE o_orderkey % 20 = 0
)
SELECT row_ord,
       o_orderkey AS order_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL
            WHEN o_orderkey % 17 = 0 THEN 'abc'
            ELSE CAST(o_custkey AS STRING) END AS cust_txt,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderkey % 19 = 0 THEN -o_totalprice
            WHEN o_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE)
            WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50
            ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            WHEN o_orderkey % 9 = 0 THEN '   '
            WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderpriority || ' '
            ELSE o_orderpriority END AS priority,
       o_orderstatus AS status,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS order_ts
FROM base
"""

CLEAN_ORDERS_SPEC = {
    "cleaning": {"remove_duplicates": {"keep": "first"}, "handle_missing": {"strategy": "fill"}},
}

FULL_SPEC = {
    "cleaning": {
        "handle_invalid_zeros": {"price": {"strategy": "median"}, "flag_invalid": True},
        "remove_duplicates": {"keep": "first"},
        "handle_missing": {"strategy": "fill"},
        "outliers": {"columns": ["price"]},
        "standardize_text": {"columns": ["priority"]},
    },
    "validation": {
        "data_types": {"enabled": True, "schema": {"price": "float", "cust_txt": "int"}},
        "value_ranges": {"enabled": True, "ranges": {"price": {"min": 0, "max": 400000}}},
        "not_null": {"enabled": True, "columns": ["price", "priority", "order_ts"]},
        "unique": {"enabled": True, "columns": ["row_ord", "cust_txt"]},
    },
    "preprocessing": {
        "feature_selection": {"enabled": True, "action": "drop", "columns": ["order_id"]},
        "normalize": {"enabled": True, "columns": ["price"], "method": "minmax"},
        "encode_categorical": {"enabled": True, "columns": ["status"], "method": "label"},
        "datetime_features": {"enabled": True, "columns": ["order_ts"]},
        "aggregate_features": {
            "enabled": True,
            "aggregations": {
                "price_by_priority": {
                    "group_by": "priority",
                    "column": "price",
                    "function": "mean",
                }
            },
        },
    },
}

# Aggregates on a column of lineitem, grouped by supplier.
SUPPLIER_AGGREGATES = {
    "mean": "l_extendedprice",
    "min": "l_extendedprice",
    "max": "l_extendedprice",
    "sum": "l_extendedprice",
    "count": "l_extendedprice",
    "size": "l_extendedprice",
    "nunique": "l_partkey",
    "std": "l_extendedprice",
    "var": "l_tax",
    "sem": "l_extendedprice",
    "median": "l_extendedprice",
    "quantile": "l_discount",
    "any": "l_tax",
    "all": "l_tax",
    "skew": "l_extendedprice",
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(DIRTY_ORDERS, orders=table(spark, folder, "orders"))


def blank_free_orders(spark: SparkSession, folder: str) -> DataFrame:
    return blanks_to_null(dirty_orders(spark, folder))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Round the named columns, or all doubles."""
    chosen = set(names) or {c for c, kind in df.dtypes if kind == "double"}
    return df.select(
        *[F.round(c, PLACES).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )


# ---------------------------------------------------------------- whole runs


@query
def clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    result = QualityRun(CLEAN_ORDERS_SPEC).run(dirty_orders(spark, folder), order_by="row_ord")
    return rounded(result.data)


def _full_run(spark: SparkSession, folder: str) -> RunResult:
    return QualityRun(FULL_SPEC).run(dirty_orders(spark, folder), order_by="row_ord")


@query
def clean_check_prepare(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_full_run(spark, folder).data)


@query
def run_validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return _full_run(spark, folder).validation


@query
def summary_report(spark: SparkSession, folder: str) -> DataFrame:
    return _full_run(spark, folder).summary


@query
def step_report(spark: SparkSession, folder: str) -> DataFrame:
    return _full_run(spark, folder).steps


# ---------------------------------------------------------------- blanks and text


@query
def blank_to_null(spark: SparkSession, folder: str) -> DataFrame:
    return blanks_to_null(dirty_orders(spark, folder))


@query
def drop_all_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = dirty_orders(spark, folder).select("cust_txt", "price", "priority")
    return drop_empty_rows(blanks_to_null(columns))


@query
def trim_text(spark: SparkSession, folder: str) -> DataFrame:
    return trim_columns(dirty_orders(spark, folder)).select("row_ord", "priority")


@query
def std_text(spark: SparkSession, folder: str) -> DataFrame:
    return standardize_text(dirty_orders(spark, folder), ["priority", "status"])


# ---------------------------------------------------------------- numbers


@query
def numeric_detect(spark: SparkSession, folder: str) -> DataFrame:
    return numeric_detection(blank_free_orders(spark, folder))


@query
def numeric_coerce(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_numeric_columns(dirty_orders(spark, folder), ["cust_txt"])
    return cleaned.select("row_ord", "cust_txt")


@query
def null_negatives(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_numeric_columns(dirty_orders(spark, folder), ["price"])
    return cleaned.select("row_ord", "price")


@query
def coercion_report(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder)
    return fit_numeric_cleaner(orders).report(orders)


# ---------------------------------------------------------------- duplicates


@query
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return remove_duplicates(dirty_orders(spark, folder), keep="first", order_by="row_ord")


@query
def dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    return remove_duplicates(dirty_orders(spark, folder), keep="last", order_by="row_ord")


@query
def dedup_none(spark: SparkSession, folder: str) -> DataFrame:
    return remove_duplicates(dirty_orders(spark, folder), keep=False, order_by="row_ord")


@query
def dedup_whole_rows(spark: SparkSession, folder: str) -> DataFrame:
    return remove_duplicates(dirty_orders(spark, folder).drop("row_ord"), subset=[])


@query
def dedup_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return remove_duplicates(documents, subset=["text"], keep="first", order_by="doc_id")


@query
def dedup_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """First order of each customer in file order; the file is sorted by order key."""
    orders = read_table(spark, f"{folder}/orders.parquet", row_order=True)
    first = remove_duplicates(orders, subset=["o_custkey"], keep="first", order_by=ROW_ORDER)
    return first.drop(*ROW_ORDER)


# ---------------------------------------------------------------- invalid zeros


def _zeros(spark: SparkSession, folder: str, flag: bool = False, **rule: str) -> DataFrame:
    repaired = handle_invalid_zeros(blank_free_orders(spark, folder), {"price": rule}, flag)
    return rounded(repaired)


@query
def zeros_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _zeros(spark, folder, flag=True, strategy="null")


@query
def zeros_drop(spark: SparkSession, folder: str) -> DataFrame:
    return _zeros(spark, folder, strategy="drop")


@query
def zeros_null(spark: SparkSession, folder: str) -> DataFrame:
    return _zeros(spark, folder, strategy="neighborhood_mean")


@query
def zeros_group_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _zeros(spark, folder, strategy="neighborhood_mean", group_by="priority")


@query
def zeros_overall_mean(spark: SparkSession, folder: str) -> DataFrame:
    return _zeros(spark, folder, strategy="neighborhood_mean", group_by="district")


@query
def zeros_median(spark: SparkSession, folder: str) -> DataFrame:
    return _zeros(spark, folder, strategy="median")


@query
def zeros_mode(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    graded = orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("grade"))
    return handle_invalid_zeros(graded, {"grade": {"strategy": "mode"}})


# ---------------------------------------------------------------- missing values


@query
def missing_drop(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder)
    return handle_missing_values(orders, "drop", columns=["cust_txt", "price", "priority"])


@query
def fill_const_num(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder)
    return handle_missing_values(orders, "fill", fill_value=-1, columns=["cust_txt", "price"])


@query
def fill_const_text(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder)
    filled = handle_missing_values(
        orders, "fill", fill_value="none given", columns=["priority", "price"]
    )
    return rounded(filled)


@query
def fill_median(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder)
    return rounded(handle_missing_values(orders, "fill", columns=["cust_txt", "price"]))


@query
def fill_mode(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder)
    return handle_missing_values(orders, "fill", columns=["priority", "status"])


def _sparse_events(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    kind = F.when(F.col("event_id") % 50 == 7, F.col("event_type"))
    return events.select("event_id", "ts", value.alias("value"), kind.alias("event_type"))


@query
def ffill_events(spark: SparkSession, folder: str) -> DataFrame:
    return forward_fill(_sparse_events(spark, folder), order_by=["ts", "event_id"])


@query
def bfill_events(spark: SparkSession, folder: str) -> DataFrame:
    return backward_fill(_sparse_events(spark, folder), order_by=["ts", "event_id"])


# ---------------------------------------------------------------- outliers


@query
def outlier_iqr_cap(spark: SparkSession, folder: str) -> DataFrame:
    orders = dirty_orders(spark, folder).select("row_ord", "price")
    return rounded(remove_outliers(orders, ["price"], "iqr", cap=True))


@query
def outlier_iqr_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Two columns in sequence: the second bounds come from the rows the first one left."""
    lines = table(spark, folder, "lineitem")
    return remove_outliers(lines, ["l_extendedprice", "l_quantity"], "iqr", factor=0.2)


@query
def outlier_iqr_drop_simultaneous(spark: SparkSession, folder: str) -> DataFrame:
    """Both bounds come from all rows."""
    lines = table(spark, folder, "lineitem")
    return remove_outliers(lines, ["l_extendedprice", "l_quantity"], "iqr", factor=0.2, simultaneous=True)


@query
def outlier_iqr_drop_dirty(spark: SparkSession, folder: str) -> DataFrame:
    orders = dirty_orders(spark, folder).select("row_ord", "price", "cust_txt")
    return remove_outliers(orders, ["price", "cust_txt"], "iqr", factor=0.5)


@query
def outlier_z_cap(spark: SparkSession, folder: str) -> DataFrame:
    orders = dirty_orders(spark, folder).select("row_ord", "price")
    return rounded(remove_outliers(orders, ["price"], "zscore", cap=True), "price")


@query
def outlier_z_drop(spark: SparkSession, folder: str) -> DataFrame:
    orders = dirty_orders(spark, folder).select("row_ord", "price")
    return remove_outliers(orders, ["price"], "zscore")


def infinite_orders(spark: SparkSession, folder: str, share: str) -> DataFrame:
    """Orders whose price is infinite where ``share`` holds."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    infinite = F.when(F.expr(share), F.lit(float("inf"))).otherwise(F.col("o_totalprice"))
    return orders.select("o_orderkey", infinite.alias("price"))


@query
def outlier_z_drop_infinite(spark: SparkSession, folder: str) -> DataFrame:
    return remove_outliers(infinite_orders(spark, folder, "o_orderkey % 50 = 0"), ["price"], "zscore")


@query
def outlier_z_cap_infinite(spark: SparkSession, folder: str) -> DataFrame:
    orders = infinite_orders(spark, folder, "o_orderkey % 50 = 0")
    return remove_outliers(orders, ["price"], "zscore", cap=True)


@query
def outlier_iqr_drop_infinite(spark: SparkSession, folder: str) -> DataFrame:
    return remove_outliers(infinite_orders(spark, folder, "o_orderkey % 5 > 0"), ["price"], "iqr")


@query
def outlier_auto_cap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(remove_outliers(table(spark, folder, "part"), None, "iqr", 0.4, cap=True))


# ---------------------------------------------------------------- features


@query
def select_keep(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return select_features(customers, ["c_name", "c_custkey", "c_acctbal"], "keep")


@query
def select_drop(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return select_features(customers, ["c_name", "c_mktsegment"], "drop")


def _scaled(spark: SparkSession, folder: str, method: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    scaled = normalize(lines, ["l_quantity", "l_extendedprice", "l_linenumber"], method)
    return rounded(scaled, "l_quantity", "l_extendedprice", "l_linenumber")


@query
def scale_standard(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "standard")


@query
def scale_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "minmax")


@query
def label_encode(spark: SparkSession, folder: str) -> DataFrame:
    orders = blank_free_orders(spark, folder).select("row_ord", "priority", "cust_txt")
    return encode_categorical(orders, ["priority", "cust_txt"], "label")


@query
def onehot(spark: SparkSession, folder: str) -> DataFrame:
    return encode_categorical(table(spark, folder, "customer"), ["c_mktsegment"], "onehot")


@query
def date_parts(spark: SparkSession, folder: str) -> DataFrame:
    orders = dirty_orders(spark, folder).select("row_ord", "order_ts")
    return datetime_features(orders, ["order_ts"])


@query
def date_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 29 == 0, F.lit("not a date")).otherwise(
        F.col("o_orderdate").cast("string")
    )
    orders = table(spark, folder, "orders").select("o_orderkey", text.alias("ordered_on"))
    return datetime_features(orders, ["ordered_on"])


def _spelt_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as people write them, some of them unreadable."""
    day = F.col("o_orderdate")
    lost = F.col("o_orderkey") % 29 == 0
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(lost, F.lit("not a date")).otherwise(F.date_format(day, "MM/dd/yyyy")).alias("us"),
        F.when(lost, F.lit(" ")).otherwise(F.date_format(day, "MMMM d, yyyy")).alias("spelt"),
        F.date_format(day, "dd.MM.yyyy HH:mm").alias("dotted"),
    )


@query
def date_parse_us(spark: SparkSession, folder: str) -> DataFrame:
    return datetime_features(_spelt_dates(spark, folder).select("o_orderkey", "us"), ["us"])


@query
def date_parse_month_name(spark: SparkSession, folder: str) -> DataFrame:
    return datetime_features(_spelt_dates(spark, folder).select("o_orderkey", "spelt"), ["spelt"])


@query
def date_lost_cells(spark: SparkSession, folder: str) -> DataFrame:
    orders = _spelt_dates(spark, folder)
    return fit_dates(orders, ["us", "spelt", "dotted"]).report(orders)


@query
def date_all_or_nothing(spark: SparkSession, folder: str) -> DataFrame:
    """A column that would lose cells stays as it is."""
    orders = _spelt_dates(spark, folder).select("o_orderkey", "us", "dotted")
    return datetime_features(orders, ["us", "dotted"], all_or_nothing=True)


@query
def feature_skipped(spark: SparkSession, folder: str) -> DataFrame:
    """Rules on unknown columns, without a group or of unfit types leave the others alone."""
    rules = {
        "unknown": {"group_by": "l_suppkey", "column": "weight", "function": "mean"},
        "incomplete": {"column": "l_quantity", "function": "mean"},
        "unfit": {"group_by": "l_suppkey", "column": "l_shipmode", "function": "mean"},
        "kept": {"group_by": "l_suppkey", "column": "l_quantity", "function": "max"},
    }
    lines = table(spark, folder, "lineitem").withColumn("l_shipmode", F.col("l_linenumber").cast("string"))
    return aggregate_features(lines.select("l_orderkey", "l_suppkey", "l_quantity", "l_shipmode"), rules)


def _supplier_feature(name: str, column: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", column)
        rule = {"group_by": "l_suppkey", "column": column, "function": name}
        return rounded(aggregate_features(lines, {"by_supplier": rule}))

    return run


for _name, _column in SUPPLIER_AGGREGATES.items():
    QUERIES[f"agg_feature_{_name}"] = _supplier_feature(_name, _column)


@query
def agg_feature_prod(spark: SparkSession, folder: str) -> DataFrame:
    """The product spans many magnitudes, so its logarithm is compared."""
    lines = table(spark, folder, "lineitem")
    kept = lines.select("l_orderkey", "l_suppkey", (1 + F.col("l_tax")).alias("rate"))
    rule = {"group_by": "l_suppkey", "column": "rate", "function": "prod"}
    feature = aggregate_features(kept, {"by_supplier": rule})
    product = F.round(F.log("by_supplier_prod"), PLACES)
    return feature.select("l_orderkey", "l_suppkey", product.alias("log_product"))


def _customer_feature(spark: SparkSession, folder: str, function: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    rule = {"group_by": "o_custkey", "column": "o_totalprice", "function": function}
    return aggregate_features(orders, {"order_price": rule}, order_by="o_orderkey")


@query
def agg_feature_first(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_feature(spark, folder, "first")


@query
def agg_feature_last(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_feature(spark, folder, "last")


@query
def agg_feature_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a group get null; the third feature builds on the first."""
    orders = blank_free_orders(spark, folder).select("row_ord", "priority", "status", "price")
    rules = {
        "price": {"group_by": "priority", "column": "price", "function": "mean"},
        "price_of": {"group_by": "priority", "column": "price", "function": "count"},
        "level": {"group_by": "status", "column": "price_mean", "function": "max"},
    }
    return rounded(aggregate_features(orders, rules))


# ---------------------------------------------------------------- checks


@query
def check_types(spark: SparkSession, folder: str) -> DataFrame:
    expected = {
        "row_ord": "int64",
        "order_id": "string",
        "cust_txt": "int",
        "price": "float64",
        "priority": "object",
        "status": "bool",
        "order_ts": "datetime64[ns]",
        "weight": "float",
    }
    return check_data_types(dirty_orders(spark, folder), expected)


@query
def check_ranges(spark: SparkSession, folder: str) -> DataFrame:
    ranges = {
        "price": {"min": 0, "max": 400000},
        "order_id": {"min": 0},
        "weight": {"max": 10},
    }
    return check_value_ranges(dirty_orders(spark, folder), ranges)


@query
def check_ranges_mistyped(spark: SparkSession, folder: str) -> DataFrame:
    """Limits that do not fit the type of a column, next to one that does."""
    ranges = {"price": {"min": "low", "max": 400000}, "priority": {"max": 3}}
    return check_value_ranges(dirty_orders(spark, folder), ranges)


@query
def check_nulls(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["order_id", "cust_txt", "price", "priority", "order_ts", "weight"]
    return check_not_null(dirty_orders(spark, folder), columns)


@query
def check_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return check_unique(dirty_orders(spark, folder), ["row_ord", "order_id", "cust_txt", "price"])


def _has_open_orders(df: DataFrame, status: str) -> Column:
    return F.col("status") != status


@query
def check_own_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = [
        {"name": "price is not negative", "function": F.col("price") >= 0},
        {"name": "not pending", "function": _has_open_orders, "args": {"status": "P"}},
        {"name": "has prices", "function": lambda df: "price" in df.columns},
        {"name": "has weights", "function": lambda df: "weight" in df.columns},
        {"name": "broken", "function": "text"},
    ]
    return check_custom(dirty_orders(spark, folder), rules)


@query
def check_rules_broken(spark: SparkSession, folder: str) -> DataFrame:
    """Rules that break on single values, next to good and failing ones."""
    rules = [
        {"name": "price is not negative", "function": F.col("price") >= 0},
        {"name": "customer is a number", "function": F.col("cust_txt").cast("int") > 0},
        {"name": "known status", "function": F.col("status").isin("F", "O", "P")},
        {"name": "not pending", "function": F.col("status") != "P"},
        {"name": "odd share", "function": F.expr("1 / (order_id % 2) >= 1")},
    ]
    return check_custom(dirty_orders(spark, folder), rules)


@query
def strict_or_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """What a failed check does to a run: it ends a strict one, a lenient one goes on."""
    checks = {"not_null": {"enabled": True, "columns": ["price"]}}
    outcomes = []
    for mode in ("strict", "lenient"):
        stages = {"cleaning": False, "preprocessing": False, "strict_validation": mode == "strict"}
        try:
            result = QualityRun({"validation": checks, "pipeline": stages}).run(dirty_orders(spark, folder))
        except ValidationError:
            outcomes.append((mode, "raised", None))
        else:
            outcomes.append((mode, result.validation.first()["status"], result.data.count()))
    return spark.createDataFrame(outcomes, "mode string, outcome string, rows bigint")


@query
def check_fail_fast(spark: SparkSession, folder: str) -> DataFrame:
    """The first check that fails ends a suite that is asked to fail fast."""
    orders = dirty_orders(spark, folder)
    outcomes = []
    for column in ("price", "row_ord"):
        try:
            validate(orders, {"not_null": {"enabled": True, "columns": [column]}}, fail_fast=True)
        except ValidationError:
            outcomes.append((column, "raised"))
        else:
            outcomes.append((column, "passed"))
    return spark.createDataFrame(outcomes, "column string, outcome string")


@query
def check_suite(spark: SparkSession, folder: str) -> DataFrame:
    return validate(
        dirty_orders(spark, folder),
        {
            "value_ranges": {"enabled": True, "ranges": {"price": {"min": 0, "max": 400000}}},
            "not_null": {"enabled": True, "columns": ["price", "status"]},
            "unique": {"enabled": True, "columns": ["order_id"]},
            "custom": {
                "enabled": True,
                "validations": [{"name": "known status", "function": F.col("status") != "P"}],
            },
        },
    )


# ---------------------------------------------------------------- profiles


@query
def profile_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_profile(dirty_orders(spark, folder).drop("row_ord"))


@query
def profile_describe(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(describe(table(spark, folder, "lineitem")))


@query
def profile_describe_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(describe(dirty_orders(spark, folder), ["price"]))


@query
def profile_info(spark: SparkSession, folder: str) -> DataFrame:
    return column_info(dirty_orders(spark, folder))


@query
def preview_orders(spark: SparkSession, folder: str) -> DataFrame:
    return preview(table(spark, folder, "orders"), "o_orderkey", 10)


@query
def orders_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_metadata(table(spark, folder, "orders"))


# ---------------------------------------------------------------- sources and sinks


def _round_trip(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    path = new_scratch_path(spark, "round-trip") + f".{fmt}"
    write_table(blank_free_orders(spark, folder), path)
    back = read_table(spark, path)
    return back.withColumn("order_ts", F.col("order_ts").cast("timestamp_ntz"))


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, "csv")


@query
def json_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, "json")


@query
def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, "parquet")


def _first_in_file(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    """First order of each customer in the order of files that were written by falling order key."""
    path = new_scratch_path(spark, "falling") + f".{fmt}"
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    write_table(orders.orderBy(F.desc("o_orderkey")), path)
    read = read_table(spark, path, row_order=True)
    return remove_duplicates(read, ["o_custkey"], "first", ROW_ORDER).drop(*ROW_ORDER)


@query
def csv_row_order(spark: SparkSession, folder: str) -> DataFrame:
    return _first_in_file(spark, folder, "csv")


@query
def json_row_order(spark: SparkSession, folder: str) -> DataFrame:
    return _first_in_file(spark, folder, "json")


@query
def csv_swapped_headers(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of files whose columns stand in different order."""
    path = new_scratch_path(spark, "swapped") + ".csv"
    orders = table(spark, folder, "orders")
    for odd, columns in enumerate((["o_orderkey", "o_custkey"], ["o_custkey", "o_orderkey"])):
        part = orders.filter(F.col("o_orderkey") % 2 == odd).select(*columns)
        part.write.option("header", True).mode("append").csv(path)
    return read_table(spark, path).select("o_orderkey", "o_custkey")


@query
def csv_typing(spark: SparkSession, folder: str) -> DataFrame:
    """Types a CSV of customers gets: one row per column."""
    path = new_scratch_path(spark, "customers") + ".csv"
    write_table(table(spark, folder, "customer"), path)
    return column_info(read_table(spark, path))
