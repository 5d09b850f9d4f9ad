"""The same queries as :mod:`lustra.plans.catalog` in ANSI SQL, for an independent check."""

from __future__ import annotations

from lustra.plans.catalog import DIRTY_ORDERS, SUPPLIER_AGGREGATES

DIRTY = DIRTY_ORDERS.format(orders="orders")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
REPORT = "check, column, expected, found, failed_rows, status, action"

BLANK_FREE = f"""
SELECT row_ord, order_id, nullif(trim(cust_txt), '') AS cust_txt, price,
       nullif(trim(priority), '') AS priority, nullif(trim(status), '') AS status, order_ts
FROM ({DIRTY})
"""
TRIMMED = f"""
SELECT row_ord, order_id, trim(cust_txt) AS cust_txt, price, trim(priority) AS priority,
       trim(status) AS status, order_ts
FROM ({DIRTY})
"""


def number(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches(trim({column}), '{NUMBER}') "
        f"THEN try_cast(trim({column}) AS DOUBLE) END"
    )


def mode_of(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


def report_row(
    check: str, column: str, expected: str, found: str, failed: str, status: str, action: str
) -> str:
    return (
        f"SELECT '{check}' AS check, '{column}' AS \"column\", '{expected}' AS expected, "
        f"{found} AS found, CAST({failed} AS BIGINT) AS failed_rows, {status} AS status, "
        f"{action} AS action"
    )


def count_row(check: str, column: str, expected: str, failed: str, source: str) -> str:
    status = "CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END"
    row = report_row(check, column, expected, "CAST(n AS VARCHAR)", "n", status, status)
    return f"{row} FROM (SELECT {failed} AS n FROM {source})"


def missing_row(check: str, column: str) -> str:
    return report_row(
        check, column, "exists", "'MISSING'", "NULL", "'failed'", "'validation failed'"
    )


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


DEDUP_KEYS = "cust_txt, price, priority, status, order_ts"
COLUMNS = "row_ord, order_id, cust_txt, price, priority, status, order_ts"


def dedup(direction: str, source: str) -> str:
    return (
        f"SELECT {COLUMNS} FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY {DEDUP_KEYS} ORDER BY row_ord {direction}) AS rn FROM {source}) "
        "WHERE rn = 1"
    )


def price_only(price: str, source: str = "b", flag: str = "", where: str = "") -> str:
    return (
        f"WITH b AS ({BLANK_FREE}) SELECT row_ord, order_id, cust_txt, {price} AS price, "
        f"priority, status, order_ts{flag} FROM {source} {where}"
    )


def iqr(column: str, source: str, factor: str) -> str:
    return (
        f"SELECT q1 - {factor} * (q3 - q1) AS lo, q3 + {factor} * (q3 - q1) AS hi FROM "
        f"(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 "
        f"FROM {source})"
    )


def cap_all(columns: list[str], source: str, factor: str) -> str:
    """A column whose quartiles coincide is left alone."""
    caps = []
    for c in columns:
        q1 = f"(SELECT quantile_cont({c}, 0.25) FROM {source})"
        q3 = f"(SELECT quantile_cont({c}, 0.75) FROM {source})"
        low, high = f"{q1} - {factor} * ({q3} - {q1})", f"{q3} + {factor} * ({q3} - {q1})"
        caps.append(
            f"round(CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} "
            f"ELSE CAST({c} AS DOUBLE) END, 6) AS {c}"
        )
    return ", ".join(caps)


CLEAN = f"""
WITH b AS ({BLANK_FREE}),
kept AS (SELECT * FROM b WHERE NOT (row_ord IS NULL AND order_id IS NULL AND cust_txt IS NULL
  AND price IS NULL AND priority IS NULL AND status IS NULL AND order_ts IS NULL)),
typed AS (SELECT row_ord, order_id, {number("cust_txt")} AS cust_txt,
  CASE WHEN price >= 0 THEN price END AS price, priority, status, order_ts FROM kept),
d AS ({dedup("", "typed")})
SELECT row_ord, order_id,
  round(coalesce(cust_txt, (SELECT median(cust_txt) FROM d)), 6) AS cust_txt,
  round(coalesce(price, (SELECT median(price) FROM d)), 6) AS price,
  coalesce(priority, {mode_of("priority", "d")}) AS priority, status, order_ts
FROM d
"""

# The whole run: zeros to the median, typed, first of doubles, filled, capped, lower-cased.
FULL_CTES = f"""
WITH b AS ({BLANK_FREE}),
z AS (SELECT * REPLACE (CASE WHEN price = 0
    THEN (SELECT median(price) FROM b WHERE price <> 0) ELSE price END AS price),
  coalesce(price <> 0, true) AS is_valid_price FROM b),
typed AS (SELECT * REPLACE ({number("cust_txt")} AS cust_txt,
  CASE WHEN price >= 0 THEN price END AS price) FROM z),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY {DEDUP_KEYS}, is_valid_price ORDER BY row_ord) AS rn FROM typed) WHERE rn = 1),
f AS (SELECT * REPLACE (coalesce(cust_txt, (SELECT median(cust_txt) FROM d)) AS cust_txt,
  coalesce(price, (SELECT median(price) FROM d)) AS price,
  coalesce(priority, {mode_of("priority", "d")}) AS priority) FROM d),
q AS ({iqr("price", "f", "1.5")}),
c AS (SELECT * REPLACE (CASE WHEN price < (SELECT lo FROM q) THEN (SELECT lo FROM q)
  WHEN price > (SELECT hi FROM q) THEN (SELECT hi FROM q) ELSE price END AS price,
  lower(trim(priority)) AS priority) FROM f)
"""

FULL = f"""
{FULL_CTES},
s AS (SELECT row_ord, cust_txt,
  (price - (SELECT min(price) FROM c)) / (SELECT max(price) - min(price) FROM c) AS price,
  priority, CAST(dense_rank() OVER (ORDER BY status) - 1 AS BIGINT) AS status, order_ts,
  is_valid_price FROM c),
g AS (SELECT priority, avg(price) AS m FROM s GROUP BY priority)
SELECT s.row_ord, round(s.cust_txt, 6) AS cust_txt, round(s.price, 6) AS price, s.priority,
  s.status, s.order_ts, s.is_valid_price,
  CAST(year(order_ts) AS INTEGER) AS order_ts_year,
  CAST(month(order_ts) AS INTEGER) AS order_ts_month,
  CAST(day(order_ts) AS INTEGER) AS order_ts_day,
  CAST(isodow(order_ts) - 1 AS INTEGER) AS order_ts_dayofweek,
  round(g.m, 6) AS price_by_priority_mean
FROM s LEFT JOIN g ON s.priority = g.priority
"""

RUN_VALIDATION = f"""
{FULL_CTES}
{union(
    report_row("data_types", "price", "float", "'double'", "NULL", "'passed'", "'passed'"),
    report_row("data_types", "cust_txt", "int", "'double'", "NULL", "'failed'",
               "'can be coerced to numeric'"),
    count_row("value_ranges", "price", "min 0", "count(*) FILTER (price < 0)", "c"),
    count_row("value_ranges", "price", "max 400000", "count(*) FILTER (price > 400000)", "c"),
    count_row("not_null", "price", "no nulls", "count(*) FILTER (price IS NULL)", "c"),
    count_row("not_null", "priority", "no nulls", "count(*) FILTER (priority IS NULL)", "c"),
    count_row("not_null", "order_ts", "no nulls", "count(*) FILTER (order_ts IS NULL)", "c"),
    count_row("unique", "row_ord", "unique", "count(*) - count(DISTINCT row_ord)", "c"),
    count_row("unique", "cust_txt", "unique", "count(*) - count(DISTINCT cust_txt)", "c"),
)}
"""


def nulls(source: str, columns: str) -> str:
    parts = [f"count(*) FILTER ({c.strip()} IS NULL)" for c in columns.split(",")]
    return f"(SELECT {' + '.join(parts)} FROM {source})"


SUMMARY = f"""
{FULL_CTES},
raw AS ({DIRTY})
SELECT (SELECT count(*) FROM raw) AS initial_rows, CAST(7 AS BIGINT) AS initial_columns,
  {nulls("raw", COLUMNS)} AS initial_missing,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw))
    AS initial_duplicates,
  (SELECT count(*) FROM c) AS final_rows, CAST(12 AS BIGINT) AS final_columns,
  {nulls("raw", COLUMNS)} - {nulls("c", COLUMNS)} AS missing_values_handled,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM c) AS duplicates_removed,
  (SELECT count(*) FILTER (price < (SELECT lo FROM q) OR price > (SELECT hi FROM q)) FROM f)
    AS outliers_handled,
  CAST(4 AS BIGINT) AS numeric_columns_validated, CAST(2 AS BIGINT) AS text_columns_cleaned,
  (SELECT count(cust_txt) FROM z) - (SELECT count(cust_txt) FROM typed)
    + (SELECT count(price) FROM z) - (SELECT count(price) FROM typed) AS type_coercions
"""


def step(position: int, name: str, source: str) -> str:
    return (
        f"SELECT CAST({position} AS INTEGER) AS position, '{name}' AS step, "
        f"count(*) AS rows FROM {source}"
    )


STEPS = f"""
{FULL_CTES}
{union(
    step(0, "input", "b"),
    step(1, "drop_empty_rows", "b"),
    step(2, "handle_invalid_zeros", "z"),
    step(3, "clean_numeric", "typed"),
    step(4, "remove_duplicates", "d"),
    step(5, "handle_missing", "f"),
    step(6, "outliers", "c"),
    step(7, "standardize_text", "c"),
)}
"""


def ordered_fill(direction: str) -> str:
    value = "CASE WHEN event_id % 3 <> 0 THEN value END"
    kind = "CASE WHEN event_id % 50 = 7 THEN event_type END"
    frame = (
        f"(ORDER BY ts {direction}, event_id {direction} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return f"""
WITH e AS (SELECT event_id, ts, {value} AS value, {kind} AS event_type FROM events)
SELECT event_id, ts, last_value(value IGNORE NULLS) OVER {frame} AS value,
  last_value(event_type IGNORE NULLS) OVER {frame} AS event_type
FROM e
"""


GROUP_SQL = {
    "mean": "avg({c})",
    "min": "min({c})",
    "max": "max({c})",
    "sum": "coalesce(sum({c}), 0)",
    "count": "count({c})",
    "size": "count(*)",
    "nunique": "count(DISTINCT {c})",
    "std": "stddev_samp({c})",
    "var": "var_samp({c})",
    "sem": "stddev_samp({c}) / sqrt(count({c}))",
    "median": "quantile_cont({c}, 0.5)",
    "quantile": "quantile_cont({c}, 0.5)",
    "any": "coalesce(bool_or({c} <> 0), false)",
    "all": "coalesce(bool_and({c} <> 0), true)",
    "skew": "skewness({c})",
}
WHOLE = ("count", "size", "nunique", "any", "all")


def supplier_feature(name: str, column: str) -> str:
    feature = f"by_supplier_{name}"
    value = f"g.{feature}" if name in WHOLE else f"round(g.{feature}, 6) AS {feature}"
    return f"""
SELECT l.l_orderkey, l.l_suppkey, round(l.{column}, 6) AS {column}, {value}
FROM lineitem l LEFT JOIN (SELECT l_suppkey, {GROUP_SQL[name].format(c=column)} AS {feature}
  FROM lineitem GROUP BY l_suppkey) g ON l.l_suppkey = g.l_suppkey
"""


def customer_feature(name: str) -> str:
    pick = {"first": "arg_min", "last": "arg_max"}[name]
    return f"""
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, g.v AS order_price_{name}
FROM orders o LEFT JOIN (SELECT o_custkey, {pick}(o_totalprice, o_orderkey) AS v
  FROM orders GROUP BY o_custkey) g ON o.o_custkey = g.o_custkey
"""


def scaled(center: str, spread: str) -> str:
    def one(c: str) -> str:
        return (
            f"round((l.{c} - (SELECT {center.format(c=c)} FROM lineitem)) / "
            f"(SELECT {spread.format(c=c)} FROM lineitem), 6) AS {c}"
        )

    columns = ", ".join(one(c) for c in ("l_quantity", "l_extendedprice", "l_linenumber"))
    return f"SELECT * REPLACE ({columns}) FROM lineitem l"


def describe_row(column: str, source: str) -> str:
    return f"""
SELECT '{column}' AS "column", count({column}) AS count, round(avg({column}), 6) AS mean,
  round(stddev_samp({column}), 6) AS std, round(CAST(min({column}) AS DOUBLE), 6) AS min,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.25), 6) AS p25,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.5), 6) AS p50,
  round(quantile_cont(CAST({column} AS DOUBLE), 0.75), 6) AS p75,
  round(CAST(max({column}) AS DOUBLE), 6) AS max
FROM {source}
"""


def info_row(column: str, kind: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS non_null, '{kind}' AS type "
        f"FROM {source}"
    )


def detect_row(column: str, value: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count(*) AS total_rows, count({value}) AS numeric_rows,"
        f" count({value}) > 0.5 * count(*) AS is_numeric FROM b"
    )


def date_columns(name: str) -> str:
    return f"""CAST(year({name}) AS INTEGER) AS {name}_year,
  CAST(month({name}) AS INTEGER) AS {name}_month, CAST(day({name}) AS INTEGER) AS {name}_day,
  CAST(isodow({name}) - 1 AS INTEGER) AS {name}_dayofweek"""


LINE_NUMBERS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
D = f"({DIRTY})"
SUITE_SOURCE = "d"


def z_score(select: str) -> str:
    return (
        f"WITH d AS {D}, s AS (SELECT avg(price) AS m, stddev_samp(price) AS sd FROM d) {select}"
    )


ORACLES: dict[str, str] = {
    "clean_orders": CLEAN,
    "clean_check_prepare": FULL,
    "run_validation_report": RUN_VALIDATION,
    "summary_report": SUMMARY,
    "step_report": STEPS,
    "blank_to_null": BLANK_FREE,
    "drop_all_null_rows": f"SELECT cust_txt, price, priority FROM ({BLANK_FREE}) "
    "WHERE NOT (cust_txt IS NULL AND price IS NULL AND priority IS NULL)",
    "trim_text": f"SELECT row_ord, trim(priority) AS priority FROM {D}",
    "std_text": f"SELECT * REPLACE (lower(trim(priority)) AS priority, "
    f"lower(trim(status)) AS status) FROM {D}",
    "numeric_detect": f"WITH b AS ({BLANK_FREE}) "
    + union(
        detect_row("row_ord", "row_ord"),
        detect_row("order_id", "order_id"),
        detect_row("cust_txt", number("cust_txt")),
        detect_row("price", "price"),
        detect_row("priority", number("priority")),
        detect_row("status", number("status")),
    ),
    "numeric_coerce": f"SELECT row_ord, {number('cust_txt')} AS cust_txt FROM {D}",
    "null_negatives": f"SELECT row_ord, CASE WHEN price < 0 THEN NULL ELSE price END AS price "
    f"FROM {D}",
    "coercion_report": f"""
WITH b AS ({BLANK_FREE})
SELECT 'cust_txt' AS "column", count(cust_txt) - count({number("cust_txt")}) AS coerced,
  CAST(0 AS BIGINT) AS negatives_nulled FROM b
UNION ALL
SELECT 'price', CAST(0 AS BIGINT), count(*) FILTER (price < 0) FROM b
""",
    "dedup_first": dedup("", f"({TRIMMED})"),
    "dedup_last": dedup("DESC", f"({TRIMMED})"),
    "dedup_none": f"SELECT {COLUMNS} FROM (SELECT *, count(*) OVER "
    f"(PARTITION BY {DEDUP_KEYS}) AS n FROM ({TRIMMED})) WHERE n = 1",
    "dedup_whole_rows": f"SELECT DISTINCT order_id, {DEDUP_KEYS} FROM ({TRIMMED})",
    "dedup_documents": "SELECT doc_id, trim(text) AS text, lang, source, n_chars FROM (SELECT *, "
    "row_number() OVER (PARTITION BY trim(text) ORDER BY doc_id) AS rn FROM documents) "
    "WHERE rn = 1",
    "dedup_file_order": "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER "
    "(PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1",
    "zeros_flag": price_only(
        "round(nullif(price, 0), 6)", flag=", coalesce(price <> 0, true) AS is_valid_price"
    ),
    "zeros_drop": price_only("round(price, 6)", where="WHERE price IS NULL OR price <> 0"),
    "zeros_null": price_only("round(nullif(price, 0), 6)"),
    "zeros_group_mean": price_only(
        "round(CASE WHEN price = 0 THEN coalesce(CASE WHEN priority IS NOT NULL THEN "
        "avg(nullif(price, 0)) OVER (PARTITION BY priority) END, "
        "(SELECT avg(price) FROM b WHERE price <> 0)) ELSE price END, 6)"
    ),
    "zeros_overall_mean": price_only(
        "round(CASE WHEN price = 0 THEN (SELECT avg(price) FROM b WHERE price <> 0) "
        "ELSE price END, 6)"
    ),
    "zeros_median": price_only(
        "round(CASE WHEN price = 0 THEN (SELECT median(price) FROM b WHERE price <> 0) "
        "ELSE price END, 6)"
    ),
    "zeros_mode": "WITH g AS (SELECT o_orderkey, CAST(o_custkey % 5 AS DOUBLE) AS grade "
    "FROM orders), n AS (SELECT nullif(grade, 0) AS grade FROM g) SELECT o_orderkey, "
    f"CASE WHEN grade = 0 THEN {mode_of('grade', 'n')} ELSE grade END AS grade FROM g",
    "missing_drop": f"SELECT * FROM ({BLANK_FREE}) "
    "WHERE cust_txt IS NOT NULL AND price IS NOT NULL AND priority IS NOT NULL",
    "fill_const_num": f"SELECT * REPLACE (coalesce({number('cust_txt')}, -1.0) AS cust_txt, "
    f"coalesce(price, -1.0) AS price) FROM ({BLANK_FREE})",
    "fill_const_text": f"WITH b AS ({BLANK_FREE}) SELECT * REPLACE "
    "(coalesce(priority, 'none given') AS priority, "
    "round(coalesce(price, (SELECT median(price) FROM b)), 6) AS price) FROM b",
    "fill_median": f"""
WITH b AS ({BLANK_FREE}), n AS (SELECT * REPLACE ({number("cust_txt")} AS cust_txt) FROM b)
SELECT * REPLACE (
  round(coalesce(cust_txt, (SELECT median(cust_txt) FROM n)), 6) AS cust_txt,
  round(coalesce(price, (SELECT median(price) FROM n)), 6) AS price) FROM n
""",
    "fill_mode": f"WITH b AS ({BLANK_FREE}) SELECT * REPLACE "
    f"(coalesce(priority, {mode_of('priority', 'b')}) AS priority) FROM b",
    "ffill_events": ordered_fill("ASC"),
    "bfill_events": ordered_fill("DESC"),
    "outlier_iqr_cap": f"""
WITH d AS (SELECT row_ord, price FROM {D}), q AS ({iqr("price", "d", "1.5")})
SELECT row_ord, round(CASE WHEN price < (SELECT lo FROM q) THEN (SELECT lo FROM q)
  WHEN price > (SELECT hi FROM q) THEN (SELECT hi FROM q) ELSE price END, 6) AS price FROM d
""",
    "outlier_iqr_drop": f"""
WITH q1 AS ({iqr("l_extendedprice", "lineitem", "0.2")}),
l1 AS (SELECT * FROM lineitem WHERE l_extendedprice IS NULL OR
  l_extendedprice BETWEEN (SELECT lo FROM q1) AND (SELECT hi FROM q1)),
q2 AS ({iqr("l_quantity", "l1", "0.2")})
SELECT * FROM l1 WHERE l_quantity IS NULL OR
  l_quantity BETWEEN (SELECT lo FROM q2) AND (SELECT hi FROM q2)
""",
    "outlier_iqr_drop_simultaneous": f"""
WITH q1 AS ({iqr("l_extendedprice", "lineitem", "0.2")}), q2 AS ({iqr("l_quantity", "lineitem", "0.2")})
SELECT * FROM lineitem WHERE (l_extendedprice IS NULL OR
  l_extendedprice BETWEEN (SELECT lo FROM q1) AND (SELECT hi FROM q1)) AND (l_quantity IS NULL OR
  l_quantity BETWEEN (SELECT lo FROM q2) AND (SELECT hi FROM q2))
""",
    "outlier_iqr_drop_dirty": f"""
WITH d AS (SELECT row_ord, price, cust_txt, {number("cust_txt")} AS cust FROM {D}),
q1 AS ({iqr("price", "d", "0.5")}),
d1 AS (SELECT * FROM d WHERE price IS NULL OR
  price BETWEEN (SELECT lo FROM q1) AND (SELECT hi FROM q1)),
q2 AS ({iqr("cust", "d1", "0.5")})
SELECT row_ord, price, cust_txt FROM d1 WHERE cust IS NULL OR
  cust BETWEEN (SELECT lo FROM q2) AND (SELECT hi FROM q2)
""",
    "outlier_z_cap": z_score(
        "SELECT row_ord, round(CASE WHEN abs((price - m) / sd) >= 3 AND price < m THEN m - 3 * sd "
        "WHEN abs((price - m) / sd) >= 3 AND price > m THEN m + 3 * sd ELSE price END, 6) "
        "AS price FROM d, s"
    ),
    "outlier_z_drop": z_score(
        "SELECT row_ord, price FROM d, s WHERE price IS NULL OR abs((price - m) / sd) < 3"
    ),
    **dict.fromkeys(
        ["outlier_z_drop_infinite", "outlier_z_cap_infinite"],
        "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN CAST('inf' AS DOUBLE) "
        "ELSE o_totalprice END AS price FROM orders",
    ),
    "outlier_iqr_drop_infinite": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 "
    "THEN CAST('inf' AS DOUBLE) ELSE o_totalprice END AS price FROM orders",
    "outlier_auto_cap": "SELECT * REPLACE ("
    + cap_all(["p_partkey", "p_size", "p_retailprice"], "part", "0.4")
    + ") FROM part",
    "select_keep": "SELECT c_name, c_custkey, c_acctbal FROM customer",
    "select_drop": "SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer",
    "scale_standard": scaled("avg({c})", "stddev_pop({c})"),
    "scale_minmax": scaled("min({c})", "max({c}) - min({c})"),
    "label_encode": f"WITH b AS ({BLANK_FREE}) SELECT row_ord, "
    "dense_rank() OVER (ORDER BY coalesce(priority, 'nan')) - 1 AS priority, "
    "dense_rank() OVER (ORDER BY coalesce(cust_txt, 'nan')) - 1 AS cust_txt FROM b",
    "onehot": "SELECT * EXCLUDE (c_mktsegment), "
    + ", ".join(f"coalesce(c_mktsegment = '{s}', false) AS c_mktsegment_{s}" for s in SEGMENTS)
    + " FROM customer",
    "date_parts": f"SELECT row_ord, order_ts, {date_columns('order_ts')} FROM {D}",
    "date_parse": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN NULL "
    "ELSE o_orderdate END AS ordered_on FROM orders) "
    f"SELECT o_orderkey, ordered_on, {date_columns('ordered_on')} FROM t",
    "date_parse_us": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 <> 0 THEN "
    "date_trunc('day', o_orderdate)::timestamp END AS us FROM orders) "
    f"SELECT o_orderkey, us, {date_columns('us')} FROM t",
    "date_parse_month_name": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 <> 0 THEN "
    "date_trunc('day', o_orderdate)::timestamp END AS spelt FROM orders) "
    f"SELECT o_orderkey, spelt, {date_columns('spelt')} FROM t",
    "date_all_or_nothing": "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 29 = 0 THEN 'not a date' "
    "ELSE strftime(o_orderdate, '%m/%d/%Y') END AS us, "
    "date_trunc('minute', o_orderdate)::timestamp AS dotted FROM orders) "
    f"SELECT o_orderkey, us, dotted, {date_columns('dotted')} FROM t",
    "feature_skipped": "SELECT l_orderkey, l_suppkey, l_quantity, CAST(l_linenumber AS VARCHAR) AS l_shipmode, "
    "max(l_quantity) OVER (PARTITION BY l_suppkey) AS kept_max FROM lineitem",
    "check_fail_fast": f"SELECT 'price' AS \"column\", CASE WHEN count(*) FILTER (price IS NULL) > 0 THEN 'raised' "
    f"ELSE 'passed' END AS outcome FROM {D} UNION ALL SELECT 'row_ord', CASE WHEN count(*) FILTER (row_ord IS NULL) > 0 "
    f"THEN 'raised' ELSE 'passed' END FROM {D}",
    "csv_row_order": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "json_row_order": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey",
    "csv_swapped_headers": "SELECT o_orderkey, o_custkey FROM orders",
    "date_lost_cells": "SELECT 'us' AS \"column\", 'M/d/yyyy[ H:mm[:ss]]' AS form, count(*) AS cells, "
    "count(*) FILTER (o_orderkey % 29 = 0) AS lost FROM orders "
    "UNION ALL SELECT 'spelt', 'MMMM d, yyyy', "
    "count(*) FILTER (o_orderkey % 29 <> 0), 0 FROM orders "
    "UNION ALL SELECT 'dotted', 'd.M.yyyy[ H:mm[:ss]]', count(*), 0 FROM orders",
    "agg_feature_prod": "SELECT l.l_orderkey, l.l_suppkey, round(g.p, 6) AS log_product "
    "FROM lineitem l LEFT JOIN (SELECT l_suppkey, ln(product(1 + l_tax)) AS p FROM lineitem "
    "GROUP BY l_suppkey) g ON l.l_suppkey = g.l_suppkey",
    "agg_feature_first": customer_feature("first"),
    "agg_feature_last": customer_feature("last"),
    "agg_feature_null_keys": f"""
WITH b AS ({BLANK_FREE}),
g AS (SELECT priority, avg(price) AS m, count(price) AS n FROM b
  WHERE priority IS NOT NULL GROUP BY priority),
j AS (SELECT row_ord, b.priority, status, price, m, n FROM b
  LEFT JOIN g ON b.priority = g.priority),
h AS (SELECT status, max(m) AS top FROM j GROUP BY status)
SELECT row_ord, priority, j.status, round(price, 6) AS price, round(m, 6) AS price_mean,
  n AS price_of_count, round(top, 6) AS level_max
FROM j LEFT JOIN h ON j.status = h.status
""",
    "check_types": union(
        report_row("data_types", "row_ord", "int64", "'bigint'", "NULL", "'passed'", "'passed'"),
        report_row(
            "data_types", "order_id", "string", "'bigint'", "NULL", "'failed'",
            "'validation failed'",
        ),
        report_row(
            "data_types", "cust_txt", "int", "'string'", "NULL", "'failed'",
            "CASE WHEN ok THEN 'can be coerced to numeric' ELSE 'validation failed' END",
        )
        + f" FROM (SELECT count({number('cust_txt')}) > 0.8 * count(*) AS ok FROM {D})",
        report_row("data_types", "price", "float64", "'double'", "NULL", "'passed'", "'passed'"),
        report_row("data_types", "priority", "object", "'string'", "NULL", "'passed'", "'passed'"),
        report_row(
            "data_types", "status", "bool", "'string'", "NULL", "'failed'",
            "'can be coerced to bool'",
        ),
        report_row(
            "data_types", "order_ts", "datetime64[ns]", "'timestamp_ntz'", "NULL", "'passed'",
            "'passed'",
        ),
        report_row(
            "data_types", "weight", "float", "'MISSING'", "NULL", "'failed'",
            "'validation failed'",
        ),
    ),
    "check_ranges": union(
        count_row("value_ranges", "price", "min 0", "count(*) FILTER (price < 0)", D),
        count_row("value_ranges", "price", "max 400000", "count(*) FILTER (price > 400000)", D),
        count_row("value_ranges", "order_id", "min 0", "count(*) FILTER (order_id < 0)", D),
        missing_row("value_ranges", "weight"),
    ),
    "check_ranges_mistyped": union(
        report_row(
            "value_ranges", "price", "min low", "'double'", "NULL", "'failed'", "'validation failed'"
        ),
        count_row("value_ranges", "price", "max 400000", "count(*) FILTER (price > 400000)", D),
        report_row(
            "value_ranges", "priority", "max 3", "'string'", "NULL", "'failed'", "'validation failed'"
        ),
    ),
    "check_nulls": union(
        *[
            count_row("not_null", c, "no nulls", f"count(*) FILTER ({c} IS NULL)", D)
            for c in ("order_id", "cust_txt", "price", "priority", "order_ts")
        ],
        missing_row("not_null", "weight"),
    ),
    "check_uniqueness": union(
        *[
            count_row(
                "unique",
                c,
                "unique",
                f"count(*) - count(DISTINCT {c}) - max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)",
                D,
            )
            for c in ("row_ord", "order_id", "cust_txt", "price")
        ]
    ),
    "check_own_rules": union(
        count_row(
            "custom", "price is not negative", "true", "count(*) FILTER (NOT price >= 0)", D
        ),
        count_row("custom", "not pending", "true", "count(*) FILTER (status = 'P')", D),
        report_row("custom", "has prices", "true", "'true'", "NULL", "'passed'", "'passed'"),
        report_row("custom", "has weights", "true", "'false'", "NULL", "'failed'", "'failed'"),
        report_row(
            "custom", "broken", "true", "NULL", "NULL", "'failed'", "'function is not callable'"
        ),
    ),
    "check_rules_broken": union(
        count_row(
            "custom", "price is not negative", "true", "count(*) FILTER (NOT price >= 0)", D
        ),
        report_row(
            "custom", "customer is a number", "true", "NULL", "NULL", "'failed'",
            "'raised NumberFormatException: CAST_INVALID_INPUT'",
        ),
        count_row(
            "custom", "known status", "true", "count(*) FILTER (status NOT IN ('F', 'O', 'P'))", D
        ),
        count_row("custom", "not pending", "true", "count(*) FILTER (status = 'P')", D),
        report_row(
            "custom", "odd share", "true", "NULL", "NULL", "'failed'",
            "'raised ArithmeticException: DIVIDE_BY_ZERO'",
        ),
    ),
    "strict_or_lenient": f"SELECT 'strict' AS mode, CASE WHEN n > 0 THEN 'raised' ELSE 'passed' END AS outcome, "
    f"CASE WHEN n = 0 THEN total END AS rows FROM (SELECT count(*) FILTER (price IS NULL) AS n, count(*) AS total FROM {D}) "
    f"UNION ALL SELECT 'lenient', CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END, total "
    f"FROM (SELECT count(*) FILTER (price IS NULL) AS n, count(*) AS total FROM {D})",
    "check_suite": union(
        count_row("value_ranges", "price", "min 0", "count(*) FILTER (price < 0)", D),
        count_row("value_ranges", "price", "max 400000", "count(*) FILTER (price > 400000)", D),
        count_row("not_null", "price", "no nulls", "count(*) FILTER (price IS NULL)", D),
        count_row("not_null", "status", "no nulls", "count(*) FILTER (status IS NULL)", D),
        count_row("unique", "order_id", "unique", "count(*) - count(DISTINCT order_id)", D),
        count_row("custom", "known status", "true", "count(*) FILTER (status = 'P')", D),
    ),
    "profile_quality": f"""
WITH d AS (SELECT order_id, {DEDUP_KEYS} FROM {D})
SELECT (SELECT count(*) FROM d) AS rows, CAST(6 AS BIGINT) AS columns,
  {nulls("d", "order_id, " + DEDUP_KEYS)} AS missing_cells,
  CAST(2 AS BIGINT) AS numeric_columns, CAST(3 AS BIGINT) AS text_columns,
  (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))
    AS duplicate_rows
""",
    "profile_describe": union(*[describe_row(c, "lineitem") for c in LINE_NUMBERS]),
    "profile_describe_dirty": describe_row("price", D),
    "profile_info": union(
        info_row("row_ord", "bigint", D),
        info_row("order_id", "bigint", D),
        info_row("cust_txt", "string", D),
        info_row("price", "double", D),
        info_row("priority", "string", D),
        info_row("status", "string", D),
        info_row("order_ts", "timestamp_ntz", D),
    ),
    "preview_orders": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "orders_metadata": "SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, "
    "['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', "
    "'o_orderpriority'] AS column_names FROM orders",
    "csv_round_trip": BLANK_FREE,
    "json_round_trip": BLANK_FREE,
    "parquet_round_trip": BLANK_FREE,
    "csv_typing": union(
        info_row("c_custkey", "bigint", "customer"),
        info_row("c_name", "string", "customer"),
        info_row("c_nationkey", "bigint", "customer"),
        info_row("c_acctbal", "double", "customer"),
        info_row("c_mktsegment", "string", "customer"),
    ),
}
for _name, _column in SUPPLIER_AGGREGATES.items():
    ORACLES[f"agg_feature_{_name}"] = supplier_feature(_name, _column)
