"""Readers for CSV, JSON and Parquet, with the file order of the rows on request."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.functions.numbers import parse_number
from lustra.functions.text import quoted, trim_text
from lustra.operators.cleaning import replace_columns
from lustra.operators.lookup import BROADCAST_BYTES, ROW_OVERHEAD_BYTES

FORMATS = ("csv", "json", "parquet")

# CSV cells that mean "no value", next to cells of nothing but whitespace.
NULL_TOKENS = (
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
INTEGER_PATTERN = r"^[+-]?\d+$"

# The two bookkeeping columns of the file order: position of the block, row inside it.
ROW_ORDER = ("_block_position", "_row_position")
POSITION_BITS = 63
# Holds the text of CSV rows whose number of cells is not that of the header.
BROKEN = "_broken_row"
# A cell that no file holds.
EXTRA_CELL = "\x01one more\x02"


def path_format(path: str) -> str:
    """Format from the lower-case suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {suffix!r}, expected one of {FORMATS}")
    return suffix


def read_table(
    spark: SparkSession, path: str, fmt: str | None = None, row_order: bool = False
) -> DataFrame:
    """Read a file or a folder of part files; the suffix decides unless ``fmt`` does."""
    fmt = fmt or path_format(path)
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format: {fmt!r}, expected one of {FORMATS}")
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    try:
        return readers[fmt](spark, path, row_order=row_order)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"input not found: {path}") from error
        raise


def read_parquet(spark: SparkSession, path: str, row_order: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return with_row_order(df, "parquet") if row_order else df


def read_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    row_order: bool = False,
) -> DataFrame:
    """Read CSV with a header: null tokens to null, then typed columns.

    Files of a folder may have their columns in different order; they are read by name. One
    pass over the raw lines finds each file's header and whether some record spans lines, in
    which case this file alone is read unsplit. With ``multi_line`` given there is no such
    pass, and files whose headers differ are an error. Rows with more cells than the header
    are an error, shorter rows end in nulls. Empty files have no rows.
    """
    groups = [(None, multi_line, [path])] if multi_line is not None else _alike_files(spark, path)
    parts = []
    for _, unsplit, paths in groups:
        reader = (
            spark.read.option("header", True)
            .option("multiLine", unsplit)
            .option("quote", '"')
            .option("escape", '"')
            .option("nullValue", "")
            .option("enforceSchema", multi_line is None)
        )
        names = reader.csv(paths).columns
        whole = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BROKEN]])
        reader = reader.option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", False)
        parts.append(reader.schema(whole).csv(paths))
    if row_order:
        files = [f for raw in parts for f in raw.inputFiles()]
        parts = [with_row_order(raw, "csv", files) for raw in parts]
    raw = reduce(DataFrame.unionByName, parts)
    names = [c for c in parts[0].columns if c != BROKEN and c not in ROW_ORDER]
    blanked = {c: _null_tokens_to_null(c) for c in names}
    return infer_column_types(replace_columns(raw, blanked), names, _is_overlong(len(names))).drop(BROKEN)


def _is_overlong(columns: int) -> Column:
    """Whether a row that has not as many cells as the header has more of them.

    The parser itself tells: one more cell is appended to the row, and only in a row that is too short does it end up in a
    column. Quotes inside a cell and empty cells at the end are then read as anywhere else.
    """
    schema = ", ".join(f"c{i} string" for i in range(columns))
    longer = F.concat(F.col(BROKEN), F.lit("," + EXTRA_CELL))
    cells = F.from_csv(longer, schema, {"quote": '"', "escape": '"'})
    found = [F.coalesce(cells[f"c{i}"] == EXTRA_CELL, F.lit(False)) for i in range(columns)]
    return F.col(BROKEN).isNotNull() & ~F.greatest(*found, F.lit(False))


def _alike_files(spark: SparkSession, path: str) -> list[tuple[str | None, bool, list[str]]]:
    """Header, whether some line holds an odd number of quotes, and the files, per kind of file."""
    lines = spark.read.text(path).filter(trim_text("value") != "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # A file's first line is the first row of its first block.
    first = F.when(
        F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()
    )
    files = (
        lines.select(F.col("_metadata.file_path").alias("file"), first.alias("at"), "value", quotes.alias("q"))
        .groupBy("file")
        .agg(F.min_by("value", "at").alias("header"), F.max(F.col("q") % 2).alias("open"))
    )
    kinds = files.groupBy("header", "open").agg(F.sort_array(F.collect_list("file")).alias("files"))
    found = kinds.orderBy("header", "open").collect()
    if len(found) < 2:
        return [(None, bool(found and found[0]["open"]), [path])]
    return [(row["header"], bool(row["open"]), [unquote(f) for f in row["files"]]) for row in found]


def _null_tokens_to_null(name: str):
    cell = quoted(name)
    no_value = (trim_text(name) == "") | cell.isin(*NULL_TOKENS)
    return F.when(~no_value, cell)


def infer_column_types(
    df: DataFrame, columns: Sequence[str] | None = None, overlong: Column | None = None
) -> DataFrame:
    """Type the text columns of a CSV: one aggregate, then one projection.

    Rows for which ``overlong`` is true are an error; they are counted in the same aggregate.

    A column is numeric only if every cell that has a value reads as a number, and integer
    if all of these are whole. A column of true and false without gaps is boolean. A column
    without any value is numeric. Everything else, dates included, stays text.
    """
    names = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in set(columns))
    ]
    if not names:
        return df
    counts = [F.count(F.lit(1)).alias("rows")]
    if overlong is not None:
        counts.append(F.count_if(overlong).alias("overlong"))
    for i, c in enumerate(names):
        text = trim_text(c)
        whole = F.when(text.rlike(INTEGER_PATTERN), text.try_cast("bigint"))
        counts += [
            F.count(quoted(c)).alias(f"cells{i}"),
            F.count(parse_number(c)).alias(f"numbers{i}"),
            F.count(whole).alias(f"whole{i}"),
            F.count_if(quoted(c).isin(*TRUE_TOKENS, *FALSE_TOKENS)).alias(f"flags{i}"),
        ]
    seen = df.agg(*counts).first()
    if overlong is not None and seen["overlong"]:
        raise ValueError(f"{seen['overlong']} rows have more cells than the header")
    typed = {}
    for i, c in enumerate(names):
        cells = seen[f"cells{i}"]
        if cells and seen[f"whole{i}"] == cells:
            typed[c] = trim_text(c).try_cast("bigint")
        elif seen[f"numbers{i}"] == cells:
            typed[c] = parse_number(c)
        elif cells == seen["rows"] and seen[f"flags{i}"] == cells:
            typed[c] = quoted(c).isin(*TRUE_TOKENS)
    return replace_columns(df, typed)


def read_json(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    row_order: bool = False,
) -> DataFrame:
    """Read records: JSON Lines, or files that hold one array of records.

    The first character of the input tells the two apart unless ``multi_line`` does.
    Strings stay strings. Columns come in the order in which they appear; those that the first
    record of an array lacks come last, by name. Malformed input is an error.
    """
    if multi_line is None:
        content = spark.read.text(path).select(F.ltrim("value").alias("value"))
        first = content.filter("value != ''").first()
        multi_line = first is not None and not (
            first["value"].startswith("{") and first["value"].rstrip().endswith("}")
        )
    df = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    found = [c for c in _json_keys(spark, path, multi_line) if c in df.columns]
    df = df.select(*[quoted(c) for c in found], *[quoted(c) for c in df.columns if c not in set(found)])
    return with_row_order(df, "json") if row_order else df


def _json_keys(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    """Names of the fields in order of their first appearance, in one pass over the lines."""
    if multi_line:
        pages = spark.read.text(path, wholetext=True)
        record = F.coalesce(F.get_json_object("value", "$[0]"), "value")
        first = pages.select(F.json_object_keys(record).alias("keys")).filter("keys is not null").first()
        return first["keys"] if first else []
    at = F.monotonically_increasing_id().cast("decimal(20,0)").alias("at")
    keys = spark.read.text(path).select(at, F.json_object_keys("value").alias("keys"))
    placed = keys.select("at", F.posexplode("keys").alias("pos", "key"))
    # A sum of line and place, so that a hash aggregate can hold it.
    place = F.col("at") * F.lit(1_000_000).cast("decimal(7,0)") + F.col("pos")
    first = placed.groupBy("key").agg(F.min(place).alias("place"))
    return [row["key"] for row in first.orderBy("place").collect()]


def with_row_order(df: DataFrame, fmt: str, files: Sequence[str] | None = None) -> DataFrame:
    """Add the file order of the rows as two columns, taken directly at the scan.

    Files count in name order; ``files`` names them all if ``df`` reads a part of them. Within a file the first column follows the split and the
    second the row: the row index in Parquet, the reading order in text formats. Both are
    fixed by the files, so they are the same when a task runs again.
    """
    spark = df.sparkSession
    files = sorted(_plain_path(p) for p in (files or df.inputFiles()))
    # The file number takes the upper bits it needs; the lower ones hold the place in the file.
    shift = POSITION_BITS - len(files).bit_length()
    numbered = spark.createDataFrame(
        list(zip(files, range(len(files)), strict=True)), "_file string, _file_number bigint"
    )
    block, row = ROW_ORDER
    if fmt == "parquet":
        start, position = F.lit(0).cast("bigint"), F.col("_metadata.row_index")
    else:
        start, position = F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    placed = df.select(
        "*",
        F.regexp_replace("_metadata.file_path", r"^(\w+):/+", "$1:/").alias("_file"),
        start.alias(block),
        position.alias(row),
    )
    unknown = F.raise_error(F.concat(F.lit("file not listed: "), F.col("_file"))).cast("bigint")
    number = F.coalesce(F.col("_file_number"), unknown)
    too_far = F.raise_error(F.concat(F.lit("file too long to be numbered: "), F.col("_file")))
    start = F.when(F.col(block) < (1 << shift), F.col(block)).otherwise(too_far.cast("bigint"))
    # One row per file, a list the driver already holds to plan the scan; its size is known from there.
    if sum(len(f) + ROW_OVERHEAD_BYTES for f in files) <= BROADCAST_BYTES:
        numbered = F.broadcast(numbered)
    return (
        placed.join(numbered, "_file", "left")
        .withColumn(block, F.shiftleft(number, shift) + start)
        .select(*[quoted(c) for c in df.columns], block, row)
    )


def _plain_path(path: str) -> str:
    scheme, _, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}"
