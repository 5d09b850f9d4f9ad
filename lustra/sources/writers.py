"""Writers for CSV, JSON Lines and Parquet folders, and the metadata record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lustra.sources.readers import FORMATS, path_format


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "errorifexists",
    metadata: bool = False,
) -> None:
    """Write a folder of part files; the suffix decides unless ``fmt`` does.

    With ``metadata`` the record of :func:`dataset_metadata` is written next to the data,
    in ``<path>.metadata``.
    """
    fmt = fmt or path_format(path)
    if fmt not in FORMATS:
        raise ValueError(f"unsupported file format: {fmt!r}, expected one of {FORMATS}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        # A blank cell stands for null, so an empty text must be quoted to differ from it.
        writer.option("header", True).option("nullValue", "").option("emptyValue", '""').option(
            "escape", '"'
        ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(
            path
        )
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    if metadata:
        written = df.sparkSession.read.schema(df.schema).format(fmt)
        if fmt == "csv":
            written = written.option("header", True).option("multiLine", True).option("escape", '"')
        dataset_metadata(written.load(path)).write.mode(mode).json(
            path.rstrip("/") + ".metadata"
        )


def dataset_metadata(df: DataFrame) -> DataFrame:
    """One row: number of rows, number of columns, column names in order."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
    )
