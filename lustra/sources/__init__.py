"""Reading and writing tables."""

from lustra.sources.readers import (
    ROW_ORDER,
    infer_column_types,
    path_format,
    read_csv,
    read_json,
    read_parquet,
    read_table,
    with_row_order,
)
from lustra.sources.writers import dataset_metadata, write_table

__all__ = [
    "ROW_ORDER",
    "dataset_metadata",
    "infer_column_types",
    "path_format",
    "read_csv",
    "read_json",
    "read_parquet",
    "read_table",
    "with_row_order",
    "write_table",
]
