"""Apply fitted models to rows as they arrive.

Fits need whole tables and stay in batch jobs. A fitted transform that works row by row
(numeric cleaning, constant fills, caps, scaling, one-hot columns, lookups) also accepts a
streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lustra.operators.cleaning import blanks_to_null, drop_blank_rows
from lustra.session import new_scratch_path


def apply_models(stream: DataFrame, models: Sequence[Any]) -> DataFrame:
    """Blank handling, then each model's transform."""
    cleaned = blanks_to_null(drop_blank_rows(stream))
    for model in models:
        cleaned = model.transform(cleaned)
    return cleaned


def write_stream(
    stream: DataFrame, path: str, checkpoint: str | None = None, fmt: str = "parquet"
) -> StreamingQuery:
    """Append to ``path`` what has arrived, then stop.

    Give a lasting ``checkpoint`` folder to continue from it with the next call.
    """
    location = checkpoint or new_scratch_path(stream.sparkSession, "stream")
    return (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", location)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
