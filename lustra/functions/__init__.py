"""Column expressions and schema rules shared by the operators."""

from lustra.functions.columns import (
    id_columns,
    numeric_columns,
    rejects_negatives,
    text_columns,
)
from lustra.functions.numbers import as_number, parse_number, quiet_nan
from lustra.functions.text import finish_trim, standardize, trim_text

__all__ = [
    "as_number",
    "finish_trim",
    "id_columns",
    "numeric_columns",
    "parse_number",
    "quiet_nan",
    "rejects_negatives",
    "standardize",
    "text_columns",
    "trim_text",
]
