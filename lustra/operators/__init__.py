"""The operators. Map operators take a table and return a table; fitted ones return a model."""

from lustra.operators.checks import (
    ValidationError,
    check_custom,
    check_data_types,
    check_not_null,
    check_unique,
    check_value_ranges,
    raise_on_failure,
    validate,
)
from lustra.operators.cleaning import (
    blanks_to_null,
    clean_numeric_columns,
    drop_blank_rows,
    drop_empty_rows,
    fit_numeric_cleaner,
    numeric_detection,
    standardize_text,
    trim_columns,
)
from lustra.operators.dates import datetime_features, fit_dates
from lustra.operators.dedup import duplicate_key, remove_duplicates
from lustra.operators.encoding import encode_categorical, fit_labels, fit_onehot
from lustra.operators.features import aggregate_features, fit_group_features, select_features
from lustra.operators.missing import drop_missing, fit_fill, handle_missing_values
from lustra.operators.ordered_fill import backward_fill, fit_ordered_fill, forward_fill
from lustra.operators.outliers import fit_outliers, remove_outliers
from lustra.operators.profile import (
    column_info,
    describe,
    duplicate_rows,
    preview,
    quality_profile,
)
from lustra.operators.quantiles import column_quantiles, group_quantiles
from lustra.operators.scaling import fit_scaler, normalize
from lustra.operators.zeros import fit_invalid_zeros, handle_invalid_zeros

__all__ = [
    "ValidationError",
    "aggregate_features",
    "backward_fill",
    "blanks_to_null",
    "check_custom",
    "check_data_types",
    "check_not_null",
    "check_unique",
    "check_value_ranges",
    "clean_numeric_columns",
    "column_info",
    "column_quantiles",
    "datetime_features",
    "describe",
    "drop_blank_rows",
    "drop_empty_rows",
    "drop_missing",
    "duplicate_key",
    "duplicate_rows",
    "encode_categorical",
    "fit_dates",
    "fit_fill",
    "fit_group_features",
    "fit_invalid_zeros",
    "fit_labels",
    "fit_numeric_cleaner",
    "fit_onehot",
    "fit_ordered_fill",
    "fit_outliers",
    "fit_scaler",
    "forward_fill",
    "group_quantiles",
    "handle_invalid_zeros",
    "handle_missing_values",
    "normalize",
    "numeric_detection",
    "preview",
    "quality_profile",
    "raise_on_failure",
    "remove_duplicates",
    "remove_outliers",
    "select_features",
    "standardize_text",
    "trim_columns",
    "validate",
]
