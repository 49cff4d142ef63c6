"""One-hot encoding and scaling, fitted on training data and frozen."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.errors import InputError
from stayrate.functions.modes import categories
from stayrate.functions.quantiles import exact_quantiles
from stayrate.operators.checks import (
    require_columns, require_fitted, require_known, require_non_empty, require_numeric, require_some,
)

SCALERS = ("standard", "minmax", "robust")
MAX_CATEGORIES = 1_000


@dataclass(frozen=True)
class OneHotParams:
    """Sorted categories per column; the first of each has no output column."""

    categories: dict[str, list[str]]

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, values in self.categories.items() for v in values[1:]]


@dataclass(frozen=True)
class ScaleParams:
    """What is subtracted from and what divides each column."""

    method: str
    columns: dict[str, list[float]]


def fit_onehot(train: DataFrame, columns: Sequence[str], max_categories: int = MAX_CATEGORIES) -> OneHotParams:
    """Sorted distinct values; a column with more than ``max_categories`` of them is an error."""
    columns = require_some(columns, "one-hot encoding")
    require_columns(train, columns)
    return OneHotParams(categories(train, columns, max_categories))


def apply_onehot(df: DataFrame, params: OneHotParams) -> DataFrame:
    """Replace the columns by 0/1 columns appended at the end; an unseen value is 0 everywhere."""
    require_fitted(params, "the one-hot parameters")
    require_columns(df, params.categories)
    flags = [
        F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}")
        for c, values in params.categories.items()
        for v in values[1:]
    ]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in params.categories]
    return df.select(*kept, *flags)


def fit_scaler(train: DataFrame, columns: Sequence[str], method: str = "standard") -> ScaleParams:
    """Center and divisor per column; a divisor of zero becomes 1.

    standard: mean and population deviation. minmax: minimum and range. robust: median and
    quartile distance.
    """
    require_known(method, SCALERS, "scaling method")
    columns = require_some(columns, "scaling")
    require_numeric(train, columns)
    if method == "robust":
        require_non_empty(train)
        found = exact_quantiles(train, {c: [0.25, 0.5, 0.75] for c in columns})
        pairs = {c: (q[1], q[2] - q[0]) if q[1] is not None else (0.0, 1.0) for c, q in found.items()}
    else:
        first, second = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        pairs = {}
        figures = [f(F.col(c).cast("double")) for c in columns for f in (first, second)]
        row = train.agg(*figures, F.count("*").alias("rows")).first()
        if not row["rows"]:
            raise InputError("no rows to fit on")
        for i, c in enumerate(columns):
            center, other = row[2 * i] or 0.0, row[2 * i + 1] or 0.0
            pairs[c] = (center, other if method == "standard" else other - center)
    return ScaleParams(method, {c: [float(a), float(b) or 1.0] for c, (a, b) in pairs.items()})


def apply_scaler(df: DataFrame, params: ScaleParams) -> DataFrame:
    """Scale the fitted columns in place; all others stay as they are."""
    require_fitted(params, "the scaling parameters")
    require_numeric(df, params.columns)
    return df.withColumns({
        c: (F.col(c).cast("double") - F.lit(center)) / F.lit(divisor)
        for c, (center, divisor) in params.columns.items()
    })
