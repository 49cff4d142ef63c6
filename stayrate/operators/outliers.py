"""Detection and treatment of outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.functions.quantiles import exact_quantiles
from stayrate.functions.scalars import clip
from stayrate.operators.checks import require_known, require_non_empty, require_numeric, require_some

METHODS = ("iqr", "zscore")
TREATMENTS = ("keep", "remove", "cap")
DEFAULT_REACH = {"iqr": 1.5, "zscore": 3.0}

Bounds = dict[str, tuple[float | None, float | None]]


def iqr_bounds(df: DataFrame, columns: Sequence[str], reach: float | None = None, approx: bool = False) -> Bounds:
    """Quartiles widened by ``reach`` times their distance; 0 or nothing means the default 1.5."""
    k = reach or DEFAULT_REACH["iqr"]
    if approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], 10_000) for c in columns]).first()
        found = dict(zip(columns, row, strict=True))
    else:
        found = exact_quantiles(df, {c: [0.25, 0.75] for c in columns})
    bounds: Bounds = {}
    for c in columns:
        q1, q3 = found[c] or (None, None)
        bounds[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return bounds


def zscore_bounds(df: DataFrame, columns: Sequence[str], reach: float | None = None) -> Bounds:
    """Mean plus and minus ``reach`` sample deviations; 0 or nothing means the default 3.0.

    A single value has no deviation, hence no bounds and no outliers.
    """
    z = reach or DEFAULT_REACH["zscore"]
    row = df.agg(*[
        f(F.col(c).cast("double")) for c in columns for f in (F.avg, F.stddev_samp)
    ]).first()
    bounds: Bounds = {}
    for i, c in enumerate(columns):
        mean, deviation = row[2 * i], row[2 * i + 1]
        if mean is None or deviation is None:
            bounds[c] = (None, None)
        else:
            bounds[c] = (mean - z * deviation, mean + z * deviation)
    return bounds


def fit_bounds(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", reach: float | None = None, approx: bool = False
) -> Bounds:
    """Bounds of all columns from one set of statistics jobs."""
    require_known(method, METHODS, "outlier method")
    columns = require_some(columns, "outliers")
    require_numeric(df, columns)
    return iqr_bounds(df, columns, reach, approx) if method == "iqr" else zscore_bounds(df, columns, reach)


def is_outlier(column: str, bounds: tuple[float | None, float | None]) -> Column:
    """Strictly outside the bounds; a missing value is not an outlier."""
    low, high = bounds
    if low is None or high is None:
        return F.lit(False)
    c = F.col(column)
    return F.coalesce((c < F.lit(low)) | (c > F.lit(high)), F.lit(False))


def outlier_counts(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Number of outliers per column, all columns in one pass."""
    counts = df.agg(*[F.count_if(is_outlier(c, b)).alias(c) for c, b in bounds.items()])
    return counts.unpivot([], list(bounds), "column", "outliers")


def cap(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Limit each column to its bounds. Columns become doubles whether or not outliers exist."""
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items()})


def remove(
    df: DataFrame, columns: Sequence[str], method: str = "iqr", reach: float | None = None
) -> DataFrame:
    """Drop outlier rows column by column; each column's bounds come from the rows still left."""
    for column in columns:
        bounds = fit_bounds(df, [column], method, reach)
        df = df.where(~is_outlier(column, bounds[column]))
    return df


def treat(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    treatment: str = "cap",
    reach: float | None = None,
) -> DataFrame:
    """Detect outliers by ``method`` and keep, remove or cap them."""
    require_known(method, METHODS, "outlier method")
    require_known(treatment, TREATMENTS, "treatment")
    columns = require_some(columns, "outliers")
    require_numeric(df, columns)
    require_non_empty(df)
    if treatment == "keep":
        return df
    if treatment == "remove":
        return remove(df, columns, method, reach)
    return cap(df, fit_bounds(df, columns, method, reach))


def cap_continuous(df: DataFrame, columns: Sequence[str] = schema.CAPPED_COLUMNS) -> DataFrame:
    """Cap the continuous columns at 1.5 quartile distances, all from one set of statistics."""
    return cap(df, fit_bounds(df, [c for c in columns if c in df.columns]))


def winsorize(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Limit each column to two of its percentiles."""
    require_numeric(df, require_some(columns, "winsorize"))
    found = exact_quantiles(df, {c: [low, high] for c in columns})
    return cap(df, {c: tuple(v) for c, v in found.items()})
