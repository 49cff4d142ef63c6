"""De-duplication, imputation, typing and text normalisation of the customer table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schema
from stayrate.errors import CleaningError, StayrateError
from stayrate.functions.modes import most_frequent
from stayrate.functions.quantiles import exact_quantiles
from stayrate.functions.scalars import float_number, number, parsed_date, stripped, title_case, whole_number
from stayrate.operators.checks import require_columns, require_non_empty
from stayrate.session import stage

Stager = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class FillValues:
    """Values put in place of missing ones, learned from a table."""

    medians: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column; null is the only missing value."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, floats) else f.name
        for f in df.schema
    ])


def dedupe_first(df: DataFrame, key: str = "customer_id", order: str = schema.INGEST_ORDER) -> DataFrame:
    """The first row of each key in ingest order; rows without a key count as one key.

    Spark keeps one row per key and partition before the shuffle, so a key with a third of all rows
    sends only as many rows as there are partitions.
    """
    require_columns(df, [key, order])
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def dedupe_rows(df: DataFrame) -> DataFrame:
    """Distinct rows, for tables without a key."""
    return df.dropDuplicates()


def duplicate_count(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Number of rows that :func:`dedupe_first` drops."""
    keys = df.groupBy(key).agg(F.count("*").alias("n"))
    return keys.agg((F.sum("n") - F.count("*")).cast("bigint").alias("duplicates"))


def impute_zero(df: DataFrame, columns: Sequence[str] = schema.ZERO_FILL_COLUMNS) -> DataFrame:
    """Counts and amounts that are missing did not happen."""
    return df.fillna(0, list(columns))


def fit_medians(df: DataFrame, columns: Sequence[str] = schema.MEDIAN_FILL_COLUMNS) -> dict[str, float]:
    """Exact medians; a column without values has none and is left alone."""
    typed = df.select(*[number(c).alias(c) for c in columns])
    found = exact_quantiles(typed, {c: [0.5] for c in columns})
    return {c: v[0] for c, v in found.items() if v[0] is not None}


def fit_modes(df: DataFrame, columns: Sequence[str] = schema.MODE_FILL_COLUMNS) -> dict[str, str]:
    """Most frequent raw texts, smallest on ties; a column without values is an error."""
    found = most_frequent(df, list(columns))
    empty = [c for c, v in found.items() if v is None]
    if empty:
        raise CleaningError(f"no value to impute from: {', '.join(empty)}")
    return found


def fit_fill_values(df: DataFrame) -> FillValues:
    """Medians and modes of a de-duplicated table."""
    return FillValues(fit_medians(df), fit_modes(df))


def impute_median(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill numeric columns; they become doubles, since a median may lie between two integers."""
    return df.withColumns({c: F.coalesce(number(c), F.lit(float(m))) for c, m in medians.items()})


def impute_mode(df: DataFrame, modes: dict[str, str]) -> DataFrame:
    """Fill category columns."""
    return df.fillna(modes)


def drop_missing_critical(df: DataFrame, columns: Sequence[str] = schema.CRITICAL_COLUMNS) -> DataFrame:
    """Drop rows without id, registration date or label, before any date is parsed."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))


def cast_int(df: DataFrame, columns: Sequence[str] = schema.INT_COLUMNS) -> DataFrame:
    """Integers: truncated, 0 where missing or unreadable."""
    return df.withColumns({c: whole_number(c) for c in columns})


def cast_float(df: DataFrame, columns: Sequence[str] = schema.FLOAT_COLUMNS) -> DataFrame:
    """Doubles: 0.0 where missing or unreadable."""
    return df.withColumns({c: float_number(c) for c in columns})


def parse_dates(
    df: DataFrame,
    columns: Sequence[str] = schema.DATE_COLUMNS,
    formats: tuple[str, ...] = ("yyyy-MM-dd",),
) -> DataFrame:
    """Timestamps without zone; unreadable text becomes missing."""
    return df.withColumns({c: parsed_date(c, formats) for c in columns})


def _text_columns(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != "customer_id"
    ]


def normalise_strings(df: DataFrame, columns: Sequence[str] | None = None, missing: str = "Nan") -> DataFrame:
    """Strip and title-case text columns; a value still missing becomes the text ``missing``."""
    columns = _text_columns(df) if columns is None else columns
    return df.withColumns({c: F.coalesce(title_case(stripped(c)), F.lit(missing)) for c in columns})


def label_missing(df: DataFrame, columns: Sequence[str], missing: str = "Nan") -> DataFrame:
    """The label that a missing category carries after normalisation."""
    return df.fillna(missing, list(columns))


def fix_acronyms(df: DataFrame, repair_all: bool = False, column: str = "payment_method") -> DataFrame:
    """Restore payment names that title-casing spoils.

    By default ``Cash On Delivery`` stays beside ``Cash on Delivery``; ``repair_all`` joins them.
    """
    repairs = schema.PAYMENT_REPAIRS_ALL if repair_all else schema.PAYMENT_REPAIRS
    return df.replace(repairs, subset=[column])


def fill_and_type(
    df: DataFrame, fills: FillValues, repair_all: bool = False, critical: Sequence[str] = schema.CRITICAL_COLUMNS
) -> DataFrame:
    """All row-wise cleaning steps with known fill values: one projection, no shuffle.

    Rows without a ``critical`` column are dropped. Where the label is not among them, a label that is not known yet
    stays missing.
    """
    label = F.when(F.col("churn").isNotNull(), whole_number("churn"))
    return (
        impute_zero(df)
        .transform(impute_median, fills.medians)
        .transform(impute_mode, fills.modes)
        .transform(drop_missing_critical, critical)
        .transform(cast_int, [c for c in schema.INT_COLUMNS if c != "churn"])
        .withColumn("churn", label)
        .transform(cast_float)
        .transform(parse_dates)
        .transform(normalise_strings)
        .transform(fix_acronyms, repair_all)
    )


def clean_customers(df: DataFrame, staged: Stager | None = stage, fills: FillValues | None = None) -> DataFrame:
    """De-duplicate, impute, drop, type and normalise, in that order.

    ``staged`` writes the de-duplicated rows once, so the passes for medians and modes and the
    final projection scan a table instead of repeating the shuffle; ``None`` repeats it. Give
    ``fills`` to use values learned elsewhere.
    """
    try:
        require_columns(df, schema.ALL_COLUMNS)
        require_non_empty(df)
        unique = dedupe_first(nan_to_null(df))
        if staged is not None:
            unique = staged(unique, "unique")
        return fill_and_type(unique, fills or fit_fill_values(unique))
    except CleaningError:
        raise
    except (StayrateError, PySparkException) as e:
        raise CleaningError(f"cleaning failed: {e}") from e
