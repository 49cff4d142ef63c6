"""Raw customer table to cleaned and capped table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.operators.checks import require_columns, require_known, require_non_empty
from stayrate.operators.clean import (
    FillValues, Stager, dedupe_first, drop_missing_critical, fill_and_type, fit_fill_values, nan_to_null,
)
from stayrate.operators.outliers import Bounds, cap, fit_bounds
from stayrate.operators.split import stratified_split
from stayrate.session import stage, tuned
from stayrate.sources.files import write_clean


@dataclass(frozen=True)
class Prepared:
    """A cleaned and capped table with the values it was cleaned and capped with."""

    table: DataFrame
    fills: FillValues
    bounds: Bounds


def prepare(raw: DataFrame, staged: Stager = stage, fit_on: str = "all", seed: int = 42) -> Prepared:
    """Clean and cap. The repeated customers are removed once; every later pass is a plain scan.

    Fill values and bounds come from all rows, or with ``fit_on="train"`` only from the rows that
    the split with the same seed will train on.
    """
    require_known(fit_on, ("all", "train"), "fitting rows")
    require_columns(raw, schema.ALL_COLUMNS)
    require_non_empty(raw)
    tuned(raw.sparkSession)
    unique = staged(dedupe_first(nan_to_null(raw)), "unique")
    source = unique if fit_on == "all" else stratified_split(drop_missing_critical(unique), seed=seed)[0]
    fills = fit_fill_values(source)
    typed = fill_and_type(unique, fills)
    bounds = fit_bounds(typed if fit_on == "all" else fill_and_type(source, fills), list(schema.CAPPED_COLUMNS))
    return Prepared(cap(typed, bounds).drop(schema.INGEST_ORDER), fills, bounds)


def preprocess_customers(raw: DataFrame, save_to: str | None = None, kind: str = "parquet") -> DataFrame:
    """Clean, cap and, given a path, write."""
    table = prepare(raw).table
    if save_to is not None:
        write_clean(table, save_to, kind)
    return table


def prepare_frozen(raw: DataFrame, fills: FillValues, bounds: Bounds, unique: bool = True) -> DataFrame:
    """Clean and cap new rows with values learned before; without ``unique`` it needs no shuffle and
    also runs on a stream.

    Every customer with an id is kept: the label may be missing or its column absent, and so may dates.
    """
    rows = raw if "churn" in raw.columns else raw.withColumn("churn", F.lit(None).cast("bigint"))
    rows = nan_to_null(rows)
    if unique:
        rows = dedupe_first(rows)
    return cap(fill_and_type(rows, fills, critical=("customer_id",)), bounds).drop(schema.INGEST_ORDER)
