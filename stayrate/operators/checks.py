"""Checks of input and arguments, domain and label reports, report filters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schema
from stayrate.errors import InputError, NotFittedError, OptionError
from stayrate.functions.scalars import recode


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail when a column is absent; costs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InputError(f"missing columns: {', '.join(missing)}")
    return df


def require_non_empty(df: DataFrame | None) -> DataFrame:
    """Fail on no data; reads at most one row."""
    if df is None or df.isEmpty():
        raise InputError("the input has no rows")
    return df


def require_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail when a column is absent or has no numeric type."""
    columns = list(columns)
    require_columns(df, columns)
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, T.NumericType)]
    if wrong:
        kinds = ", ".join(f"{c} ({df.schema[c].dataType.simpleString()})" for c in wrong)
        raise InputError(f"not numeric: {kinds}")
    return df


def require_fitted(params: object | None, what: str) -> None:
    """Fail when nothing was fitted yet."""
    if params is None:
        raise NotFittedError(f"{what} must be fitted first")


def require_known(value: str, known: Sequence[str], what: str) -> str:
    """Fail on an option that is not supported."""
    if value not in known:
        raise OptionError(f"unknown {what} {value!r}; known: {', '.join(known)}")
    return value


def require_some(columns: Sequence[str], what: str) -> list[str]:
    """Fail on an empty column list."""
    if not columns:
        raise OptionError(f"{what}: no columns given")
    return list(columns)


def columns_by_type(df: DataFrame, skip: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the text columns and of the numeric columns."""
    skip = set(skip)
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    return text, numeric


def filter_members(df: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Rows whose value is listed, in every column given; a missing value is never listed."""
    require_columns(df, allowed)
    tests = [F.col(c).isin(list(values)) for c, values in allowed.items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def filter_predicted_churn(df: DataFrame) -> DataFrame:
    """Customers predicted to leave."""
    return df.where(F.col("predicted_churn") == 1)


def distinct_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct present values of each column, sorted, as (column, option)."""
    pairs = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("option")))
        for c in columns
    ])
    found = df.select(F.explode(F.array_compact(pairs)).alias("p")).select("p.column", "p.option")
    return found.distinct().orderBy("column", "option")


def domain_rules(domains: dict[str, Sequence[str]] | None = None) -> dict[str, Column]:
    """Per rule, whether a row breaks it; a missing value does.

    The last rule, ``city_state``, is broken where a known city lies in another state.
    """
    domains = schema.DOMAINS if domains is None else domains
    rules = {c: ~F.coalesce(F.col(c).isin(list(v)), F.lit(False)) for c, v in domains.items()}
    home = recode("city", schema.CITY_STATE)
    rules["city_state"] = F.coalesce(home != F.col("state"), F.lit(False))
    return rules


def domain_violations(df: DataFrame, domains: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Number of rows outside the allowed values, per rule."""
    rules = domain_rules(domains)
    counts = df.agg(*[F.count_if(test).alias(rule) for rule, test in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def label_rate_check(df: DataFrame, label: str = "churn") -> DataFrame:
    """Share of churned customers and whether it lies in the expected range."""
    low, high = schema.CHURN_RATE_RANGE
    rate = F.avg(F.col(label).cast("double"))
    return df.agg(rate.alias("churn_rate"), rate.between(low, high).alias("in_range"))
