"""Checks that ride along: domain, label and outlier figures collected while a table is written, without a scan of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.operators.checks import domain_rules
from stayrate.operators.outliers import Bounds, is_outlier
from stayrate.session import stage


def observe_checks(
    df: DataFrame, bounds: Bounds | None = None, domains: dict[str, Sequence[str]] | None = None, label: str = "churn"
) -> tuple[DataFrame, Observation]:
    """``df`` with an observation of its check figures; the first action on it fills the observation."""
    figures = [F.count_if(test).cast("double").alias(f"domain:{rule}") for rule, test in domain_rules(domains).items()]
    figures += [F.count_if(is_outlier(c, b)).cast("double").alias(f"outlier:{c}") for c, b in (bounds or {}).items()]
    figures.append(F.avg(F.col(label).cast("double")).alias("label:rate"))
    watch = Observation()
    return df.observe(watch, *figures), watch


def figures_of(df: DataFrame, watch: Observation) -> DataFrame:
    """check, name, figure; waits for the action that ``watch`` rides on."""
    rows = [(*name.split(":", 1), value) for name, value in watch.get.items()]
    return df.sparkSession.createDataFrame(rows, "check string, name string, figure double")


def rate_in_range(watch: Observation) -> bool:
    """Whether the share of churned customers lies in the expected range."""
    low, high = schema.CHURN_RATE_RANGE
    return watch.get["label:rate"] is not None and low <= watch.get["label:rate"] <= high


def stage_checked(df: DataFrame, name: str, bounds: Bounds | None = None, domains: dict[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Write ``df`` to the shared folder; the table read back, and its check figures."""
    watched, watch = observe_checks(df, bounds, domains)
    kept = stage(watched, name)
    return kept, figures_of(kept, watch)
