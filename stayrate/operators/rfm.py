"""Recency, frequency and monetary scores with boundaries frozen on training data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.errors import InputError
from stayrate.functions.quantiles import exact_quantiles
from stayrate.functions.scalars import days_between, quantile_band
from stayrate.operators.checks import require_columns, require_fitted

FIFTHS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]


@dataclass(frozen=True)
class RfmParams:
    """Reference date (ISO text) and the distinct quintile edges, outer ones included."""

    reference: str
    recency: list[float]
    orders: list[float]
    spend: list[float]

    def reference_column(self) -> Column:
        return F.lit(self.reference).cast("timestamp_ntz")


def _distinct(edges: list[float | None]) -> list[float]:
    return sorted({e for e in edges if e is not None})


def fit_rfm(train: DataFrame) -> RfmParams:
    """Latest purchase and quintile edges of a training table; equal edges are merged."""
    require_columns(train, schema.RFM_COLUMNS)
    latest: datetime | None = train.agg(F.max(F.col("last_purchase_date").cast("timestamp_ntz"))).first()[0]
    if latest is None:
        raise InputError("no purchase date to fit on")
    reference = latest.isoformat(sep=" ")
    recency = days_between("last_purchase_date", F.lit(reference).cast("timestamp_ntz"))
    edges = exact_quantiles(
        train.select(recency.alias("recency"), "total_orders", "total_spend"),
        {c: FIFTHS for c in ("recency", "total_orders", "total_spend")},
    )
    return RfmParams(reference, *[_distinct(edges[c]) for c in ("recency", "total_orders", "total_spend")])


def recency_days(params: RfmParams, date: str = "last_purchase_date") -> Column:
    """Whole days from the last purchase to the reference date."""
    return days_between(date, params.reference_column())


def score(value: Column | str, edges: list[float], descending: bool = False) -> Column:
    """Band from 1 to the number of bands, or the reverse; values beyond the edges are in the outer
    bands, and a column that was constant in training has no bands."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    band = quantile_band(value, edges[1:-1])
    return F.lit(len(edges)) - band if descending else band


def scores(params: RfmParams) -> dict[str, Column]:
    """The three scores as columns over a table with recency_days."""
    return {
        "recency_score": score("recency_days", params.recency, descending=True),
        "frequency_score": score("total_orders", params.orders),
        "monetary_score": score("total_spend", params.spend),
    }


def concat_scores(r: Column, f: Column, m: Column) -> Column:
    """The scores written one after the other; a missing one reads ``nan``."""
    return F.concat(*[F.coalesce(s.cast("string"), F.lit("nan")) for s in (r, f, m)])


def segment(r: Column, f: Column, m: Column) -> Column:
    """Business segment of three scores; Unknown when one is missing."""
    # Limits and names of the segments
    return (
        F.when(r.isNull() | f.isNull() | m.isNull(), "Unknown")
        .when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "Recent Users")
        .when((r <= 2) & (f >= 4), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost")
        .otherwise("Average")
    )


def rfm_components(df: DataFrame, params: RfmParams) -> DataFrame:
    """Recency, frequency, monetary value, their scores, the score text and the three-digit score."""
    require_fitted(params, "the RFM parameters")
    require_columns(df, schema.RFM_COLUMNS)
    r, f, m = (F.col(c) for c in ("recency_score", "frequency_score", "monetary_score"))
    return (
        df.withColumn("recency_days", recency_days(params))
        .withColumns({c: s.cast("bigint") for c, s in scores(params).items()})
        .withColumns({
            "recency": F.col("recency_days"),
            "frequency": F.col("total_orders"),
            "monetary": F.col("total_spend"),
            "rfm_score_text": concat_scores(r, f, m),
            "rfm_score": r * 100 + f * 10 + m,
        })
    )


def apply_rfm(df: DataFrame, params: RfmParams) -> DataFrame:
    """Add recency_days and rfm_segment."""
    require_fitted(params, "the RFM parameters")
    require_columns(df, schema.RFM_COLUMNS)
    aged = df.withColumn("recency_days", recency_days(params))
    return aged.withColumn("rfm_segment", segment(*scores(params).values()))
