"""Engagement score: a weighted sum of scaled behaviour, scaled again, frozen on training data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.errors import InputError
from stayrate.functions.scalars import clip, min_max, round_half_even
from stayrate.operators.checks import require_columns, require_fitted


@dataclass(frozen=True)
class EngagementParams:
    """Range of each input and of their weighted sum in training, and the range of the score."""

    ranges: dict[str, list[float]]
    total: list[float]
    target: list[float]


def weighted_sum(ranges: dict[str, list[float]]) -> Column:
    """Weighted sum of the inputs scaled to their training ranges."""
    parts = [min_max(c, *ranges[c]) * F.lit(w) for c, w in schema.ENGAGEMENT_WEIGHTS.items()]
    return reduce(lambda a, b: a + b, parts)


def fit_engagement(train: DataFrame, target: tuple[float, float] = (0.0, 100.0)) -> EngagementParams:
    """Two one-row aggregates: ranges of the inputs, then the range of their weighted sum."""
    columns = list(schema.ENGAGEMENT_WEIGHTS)
    require_columns(train, columns)
    extremes = [f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]
    row = train.agg(*extremes, F.count("*").alias("rows")).first()
    if not row["rows"]:
        raise InputError("no rows to fit on")
    ranges = {c: [row[2 * i] or 0.0, row[2 * i + 1] or 0.0] for i, c in enumerate(columns)}
    total = weighted_sum(ranges)
    ends = train.agg(F.min(total), F.max(total)).first()
    return EngagementParams(ranges, [ends[0] or 0.0, ends[1] or 0.0], [float(t) for t in target])


def engagement_score(params: EngagementParams) -> Column:
    """Score in the target range, two decimals."""
    low, high = params.target
    share = min_max(weighted_sum(params.ranges), *params.total)
    return round_half_even(clip(share * F.lit(high - low) + F.lit(low), low, high), 2)


def apply_engagement(df: DataFrame, params: EngagementParams) -> DataFrame:
    """Add engagement_score."""
    require_fitted(params, "the engagement parameters")
    require_columns(df, schema.ENGAGEMENT_WEIGHTS)
    return df.withColumn("engagement_score", engagement_score(params))
