"""Feature engineering: the fitted pair of RFM and engagement, and the named business features."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.functions.quantiles import exact_quantiles
from stayrate.functions.scalars import as_column, days_between, min_max, quantile_band
from stayrate.operators.checks import require_columns, require_fitted
from stayrate.operators.engagement import EngagementParams, apply_engagement, fit_engagement
from stayrate.operators.rfm import FIFTHS, RfmParams, apply_rfm, fit_rfm


@dataclass(frozen=True)
class FeatureParams:
    """Everything the engineered features need from training data."""

    rfm: RfmParams
    engagement: EngagementParams


def fit_features(train: DataFrame) -> FeatureParams:
    """Learn RFM boundaries and engagement ranges."""
    return FeatureParams(fit_rfm(train), fit_engagement(train))


def apply_features(df: DataFrame, params: FeatureParams) -> DataFrame:
    """Add recency_days, rfm_segment and engagement_score; one projection."""
    require_fitted(params, "the feature parameters")
    return apply_engagement(apply_rfm(df, params.rfm), params.engagement)


def age_group(age: Column | str) -> Column:
    """Age band; missing outside 1 to 100."""
    a = as_column(age)
    bands = F.when(a.isNull() | (a <= 0), None)
    for upper, label in schema.AGE_BANDS:
        bands = bands.when(a <= upper, label)
    return bands


def lifetime_days(first: str = "registration_date", last: str = "last_purchase_date") -> Column:
    """Days from registration to the last purchase."""
    return days_between(first, F.col(last))


def avg_monthly_spend(spend: str = "total_spend") -> Column:
    """Spend per 30 days of lifetime, at least one month."""
    return F.col(spend) / F.greatest(lifetime_days() / 30, F.lit(1.0))


def risk_score() -> Column:
    """Weighted sum of complaints, abandoned carts, support calls and dissatisfaction."""
    dissatisfaction = F.lit(schema.BEST_SATISFACTION) - F.col("customer_satisfaction")
    parts = [
        (dissatisfaction if name == "dissatisfaction" else F.col(name)) * F.lit(weight)
        for name, weight in schema.RISK_WEIGHTS.items()
    ]
    return reduce(lambda a, b: a + b, parts)


def ratio(part: str, whole: str) -> Column:
    """Part by whole, missing when the whole is 0."""
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def discount_dependency() -> Column:
    return ratio("discount_usage", "total_orders")


def complaint_ratio() -> Column:
    return ratio("complaints", "support_calls")


def return_ratio() -> Column:
    return ratio("returned_orders", "total_orders")


def premium_flag() -> Column:
    return F.coalesce((F.col("membership_type") == "Premium").cast("bigint"), F.lit(0).cast("bigint"))


def with_browsing_score(df: DataFrame) -> DataFrame:
    """Mean of browsing time and pages viewed, each scaled to its range in the table."""
    columns = ("browsing_time", "pages_viewed")
    require_columns(df, columns)
    row = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (F.min, F.max)]).first()
    scaled = [min_max(c, row[2 * i] or 0.0, row[2 * i + 1] or 0.0) for i, c in enumerate(columns)]
    return df.withColumn("browsing_score", (scaled[0] + scaled[1]) / 2)


def with_engagement_v2(df: DataFrame) -> DataFrame:
    """Half browsing and three tenths pages, each by its maximum, and two tenths purchase frequency."""
    row = df.agg(F.max(F.col("browsing_time").cast("double")), F.max(F.col("pages_viewed").cast("double"))).first()
    parts = [F.try_divide(F.col(c).cast("double"), F.lit(m or 0.0)) for c, m in zip(("browsing_time", "pages_viewed"), row)]
    # The weights
    score = parts[0] * F.lit(0.5) + parts[1] * F.lit(0.3) + F.col("purchase_frequency") * F.lit(0.2)
    return df.withColumn("engagement_score_v2", score)


def with_vip_flag(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Customers whose lifetime value reaches the given quantile."""
    limit = exact_quantiles(df, {"customer_lifetime_value": [share]})["customer_lifetime_value"][0]
    flag = F.coalesce((F.col("customer_lifetime_value") >= F.lit(limit)).cast("bigint"), F.lit(0).cast("bigint"))
    return df.withColumn("vip_flag", flag)


def with_activity_level(df: DataFrame, score: str = "engagement_score") -> DataFrame:
    """Fifth of the engagement score by name; merged edges leave the highest names unused."""
    edges = exact_quantiles(df, {score: FIFTHS})[score]
    edges = sorted({e for e in edges if e is not None})
    names = F.array(*[F.lit(n) for n in schema.ACTIVITY_LEVELS])
    band = quantile_band(score, edges[1:-1]) if len(edges) > 1 else F.lit(None).cast("int")
    return df.withColumn("activity_level", F.element_at(names, band))


def purchase_interval(orders: DataFrame, customer: str, date: str) -> DataFrame:
    """Mean days between consecutive purchases of each customer.

    The gaps add up to last minus first purchase, so this is a plain aggregate that is combined
    before the shuffle: no customer's orders are sorted or gathered.
    """
    found = orders.groupBy(customer).agg(
        F.count(date).alias("n"),
        F.unix_date(F.min(F.to_date(date))).alias("a"),
        F.unix_date(F.max(F.to_date(date))).alias("b"),
    )
    gap = F.when(F.col("n") > 1, (F.col("b") - F.col("a")) / (F.col("n") - 1))
    return found.select(customer, gap.alias("purchase_interval"))


def log_sqrt_transform(df: DataFrame, columns: tuple[str, ...] = schema.SKEWED_COLUMNS) -> DataFrame:
    """Logarithm of one plus each skewed column, and its square root."""
    require_columns(df, columns)
    added = {}
    for c in columns:
        positive = F.when(F.col(c) >= 0, F.col(c).cast("double"))
        added[f"{c}_log"] = F.log1p(positive)
        added[f"{c}_sqrt"] = F.sqrt(positive)
    return df.withColumns(added)
