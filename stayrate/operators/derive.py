"""Rules that turn the 13-column base file into the 32-column customer table.

Where the rule has a free factor (cashback rate, sessions per order, rating noise and so on) it is
an argument: a number, or any column, for example ``F.rand(42) * 0.03 + 0.02``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.functions.scalars import as_column, clip, recode, round_half_even

Number = Column | float | int

# What a missing entry of the base file stands for.
BASE_DEFAULTS = {
    "SatisfactionScore": 3,
    "Complain": 0,
    "OrderCount": 1,
    "CouponUsed": 0,
    "HourSpendOnApp": 2.0,
    "DaySinceLastOrder": 0,
    "CityTier": 3,
    "CashbackAmount": 100.0,
}
# A missing tenure is 0 months, but 1 month where frequency is computed.
TENURE_DEFAULT, TENURE_DEFAULT_FREQUENCY = 0, 1

# Cities by tier.
TIER_CITIES = {
    1: ("Mumbai", "Delhi", "Bangalore", "Hyderabad", "Chennai"),
    2: ("Pune", "Ahmedabad", "Jaipur", "Lucknow", "Chandigarh"),
    3: ("Indore", "Bhopal", "Surat", "Nagpur", "Patna", "Kochi"),
}


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults of the base file, tenure included."""
    return df.fillna({**BASE_DEFAULTS, "Tenure": TENURE_DEFAULT})


def mapped_gender(value: Column | str) -> Column:
    """The given gender, Other where it is missing."""
    return F.coalesce(as_column(value), F.lit("Other"))


def mapped_payment(value: Column | str) -> Column:
    """Payment method of a base payment mode; unknown or missing means Credit Card."""
    return recode(value, schema.PAYMENT_MODE_MAP, "Credit Card")


def hours_to_minutes(hours: Column | str) -> Column:
    """Whole minutes; missing hours are 2."""
    return (F.coalesce(as_column(hours).cast("double"), F.lit(2.0)) * 60).cast("bigint")


def date_back(anchor: Column, days: Column | str) -> Column:
    """``anchor`` minus a number of days, as yyyy-MM-dd."""
    return F.date_format(F.date_sub(anchor, F.coalesce(as_column(days), F.lit(0)).cast("int")), "yyyy-MM-dd")


def state_of_city(city: Column | str) -> Column:
    """State by city; a fixed map of twenty entries needs no join."""
    return recode(city, schema.CITY_STATE)


def city_of_tier(tier: Column | str, pick: Number) -> Column:
    """One of the cities of a tier, chosen by the non-negative whole number ``pick``."""
    t = F.coalesce(as_column(tier), F.lit(3))
    chosen = None
    for level in (1, 2, 3):
        names = F.array(*[F.lit(n) for n in TIER_CITIES[level]])
        one = F.element_at(names, (F.pmod(as_column(pick), F.lit(len(TIER_CITIES[level]))) + 1).cast("int"))
        chosen = F.when(t == level, one) if chosen is None else (
            chosen.otherwise(one) if level == 3 else chosen.when(t == level, one)
        )
    return chosen


def age_from_normal(z: Number) -> Column:
    """Age from a standard normal number: mean 35, deviation 12, kept within 18 and 70."""
    return clip(F.lit(35.0) + F.lit(12.0) * as_column(z), 18.0, 70.0).cast("bigint")


def spend_from_cashback(cashback: Column | str, rate: Number) -> Column:
    """Spend before rounding."""
    return F.coalesce(as_column(cashback).cast("double"), F.lit(100.0)) / as_column(rate).cast("double")


def average_order_value(spend: Column | str, orders: Column | str) -> Column:
    """Spend per order, no orders counting as one."""
    return round_half_even(as_column(spend) / F.greatest(as_column(orders), F.lit(1)), 2)


def purchase_frequency(orders: Column | str, tenure_months: Column | str) -> Column:
    """Orders per year; at least a tenth of a year."""
    years = F.coalesce(as_column(tenure_months).cast("double"), F.lit(float(TENURE_DEFAULT_FREQUENCY))) / 12
    return round_half_even(as_column(orders) / F.greatest(years, F.lit(0.1)), 2)


def discount_usage(coupons: Column | str, factor: Number) -> Column:
    """Discounts used, from coupons used."""
    return (as_column(coupons) * as_column(factor)).cast("bigint")


def session_duration(browsing: Column | str, orders: Column | str, sessions_per_order: Number) -> Column:
    """Minutes per session, at least one session."""
    sessions = F.greatest((as_column(orders) * as_column(sessions_per_order)).cast("double"), F.lit(1.0))
    return round_half_even(as_column(browsing) / sessions, 1)


def pages_viewed(session: Column | str, pages_per_minute: Number) -> Column:
    """Pages seen in a session."""
    return (as_column(session) * as_column(pages_per_minute)).cast("bigint")


def bounded_returns(returned: Column | str, orders: Column | str) -> Column:
    """Returned orders, never more than orders."""
    r, n = as_column(returned), as_column(orders)
    return F.when(r > n, n).otherwise(r).cast("bigint")


def refund_amount(returned: Column | str, order_value: Column | str, share: Number) -> Column:
    """Money paid back."""
    return round_half_even(as_column(returned) * as_column(order_value) * as_column(share), 2)


def support_calls(complaints: Column | str, factor: Number) -> Column:
    """Calls, from complaints."""
    return (as_column(complaints) * as_column(factor)).cast("bigint")


def delivery_rating(satisfaction: Column | str, offset: Number) -> Column:
    """Whole rating from 1 to 5."""
    return clip(F.rint(as_column(satisfaction) + as_column(offset)), 1.0, 5.0).cast("bigint")


def customer_rating(satisfaction: Column | str, offset: Number) -> Column:
    """Rating from 1.0 to 5.0 with one decimal."""
    return round_half_even(clip((as_column(satisfaction) + as_column(offset)).cast("double"), 1.0, 5.0), 1)


def lifetime_value(spend: Column | str, churn: Column | str, multiplier: Number) -> Column:
    """Spend of those who left, more for those who stay."""
    s = as_column(spend)
    return round_half_even(F.when(as_column(churn) == 1, s).otherwise(s * as_column(multiplier)), 2)


def loyalty_raw(orders: Column | str, tenure_months: Column | str, spend: Column | str) -> Column:
    """Weighted sum behind the loyalty score."""
    return as_column(orders) * 5 + as_column(tenure_months) * 2 + as_column(spend) / 1000


def loyalty_range(df: DataFrame, raw: Column) -> tuple[float, float]:
    """Smallest and largest raw loyalty of a table."""
    row = df.agg(F.min(raw).cast("double"), F.max(raw).cast("double")).first()
    return (row[0] or 0.0, row[1] or 0.0)


def loyalty_score(raw: Column, low: float, high: float) -> Column:
    """Raw loyalty scaled to whole numbers from 1 to 99."""
    share = (raw - F.lit(low)) / F.lit(high - low + 1e-5)
    return (share * 99 + 1).cast("bigint")


def membership_tier(loyalty: Column | str) -> Column:
    """Tier by loyalty score."""
    s = as_column(loyalty)
    # Limits and names of the tiers
    return F.when(s > 85, "Premium").when(s > 60, "Gold").when(s > 30, "Silver").otherwise("Basic")


@dataclass(frozen=True)
class Factors:
    """Free factors of the rules; the defaults are the middles of their usual ranges."""

    city_pick: Number = 0
    age_normal: Number = 0.0
    cashback_rate: Number = 0.035
    discount: Number = 1.6
    sessions_per_order: Number = 3.5
    pages_per_minute: Number = 2.25
    wishlist: Number = 3
    abandoned: Number = 2
    returned: Number = 0
    refund_share: Number = 0.9
    calls_per_complaint: Number = 2.25
    delivery_offset: Number = 0.0
    rating_offset: Number = 0.0
    value_multiplier: Number = 1.3


def customers_from_base(base: DataFrame, anchor: Column, factors: Factors = Factors()) -> DataFrame:
    """All 32 columns in table order. The base file is read twice: once for the loyalty range."""
    f = factors
    filled = base.fillna(BASE_DEFAULTS)
    tenure = F.coalesce(F.col("Tenure"), F.lit(TENURE_DEFAULT))
    spend = spend_from_cashback("CashbackAmount", f.cashback_rate)
    first = filled.select(
        F.col("CustomerID").cast("string").alias("customer_id"),
        age_from_normal(f.age_normal).alias("age"),
        mapped_gender("Gender").alias("gender"),
        city_of_tier("CityTier", f.city_pick).alias("city"),
        F.lit(schema.COUNTRY).alias("country"),
        date_back(anchor, tenure * 30).alias("registration_date"),
        date_back(anchor, "DaySinceLastOrder").alias("last_purchase_date"),
        purchase_frequency("OrderCount", "Tenure").alias("purchase_frequency"),
        F.col("OrderCount").cast("bigint").alias("total_orders"),
        average_order_value(spend, "OrderCount").alias("average_order_value"),
        round_half_even(spend, 2).alias("total_spend"),
        discount_usage("CouponUsed", f.discount).alias("discount_usage"),
        F.col("CouponUsed").cast("bigint").alias("coupon_usage"),
        hours_to_minutes("HourSpendOnApp").alias("browsing_time"),
        as_column(f.wishlist).cast("bigint").alias("wishlist_items"),
        as_column(f.abandoned).cast("bigint").alias("cart_abandonment"),
        mapped_payment("PreferredPaymentMode").alias("payment_method"),
        bounded_returns(f.returned, "OrderCount").alias("returned_orders"),
        customer_rating("SatisfactionScore", f.rating_offset).alias("customer_rating"),
        delivery_rating("SatisfactionScore", f.delivery_offset).alias("delivery_rating"),
        support_calls("Complain", f.calls_per_complaint).alias("support_calls"),
        F.col("Complain").cast("bigint").alias("complaints"),
        F.col("SatisfactionScore").cast("bigint").alias("customer_satisfaction"),
        F.lit("Regular").alias("customer_segment"),
        F.col("Churn").cast("bigint").alias("churn"),
        tenure.alias("_tenure"),
    ).withColumns({
        "state": state_of_city("city"),
        "session_duration": session_duration("browsing_time", "total_orders", f.sessions_per_order),
        "refund_amount": refund_amount("returned_orders", "average_order_value", f.refund_share),
        "customer_lifetime_value": lifetime_value("total_spend", "churn", f.value_multiplier),
    })
    raw = loyalty_raw("total_orders", "_tenure", "total_spend")
    low, high = loyalty_range(first, raw)
    whole = first.withColumn("pages_viewed", pages_viewed("session_duration", f.pages_per_minute))
    whole = whole.withColumn("loyalty_score", loyalty_score(raw, low, high))
    return whole.withColumn("membership_type", membership_tier("loyalty_score")).select(*schema.ALL_COLUMNS)
