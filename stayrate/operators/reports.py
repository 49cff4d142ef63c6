"""Dashboard figures over the scored table and business figures over orders and events.

Sums of money are taken as decimals, so they do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.functions.scalars import label_churn, label_prediction, month_bucket
from stayrate.operators.checks import filter_predicted_churn
from stayrate.operators.features import age_group


def money_sum(column: Column | str) -> Column:
    """Exact sum of amounts with up to six decimals."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(24,6)")).cast("double")


def exact_avg(column: str) -> Column:
    """Mean of an amount of money from an exact sum; missing values are left out."""
    return F.try_divide(money_sum(column), F.count(column).cast("double"))


# --- figures of the dashboard -------------------------------------------------------------------


def _churn_rate() -> Column:
    rate = F.try_divide(F.lit(100.0) * F.sum("churn"), F.count("*").cast("double"))
    return F.coalesce(rate, F.lit(0.0))


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """All four headline figures in one pass."""
    return df.agg(
        F.count("*").alias("total_customers"),
        _churn_rate().alias("churn_rate"),
        exact_avg("average_order_value").alias("avg_order_value"),
        F.coalesce(F.sum("predicted_churn"), F.lit(0)).cast("bigint").alias("predicted_churn"),
    )


def kpi_total_customers(df: DataFrame) -> DataFrame:
    """Number of customers."""
    return df.agg(F.count("*").alias("total_customers"))


def kpi_churn_rate(df: DataFrame) -> DataFrame:
    """Percentage of churned customers, 0 for no customers."""
    return df.agg(_churn_rate().alias("churn_rate"))


def kpi_avg_order_value(df: DataFrame) -> DataFrame:
    """Mean order value."""
    return df.agg(exact_avg("average_order_value").alias("avg_order_value"))


def kpi_predicted_churn(df: DataFrame) -> DataFrame:
    """Customers predicted to leave, 0 for no customers."""
    return df.agg(F.coalesce(F.sum("predicted_churn"), F.lit(0)).cast("bigint").alias("predicted_churn"))


def churn_distribution(df: DataFrame) -> DataFrame:
    """Customers per churn status, larger first."""
    counts = df.where(F.col("churn").isNotNull()).groupBy("churn").agg(F.count("*").alias("customers"))
    return counts.select(label_churn("churn").alias("churn_status"), "customers").orderBy(
        F.desc("customers"), "churn_status"
    )


def segment_counts(df: DataFrame) -> DataFrame:
    """Customers per RFM segment, larger first."""
    counts = df.where(F.col("rfm_segment").isNotNull()).groupBy("rfm_segment")
    return counts.agg(F.count("*").alias("customers")).orderBy(F.desc("customers"), "rfm_segment")


def monthly_revenue(df: DataFrame) -> DataFrame:
    """Spend of customers by the month of their last purchase."""
    month = month_bucket("last_purchase_date").alias("month")
    return df.groupBy(month).agg(money_sum("total_spend").alias("revenue")).orderBy("month")


def churn_by_membership(df: DataFrame) -> DataFrame:
    """Customers per membership and churn status."""
    present = F.col("membership_type").isNotNull() & F.col("churn").isNotNull()
    counts = df.where(present).groupBy("membership_type", "churn").agg(F.count("*").alias("customers"))
    return counts.select("membership_type", label_churn("churn").alias("churn_status"), "customers").orderBy(
        "membership_type", "churn_status"
    )


def engagement_by_prediction(df: DataFrame) -> DataFrame:
    """Mean engagement per predicted class."""
    means = df.where(F.col("predicted_churn").isNotNull()).groupBy("predicted_churn")
    return means.agg(F.avg("engagement_score").alias("avg_engagement")).select(
        label_prediction("predicted_churn").alias("prediction"), "avg_engagement"
    )


def top_high_risk(df: DataFrame, top: int = 100) -> DataFrame:
    """The biggest spenders among predicted churners; equal spend is ordered by customer."""
    ranked = filter_predicted_churn(df).orderBy(F.desc("total_spend"), "customer_id")
    return ranked.select(*schema.RISK_DISPLAY).limit(top)


def display_names(df: DataFrame, names: dict[str, str] = schema.RISK_DISPLAY) -> DataFrame:
    """Rename columns for display."""
    return df.withColumnsRenamed(names)


# --- business figures ---------------------------------------------------------------------------


def kpi_active_inactive(df: DataFrame) -> DataFrame:
    """Active and inactive customers, and customers with two or more orders."""
    return df.agg(
        F.count_if(F.col("churn") == 0).alias("active_customers"),
        F.count_if(F.col("churn") == 1).alias("inactive_customers"),
        F.count_if(F.col("total_orders") >= 2).alias("repeat_customers"),
    )


def kpi_retention_rate(df: DataFrame) -> DataFrame:
    """Share of customers who stay."""
    return df.agg((F.lit(1.0) - F.avg(F.col("churn").cast("double"))).alias("retention_rate"))


def kpi_revenue_net(df: DataFrame) -> DataFrame:
    """Revenue, refunds, their share and what is left."""
    totals = df.agg(money_sum("total_spend").alias("revenue"), money_sum("refund_amount").alias("refunds"))
    return totals.select(
        "revenue",
        "refunds",
        F.try_divide("refunds", "revenue").alias("refund_rate"),
        (F.col("revenue") - F.col("refunds")).alias("net_revenue"),
    )


def kpi_clv_session(df: DataFrame) -> DataFrame:
    """Mean lifetime value and mean session duration."""
    return df.agg(
        exact_avg("customer_lifetime_value").alias("avg_lifetime_value"),
        F.avg("session_duration").alias("avg_session_duration"),
    )


def kpi_growth_rate(orders: DataFrame, date: str = "o_orderdate", amount: str = "o_totalprice") -> DataFrame:
    """Monthly revenue and its change against the calendar month before, missing where that month has no orders.

    Orders without a date belong to no month and are left out. Only months that are already added up meet in one
    window: twelve rows per year of history.
    """
    dated = orders.where(F.col(date).isNotNull()).groupBy(F.trunc(date, "MM").alias("first"))
    months = dated.agg(money_sum(amount).alias("revenue"))
    order = Window.orderBy("first")
    follows = F.add_months(F.lag("first").over(order), 1) == F.col("first")
    before = F.when(follows, F.lag("revenue").over(order))
    growth = F.try_divide(F.col("revenue") - before, before)
    return months.select(F.date_format("first", "yyyy-MM").alias("month"), "revenue", growth.alias("growth_rate"))


def kpi_conversion_rate(events: DataFrame) -> DataFrame:
    """Purchases per view."""
    counts = events.where(F.col("event_type").isin("purchase", "view")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "view").alias("views"),
    )
    rate = F.try_divide(F.col("purchases").cast("double"), F.col("views").cast("double"))
    return counts.select("purchases", "views", rate.alias("conversion_rate"))


def sales_by_period(orders: DataFrame, date: str = "o_orderdate", amount: str = "o_totalprice") -> DataFrame:
    """Revenue and orders by month, quarter and year from one pass.

    Orders are added up per month first; quarters and years are sums of months.
    """
    months = orders.groupBy(F.date_format(date, "yyyy-MM").alias("month")).agg(
        F.sum(F.col(amount).cast("decimal(24,6)")).alias("revenue"), F.count("*").alias("orders")
    )
    year = F.substring("month", 1, 4)
    quarter = F.concat(year, F.lit("-Q"), F.ceil(F.substring("month", 6, 2).cast("int") / 3).cast("string"))
    periods = F.array(
        F.struct(F.lit("month").alias("period"), F.col("month").alias("start")),
        F.struct(F.lit("quarter").alias("period"), quarter.alias("start")),
        F.struct(F.lit("year").alias("period"), year.alias("start")),
    )
    spread = months.select(F.explode(periods).alias("p"), "revenue", "orders")
    return spread.groupBy("p.period", "p.start").agg(
        F.sum("revenue").cast("double").alias("revenue"), F.sum("orders").cast("bigint").alias("orders")
    )


def cohort_retention(
    orders: DataFrame, customer: str = "o_custkey", date: str = "o_orderdate"
) -> DataFrame:
    """Customers of each first-purchase month who buy again, by months since then.

    A customer's months are gathered as a set, which no order makes larger than the history has months: one shuffle by
    customer, and each task has reduced its customers before it.
    """
    months = orders.groupBy(customer).agg(F.collect_set(F.year(date) * 12 + F.month(date) - 1).alias("months"))
    active = months.select(F.array_min("months").alias("first"), F.explode("months").alias("m"))
    aged = active.groupBy("first", (F.col("m") - F.col("first")).alias("months_since"))
    cohort = F.concat(
        F.floor(F.col("first") / 12).cast("string"), F.lit("-"), F.lpad((F.col("first") % 12 + 1).cast("string"), 2, "0")
    )
    return aged.agg(F.count("*").alias("customers")).select(
        cohort.alias("cohort"), F.col("months_since").cast("bigint"), "customers"
    )


def sales_by_payment(df: DataFrame) -> DataFrame:
    """Revenue and customers per payment method."""
    return df.groupBy("payment_method").agg(
        money_sum("total_spend").alias("revenue"), F.count("*").alias("customers")
    )


def sales_by_region(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Revenue per region and nation.

    Orders are added up per customer before the join, so a customer with very many orders joins one
    row. Spark broadcasts nation and region by their measured size.
    """
    spent = orders.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(24,6)")).alias("revenue"), F.count("*").alias("orders")
    )
    by_nation = (
        spent.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    )
    return (
        by_nation.join(nation.select("n_nationkey", "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region.select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            F.col("revenue").cast("double").alias("revenue"),
            F.col("orders").cast("bigint").alias("orders"),
        )
    )


def demographic_segments(df: DataFrame, keys: Sequence[str] = ("age_group", "gender", "city")) -> DataFrame:
    """Customers, churn rate and spend for every combination of age group, gender and city, with
    subtotals. A key that a line does not split by reads ``All``.

    Rows are added up for the full combination first; only these sums are multiplied for subtotals.
    """
    finest = df.withColumn("age_group", F.coalesce(age_group("age"), F.lit("Unknown"))).groupBy(*keys).agg(
        F.count("*").alias("customers"),
        F.sum("churn").alias("churned"),
        F.count("churn").alias("labelled"),
        F.sum(F.col("total_spend").cast("decimal(24,6)")).alias("revenue"),
    )
    totals = finest.cube(*keys).agg(
        *[F.grouping(k).alias(f"_{k}") for k in keys],
        F.sum("customers").cast("bigint").alias("customers"),
        F.try_divide(F.sum("churned").cast("double"), F.sum("labelled").cast("double")).alias("churn_rate"),
        F.sum("revenue").cast("double").alias("revenue"),
    )
    labels = [F.when(F.col(f"_{k}") == 1, "All").otherwise(F.col(k)).alias(k) for k in keys]
    return totals.select(*labels, "customers", "churn_rate", "revenue")
