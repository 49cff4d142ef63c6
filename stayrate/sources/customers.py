"""The customer table and the base file, derived from order, line, event and customer tables.

Every figure is an aggregate that is combined before its shuffle: lines per order, then orders per
customer, and events per user. Only tables with one row per order, customer or user are joined, on
keys without repeats on one side, so no customer, order or user can overload a task.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.functions.scalars import recode, round_half_even
from stayrate.operators import derive
from stayrate.session import once

_MONEY = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _line_facts(lineitem: DataFrame) -> DataFrame:
    """Per order: discounted lines, coupon lines, whether something came back and its worth."""
    price, discount = F.col("l_extendedprice").cast(_MONEY), F.col("l_discount").cast("decimal(4,2)")
    back = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)
    return lineitem.groupBy("l_orderkey").agg(
        F.count_if(F.col("l_discount") >= 0.05).alias("discounts"),
        F.count_if(F.col("l_discount") >= 0.09).alias("coupons"),
        F.max(back.cast("int")).alias("returned"),
        F.sum(F.when(back, price * (F.lit(1).cast("decimal(4,2)") - discount))).alias("refund"),
    )


def _order_facts(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Per customer: order dates, counts and sums, and the priority of the latest order.

    The latest order is found as the largest number made of date, order key and priority digit; a
    number keeps the aggregation hash-based, where a struct with text would make Spark sort.
    """
    wide = "decimal(38,0)"
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    ranked = (
        F.unix_date(F.to_date("o_orderdate")).cast("decimal(6,0)") * F.lit(Decimal(10**20))
        + F.col("o_orderkey").cast("decimal(19,0)") * F.lit(Decimal(10))
        + digit.cast("decimal(1,0)")
    ).cast(wide)
    joined = orders.join(_line_facts(lineitem), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    found = joined.groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("first_order"),
        F.max(F.to_date("o_orderdate")).alias("last_order"),
        F.count("*").alias("orders"),
        F.sum(F.col("o_totalprice").cast(_MONEY)).cast("double").alias("spend"),
        F.sum("discounts").alias("discounts"),
        F.sum("coupons").alias("coupons"),
        F.sum("returned").alias("returned"),
        F.sum("refund").cast("double").alias("refund"),
        F.max(ranked).alias("latest"),
    )
    return found.withColumn("priority", F.pmod("latest", F.lit(Decimal(10))).cast("int")).drop("latest")


def _event_facts(events: DataFrame) -> DataFrame:
    """Per user: counts by event type, and sum and mean of the values."""
    kinds = {"views": "view", "clicks": "click", "purchases": "purchase", "errors": "error"}
    total = F.sum(F.col("value").cast(_MONEY)).cast("double")
    return events.groupBy("user_id").agg(
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in kinds.items()],
        total.alias("value_sum"),
        (total / F.count("value")).alias("value_mean"),
    )


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with all order and event figures; staged once per session."""

    def build() -> DataFrame:
        customer, orders, lineitem, events, nation, region = (
            read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "events", "nation", "region")
        )
        users = events.agg(F.max("user_id") + 1).first()[0]
        geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            "n_nationkey", "n_name", "r_name"
        )
        return (
            customer.withColumn("user", F.pmod(F.col("c_custkey"), F.lit(users)))
            .join(_order_facts(orders, lineitem), F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(_event_facts(events), F.col("user") == F.col("user_id"), "left")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .drop("user", "user_id", "o_custkey", "n_nationkey")
            .fillna(0, ["orders", "discounts", "coupons", "returned", "views", "clicks", "purchases", "errors"])
            .fillna(0.0, ["spend", "refund", "value_sum"])
        )

    return once(spark, ("facts", sf_dir), build)


def _gap(test: Column, value: Column) -> Column:
    """The value, missing where the test holds."""
    return F.when(~test, value)


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncleaned customer table with gaps, messy text and repeated customers.

    Staged once per session: it stands for the stored table that every job reads.
    """
    return once(spark, ("customers", sf_dir), lambda: _raw_customers(spark, sf_dir))


def _raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    last_day = read(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    facts = customer_facts(spark, sf_dir)
    k = F.col("c_custkey")
    months = F.date_diff("last_order", "first_order") / 30
    known = F.coalesce(months, F.lit(0.0))
    churned = F.when(F.col("last_order").isNotNull(), (F.date_diff(F.lit(last_day), "last_order") > 365).cast("bigint"))
    raw = derive.loyalty_raw("orders", known, "spend")
    low, high = derive.loyalty_range(facts, raw)
    loyalty = derive.loyalty_score(raw, low, high)
    city = F.when(k % 4 == 0, F.concat(F.lit("  "), F.lower("n_name"))).otherwise(F.col("n_name"))
    payment = recode("priority", {1: "Credit Card", 2: "Debit Card", 3: " upi ", 4: "COD", 5: "Wallet"})
    copies = F.when(k % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spend = F.col("spend") + F.col("copy")
    columns = {
        "customer_id": F.format_string("C%08d", k.cast("long")),
        "age": _gap(k % 11 == 3, (F.lit(18) + (k * 7919) % 53).cast("double")),
        "gender": _gap(k % 13 == 5, recode(k % 3, {0: "Male", 1: "Female", 2: "Other"})),
        "city": _gap(k % 19 == 7, city),
        "state": F.col("r_name"),
        "country": F.lit(schema.COUNTRY),
        "membership_type": derive.membership_tier(loyalty),
        "registration_date": _gap(
            k % 97 == 13, F.date_format(F.date_sub("first_order", (k % 365).cast("int")), "yyyy-MM-dd")
        ),
        "last_purchase_date": F.date_format("last_order", "yyyy-MM-dd"),
        "purchase_frequency": derive.purchase_frequency("orders", months),
        "total_orders": F.col("orders"),
        "average_order_value": derive.average_order_value("spend", "orders"),
        "total_spend": spend,
        "discount_usage": F.col("discounts"),
        "coupon_usage": F.col("coupons"),
        "session_duration": _gap(k % 17 == 4, F.col("value_mean")),
        "browsing_time": F.floor("value_sum"),
        "pages_viewed": F.col("views") + k % 7,
        "wishlist_items": F.col("clicks") + k % 5,
        "cart_abandonment": _gap(k % 31 == 6, F.greatest(F.col("clicks") - F.col("purchases"), F.lit(0))),
        "payment_method": _gap(k % 23 == 1, payment),
        "returned_orders": F.col("returned"),
        "refund_amount": round_half_even("refund", 2),
        "customer_rating": round_half_even((F.col("c_acctbal") + 1000) * 4 / 11000 + 1, 1),
        "delivery_rating": F.lit(1) + k % 5,
        "support_calls": _gap(k % 37 == 8, F.col("errors").cast("double")),
        "complaints": (F.col("errors") > 16).cast("bigint"),
        "customer_satisfaction": _gap(k % 29 == 2, F.lit(1) + (k * 31) % 5),
        "customer_lifetime_value": derive.lifetime_value("spend", churned, 1.3),
        "customer_segment": _gap(k % 41 == 9, F.col("c_mktsegment")),
        "loyalty_score": loyalty,
        "churn": churned,
        schema.INGEST_ORDER: k * 2 + F.col("copy"),
    }
    doubled = facts.withColumn("copy", F.explode(copies))
    kinds = {f.name: f.dataType for f in schema.raw_schema(with_ingest_order=True)}
    return doubled.select(*[columns[name].cast(kinds[name]).alias(name) for name in kinds])


def base_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13-column base file, one row per customer, with gaps."""
    last_day = read(spark, sf_dir, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    facts = customer_facts(spark, sf_dir)
    k = F.col("c_custkey")
    since = F.date_diff(F.lit(last_day), "last_order")
    columns = {
        "CustomerID": k.cast("string"),
        "Churn": F.coalesce((since > 365).cast("int"), F.lit(0)),
        "Gender": _gap(k % 13 == 5, recode(k % 2, {0: "Male", 1: "Female"})),
        "SatisfactionScore": _gap(k % 29 == 2, F.lit(1) + (k * 31) % 5),
        "Complain": _gap(k % 43 == 3, (F.col("errors") > 16).cast("int")),
        "OrderCount": _gap(k % 59 == 7, F.col("orders")),
        "CouponUsed": _gap(k % 61 == 11, F.col("coupons")),
        "PreferredPaymentMode": _gap(
            k % 23 == 1,
            recode("priority", {1: "Credit Card", 2: "Debit Card", 3: "UPI", 4: "COD", 5: "E wallet"}, "CC"),
        ),
        "HourSpendOnApp": _gap(k % 17 == 4, F.floor("value_sum") / 60),
        "Tenure": _gap(k % 19 == 6, F.floor(F.date_diff("last_order", "first_order") / 30)),
        "DaySinceLastOrder": _gap(k % 31 == 5, since),
        "CityTier": _gap(k % 37 == 9, F.lit(1) + k % 3),
        "CashbackAmount": _gap(k % 47 == 8, round_half_even(F.col("spend") / 1000, 2)),
    }
    kinds = {f.name: f.dataType for f in schema.BASE_SCHEMA}
    return facts.select(*[columns[name].cast(kinds[name]).alias(name) for name in kinds])
