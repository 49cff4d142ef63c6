"""Schemas, column roles and fixed domain values of the customer table."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()

# The 32 customer columns in table order with their stored types.
CUSTOMER_FIELDS: tuple[tuple[str, T.DataType], ...] = (
    ("customer_id", S),
    ("age", D),
    ("gender", S),
    ("city", S),
    ("state", S),
    ("country", S),
    ("membership_type", S),
    ("registration_date", S),
    ("last_purchase_date", S),
    ("purchase_frequency", D),
    ("total_orders", L),
    ("average_order_value", D),
    ("total_spend", D),
    ("discount_usage", L),
    ("coupon_usage", L),
    ("session_duration", D),
    ("browsing_time", L),
    ("pages_viewed", L),
    ("wishlist_items", L),
    ("cart_abandonment", L),
    ("payment_method", S),
    ("returned_orders", L),
    ("refund_amount", D),
    ("customer_rating", D),
    ("delivery_rating", L),
    ("support_calls", D),
    ("complaints", L),
    ("customer_satisfaction", L),
    ("customer_lifetime_value", D),
    ("customer_segment", S),
    ("loyalty_score", L),
    ("churn", L),
)
ALL_COLUMNS = tuple(name for name, _ in CUSTOMER_FIELDS)
INGEST_ORDER = "ingest_seq"


def raw_schema(with_ingest_order: bool = False) -> T.StructType:
    """The stored customer table; everything is nullable before cleaning."""
    fields = [T.StructField(name, kind, True) for name, kind in CUSTOMER_FIELDS]
    if with_ingest_order:
        fields.append(T.StructField(INGEST_ORDER, L, True))
    return T.StructType(fields)


# Column roles.
DATE_COLUMNS = ("registration_date", "last_purchase_date")
CATEGORY_COLUMNS = (
    "gender", "city", "state", "country", "membership_type", "payment_method", "customer_segment",
)
INT_COLUMNS = (
    "age", "total_orders", "browsing_time", "pages_viewed", "wishlist_items", "cart_abandonment",
    "returned_orders", "support_calls", "complaints", "delivery_rating", "customer_satisfaction",
    "loyalty_score", "churn", "coupon_usage", "discount_usage",
)
FLOAT_COLUMNS = (
    "purchase_frequency", "average_order_value", "total_spend", "session_duration",
    "refund_amount", "customer_rating", "customer_lifetime_value",
)
ZERO_FILL_COLUMNS = (
    "complaints", "support_calls", "returned_orders", "refund_amount", "coupon_usage",
    "discount_usage", "cart_abandonment",
)
MEDIAN_FILL_COLUMNS = (
    "age", "customer_satisfaction", "customer_rating", "delivery_rating", "browsing_time",
    "session_duration",
)
MODE_FILL_COLUMNS = ("gender", "payment_method", "city", "state")
CRITICAL_COLUMNS = ("customer_id", "registration_date", "churn")
CAPPED_COLUMNS = (
    "total_spend", "average_order_value", "purchase_frequency", "session_duration",
    "browsing_time", "refund_amount", "customer_lifetime_value",
)
SKEWED_COLUMNS = (
    "total_spend", "refund_amount", "customer_lifetime_value", "session_duration", "browsing_time",
)
RFM_COLUMNS = ("last_purchase_date", "total_orders", "total_spend")

# Engagement weights by column.
ENGAGEMENT_WEIGHTS = {
    "session_duration": 0.3,
    "pages_viewed": 0.4,
    "wishlist_items": 0.2,
    "discount_usage": 0.1,
}

# Weights of the risk score; dissatisfaction is the best satisfaction minus the given one.
RISK_WEIGHTS = {"complaints": 0.4, "cart_abandonment": 0.3, "support_calls": 0.2, "dissatisfaction": 0.1}
BEST_SATISFACTION = 5

# Allowed category values.
GENDERS = ("Male", "Female", "Other")
MEMBERSHIPS = ("Basic", "Silver", "Gold", "Premium")
PAYMENT_METHODS = ("Credit Card", "Debit Card", "UPI", "Net Banking", "Wallet", "Cash on Delivery")
SEGMENTS = ("New", "Regular", "Loyal", "VIP", "At Risk", "Dormant")
COUNTRY = "India"
DOMAINS = {
    "gender": GENDERS,
    "membership_type": MEMBERSHIPS,
    "payment_method": PAYMENT_METHODS,
    "customer_segment": SEGMENTS,
}

# Spellings repaired after title-casing, and the third one repaired on request.
PAYMENT_REPAIRS = {"Upi": "UPI", "Cod": "Cash on Delivery"}
PAYMENT_REPAIRS_ALL = {**PAYMENT_REPAIRS, "Cash On Delivery": "Cash on Delivery"}

# Base-file payment modes and the methods they stand for.
PAYMENT_MODE_MAP = {
    "Debit Card": "Debit Card",
    "Credit Card": "Credit Card",
    "E wallet": "Wallet",
    "UPI": "UPI",
    "COD": "Cash on Delivery",
    "Cash on Delivery": "Cash on Delivery",
}

# City and the state it lies in.
CITY_STATE = {
    "Mumbai": "Maharashtra",
    "Delhi": "Delhi",
    "Bangalore": "Karnataka",
    "Hyderabad": "Telangana",
    "Chennai": "Tamil Nadu",
    "Kolkata": "West Bengal",
    "Pune": "Maharashtra",
    "Ahmedabad": "Gujarat",
    "Jaipur": "Rajasthan",
    "Lucknow": "Uttar Pradesh",
    "Chandigarh": "Punjab",
    "Indore": "Madhya Pradesh",
    "Bhopal": "Madhya Pradesh",
    "Surat": "Gujarat",
    "Nagpur": "Maharashtra",
    "Patna": "Bihar",
    "Kochi": "Kerala",
    "Coimbatore": "Tamil Nadu",
    "Visakhapatnam": "Andhra Pradesh",
    "Vadodara": "Gujarat",
}

# Age bands (upper edge, label); the lowest band starts above 0.
AGE_BANDS = ((24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (100, "65+"))

# Names of the five activity bands, lowest first.
ACTIVITY_LEVELS = ("Very Low", "Low", "Medium", "High", "Very High")

# Share of churned customers a realistic table should have.
CHURN_RATE_RANGE = (0.15, 0.25)

# Display names of the high-risk report.
RISK_DISPLAY = {
    "customer_id": "Customer ID",
    "rfm_segment": "RFM Segment",
    "total_spend": "Total Spend ($)",
    "loyalty_score": "Loyalty Score",
    "engagement_score": "Engagement Score",
    "churn": "Actual Churn",
}

# The base file.
BASE_SCHEMA = T.StructType([
    T.StructField("CustomerID", S),
    T.StructField("Churn", T.IntegerType()),
    T.StructField("Gender", S),
    T.StructField("SatisfactionScore", T.IntegerType()),
    T.StructField("Complain", T.IntegerType()),
    T.StructField("OrderCount", T.IntegerType()),
    T.StructField("CouponUsed", T.IntegerType()),
    T.StructField("PreferredPaymentMode", S),
    T.StructField("HourSpendOnApp", D),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("DaySinceLastOrder", T.IntegerType()),
    T.StructField("CityTier", T.IntegerType()),
    T.StructField("CashbackAmount", D),
])

# The exported table: cleaned customers with engineered features and the prediction.
SCORED_EXTRA = (
    ("rfm_segment", S),
    ("engagement_score", D),
    ("predicted_churn", L),
)


def cleaned_schema() -> T.StructType:
    """Types after cleaning."""
    kinds = dict(CUSTOMER_FIELDS)
    kinds.update({c: L for c in INT_COLUMNS})
    kinds.update({c: D for c in FLOAT_COLUMNS})
    kinds.update({c: T.TimestampNTZType() for c in DATE_COLUMNS})
    return T.StructType([T.StructField(c, kinds[c], True) for c in ALL_COLUMNS])


def scored_schema() -> T.StructType:
    """Types of the scored table. Capping always yields doubles, so a capped count is a double."""
    fields = [
        T.StructField(f.name, D if f.name in CAPPED_COLUMNS else f.dataType, True)
        for f in cleaned_schema().fields
    ]
    return T.StructType(fields + [T.StructField(n, t, True) for n, t in SCORED_EXTRA])
