"""One session and the six-row fixture."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stayrate import schema  # noqa: E402
from stayrate.session import drop_staged, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(8, **{"spark.sql.warehouse.dir": str(warehouse)})
    yield session
    drop_staged(session)
    session.stop()


# Six customers with a repeated row, gaps, an outlier and messy text, by column.
SIX = {
    "customer_id": ["C001", "C002", "C003", "C001", "C004", "C005"],
    "age": [25.0, 45.0, None, 25.0, 30.0, 40.0],
    "gender": ["Male", "Female", "Female", "Male", "Male", "Female"],
    "city": ["New York", "Los Angeles", None, "New York", "Chicago", "Miami"],
    "state": ["NY", "CA", "TX", "NY", "IL", "FL"],
    "country": ["USA"] * 6,
    "membership_type": ["Premium", "Basic", "Premium", "Premium", "Basic", "Premium"],
    "registration_date": ["2023-01-01", "2023-05-15", "2023-11-20", "2023-01-01", "2023-02-10", "2023-08-05"],
    "last_purchase_date": ["2023-12-01", "2023-12-15", "2023-12-20", "2023-12-01", "2023-11-01", "2023-12-05"],
    "purchase_frequency": [1.5, 2.0, 3.5, 1.5, 1.0, 4.0],
    "total_orders": [10, 5, 20, 10, 2, 30],
    "average_order_value": [50.0, 20.0, 100.0, 50.0, 75.0, 60.0],
    "total_spend": [500.0, 100.0, 999999.0, 500.0, 150.0, 1800.0],
    "discount_usage": [2, 0, 5, 2, 0, 10],
    "coupon_usage": [1, 0, 2, 1, 0, 5],
    "session_duration": [300.5, 120.0, 600.0, 300.5, 150.0, 450.0],
    "browsing_time": [15, 5, 45, 15, 10, 30],
    "pages_viewed": [10, 3, 25, 10, 5, 20],
    "wishlist_items": [5, 1, 15, 5, 2, 10],
    "cart_abandonment": [2, 0, 5, 2, 1, 3],
    "payment_method": ["Credit Card", "UPI", " upi ", "Credit Card", "Credit Card", "Credit Card"],
    "returned_orders": [0, 0, 1, 0, 0, 2],
    "refund_amount": [0.0, 0.0, 50.0, 0.0, 0.0, 100.0],
    "customer_rating": [4.5, 3.0, 5.0, 4.5, 4.0, 4.8],
    "delivery_rating": [5, 3, 4, 5, 4, 5],
    "support_calls": [0.0, None, 2.0, 0.0, 1.0, 0.0],
    "complaints": [0, 1, 0, 0, 0, 0],
    "customer_satisfaction": [4, 3, 5, 4, 4, 5],
    "customer_lifetime_value": [1000.0, 300.0, 2500.0, 1000.0, 500.0, 4000.0],
    "customer_segment": ["High", "Low", "VIP", "High", "Mid", "VIP"],
    "loyalty_score": [80, 40, 95, 80, 50, 90],
    "churn": [0, 1, 0, 0, 1, 0],
}


@pytest.fixture
def six(spark):
    rows = [(*values, i) for i, values in enumerate(zip(*[SIX[c] for c in schema.ALL_COLUMNS], strict=True))]
    return spark.createDataFrame(rows, schema.raw_schema(with_ingest_order=True))
