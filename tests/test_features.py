"""Segments, engagement, encoding, scaling and named features."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.errors import InputError, NotFittedError, OptionError
from stayrate.operators import checks, clean, derive, encode, engagement, features, rfm
from stayrate.plans import augment


@pytest.fixture(scope="module")
def people(spark):
    frame = spark.range(50).select(
        F.col("id").cast("string").alias("customer_id"),
        F.expr("timestamp_ntz'2024-01-31' - make_dt_interval(int(id))").alias("last_purchase_date"),
        (F.col("id") + 1).alias("total_orders"),
        (F.col("id") * 10.0).alias("total_spend"),
        (F.col("id") * 1.5).alias("session_duration"),
        (F.col("id") % 7).alias("pages_viewed"),
        F.lit(4).cast("bigint").alias("wishlist_items"),
        (F.lit(50) - F.col("id")).alias("discount_usage"),
    )
    return frame.persist()


def test_rfm_scores_and_segments(people):
    params = rfm.fit_rfm(people)
    assert params.reference == "2024-01-31 00:00:00"
    np.testing.assert_allclose(params.recency, np.quantile(np.arange(50), rfm.FIFTHS))
    rows = {r["customer_id"]: r for r in rfm.rfm_components(people, params).collect()}
    assert (rows["0"]["recency_score"], rows["0"]["frequency_score"]) == (5, 1)
    assert (rows["49"]["recency_score"], rows["49"]["monetary_score"]) == (1, 5)
    assert rows["0"]["rfm_score_text"] == "511" and rows["0"]["rfm_score"] == 511
    found = {r["customer_id"]: r["rfm_segment"] for r in rfm.apply_rfm(people, params).collect()}
    assert found["0"] == "Recent Users" and found["49"] == "At Risk"


def test_segment_rules_in_order(spark):
    cases = {(5, 5, 5): "Champions", (4, 4, 4): "Champions", (4, 4, 3): "Loyal Customers", (3, 3, 1): "Loyal Customers",
             (5, 2, 5): "Recent Users", (2, 4, 1): "At Risk", (2, 2, 5): "Lost", (3, 2, 3): "Average",
             (2, 3, 3): "Average", (None, 5, 5): "Unknown", (5, 5, None): "Unknown"}
    frame = spark.createDataFrame([(*k, v) for k, v in cases.items()], "r int, f int, m int, want string")
    got = frame.select(rfm.segment(F.col("r"), F.col("f"), F.col("m")), "want").collect()
    assert all(a == b for a, b in got)


def test_frozen_boundaries_hold_for_values_beyond_them(people):
    params = rfm.fit_rfm(people)
    beyond = people.limit(1).select(
        F.expr("timestamp_ntz'2025-01-01'").alias("last_purchase_date"),
        F.lit(10_000).alias("total_orders"), F.lit(-5.0).alias("total_spend"),
    )
    row = rfm.rfm_components(beyond, params).first()
    assert (row["recency_score"], row["frequency_score"], row["monetary_score"]) == (5, 5, 1)
    assert row["recency_days"] == -336
    missing = beyond.withColumn("last_purchase_date", F.lit(None).cast("timestamp_ntz"))
    assert rfm.rfm_components(missing, params).first()["rfm_score_text"].startswith("nan")
    assert rfm.apply_rfm(missing, params).first()["rfm_segment"] == "Unknown"


def test_equal_edges_are_merged(spark):
    rows = [("2024-01-01", n, 5.0) for n in (1, 1, 1, 1, 2, 3)]
    frame = spark.createDataFrame(rows, "d string, total_orders long, total_spend double")
    frame = frame.withColumn("last_purchase_date", F.col("d").cast("timestamp_ntz"))
    params = rfm.fit_rfm(frame)
    assert params.orders == [1.0, 2.0, 3.0]
    assert params.spend == [5.0]
    scored = rfm.rfm_components(frame, params)
    assert sorted(r["frequency_score"] for r in scored.collect()) == [1, 1, 1, 1, 1, 2]
    assert {r["rfm_segment"] for r in rfm.apply_rfm(frame, params).collect()} == {"Unknown"}


def test_engagement_range_and_constant_input(people):
    params = engagement.fit_engagement(people)
    assert params.ranges["wishlist_items"] == [4.0, 4.0]
    scores = [r["engagement_score"] for r in engagement.apply_engagement(people, params).collect()]
    assert min(scores) == 0.0 and max(scores) == 100.0
    wider = people.withColumn("session_duration", F.lit(1e9))
    assert engagement.apply_engagement(wider, params).agg(F.max("engagement_score")).first()[0] == 100.0
    other = engagement.fit_engagement(people, (1.0, 5.0))
    scores = [r["engagement_score"] for r in engagement.apply_engagement(people, other).collect()]
    assert min(scores) == 1.0 and max(scores) == 5.0


def test_nothing_fitted_is_an_error(people):
    for call in (rfm.apply_rfm, engagement.apply_engagement, features.apply_features, encode.apply_onehot, encode.apply_scaler):
        with pytest.raises(NotFittedError):
            call(people, None)
    with pytest.raises(InputError):
        rfm.fit_rfm(people.where("false"))
    with pytest.raises(InputError):
        engagement.fit_engagement(people.where("false"))
    with pytest.raises(InputError):
        rfm.fit_rfm(people.drop("total_spend"))


def test_fitting_does_not_see_other_rows(people):
    train = people.where("customer_id < '3'")
    alone = features.fit_features(train)
    features.apply_features(people, alone)
    assert alone == features.fit_features(train)
    assert features.apply_features(people, alone).count() == people.count()


def test_onehot(spark):
    train = spark.createDataFrame([("b", "x", 1.0), ("a", "x", 2.0), ("c", "x", 3.0)], "k string, one string, v double")
    params = encode.fit_onehot(train, ["k", "one"])
    assert params.categories == {"k": ["a", "b", "c"], "one": ["x"]}
    new = spark.createDataFrame([("c", "x", 1.0), ("z", "y", 2.0)], "k string, one string, v double")
    done = encode.apply_onehot(new, params)
    assert done.columns == ["v", "k_b", "k_c"]
    assert [tuple(r) for r in done.collect()] == [(1.0, 0.0, 1.0), (2.0, 0.0, 0.0)]
    with pytest.raises(OptionError):
        encode.fit_onehot(train, [])
    with pytest.raises(InputError):
        encode.fit_onehot(train, ["k"], max_categories=2)


@pytest.mark.parametrize("method", encode.SCALERS)
def test_scalers(spark, method):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    train = spark.createDataFrame([(float(v), 3.0) for v in x], "x double, same double")
    params = encode.fit_scaler(train, ["x", "same"], method)
    expected = {
        "standard": (x - x.mean()) / x.std(),
        "minmax": (x - 1) / 8,
        "robust": (x - np.median(x)) / (np.quantile(x, 0.75) - np.quantile(x, 0.25)),
    }[method]
    rows = encode.apply_scaler(train, params).orderBy("x").collect()
    np.testing.assert_allclose([r["x"] for r in rows], expected)
    assert {r["same"] for r in rows} == {0.0}


def test_scaler_arguments(spark):
    frame = spark.createDataFrame([("a", 1.0)], "t string, x double")
    with pytest.raises(OptionError):
        encode.fit_scaler(frame, ["x"], "cubic")
    with pytest.raises(OptionError):
        encode.fit_scaler(frame, [])
    with pytest.raises(InputError):
        encode.fit_scaler(frame, ["t"])
    with pytest.raises(InputError):
        encode.fit_scaler(frame.where("false"), ["x"])


def test_named_features(spark, six):
    tidy = clean.clean_customers(six)
    rows = {r["customer_id"]: r for r in tidy.select(
        "customer_id",
        features.age_group("age").alias("band"),
        features.risk_score().alias("risk"),
        features.complaint_ratio().alias("complaint"),
        features.premium_flag().alias("premium"),
        features.lifetime_days().alias("life"),
    ).collect()}
    assert rows["C003"]["band"] == "35-44" and rows["C001"]["band"] == "25-34"
    assert rows["C002"]["risk"] == pytest.approx(0.4 + 0.2)
    assert rows["C002"]["complaint"] is None
    assert rows["C004"]["premium"] == 0 and rows["C005"]["premium"] == 1
    assert rows["C001"]["life"] == 334
    ages = spark.createDataFrame([(0,), (1,), (24,), (100,), (101,), (None,)], "age int")
    assert [r[0] for r in ages.select(features.age_group("age")).collect()] == [None, "18-24", "18-24", "65+", None, None]
    vip = {r["customer_id"]: r["vip_flag"] for r in features.with_vip_flag(tidy).collect()}
    assert vip == {"C001": 0, "C002": 0, "C003": 0, "C004": 0, "C005": 1}


def test_purchase_interval_like_consecutive_gaps(spark):
    days = {"a": [1, 4, 10], "b": [5], "c": [2, 2, 8]}
    rows = [(k, f"2024-01-{d:02d}") for k, v in days.items() for d in v]
    frame = spark.createDataFrame(rows, "c string, d string")
    found = {r["c"]: r["purchase_interval"] for r in features.purchase_interval(frame, "c", "d").collect()}
    assert found == {"a": np.mean(np.diff(days["a"])), "b": None, "c": np.mean(np.diff(days["c"]))}


def test_filters_and_domains(spark):
    frame = spark.createDataFrame(
        [("Male", "Gold", "Mumbai", "Maharashtra"), ("Male", None, "Mumbai", "Goa"), (None, "Iron", "Paris", "X")],
        "gender string, membership_type string, city string, state string",
    )
    assert checks.filter_members(frame, {"gender": ["Male"], "membership_type": ["Gold"]}).count() == 1
    found = {r["rule"]: r["violations"] for r in checks.domain_violations(
        frame, {"gender": schema.GENDERS, "membership_type": schema.MEMBERSHIPS}).collect()}
    assert found == {"gender": 1, "membership_type": 2, "city_state": 1}


def test_base_file_to_customers(spark):
    rows = [
        ("1", 0, "Male", 4, 1, 3, 2, "E wallet", 1.5, 10, 5, 1, 200.0),
        ("2", 1, None, None, None, None, None, "CC", None, None, None, None, None),
    ]
    base = spark.createDataFrame(rows, schema.BASE_SCHEMA)
    factors = derive.Factors(city_pick=F.col("CustomerID").cast("int"), cashback_rate=0.04, returned=9)
    done = {r["customer_id"]: r for r in augment.augment(base, "2024-03-31", factors).collect()}
    one, two = done["1"], done["2"]
    assert one["payment_method"] == "Wallet" and two["payment_method"] == "Credit Card"
    assert one["total_spend"] == 5000.0 and two["total_spend"] == 2500.0
    assert one["average_order_value"] == round(5000 / 3, 2)
    assert one["purchase_frequency"] == 3.6 and two["purchase_frequency"] == 10.0
    assert (one["registration_date"], one["last_purchase_date"]) == ("2023-06-05", "2024-03-26")
    assert two["registration_date"] == "2024-03-31"
    assert (one["city"], one["state"], two["city"]) == ("Delhi", "Delhi", "Surat")
    assert one["browsing_time"] == 90 and two["browsing_time"] == 120
    assert one["returned_orders"] == 3 and two["returned_orders"] == 1
    assert one["customer_lifetime_value"] == 6500.0 and two["customer_lifetime_value"] == 2500.0
    assert one["loyalty_score"] == 99 and two["loyalty_score"] == 1
    assert one["membership_type"] == "Premium" and two["membership_type"] == "Basic"
    assert two["gender"] == "Other" and two["customer_satisfaction"] == 3
    assert list(one.asDict()) == list(schema.ALL_COLUMNS)
