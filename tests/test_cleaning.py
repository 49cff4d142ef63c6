"""Cleaning and outliers on the six-row fixture, with results worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schema
from stayrate.errors import CleaningError, InputError, OptionError
from stayrate.operators import checks, clean, outliers
from stayrate.plans import preprocess
from stayrate.session import stage


def by_id(df, column):
    return {r["customer_id"]: r[column] for r in df.collect()}


def test_no_rows_is_an_error(six):
    empty = six.where(F.lit(False))
    with pytest.raises(CleaningError):
        clean.clean_customers(empty)
    with pytest.raises(InputError):
        outliers.treat(empty, ["total_spend"])
    with pytest.raises(InputError):
        checks.require_non_empty(None)


def test_missing_columns_are_named(six):
    with pytest.raises(CleaningError, match="churn"):
        clean.clean_customers(six.drop("churn"))


def test_first_of_repeated_customers_is_kept(six):
    changed = six.withColumn("age", F.when(F.col(schema.INGEST_ORDER) == 3, 99.0).otherwise(F.col("age")))
    rows = clean.dedupe_first(changed).orderBy(schema.INGEST_ORDER).collect()
    assert [r["customer_id"] for r in rows] == ["C001", "C002", "C003", "C004", "C005"]
    assert rows[0]["age"] == 25.0
    assert clean.duplicate_count(six).first()[0] == 1


def test_customers_without_id_count_as_one(six):
    nameless = six.withColumn("customer_id", F.when(F.col("churn") == 0, F.col("customer_id")))
    assert clean.dedupe_first(nameless).where(F.col("customer_id").isNull()).count() == 1


def test_hot_customer_is_reduced_before_the_shuffle(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', string(id)) AS customer_id", "id AS ingest_seq")
    found = clean.dedupe_first(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert found.count() == 13_334
    assert found.where("customer_id = 'hot'").first()["ingest_seq"] == 0


def test_gaps_are_filled(six):
    done = clean.clean_customers(six, stage)
    assert by_id(done, "support_calls")["C002"] == 0
    assert by_id(done, "age")["C003"] == 35
    assert by_id(done, "city")["C003"] == "Chicago"


def test_types_and_texts(six):
    done = clean.clean_customers(six)
    assert done.count() == 5
    kinds = dict(done.dtypes)
    assert all(kinds[c] == "bigint" for c in schema.INT_COLUMNS)
    assert all(kinds[c] == "double" for c in schema.FLOAT_COLUMNS)
    assert all(kinds[c] == "timestamp_ntz" for c in schema.DATE_COLUMNS)
    assert set(by_id(done, "payment_method").values()) == {"Credit Card", "UPI"}
    assert by_id(done, "state")["C001"] == "Ny"
    assert by_id(done, "country")["C001"] == "Usa"
    assert by_id(done, "customer_segment")["C003"] == "Vip"


def test_missing_labels_and_unreadable_values(six):
    odd = six.withColumns({
        "customer_segment": F.lit(None).cast("string"),
        "total_orders": F.when(F.col("customer_id") == "C002", "abc").otherwise("12.7"),
        "registration_date": F.when(F.col("customer_id") == "C002", "soon").otherwise(F.col("registration_date")),
        "total_spend": F.when(F.col("customer_id") == "C004", float("nan")).otherwise(F.col("total_spend")),
        "churn": F.when(F.col("customer_id") == "C005", None).otherwise(F.col("churn")),
    })
    done = clean.clean_customers(odd)
    assert by_id(done, "customer_segment") == {c: "Nan" for c in ("C001", "C002", "C003", "C004")}
    assert by_id(done, "total_orders")["C002"] == 0
    assert by_id(done, "total_orders")["C001"] == 12
    assert by_id(done, "registration_date")["C002"] is None
    assert by_id(done, "total_spend")["C004"] == 0.0


def test_infinite_integer_is_an_error(spark):
    frame = spark.createDataFrame([(float("inf"),)], "age double")
    with pytest.raises(Exception, match="infinite"):
        clean.cast_int(frame, ["age"]).collect()


def test_no_mode_is_an_error(six):
    with pytest.raises(CleaningError, match="gender"):
        clean.clean_customers(six.withColumn("gender", F.lit(None).cast("string")))


def test_payment_spellings(spark):
    frame = spark.createDataFrame([("Upi",), ("Cod",), ("Cash On Delivery",), ("Wallet",)], "payment_method string")
    kept = [r[0] for r in clean.fix_acronyms(frame).collect()]
    assert kept == ["UPI", "Cash on Delivery", "Cash On Delivery", "Wallet"]
    assert [r[0] for r in clean.fix_acronyms(frame, repair_all=True).collect()][2] == "Cash on Delivery"


def test_modes_ignore_gaps_and_break_ties_downwards(spark):
    frame = spark.createDataFrame([("b", None), ("a", None), (None, "x")], "p string, q string")
    assert clean.fit_modes(frame, ["p", "q"]) == {"p": "a", "q": "x"}


def test_outlier_is_capped(six):
    tidy = clean.clean_customers(six)
    bounds = outliers.iqr_bounds(tidy, ["total_spend"])
    assert bounds["total_spend"] == (-2325.0, 4275.0)
    done = by_id(outliers.treat(tidy, ["total_spend"]), "total_spend")
    assert done == {"C001": 500.0, "C002": 100.0, "C003": 4275.0, "C004": 150.0, "C005": 1800.0}
    removed = outliers.treat(tidy, ["total_spend"], treatment="remove")
    assert sorted(by_id(removed, "total_spend")) == ["C001", "C002", "C004", "C005"]
    kept = outliers.treat(tidy, ["total_spend"], treatment="keep")
    assert by_id(kept, "total_spend")["C003"] == 999999.0


def test_whole_preparation(six, tmp_path):
    table = preprocess.preprocess_customers(six, str(tmp_path / "clean"), "csv")
    assert table.count() == 5
    assert table.columns == list(schema.ALL_COLUMNS)
    assert all(v is not None for r in table.collect() for v in r)
    assert by_id(table, "total_spend")["C003"] == 4275.0
    written = six.sparkSession.read.option("header", True).csv(str(tmp_path / "clean"))
    assert written.count() == 5


def test_bounds_of_odd_columns(spark):
    frame = spark.createDataFrame([(1.0, 5.0, None)], "one double, same double, none double")
    assert outliers.zscore_bounds(frame, ["one"]) == {"one": (None, None)}
    assert outliers.iqr_bounds(frame, ["none"]) == {"none": (None, None)}
    constant = spark.createDataFrame([(7.0,)] * 3, "x double")
    assert outliers.zscore_bounds(constant, ["x"]) == {"x": (7.0, 7.0)}
    gaps = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (100.0,), (None,)], "x double")
    flagged = outliers.outlier_counts(gaps, {"x": (0.0, 10.0)}).collect()
    assert [tuple(r) for r in flagged] == [("x", 1)]
    assert outliers.remove(gaps, ["x"], "zscore", 1.0).where("x IS NULL").count() == 1


def test_zero_reach_means_the_default(six):
    tidy = clean.clean_customers(six)
    assert outliers.iqr_bounds(tidy, ["total_spend"], 0) == outliers.iqr_bounds(tidy, ["total_spend"])


def test_wrong_arguments(six):
    with pytest.raises(OptionError):
        outliers.treat(six, ["total_spend"], method="guess")
    with pytest.raises(OptionError):
        outliers.treat(six, ["total_spend"], treatment="hide")
    with pytest.raises(OptionError):
        outliers.treat(six, [])
    with pytest.raises(InputError):
        outliers.treat(six, ["gender"])
    with pytest.raises(InputError):
        outliers.treat(six, ["absent"])


def test_bounds_from_training_rows_only(spark, six):
    many = spark.range(400).selectExpr("id", "id % 6 AS ingest_seq").join(six, "ingest_seq").withColumns({
        "customer_id": F.concat(F.lit("N"), F.col("id")),
        "ingest_seq": F.col("id"),
        "total_spend": F.when(F.col("id") == 7, 1e9).otherwise(F.col("id") * 1.0),
    }).drop("id")
    everywhere = preprocess.prepare(many)
    from_train = preprocess.prepare(many, fit_on="train")
    assert from_train.table.count() == everywhere.table.count() == 400
    assert from_train.bounds["total_spend"] != everywhere.bounds["total_spend"]
    with pytest.raises(OptionError):
        preprocess.prepare(many, fit_on="test")


def test_columns_by_type(six):
    text, numeric = checks.columns_by_type(six, skip=["customer_id", "churn"])
    assert "gender" in text and "customer_id" not in text
    assert "age" in numeric and "churn" not in numeric
    assert isinstance(six.schema["age"].dataType, T.DoubleType)
