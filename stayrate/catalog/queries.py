"""Named queries: each takes a session and a folder of tables and returns a DataFrame.

The stored artefacts of a customer-analytics job, the raw table, the cleaned table and the scored
table, are staged once per session and shared; every operator runs over whole tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.functions.scalars import (
    clip, days_between, label_churn, label_prediction, min_max, month_bucket, round_half_even, round_half_up,
)
from stayrate.operators import (
    checks, clean, derive, dictionary, encode, engagement, features, metrics, model, observed, outliers, reports, rfm, split, tuning,
)
from stayrate.plans import augment, preprocess, training
from stayrate.session import keep, once, shared_folder, stage, tuned
from stayrate.sources import artifacts, files, layout
from stayrate.sources.customers import base_customers, raw_customers, read
from stayrate.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RISK_LIMIT = 5.0  # the rule prediction: customers at or above this risk score are expected to leave
ANCHOR = "2002-01-01"


def query(name: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = lambda s, d: f(tuned(s), d)
        return f

    return register


# --- shared tables and parameters -----------------------------------------------------------------


def _prepared(s: SparkSession, d: str) -> preprocess.Prepared:
    def build() -> preprocess.Prepared:
        made = preprocess.prepare(raw_customers(s, d))
        marked = once(s, ("marked", d), lambda: split.assign_test(made.table))
        return preprocess.Prepared(marked.drop("is_test"), made.fills, made.bounds)

    return keep(s, ("prepared", d), build)


def _typed(s: SparkSession, d: str) -> DataFrame:
    """Cleaned but not capped."""
    return once(s, ("typed", d), lambda: clean.clean_customers(raw_customers(s, d), stage))


def _unique(s: SparkSession, d: str) -> DataFrame:
    return once(s, ("unique", d), lambda: clean.dedupe_first(clean.nan_to_null(raw_customers(s, d))))


def _marked(s: SparkSession, d: str) -> DataFrame:
    """The prepared table with its split, as staged with it."""
    _prepared(s, d)
    return once(s, ("marked", d), lambda: split.assign_test(_prepared(s, d).table))


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    marked = _marked(s, d)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")


def _feature_params(s: SparkSession, d: str) -> features.FeatureParams:
    return keep(s, ("features", d), lambda: features.fit_features(_parts(s, d)[0]))


def _risky(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_score", features.risk_score())


def _scored(s: SparkSession, d: str) -> DataFrame:
    """All cleaned rows with engineered features and the rule prediction."""

    def build() -> DataFrame:
        wide = _risky(features.apply_features(_prepared(s, d).table, _feature_params(s, d)))
        wide = wide.withColumn("predicted_churn", (F.col("risk_score") >= RISK_LIMIT).cast("bigint"))
        return wide.select(*[f.name for f in schema.scored_schema()], "risk_score")

    return once(s, ("scored", d), build)


def _matrix(s: SparkSession, d: str) -> tuple[model.MatrixParams, DataFrame]:
    return keep(s, ("matrix", d), lambda: model.fit_matrix(_parts(s, d)[0]))


def _bundle(s: SparkSession, d: str) -> model.Bundle:
    def build() -> model.Bundle:
        params, matrix = _matrix(s, d)
        made = _prepared(s, d)
        return model.Bundle(params, model.train_model(matrix, params.names()), made.fills, made.bounds)

    return keep(s, ("bundle", d), build)


def _r6(c: Column | str) -> Column:
    return round_half_up(c, 6)


def _params_frame(s: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A handful of fitted numbers as a table."""
    return s.createDataFrame(rows, fields)


def _folder(s: SparkSession, kind: str, d: str) -> str:
    """Where a query leaves what it writes from the tables in ``d``; deleted with the staged tables."""
    name = hashlib.md5(d.encode()).hexdigest()
    return f"{shared_folder(s)}/staged/{s.sparkContext.applicationId}/{kind}-{name}"


# --- sources ---------------------------------------------------------------------------------------


@query("scan_table")
def scan_table(s, d):
    return clean.nan_to_null(raw_customers(s, d))


@query("export_scored")
def export_scored(s, d):
    path = _folder(s, "export", d)
    files.export_scored(training.scored_table(_prepared(s, d).table, _bundle(s, d)), path)
    return files.scan_scored(s, path)


@query("batch_score")
def batch_score(s, d):
    path = _folder(s, "bundle", d)
    artifacts.save_bundle(s, _bundle(s, d), path)
    return scoring.score(raw_customers(s, d), artifacts.load_bundle(s, path), probability=True)


# --- checks ----------------------------------------------------------------------------------------


@query("drop_missing_critical")
def drop_missing_critical(s, d):
    return clean.drop_missing_critical(_unique(s, d))


@query("filter_membership_lists")
def filter_membership_lists(s, d):
    return checks.filter_members(_scored(s, d), {
        "gender": ["Female", "Other"],
        "membership_type": ["Silver", "Gold"],
        "rfm_segment": ["Champions", "At Risk", "Lost"],
    }).select("customer_id", "gender", "membership_type", "rfm_segment", "churn")


@query("filter_predicted_churn")
def filter_predicted_churn(s, d):
    return checks.filter_predicted_churn(_scored(s, d)).select("customer_id", "predicted_churn", "churn")


@query("distinct_options")
def distinct_options(s, d):
    return checks.distinct_options(_scored(s, d), ["gender", "membership_type", "rfm_segment"])


@query("domain_violations")
def domain_violations(s, d):
    return checks.domain_violations(_typed(s, d))


@query("observed_checks")
def observed_checks(s, d):
    """Domain, label and outlier figures, collected while the cleaned table is written."""
    rows = _typed(s, d)
    figures = observed.stage_checked(rows, "checked", outliers.iqr_bounds(rows, _CAPPED))[1]
    return figures.withColumn("figure", _r6("figure"))


@query("label_rate_check")
def label_rate_check(s, d):
    return checks.label_rate_check(_typed(s, d)).withColumn("churn_rate", _r6("churn_rate"))


# --- casts and scalars -------------------------------------------------------------------------------


@query("cast_int")
def cast_int(s, d):
    return clean.cast_int(_unique(s, d)).select("customer_id", *schema.INT_COLUMNS)


@query("cast_float")
def cast_float(s, d):
    return clean.cast_float(_unique(s, d)).select("customer_id", *schema.FLOAT_COLUMNS)


@query("parse_dates")
def parse_dates(s, d):
    return clean.parse_dates(_unique(s, d)).select("customer_id", *schema.DATE_COLUMNS)


@query("normalise_strings")
def normalise_strings(s, d):
    done = clean.normalise_strings(_unique(s, d), schema.CATEGORY_COLUMNS)
    return done.select("customer_id", *schema.CATEGORY_COLUMNS)


@query("null_category_label")
def null_category_label(s, d):
    columns = ["country", "membership_type", "customer_segment"]
    return clean.label_missing(_unique(s, d), columns).select("customer_id", *columns)


@query("fix_acronyms")
def fix_acronyms(s, d):
    titled = clean.normalise_strings(_unique(s, d), ["payment_method"])
    return clean.fix_acronyms(titled).select("customer_id", "payment_method")


@query("map_values")
def map_values(s, d):
    return base_customers(s, d).select(
        "CustomerID",
        derive.mapped_gender("Gender").alias("gender"),
        derive.mapped_payment("PreferredPaymentMode").alias("payment_method"),
    )


@query("recode_labels")
def recode_labels(s, d):
    return _scored(s, d).select(
        "customer_id",
        label_churn("churn").alias("churn_status"),
        label_prediction("predicted_churn").alias("prediction"),
    )


@query("fill_defaults")
def fill_defaults(s, d):
    return derive.fill_defaults(base_customers(s, d))


@query("hours_to_minutes")
def hours_to_minutes(s, d):
    return base_customers(s, d).select("CustomerID", derive.hours_to_minutes("HourSpendOnApp").alias("browsing_time"))


def _anchor() -> Column:
    return F.lit(ANCHOR).cast("date")


@query("date_back_from_anchor")
def date_back_from_anchor(s, d):
    return base_customers(s, d).select(
        "CustomerID",
        derive.date_back(_anchor(), F.col("Tenure") * 30).alias("registration_date"),
        derive.date_back(_anchor(), "DaySinceLastOrder").alias("last_purchase_date"),
    )


@query("city_to_state")
def city_to_state(s, d):
    placed = base_customers(s, d).withColumn("city", derive.city_of_tier("CityTier", F.col("CustomerID").cast("bigint")))
    return placed.select(
        "CustomerID", "city", derive.state_of_city("city").alias("state"), F.lit(schema.COUNTRY).alias("country")
    )


@query("spend_from_cashback")
def spend_from_cashback(s, d):
    spend = derive.spend_from_cashback("CashbackAmount", 0.04)
    return base_customers(s, d).select("CustomerID", round_half_even(spend).alias("total_spend"))


@query("average_order_value")
def average_order_value(s, d):
    return raw_customers(s, d).select(
        "ingest_seq", derive.average_order_value("total_spend", "total_orders").alias("average_order_value")
    )


@query("purchase_frequency")
def purchase_frequency(s, d):
    return base_customers(s, d).select(
        "CustomerID",
        derive.purchase_frequency(F.coalesce("OrderCount", F.lit(1)), "Tenure").alias("purchase_frequency"),
    )


@query("bounded_returns")
def bounded_returns(s, d):
    return raw_customers(s, d).select(
        "ingest_seq", derive.bounded_returns(F.col("returned_orders") * 7, "total_orders").alias("returned_orders")
    )


@query("lifetime_value")
def lifetime_value(s, d):
    return raw_customers(s, d).select(
        "ingest_seq", derive.lifetime_value("total_spend", "churn", 1.25).alias("customer_lifetime_value")
    )


@query("loyalty_score")
def loyalty_score(s, d):
    base = derive.fill_defaults(base_customers(s, d))
    raw = derive.loyalty_raw("OrderCount", "Tenure", F.col("CashbackAmount") * 25)
    low, high = derive.loyalty_range(base, raw)
    return base.select("CustomerID", derive.loyalty_score(raw, low, high).alias("loyalty_score"))


@query("membership_tier")
def membership_tier(s, d):
    return raw_customers(s, d).select(
        "ingest_seq", "loyalty_score", derive.membership_tier("loyalty_score").alias("membership_type")
    )


@query("constant_columns")
def constant_columns(s, d):
    return base_customers(s, d).select(
        "CustomerID", F.lit(schema.COUNTRY).alias("country"), F.lit("Regular").alias("customer_segment")
    )


@query("behaviour_from_factors")
def behaviour_from_factors(s, d):
    return raw_customers(s, d).select(
        "ingest_seq",
        derive.discount_usage("coupon_usage", 1.5).alias("discount_usage"),
        derive.session_duration("browsing_time", "total_orders", 3.5).alias("session_duration"),
        derive.pages_viewed(derive.session_duration("browsing_time", "total_orders", 3.5), 2.25).alias("pages_viewed"),
        derive.refund_amount("returned_orders", "average_order_value", 0.9).alias("refund_amount"),
        derive.support_calls("complaints", 2.25).alias("support_calls"),
    )


@query("bounded_ratings")
def bounded_ratings(s, d):
    return base_customers(s, d).select(
        "CustomerID",
        derive.delivery_rating("SatisfactionScore", 0.75).alias("delivery_rating"),
        derive.customer_rating("SatisfactionScore", -0.25).alias("customer_rating"),
    )


@query("augment_base")
def augment_base(s, d):
    factors = derive.Factors(city_pick=F.col("CustomerID").cast("bigint"), returned=F.col("Complain") * 3)
    return augment.augment(base_customers(s, d), ANCHOR, factors)


@query("reorder_columns")
def reorder_columns(s, d):
    return raw_customers(s, d).select("ingest_seq", *schema.ALL_COLUMNS).select(*schema.ALL_COLUMNS)


@query("drop_columns")
def drop_columns(s, d):
    return _scored(s, d).drop("registration_date", "last_purchase_date", "customer_id", "churn", "risk_score", "absent")


@query("rename_columns")
def rename_columns(s, d):
    return reports.display_names(_scored(s, d).select(*schema.RISK_DISPLAY))


@query("month_bucket")
def month(s, d):
    return clean.parse_dates(_unique(s, d)).select("customer_id", month_bucket("registration_date").alias("month"))


@query("days_between")
def days(s, d):
    events = read(s, d, "events")
    return events.select(
        "event_id", days_between("ts", F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).alias("days")
    )


@query("clip")
def clipped(s, d):
    return _unique(s, d).select("customer_id", clip("age", 25.0, 60.0).alias("age"))


@query("round_half_even")
def half_even(s, d):
    return read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", round_half_even(F.col("l_extendedprice") * F.lit(0.125)).alias("eighth")
    )


@query("log_sqrt_transform")
def log_sqrt(s, d):
    wide = features.log_sqrt_transform(_typed(s, d))
    added = [f"{c}_{k}" for c in schema.SKEWED_COLUMNS for k in ("log", "sqrt")]
    return wide.select("customer_id", *[_r6(c).alias(c) for c in added])


# --- cleaning ----------------------------------------------------------------------------------------


@query("dedupe_first")
def dedupe_first(s, d):
    return clean.dedupe_first(raw_customers(s, d))


@query("dedupe_all_columns")
def dedupe_all(s, d):
    return clean.dedupe_rows(raw_customers(s, d).select(*schema.ALL_COLUMNS))


@query("duplicate_count")
def duplicate_count(s, d):
    return clean.duplicate_count(raw_customers(s, d))


@query("impute_zero")
def impute_zero(s, d):
    return clean.impute_zero(_unique(s, d)).select("customer_id", *schema.ZERO_FILL_COLUMNS)


@query("impute_median")
def impute_median(s, d):
    rows = _unique(s, d)
    return clean.impute_median(rows, clean.fit_medians(rows)).select("customer_id", *schema.MEDIAN_FILL_COLUMNS)


@query("impute_mode")
def impute_mode(s, d):
    rows = _unique(s, d)
    return clean.impute_mode(rows, clean.fit_modes(rows)).select("customer_id", *schema.MODE_FILL_COLUMNS)


@query("clean_customers")
def clean_customers(s, d):
    return clean.clean_customers(raw_customers(s, d), stage)


# --- outliers ----------------------------------------------------------------------------------------

_CAPPED = list(schema.CAPPED_COLUMNS)


def _bounds_frame(s: SparkSession, bounds: outliers.Bounds) -> DataFrame:
    rows = [(c, float(lo), float(hi)) for c, (lo, hi) in bounds.items()]
    frame = _params_frame(s, rows, "column string, low double, high double")
    return frame.select("column", _r6("low").alias("low"), _r6("high").alias("high"))


@query("iqr_bounds")
def iqr_bounds(s, d):
    return _bounds_frame(s, outliers.iqr_bounds(_typed(s, d), _CAPPED))


@query("zscore_bounds")
def zscore_bounds(s, d):
    return _bounds_frame(s, outliers.zscore_bounds(_typed(s, d), _CAPPED))


@query("outlier_flag_count")
def outlier_flag_count(s, d):
    rows = _typed(s, d)
    return outliers.outlier_counts(rows, outliers.iqr_bounds(rows, _CAPPED))


@query("outlier_keep")
def outlier_keep(s, d):
    return outliers.treat(_typed(s, d), _CAPPED, treatment="keep").select("customer_id", *_CAPPED)


@query("outlier_remove")
def outlier_remove(s, d):
    return outliers.treat(_typed(s, d), _CAPPED, treatment="remove").select("customer_id", *_CAPPED)


@query("outlier_cap")
def outlier_cap(s, d):
    done = outliers.treat(_typed(s, d), _CAPPED, method="zscore", treatment="cap", reach=2.0)
    return done.select("customer_id", *[_r6(c).alias(c) for c in _CAPPED])


@query("cap_continuous_features")
def cap_continuous(s, d):
    return outliers.cap_continuous(_typed(s, d)).select("customer_id", *[_r6(c).alias(c) for c in _CAPPED])


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: _r6(c) for c in columns})


@query("preprocess_customers")
def preprocess_customers(s, d):
    return _rounded(preprocess.preprocess_customers(raw_customers(s, d)), _CAPPED)


@query("winsorize_percentile")
def winsorize(s, d):
    return outliers.winsorize(_typed(s, d), _CAPPED).select("customer_id", *[_r6(c).alias(c) for c in _CAPPED])


# --- split and features --------------------------------------------------------------------------------


@query("stratified_split")
def stratified_split(s, d):
    return _marked(s, d).select("customer_id", "churn", "is_test")


@query("stratified_folds")
def stratified_folds(s, d):
    return split.assign_folds(_prepared(s, d).table).select("customer_id", "churn", F.col("fold").cast("bigint").alias("fold"))


@query("rfm_fit")
def rfm_fit(s, d):
    p = rfm.fit_rfm(_parts(s, d)[0])
    rows = [
        (name, i, float(e))
        for name, edges in (("recency", p.recency), ("orders", p.orders), ("spend", p.spend))
        for i, e in enumerate(edges)
    ]
    frame = _params_frame(s, rows, "measure string, place bigint, edge double")
    return frame.select(
        "measure", "place", _r6("edge").alias("edge"), F.lit(p.reference).cast("timestamp_ntz").alias("reference")
    )


@query("rfm_recency")
def rfm_recency(s, d):
    return _prepared(s, d).table.select("customer_id", rfm.recency_days(_feature_params(s, d).rfm).alias("recency_days"))


def _components(s: SparkSession, d: str) -> DataFrame:
    return rfm.rfm_components(_prepared(s, d).table, _feature_params(s, d).rfm)


@query("rfm_score")
def rfm_score(s, d):
    return _components(s, d).select("customer_id", "recency_score", "frequency_score", "monetary_score")


@query("concat_scores")
def concat_scores(s, d):
    return _components(s, d).select("customer_id", "rfm_score_text")


@query("rfm_numeric_score")
def rfm_numeric_score(s, d):
    return _components(s, d).select("customer_id", "rfm_score")


@query("rfm_components")
def rfm_components(s, d):
    return _components(s, d).select(
        "customer_id", "recency", "frequency", _r6("monetary").alias("monetary"),
        "recency_score", "frequency_score", "monetary_score",
    )


@query("rfm_segment")
def rfm_segment(s, d):
    rows = rfm.apply_rfm(_prepared(s, d).table, _feature_params(s, d).rfm)
    return rows.select("customer_id", "rfm_segment")


@query("rfm_transform")
def rfm_transform(s, d):
    test = _parts(s, d)[1]
    return rfm.apply_rfm(test, _feature_params(s, d).rfm).select("customer_id", "recency_days", "rfm_segment")


@query("engagement_fit")
def engagement_fit(s, d):
    p = engagement.fit_engagement(_parts(s, d)[0])
    rows = [(c, *map(float, r)) for c, r in {**p.ranges, "weighted_sum": p.total}.items()]
    frame = _params_frame(s, rows, "measure string, low double, high double")
    return frame.select("measure", _r6("low").alias("low"), _r6("high").alias("high"))


@query("min_max_normalise")
def min_max_normalise(s, d):
    ranges = _feature_params(s, d).engagement.ranges
    return _prepared(s, d).table.select(
        "customer_id", *[_r6(min_max(c, *r)).alias(c) for c, r in ranges.items()]
    )


@query("engagement_score")
def engagement_score(s, d):
    params = _feature_params(s, d).engagement
    return engagement.apply_engagement(_prepared(s, d).table, params).select("customer_id", "engagement_score")


@query("engineer_features")
def engineer_features(s, d):
    train, test = split.stratified_split(_prepared(s, d).table)
    return features.apply_features(test, features.fit_features(train)).select(
        "customer_id", "recency_days", "rfm_segment", "engagement_score"
    )


@query("age_group")
def age_group(s, d):
    return _prepared(s, d).table.select("customer_id", features.age_group("age").alias("customer_age_group"))


@query("lifetime_days")
def lifetime_days(s, d):
    return _prepared(s, d).table.select("customer_id", features.lifetime_days().alias("customer_lifetime_days"))


@query("avg_monthly_spend")
def avg_monthly_spend(s, d):
    return _typed(s, d).select("customer_id", _r6(features.avg_monthly_spend()).alias("avg_monthly_spend"))


def _bucketed_orders(s: SparkSession, d: str) -> DataFrame:
    """The orders, bucketed by customer; the files go with the staged tables."""
    path = _folder(s, "orders", d)
    return keep(s, ("bucketed", d), lambda: layout.write_bucketed(read(s, d, "orders"), f"orders_{path.rsplit('-', 1)[1]}", "o_custkey", path))


@query("purchase_interval_bucketed")
def purchase_interval_bucketed(s, d):
    gaps = features.purchase_interval(_bucketed_orders(s, d), "o_custkey", "o_orderdate")
    return gaps.select("o_custkey", _r6("purchase_interval").alias("purchase_interval"))


@query("cohort_retention_bucketed")
def cohort_retention_bucketed(s, d):
    return reports.cohort_retention(_bucketed_orders(s, d))


@query("purchase_interval")
def purchase_interval(s, d):
    gaps = features.purchase_interval(read(s, d, "orders"), "o_custkey", "o_orderdate")
    return gaps.select("o_custkey", _r6("purchase_interval").alias("purchase_interval"))


@query("engagement_score_v2")
def engagement_score_v2(s, d):
    rows = features.with_engagement_v2(_typed(s, d))
    return rows.select("customer_id", _r6("engagement_score_v2").alias("engagement_score_v2"))


@query("risk_score")
def risk_score(s, d):
    return _typed(s, d).select("customer_id", _r6(features.risk_score()).alias("customer_risk_score"))


@query("discount_dependency")
def discount_dependency(s, d):
    return _typed(s, d).select("customer_id", _r6(features.discount_dependency()).alias("discount_dependency"))


@query("complaint_ratio")
def complaint_ratio(s, d):
    return _typed(s, d).select("customer_id", _r6(features.complaint_ratio()).alias("complaint_ratio"))


@query("return_ratio")
def return_ratio(s, d):
    return _typed(s, d).select("customer_id", _r6(features.return_ratio()).alias("return_ratio"))


@query("browsing_score")
def browsing_score(s, d):
    return features.with_browsing_score(_typed(s, d)).select("customer_id", _r6("browsing_score").alias("browsing_score"))


@query("vip_flag")
def vip_flag(s, d):
    return features.with_vip_flag(_typed(s, d)).select("customer_id", "vip_flag")


@query("premium_flag")
def premium_flag(s, d):
    return _typed(s, d).select("customer_id", features.premium_flag().alias("premium_flag"))


@query("activity_level")
def activity_level(s, d):
    return features.with_activity_level(_scored(s, d)).select("customer_id", "activity_level")


# --- encoding and scaling --------------------------------------------------------------------------------

_SCALED = [c for c in schema.ALL_COLUMNS if c in (*schema.INT_COLUMNS, *schema.FLOAT_COLUMNS) and c != "churn"]


@query("onehot_fit")
def onehot_fit(s, d):
    p = encode.fit_onehot(_parts(s, d)[0], schema.CATEGORY_COLUMNS)
    rows = [(c, i, v) for c, values in p.categories.items() for i, v in enumerate(values)]
    return _params_frame(s, rows, "column string, place bigint, category string")


@query("onehot_transform")
def onehot_transform(s, d):
    train, test = _parts(s, d)
    params = encode.fit_onehot(train, schema.CATEGORY_COLUMNS)
    return encode.apply_onehot(test.select("customer_id", *schema.CATEGORY_COLUMNS), params)


@query("dictionary_fit")
def dictionary_fit(s, d):
    return dictionary.fit_dictionary(_parts(s, d)[0], schema.CATEGORY_COLUMNS)


@query("dictionary_places")
def dictionary_places(s, d):
    train, test = _parts(s, d)
    found = stage(dictionary.fit_dictionary(train, schema.CATEGORY_COLUMNS), "dictionary")
    placed = dictionary.with_places(test, found, dictionary.dictionary_sizes(found))
    return placed.select("customer_id", *[f"{c}_place" for c in schema.CATEGORY_COLUMNS])


@query("sparse_onehot")
def sparse_onehot(s, d):
    train, test = _parts(s, d)
    fitted = dictionary.EncodeStep(columns=list(schema.CATEGORY_COLUMNS)).fit(train)
    flags = F.posexplode(vector_to_array("encoded")).alias("slot", "flag")
    held = fitted.transform(test).select("customer_id", flags).where("flag = 1")
    return held.join(fitted.names(), "slot").select("customer_id", "column", "value")


def _scaled(s: SparkSession, d: str, method: str) -> DataFrame:
    train, test = _parts(s, d)
    done = encode.apply_scaler(test, encode.fit_scaler(train, _SCALED, method))
    return done.select("customer_id", *[_r6(c).alias(c) for c in _SCALED])


@query("scale_standard")
def scale_standard(s, d):
    return _scaled(s, d, "standard")


@query("scale_minmax")
def scale_minmax(s, d):
    return _scaled(s, d, "minmax")


@query("scale_robust")
def scale_robust(s, d):
    return _scaled(s, d, "robust")


@query("scale_frozen")
def scale_frozen(s, d):
    done = encode.apply_scaler(_prepared(s, d).table, encode.fit_scaler(_parts(s, d)[0], _SCALED, "standard"))
    return done.select("customer_id", "gender", *[_r6(c).alias(c) for c in _SCALED])


# --- model and evaluation ----------------------------------------------------------------------------------


@query("class_weights")
def class_weights(s, d):
    return model.class_weights(_parts(s, d)[0]).select("churn", "rows", _r6("weight").alias("weight"))


@query("train_random_forest")
def train_random_forest(s, d):
    train = _parts(s, d)[0]
    params, matrix = model.fit_matrix(train)
    bundle = model.Bundle(params, model.train_model(matrix, params.names()))
    return metrics.classification_report(model.predict(_parts(s, d)[1], bundle))


@query("predict_class")
def predict_class(s, d):
    return model.predict(_prepared(s, d).table, _bundle(s, d)).select("customer_id", "churn", "predicted_churn")


@query("churn_probability")
def churn_probability(s, d):
    rows = model.predict(_prepared(s, d).table, _bundle(s, d), probability=True)
    return rows.select("customer_id", "churn_probability")


@query("feature_importance")
def feature_importance(s, d):
    return model.feature_importance(_bundle(s, d))


@query("export_columns")
def export_columns(s, d):
    """What the export holds beside the prediction."""
    return _rounded(export_scored(s, d).drop("predicted_churn"), _CAPPED)


@query("batch_columns")
def batch_columns(s, d):
    """What batch scoring returns beside the prediction, of customers that training would keep too."""
    done = batch_score(s, d).drop("predicted_churn", "churn_probability")
    return _rounded(done.where("churn IS NOT NULL AND registration_date IS NOT NULL"), _CAPPED)


@query("prediction_checks")
def prediction_checks(s, d):
    """Every prepared customer has a class, a probability, and the one that goes with the other."""
    p = F.col("churn_probability")
    rows = model.predict(_prepared(s, d).table, _bundle(s, d), probability=True)
    return rows.select(
        "customer_id", "churn", F.col("predicted_churn").isin(0, 1).alias("known"), p.between(0, 1).alias("in_range"),
        ((F.col("predicted_churn") == 1) == (p > 0.5)).alias("agrees"))


@query("importance_features")
def importance_features(s, d):
    """Every input of the model has an importance."""
    return model.feature_importance(_bundle(s, d)).select("feature", F.col("importance").between(0, 1).alias("in_range"))


@query("model_comparison")
def model_comparison(s, d):
    params, matrix = _matrix(s, d)
    test = model.to_matrix(_parts(s, d)[1], params)
    return model.compare_models(matrix, test, params.names())


@query("cross_validate")
def cross_validate(s, d):
    return tuning.search_settings(raw_customers(s, d), "Decision Tree")


@query("random_search")
def random_search(s, d):
    return tuning.search_settings(raw_customers(s, d), "Random Forest", folds=3, draws=4)


@query("risk_level")
def risk_level(s, d):
    chance = F.least(F.col("risk_score") / 8, F.lit(1.0))
    return _scored(s, d).select("customer_id", model.risk_level(chance).alias("risk_level"))


@query("accuracy")
def accuracy(s, d):
    return metrics.accuracy(_scored(s, d)).select(_r6("accuracy").alias("accuracy"))


@query("classification_report")
def classification_report(s, d):
    report = metrics.classification_report(_scored(s, d))
    return report.select("class", *[_r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("confusion_matrix")
def confusion_matrix(s, d):
    return metrics.confusion_matrix(_scored(s, d))


@query("roc_auc")
def roc_auc(s, d):
    return metrics.roc_auc(_scored(s, d)).select(_r6("roc_auc").alias("roc_auc"))


@query("roc_points")
def roc_points(s, d):
    points = metrics.roc_points(_scored(s, d))
    return points.select(*[_r6(c).alias(c) for c in ("threshold", "fpr", "tpr")])


@query("pr_points")
def pr_points(s, d):
    points = metrics.pr_points(_scored(s, d))
    return points.select(*[_r6(c).alias(c) for c in ("threshold", "precision", "recall")])


# --- reports ---------------------------------------------------------------------------------------------


def _report(name: str, f: Callable[[DataFrame], DataFrame], rounded: tuple[str, ...] = (), source=_scored) -> None:
    @query(name)
    def run(s: SparkSession, d: str) -> DataFrame:
        made = f(source(s, d))
        return made.withColumns({c: _r6(c) for c in rounded}) if rounded else made


def _orders(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "orders")


def _events(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events")


_report("dashboard_kpis", reports.dashboard_kpis, ("churn_rate", "avg_order_value"))
_report("kpi_total_customers", reports.kpi_total_customers)
_report("kpi_churn_rate", reports.kpi_churn_rate, ("churn_rate",))
_report("kpi_avg_order_value", reports.kpi_avg_order_value, ("avg_order_value",), _typed)
_report("kpi_predicted_churn", reports.kpi_predicted_churn)
_report("churn_distribution", reports.churn_distribution)
_report("segment_counts", reports.segment_counts)
_report("monthly_revenue", reports.monthly_revenue, ("revenue",), _typed)
_report("churn_by_membership", reports.churn_by_membership)
_report("engagement_by_prediction", reports.engagement_by_prediction, ("avg_engagement",))
_report("top_high_risk", lambda df: _rounded(reports.top_high_risk(df), ["total_spend"]))
_report("kpi_active_inactive", reports.kpi_active_inactive)
_report("kpi_retention_rate", reports.kpi_retention_rate, ("retention_rate",))
_report("kpi_revenue_net", reports.kpi_revenue_net, ("revenue", "refunds", "refund_rate", "net_revenue"), _typed)
_report("kpi_clv_session", reports.kpi_clv_session, ("avg_lifetime_value", "avg_session_duration"), _typed)
_report("kpi_growth_rate", reports.kpi_growth_rate, ("revenue", "growth_rate"), _orders)
_report("kpi_conversion_rate", reports.kpi_conversion_rate, ("conversion_rate",), _events)
_report("sales_by_period", reports.sales_by_period, ("revenue",), _orders)
_report("cohort_retention", reports.cohort_retention, (), _orders)
_report("sales_by_payment", reports.sales_by_payment, ("revenue",), _typed)
_report("demographic_segments", reports.demographic_segments, ("churn_rate", "revenue"), _typed)


@query("sales_by_region")
def sales_by_region(s, d):
    made = reports.sales_by_region(*[read(s, d, t) for t in ("orders", "customer", "nation", "region")])
    return made.withColumn("revenue", _r6("revenue"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Clean the raw table, learn segments on all of it and count customers per segment."""
    unique = stage(clean.dedupe_first(raw_customers(s, d)), "unique")
    tidy = clean.fill_and_type(unique, clean.fit_fill_values(unique))
    return reports.segment_counts(rfm.apply_rfm(tidy, rfm.fit_rfm(tidy)))


query("clean_and_segment")(flagship)
