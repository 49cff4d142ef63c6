"""Training, scoring, storage, streaming and evaluation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.errors import InputError, NotFittedError, StorageError
from stayrate.operators import metrics, model, reports
from stayrate.plans import dashboard, training
from stayrate.sources import artifacts, files, tables
from stayrate.sources.customers import raw_customers
from stayrate.streaming import scoring
from tests.conftest import SF

SMALL = {"numTrees": 8, "maxDepth": 4}


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    made = training.run_training(raw_customers(spark, SF), f"{folder}/bundle", f"{folder}/export", **SMALL)
    return made, folder


def test_training_report(trained):
    made, _ = trained
    report = {r["class"]: r for r in made.report.collect()}
    assert set(report) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert report["0"]["support"] + report["1"]["support"] == made.test.count()
    majority = report["0"]["support"] / made.test.count()
    assert made.accuracy.first()[0] >= majority - 0.25


def test_leaking_columns_are_left_out_unless_asked_for(trained):
    made, _ = trained
    names = made.bundle.matrix.names()
    assert not {"recency_days", "customer_lifetime_value", "churn", "customer_id"} & set(names)
    wide, _ = model.fit_matrix(made.train, reference_features=True)
    assert {"recency_days", "customer_lifetime_value"} <= set(wide.names())
    assert any(n.startswith("rfm_segment_") for n in wide.names())


def test_same_seed_same_model(trained):
    made, _ = trained
    params, matrix = model.fit_matrix(made.train)
    again = model.train_model(matrix, params.names(), **SMALL)
    first = [r[0] for r in model.predict(made.test, made.bundle, True).orderBy("customer_id").select("churn_probability").collect()]
    other = model.Bundle(params, again)
    second = [r[0] for r in model.predict(made.test, other, True).orderBy("customer_id").select("churn_probability").collect()]
    assert first == second
    assert all(0 <= p <= 1 for p in first)


def test_importance_covers_all_features(trained):
    made, _ = trained
    rows = model.feature_importance(made.bundle).collect()
    assert sorted(r["feature"] for r in rows) == sorted(made.bundle.matrix.names())
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert [r["place"] for r in rows] == list(range(1, len(rows) + 1))


def test_export_is_read_back(spark, trained):
    made, folder = trained
    back = files.scan_scored(spark, f"{folder}/export")
    assert back.schema == schema.scored_schema()
    direct = training.scored_table(made.table, made.bundle)
    assert back.exceptAll(direct).isEmpty() and direct.exceptAll(back).isEmpty()


def test_saved_bundle_scores_the_same(spark, trained):
    made, folder = trained
    loaded = artifacts.load_bundle(spark, f"{folder}/bundle")
    assert loaded.matrix == made.bundle.matrix
    assert loaded.fills == made.bundle.fills and loaded.bounds == made.bundle.bounds
    raw = raw_customers(spark, SF)
    scored = scoring.score(raw, loaded)
    direct = training.scored_table(made.table, made.bundle)
    assert direct.exceptAll(scored).isEmpty()
    customers = raw.where("customer_id IS NOT NULL").select("customer_id").distinct().count()
    assert scored.count() == customers > direct.count()  # rows without a registration date are not trained on
    with pytest.raises(StorageError):
        artifacts.load_bundle(spark, f"{folder}/absent")
    with pytest.raises(NotFittedError):
        artifacts.save_fitted(spark, None, f"{folder}/none")
    with pytest.raises(NotFittedError):
        scoring.score(raw_customers(spark, SF), model.Bundle(made.bundle.matrix, made.bundle.model))


def test_a_save_that_fails_leaves_the_version_before(spark, trained, tmp_path, monkeypatch):
    made, _ = trained
    path = str(tmp_path / "bundle")
    artifacts.save_bundle(spark, made.bundle, path)
    other = model.Bundle(made.bundle.matrix, made.bundle.model)
    write = artifacts.save_fitted

    def broken(session, params, to):
        if to.endswith("bounds"):
            raise StorageError("no space left")
        write(session, params, to)

    with monkeypatch.context() as patch:
        patch.setattr(artifacts, "save_fitted", broken)
        with pytest.raises(StorageError):
            artifacts.save_bundle(spark, other, path)
    assert artifacts.load_bundle(spark, path).fills == made.bundle.fills is not None
    artifacts.save_bundle(spark, other, path)
    assert artifacts.load_bundle(spark, path).fills is None


def test_limit_of_categories_reaches_the_encoder(trained):
    made, _ = trained
    with pytest.raises(InputError, match="city"):
        model.fit_matrix(made.train, max_categories=6)


def test_mean_engagement_keeps_small_values(spark):
    frame = spark.createDataFrame([(1, 1e-8), (1, 3e-8)], "predicted_churn long, engagement_score double")
    assert reports.engagement_by_prediction(frame).first()["avg_engagement"] == pytest.approx(2e-8)


def test_stream_scores_like_a_batch(spark, trained, tmp_path):
    made, _ = trained
    from stayrate.operators.clean import dedupe_first

    unique = dedupe_first(raw_customers(spark, SF))
    unique.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = scoring.read_arrivals(spark, str(tmp_path / "in"), files_per_trigger=1)
    query = scoring.start_scoring(
        stream, made.bundle, str(tmp_path / "out"), checkpoint=str(tmp_path / "state"), available_now=True
    )
    assert query.awaitTermination(120)
    batch = scoring.score(unique, made.bundle, probability=True)
    arrived = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    assert arrived.exceptAll(batch).isEmpty() and arrived.count() == batch.count()


def test_customers_without_a_label_are_scored(spark, trained):
    made, _ = trained
    raw = raw_customers(spark, SF)
    known = scoring.score(raw, made.bundle, probability=True).drop("churn")
    for unlabelled in (raw.withColumn("churn", F.lit(None).cast("bigint")), raw.drop("churn")):
        scored = scoring.score(unlabelled, made.bundle, probability=True)
        assert scored.where("churn IS NOT NULL OR predicted_churn IS NULL").isEmpty()
        assert scored.drop("churn").exceptAll(known).isEmpty() and scored.count() == known.count()


def test_model_does_not_depend_on_how_rows_are_spread(trained):
    made, _ = trained
    params, matrix = model.fit_matrix(made.train)
    found = []
    for parts in (2, 7):
        fitted = model.train_model(matrix.repartition(parts), params.names(), **SMALL)
        marked = model.predict(made.test, model.Bundle(params, fitted), True).orderBy("customer_id")
        found.append([r[0] for r in marked.select("churn_probability").collect()])
    assert found[0] == found[1]


def test_growth_compares_with_the_calendar_month_before(spark):
    rows = [("1995-01-05", 100.0), ("1995-03-01", 200.0), ("1995-04-30", 300.0), (None, 50.0)]
    orders = spark.createDataFrame(rows, "d string, o_totalprice double").withColumn("o_orderdate", F.col("d").cast("date"))
    found = [tuple(r) for r in reports.kpi_growth_rate(orders).orderBy("month").collect()]
    assert found == [("1995-01", 100.0, None), ("1995-03", 200.0, None), ("1995-04", 300.0, 0.5)]


def test_dashboard_and_its_filters(spark, trained):
    made, _ = trained
    scored = training.scored_table(made.table, made.bundle)
    shown = dashboard.dashboard(scored, {"gender": ["Male", "Female"]})
    rows = scored.where("gender IN ('Male', 'Female')")
    assert shown["kpis"].first()["total_customers"] == rows.count()
    assert sum(r["customers"] for r in shown["segment_counts"].collect()) == rows.count()
    assert shown["top_high_risk"].columns == list(schema.RISK_DISPLAY.values())
    shown["rows"].unpersist()
    with pytest.raises(InputError):
        dashboard.dashboard(scored, {"gender": ["Nobody"]})


def test_figures_of_no_customers(spark):
    empty = spark.createDataFrame([], schema.scored_schema())
    row = reports.dashboard_kpis(empty).first()
    assert tuple(row) == (0, 0.0, None, 0)


def test_missing_purchase_month(spark):
    frame = spark.createDataFrame([(None, 2.5), ("2024-02-03", 1.0)], "d string, total_spend double")
    frame = frame.withColumn("last_purchase_date", F.col("d").cast("timestamp_ntz"))
    assert [tuple(r) for r in reports.monthly_revenue(frame).collect()] == [("2024-02", 1.0), ("NaT", 2.5)]


def test_metrics_against_plain_python(spark):
    rng = random.Random(11)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(400)]
    frame = spark.createDataFrame([(y, s, int(s > 0.5)) for y, s in rows], "churn long, risk_score double, predicted_churn long")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(frame).first()[0] == pytest.approx(auc)
    points = {r["threshold"]: r for r in metrics.roc_points(frame).collect()}
    assert set(points) == {s for _, s in rows}
    for t in points:
        assert points[t]["tpr"] == pytest.approx(sum(s >= t for s in pos) / len(pos))
        assert points[t]["fpr"] == pytest.approx(sum(s >= t for s in neg) / len(neg))
    report = {r["class"]: r for r in metrics.classification_report(frame).collect()}
    hit = sum(y and s > 0.5 for y, s in rows)
    assert report["1"]["recall"] == pytest.approx(hit / len(pos))
    assert report["1"]["precision"] == pytest.approx(hit / sum(s > 0.5 for _, s in rows))


def test_report_without_a_class(spark):
    frame = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.6)], "churn long, predicted_churn long, risk_score double")
    report = {r["class"]: r for r in metrics.classification_report(frame).collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["recall"] == 0.0 and report["1"]["support"] == 0
    assert report["accuracy"]["f1"] == 0.5
    assert metrics.roc_auc(frame).first()[0] is None


def test_model_comparison(trained):
    made, _ = trained
    matrix = model.to_matrix(made.train, made.bundle.matrix)
    test = model.to_matrix(made.test, made.bundle.matrix)
    names = made.bundle.matrix.names()
    rows = model.compare_models(matrix, test, names, ("Decision Tree", "Logistic Regression"), Decision_Tree={"maxDepth": 3}).collect()
    assert {r["model"] for r in rows} == {"Decision Tree", "Logistic Regression"}
    assert rows[0]["f1"] >= rows[1]["f1"]


def test_tables_and_files(spark, six, tmp_path):
    tables.create_schema(spark, "people")
    tables.create_schema(spark, "people")
    assert tables.scan_table(spark, "people").schema == schema.raw_schema()
    tables.write_table(six.select(*schema.ALL_COLUMNS), "people")
    tables.write_table(six.select(*schema.ALL_COLUMNS).withColumn("age", F.lit(float("nan"))), "people")
    back = tables.scan_table(spark, "people")
    assert back.count() == 6 and back.where("age IS NOT NULL").isEmpty()
    with pytest.raises(StorageError):
        tables.scan_table(spark, "nowhere")

    odd = six.withColumn("city", F.when(F.col("age") > 40, 'a "b", c').otherwise(F.col("city")))
    files.write_raw_csv(odd, str(tmp_path / "raw"))
    assert files.scan_raw_csv(spark, str(tmp_path / "raw")).exceptAll(odd.drop("ingest_seq")).isEmpty()
    with pytest.raises(StorageError):
        files.scan_base_csv(spark, str(tmp_path / "absent"))
    (tmp_path / "base.csv").write_text(
        ",".join(schema.BASE_SCHEMA.names) + "\n1,0,Male,3,0,2,1,UPI,2.5,12,3,1,150.0\n2,x,Male,3,0,2,1,UPI,2.5,12,3,1,150.0\n"
    )
    rows = files.scan_base_csv(spark, str(tmp_path / "base.csv"), corrupt=True).collect()
    assert rows[0][files.CORRUPT] is None and rows[1][files.CORRUPT].startswith("2,x")
    (tmp_path / "other.csv").write_text(
        "Note," + ",".join(reversed(schema.BASE_SCHEMA.names)) + "\nhello,150.0,1,3,12,2.5,UPI,1,2,0,3,Male,0,1\n"
    )
    other = files.scan_base_csv(spark, str(tmp_path / "other.csv"), corrupt=False)
    assert [tuple(r) for r in other.collect()] == [tuple(rows[0])[:-1]]
    (tmp_path / "lacking.csv").write_text("CustomerID,Churn\n1,0\n")
    with pytest.raises(StorageError, match="Gender"):
        files.scan_base_csv(spark, str(tmp_path / "lacking.csv"))
    assert files.options_of(six, "gender") == ["Female", "Male"]


def test_models_predict_after_an_observation(spark):
    from pyspark.sql import Observation

    df = spark.range(40).select(F.col("id").cast("string").alias("customer_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("churn"))
    watch = Observation()
    df.observe(watch, F.count(F.lit(1)).alias("n")).count()
    assert watch.get["n"] == 40
    for name, options in (("Random Forest", {"numTrees": 2}), ("Logistic Regression", {"maxIter": 2})):
        fitted = model.train_model(df, ["x"], name, partitions=2, **options)
        assert len(fitted.transform(df).select("prediction").collect()) == 40


def test_trees_score_dense_vectors(spark):
    from pyspark.ml.functions import vector_to_array

    names = [f"x{i}" for i in range(9)]
    slot = F.col("id") % 9
    columns = [F.when(slot == i, F.col("id") % 7 + 1.0).otherwise(0.0).alias(n) for i, n in enumerate(names)]
    df = spark.range(90).select(F.col("id").cast("string").alias("customer_id"), (slot % 2).alias("churn"), *columns)
    for name, dense, options in (("Random Forest", True, {"numTrees": 3, "maxDepth": 3}), ("Decision Tree", True, {"maxDepth": 3}),
                                 ("Logistic Regression", False, {"maxIter": 2})):
        fitted = model.train_model(df, names, name, partitions=2, **options)
        plain = fitted.transform(df)
        assert all(len(r["features"].toArray()) > r["features"].numNonzeros() for r in plain.select("features").collect())
        scored = model._scored_rows(df.withColumn("x0", F.when(F.col("x0") > 0, F.col("x0"))), names, fitted)
        assert {type(r["features"]).__name__ == "DenseVector" for r in scored.select("features").collect()} == {dense}
        found, wanted = ({r[0]: tuple(r) for r in x.select("customer_id", "prediction", vector_to_array("probability").alias("p")).collect()}
                         for x in (scored, plain))
        assert found == wanted
