"""Replacing tables, numbering versions, streams that keep first rows, cohorts in one shuffle."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.errors import StorageError
from stayrate.operators import features, observed, reports
from stayrate.operators.clean import dedupe_first
from stayrate.sources import artifacts, layout, tables
from stayrate.sources.customers import raw_customers
from stayrate.streaming import scoring
from tests.conftest import SF


def test_a_write_that_fails_leaves_the_table(spark):
    tables.write_table(spark.range(100).select("id", F.lit("old").alias("v")), "swapped")
    before = tables.current_version(spark, "swapped")
    broken = spark.range(0, 100, 1, 8).select("id", F.when(F.col("id") < 90, F.lit("new")).otherwise(F.raise_error(F.lit("lost"))).alias("v"))
    with pytest.raises(StorageError):
        tables.write_table(broken, "swapped")
    assert tables.scan_table(spark, "swapped").groupBy("v").count().collect() == [("old", 100)]
    assert tables.current_version(spark, "swapped") == before and len(tables.versions(spark, "swapped")) == 1


def test_readers_keep_the_version_they_began_with(spark):
    tables.write_table(spark.range(10), "followed")
    reader = tables.scan_table(spark, "followed")
    tables.write_table(tables.scan_table(spark, "followed").where("id < 5").withColumn("more", F.lit(1)), "followed")
    assert reader.count() == 10
    assert tables.scan_table(spark, "followed").columns == ["id", "more"] and tables.scan_table(spark, "followed").count() == 5
    for _ in range(3):
        tables.write_table(spark.range(3), "followed")
    assert len(tables.versions(spark, "followed")) == 2 and tables.scan_table(spark, "followed").count() == 3


def test_a_plain_table_becomes_versioned(spark):
    spark.range(4).write.saveAsTable("plain_before")
    tables.create_schema(spark, "plain_before")
    assert tables.scan_table(spark, "plain_before").count() == 4 and tables.current_version(spark, "plain_before") is None
    tables.write_table(spark.range(6), "plain_before")
    assert tables.scan_table(spark, "plain_before").count() == 6 and tables.current_version(spark, "plain_before")


def test_numbers_are_claimed_once(spark, tmp_path, monkeypatch):
    path, names = str(tmp_path / "bundle"), [f"{k:032x}" for k in range(6)]
    assert artifacts._claim(spark, path, names[0]) == 1
    with monkeypatch.context() as stale:  # the list is older than the other save
        stale.setattr(artifacts, "_listed", lambda *_: [])
        assert artifacts._claim(spark, path, names[1]) == 2
    with ThreadPoolExecutor(4) as pool:
        rest = list(pool.map(lambda n: artifacts._claim(spark, path, n), names[2:]))
    assert sorted(rest) == [3, 4, 5, 6]
    assert [n for n, _ in artifacts.bundle_versions(spark, path)] == [1, 2, 3, 4, 5, 6]
    assert sorted(v for _, v in artifacts.bundle_versions(spark, path)) == names
    (tmp_path / "bundle/versions/000000000007").write_text("")  # claimed, not yet written
    assert max(artifacts.bundle_versions(spark, path))[0] == 6


def test_a_stream_keeps_first_rows_over_files_and_restarts(spark, tmp_path):
    raw = raw_customers(spark, SF).limit(60).collect()
    rng = random.Random(3)
    rows = sorted(rng.choices(raw, k=240), key=lambda _: rng.random())
    rows = [(*r[:-1], i) for i, r in enumerate(rows)]  # the place in the order of arrival is the last column
    rows = [tuple(None if schema.ALL_COLUMNS[0] == c and i % 50 == 0 else v for c, v in zip((*schema.ALL_COLUMNS, "ingest_seq"), r)) for i, r in enumerate(rows)]
    rows = [r if i % 3 else (*r[:1], float(i), *r[2:]) for i, r in enumerate(rows)]  # repeated customers differ
    kind = schema.raw_schema(with_ingest_order=True)
    whole = spark.createDataFrame(rows, kind)

    def arrive(some):
        for k in some:
            spark.createDataFrame(rows[40 * k : 40 * k + 40], kind).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        kept = scoring.first_rows(scoring.read_arrivals(spark, str(tmp_path / "in"), files_per_trigger=1))
        query = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        assert query.trigger(availableNow=True).start().awaitTermination(180)

    arrive([0, 1, 2])
    run()
    arrive([3, 4, 5])
    run()
    want = dedupe_first(whole.where("customer_id IS NOT NULL"))
    got = spark.read.schema(kind).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert want.count() < 60


def test_cohorts_take_one_shuffle_by_customer(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    plan = reports.cohort_retention(orders)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(o_custkey") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert "Window" not in plan


def test_bucketed_orders_need_no_shuffle_by_customer(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    bucketed = layout.write_bucketed(orders, "orders_bucketed", "o_custkey", buckets=8)
    for run in (lambda o: features.purchase_interval(o, "o_custkey", "o_orderdate"), reports.cohort_retention):
        plan = run(bucketed)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(o_custkey" not in plan
        assert sorted(map(str, run(bucketed).collect())) == sorted(map(str, run(orders).collect()))
    with pytest.raises(Exception, match="missing columns"):
        layout.write_bucketed(orders, "orders_bucketed", "absent")


def test_checks_ride_on_the_write(spark):
    rows = spark.createDataFrame([("Male", 1, 5.0, "a", "b"), ("X", 0, 500.0, "a", "b"), (None, 0, 1.0, "a", "b")], "gender string, churn long, total_spend double, city string, state string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "")
    kept, figures = observed.stage_checked(rows, "checked", {"total_spend": (0.0, 10.0)}, {"gender": ["Male", "Female"]})
    ran = len(jobs.getJobIdsForGroup("checked"))
    spark.sparkContext.setJobGroup("plain", "")
    from stayrate.session import stage
    stage(rows, "plain")
    assert ran == len(jobs.getJobIdsForGroup("plain")) and kept.count() == 3
    found = {(r["check"], r["name"]): r["figure"] for r in figures.collect()}
    assert found == {("domain", "gender"): 2.0, ("domain", "city_state"): 0.0, ("outlier", "total_spend"): 1.0, ("label", "rate"): pytest.approx(1 / 3)}
    watched, watch = observed.observe_checks(rows, domains={})
    watched.count()
    assert observed.rate_in_range(watch) in (True, False)
