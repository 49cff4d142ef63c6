"""Column expressions and the distributed statistics against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayrate.errors import InputError
from stayrate.functions import scalars
from stayrate.functions.modes import categories, most_frequent
from stayrate.functions.quantiles import exact_quantiles
from stayrate.functions.running import running_totals
from stayrate.functions.selection import hash_cuts
from stayrate.operators import split


def values(spark, rows, kind, expression):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_title_case_like_python(spark):
    texts = ["o'neil e-wallet 2nd", "  nation_4\t", "UPPER lower", "", "a1b2", "été-d'azur", "x "]
    found = values(spark, texts, "string", scalars.title_case(scalars.stripped("x")))
    assert found == [t.strip().title() for t in texts]


def test_half_even_like_numpy(spark):
    rng = random.Random(1)
    numbers = [0.125, 0.375, 2.345, -2.675, 1e9 + 0.005] + [rng.uniform(-1e6, 1e6) for _ in range(500)]
    assert values(spark, numbers, "double", scalars.round_half_even("x")) == list(np.round(numbers, 2))


def test_clip_keeps_gaps(spark):
    assert values(spark, [None, 1.0, 5.0, 9.0], "double", scalars.clip("x", 2.0, 6.0)) == [None, 2.0, 5.0, 6.0]
    assert values(spark, [None, 1.0], "double", scalars.clip("x", None, None)) == [None, 1.0]


def test_days_round_down(spark):
    end = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    texts = ["2024-01-09 12:00:00", "2024-01-09 12:00:01", "2024-01-10 12:00:01", "2024-01-11 12:00:01", None]
    found = values(spark, texts, "string", scalars.days_between(F.col("x").cast("timestamp_ntz"), end))
    assert found == [1, 0, -1, -2, None]


def test_days_do_not_depend_on_the_session_zone(spark):
    kept = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        end = F.lit("2024-03-11").cast("timestamp_ntz")
        assert values(spark, ["2024-03-10"], "string", scalars.days_between(F.col("x").cast("timestamp_ntz"), end)) == [1]
        assert str(values(spark, ["2024-03-10"], "string", scalars.parsed_date("x"))[0]) == "2024-03-10 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", kept)


def test_dates_in_listed_formats_only(spark):
    texts = ["2024-02-03", "03/02/2024", "2024-02-30", None]
    assert [v is None for v in values(spark, texts, "string", scalars.parsed_date("x"))] == [False, True, True, True]
    both = scalars.parsed_date("x", ("yyyy-MM-dd", "dd/MM/yyyy"))
    assert [str(v)[:10] for v in values(spark, texts[:2], "string", both)] == ["2024-02-03"] * 2


def test_numbers_from_text(spark):
    assert values(spark, ["abc", "12.7", None, "-3.9"], "string", scalars.whole_number("x")) == [0, 12, 0, -3]
    assert values(spark, [float("nan"), 2.5], "double", scalars.float_number("x")) == [0.0, 2.5]


@pytest.mark.parametrize("shape", ["even", "two heavy values", "one heavy value", "tails", "gaps", "few", "heavy ends"])
def test_narrowing_finds_the_exact_quantiles(spark, shape):
    rng = np.random.default_rng(7)
    n = 30_000
    data = {
        "even": rng.uniform(0, 1e6, n),
        "two heavy values": np.where(rng.uniform(size=n) < 0.5, 1.0, 2.0),
        "one heavy value": np.where(rng.uniform(size=n) < 0.34, 5.0, rng.uniform(0, 10, n)),
        "tails": rng.pareto(0.5, n),
        "gaps": rng.integers(0, 50, n).astype(float),
        "heavy ends": np.concatenate([np.zeros(15_000), rng.uniform(0, 1, 60), np.ones(15_000)]),
        "few": np.array([1.0, 1, 1, 1, 2, 3]),
    }[shape]
    wanted = [0.0, 0.01, 0.2, 0.25, 0.5, 0.75, 0.9, 1.0]
    rows = [(float(v),) for v in data]
    if shape == "gaps":
        rows += [(None,)] * 100
    frame = spark.createDataFrame(rows, "x double").repartition(4)
    narrowed = exact_quantiles(frame, {"x": wanted}, gap_limit=50, accuracy=200)["x"]
    at_once = exact_quantiles(frame, {"x": wanted})["x"]
    expected = np.quantile(data, wanted)
    np.testing.assert_allclose(narrowed, expected, rtol=1e-12, atol=1e-9)
    np.testing.assert_allclose(at_once, expected, rtol=1e-12, atol=1e-9)


def test_quantiles_of_several_columns_and_none(spark):
    frame = spark.createDataFrame([(1.0, None, 3), (2.0, None, 5)], "a double, b double, c int")
    for limit in (0, 1_000):
        found = exact_quantiles(frame, {"a": [0.5], "b": [0.5], "c": [0.0, 1.0]}, gap_limit=limit)
        assert found == {"a": [1.5], "b": [None], "c": [3.0, 5.0]}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.floats(0, 1))
def test_quantiles_property(spark, numbers, share):
    frame = spark.createDataFrame([(float(v),) for v in numbers], "x double")
    found = exact_quantiles(frame, {"x": [share]}, gap_limit=2, accuracy=100)["x"][0]
    assert found == pytest.approx(float(np.quantile(numbers, share)), abs=1e-8)


def test_quantiles_keep_small_values(spark):
    frame = spark.createDataFrame([(i * 1e-12,) for i in range(1, 101)], "x double")
    found = exact_quantiles(frame, {"x": [0.25, 0.5, 0.75]})["x"]
    np.testing.assert_allclose(found, np.quantile([i * 1e-12 for i in range(1, 101)], [0.25, 0.5, 0.75]), rtol=1e-12)


def test_modes_and_categories(spark):
    frame = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2), ("b", None)], "s string, n int")
    assert most_frequent(frame, ["s", "n"]) == {"s": "a", "n": "1"}
    assert categories(frame, ["s"], 2) == {"s": ["a", "b"]}
    with pytest.raises(InputError, match="s"):
        categories(frame, ["s", "n"], 1)


@pytest.mark.parametrize("bands", [1, 7, 64])
def test_running_totals(spark, bands):
    rng = random.Random(3)
    rows = sorted({round(rng.uniform(0, 1), 4) for _ in range(800)})
    frame = spark.createDataFrame([(x, i % 5, 1) for i, x in enumerate(rows)], "x double, a long, b long")
    for descending in (False, True):
        got = running_totals(frame, "x", {"a": "ta", "b": "tb"}, descending, bands).collect()
        a = b = 0
        for r in sorted(got, key=lambda r: r["x"], reverse=descending):
            a, b = a + r["a"], b + r["b"]
            assert (r["ta"], r["tb"]) == (a, b)
    empty = frame.where(F.lit(False))
    assert running_totals(empty, "x", {"a": "ta"}).count() == 0


def test_split_is_exact_and_repeatable(spark):
    frame = spark.range(10_003).selectExpr("string(id) AS customer_id", "int(id % 3 = 0) AS churn")
    train, test = split.stratified_split(frame.repartition(5))
    sizes = {r["churn"]: r["count"] for r in test.groupBy("churn").count().collect()}
    assert sizes == {1: round(0.2 * 3335), 0: round(0.2 * 6668)}
    assert train.count() + test.count() == 10_003
    again = split.stratified_split(frame.repartition(2))[1]
    assert test.exceptAll(again).isEmpty() and again.exceptAll(test).isEmpty()
    other = split.stratified_split(frame, seed=7)[1]
    assert not test.exceptAll(other).isEmpty()


def test_too_many_classes_is_an_error(spark):
    frame = spark.range(150).selectExpr("string(id) AS customer_id", "id AS churn")
    with pytest.raises(InputError, match="classes"):
        split.stratified_split(frame)
    parts = split.assign_parts(frame, [0.2], max_classes=150)
    assert parts.where("part IS NULL").isEmpty() and parts.count() == 150


def test_folds_are_even(spark):
    frame = spark.range(1_000).selectExpr("string(id) AS customer_id", "int(id % 4 = 0) AS churn")
    sizes = split.assign_folds(frame).groupBy("fold", "churn").count().collect()
    assert {(r["fold"], r["churn"]): r["count"] for r in sizes} == {
        (f, c): n for f in range(5) for c, n in ((1, 50), (0, 150))
    }


def test_one_repeated_key_stays_together(spark):
    frame = spark.range(300).selectExpr("if(id < 200, 'hot', string(id)) AS customer_id", "1 AS churn")
    cuts = hash_cuts(frame, "churn", "customer_id", 42, [0.2])
    assert len(cuts[1]) == 1
    marked = split.assign_test(frame)
    assert marked.where("customer_id = 'hot'").select("is_test").distinct().count() == 1
    assert marked.where("is_test IS NULL").count() == 0
