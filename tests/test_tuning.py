"""Steps as pipeline stages, the encoder without a limit, and search inside folds."""

from __future__ import annotations

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayrate.catalog import queries
from stayrate.errors import InputError, NotFittedError, OptionError
from stayrate.operators import split, tuning
from stayrate.operators.clean import dedupe_first, nan_to_null
from stayrate.operators.dictionary import EncodeStep, dictionary_sizes, fit_dictionary, with_places
from stayrate.operators.encode import apply_onehot, fit_onehot
from stayrate.operators.split import assign_folds
from stayrate.operators.steps import FittedStep, Step
from stayrate.sources.customers import raw_customers
from tests.conftest import SF


class Shift(FittedStep):
    def apply(self, df, state):
        return df.withColumn(self.setting("to", "x"), F.col("x") - state["mean"])


class ShiftStep(Step):
    fitted, needs = Shift, ("x",)

    def learn(self, df):
        return {"mean": df.agg(F.avg("x")).first()[0]}


def test_own_step_in_a_pipeline(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (8.0, "a")], "x double, c string")
    made = Pipeline(stages=[ShiftStep(to="y"), EncodeStep(columns=["c"])]).fit(df)
    made.write().save(str(tmp_path / "chain"))
    again = PipelineModel.load(str(tmp_path / "chain"))
    new = spark.createDataFrame([(5.0, "b"), (4.0, "z"), (4.0, None)], "x double, c string")
    for chain in (made, again):
        rows = chain.transform(new).select("y", vector_to_array("encoded").alias("v")).collect()
        assert [(r["y"], list(r["v"])) for r in rows] == [(1.0, [1.0]), (0.0, [0.0]), (0.0, [0.0])]
    unfitted = Pipeline(stages=[ShiftStep(to="y")])
    unfitted.write().save(str(tmp_path / "unfitted"))
    assert Pipeline.load(str(tmp_path / "unfitted")).fit(df).transform(new).columns == ["x", "c", "y"]


def test_steps_check_their_input(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    with pytest.raises(InputError, match="missing columns"):
        ShiftStep().fit(df.withColumnRenamed("x", "z"))
    with pytest.raises(InputError, match="no rows"):
        ShiftStep().fit(df.limit(0))
    with pytest.raises(NotFittedError):
        Shift().transform(df)
    with pytest.raises(InputError):
        ShiftStep().fit(df).transform(df.withColumnRenamed("x", "z"))


def test_five_thousand_cities(spark, tmp_path):
    n = 5000
    df = spark.range(3 * n).select(
        F.concat(F.lit("City "), (F.col("id") % n).cast("string")).alias("city"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        F.when(F.col("id") % n < n // 2, 1.0).otherwise(0.0).alias("label"))
    for sent in (100_000, 10):  # sent to the tasks, and joined
        fitted = EncodeStep(columns=["city", "kind"], sent=sent, output="features").fit(df)
        assert dictionary_sizes(fitted.dictionary) == {"city": n, "kind": 3}
        rows = fitted.transform(df)
        first = rows.select("features").first()[0]
        assert type(first).__name__ == "SparseVector" and first.size == n - 1 + 2
        assert rows.count() == 3 * n and rows.columns == ["label", "features"]
    model = LogisticRegression(regParam=1e-4).fit(rows)
    right = model.transform(rows).where(F.col("prediction") == F.col("label")).count()
    assert right > 0.99 * 3 * n
    names = {r["slot"]: (r["column"], r["value"]) for r in fitted.names().collect()}
    assert sorted(names) == list(range(n + 1)) and names[0] == ("city", "City 1") and names[n] == ("kind", "c")


def test_places_are_those_of_sorted_values(spark):
    df = spark.createDataFrame([("b", "x"), ("a", None), ("é", "x"), (None, "y"), ("a", "x")], "p string, q string")
    d = fit_dictionary(df, ["p", "q"])
    assert sorted(map(tuple, d.collect())) == [("p", "a", 0), ("p", "b", 1), ("p", "é", 2), ("q", "x", 0), ("q", "y", 1)]
    new = spark.createDataFrame([("é", "y"), ("c", None)], "p string, q string")
    assert sorted(map(str, with_places(new, d, dictionary_sizes(d)).select("p_place", "q_place").collect())) == [
        "Row(p_place=2, q_place=1)", "Row(p_place=None, q_place=None)"]


def test_sparse_equals_dense(spark):
    raw = raw_customers(spark, SF).select("customer_id", "gender", "city", "payment_method").fillna("Nan")
    columns = ["gender", "city", "payment_method"]
    dense = apply_onehot(raw, fit_onehot(raw, columns))
    fitted = EncodeStep(columns=columns).fit(raw)
    want = {r[0]: list(r)[1:] for r in dense.collect()}
    got = {r[0]: list(r[1]) for r in fitted.transform(raw).select("customer_id", vector_to_array("encoded")).collect()}
    assert got == want


def test_validation_rows_are_unseen(spark):
    raw = raw_customers(spark, SF)
    unique = assign_folds(dedupe_first(nan_to_null(raw)).where("churn is not null"), 5)
    marked = unique.withColumn("city", F.when(F.col("fold") == 2, "Onlyhere").otherwise(F.col("city")))
    marked = marked.withColumn("age", F.when(F.col("fold") == 2, 10000.0).otherwise(F.col("age")))
    fitted, train, held = tuning.fold_matrices(marked.persist(), 2, tuning.chain())
    dictionary = fitted.stages[-1].dictionary
    assert dictionary.where("value = 'Onlyhere'").isEmpty() and not dictionary.where("column = 'city'").isEmpty()
    assert fitted.stages[0].learnt()["medians"]["age"] < 1000
    other = tuning.fold_matrices(marked.persist(), 1, tuning.chain())[0]
    assert not other.stages[-1].dictionary.where("value = 'Onlyhere'").isEmpty()
    assert train.join(held, "_key").isEmpty() and held.count() > 0


def test_light_and_last_steps_are_not_staged(spark, monkeypatch):
    raw = dedupe_first(nan_to_null(raw_customers(spark, SF))).where("churn is not null").persist()
    staged, kept = [], tuning.stage
    monkeypatch.setattr(tuning, "stage", lambda df, name: staged.append(name) or kept(df, name))
    fitted, rows = tuning.fit_chain(raw, tuning.chain())
    assert staged == ["chain"] * 2  # cleaned and engineered rows; capping and scaling are repeated, nothing learns from encoded ones
    again = raw
    for step in fitted.stages:
        again = kept(step.transform(again), "again")
    assert rows.columns == again.columns
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, again.collect()))
    raw.unpersist()


def test_split_is_made_once(spark, monkeypatch):
    want = {r["customer_id"]: r["is_test"] for r in split.assign_test(queries._prepared(spark, SF).table).collect()}

    def counted(*args):
        raise AssertionError("the split is staged already")

    monkeypatch.setattr(split, "assign_test", counted)
    assert {r["customer_id"]: r["is_test"] for r in queries.QUERIES["stratified_split"](spark, SF).collect()} == want


def test_settings():
    drawn = tuning.settings_of("Random Forest", 7, 5)
    assert drawn == tuning.settings_of("Random Forest", 7, 5) != tuning.settings_of("Random Forest", 7, 6)
    assert len(drawn) == 7 and all(50 <= s["numTrees"] <= 200 and 4 <= s["maxDepth"] <= 14 for s in drawn)
    assert all(0.02 <= s["stepSize"] <= 0.3 for s in tuning.settings_of("Gradient Boosting", 20, 1))
    assert len(tuning.settings_of("Decision Tree")) == 9 and len(tuning.settings_of("Logistic Regression")) == 12
    assert len(tuning.drawn_settings({"a": (1, 2)}, 5, 1)) == 2  # no more than there are
    with pytest.raises(OptionError):
        tuning.settings_of("Oracle")


def test_search(spark):
    tried = [{"maxDepth": 1}, {"maxDepth": 5}]
    out = tuning.search_settings(raw_customers(spark, SF), "Decision Tree", tried, folds=3).collect()
    assert [r["place"] for r in out] == [1, 2] and {r["settings"] for r in out} == {"maxDepth=1", "maxDepth=5"}
    assert out[0]["mean_f1"] >= out[1]["mean_f1"] and all(0 <= r["worst_f1"] <= r["mean_f1"] <= 1 for r in out)
