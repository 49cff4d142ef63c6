"""Churn models on ``pyspark.ml``: training, scoring, comparison, cross-validation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel, GBTClassifier, LogisticRegression,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from stayrate.operators.checks import columns_by_type, require_columns, require_known
from stayrate.operators.clean import FillValues
from stayrate.operators.encode import (
    MAX_CATEGORIES, OneHotParams, ScaleParams, apply_onehot, apply_scaler, fit_onehot, fit_scaler,
)
from stayrate.operators.features import FeatureParams, apply_features, fit_features
from stayrate.operators.metrics import classification_report
from stayrate.operators.outliers import Bounds
from stayrate.session import shared_folder

LABEL = "churn"
NOT_FEATURES = ("customer_id", "churn", "registration_date", "last_purchase_date", "is_test", "fold")
# Columns computed from the label, or from which the label is computed in the derived customer table.
LEAKING = ("recency_days", "rfm_segment", "customer_lifetime_value")
# Bagging draws per partition, so training rows are dealt by customer into a number that no machine or table changes.
PARTITIONS = 32
MODELS = ("Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting")
TREES = (DecisionTreeClassificationModel, RandomForestClassificationModel, GBTClassificationModel)


@dataclass(frozen=True)
class MatrixParams:
    """How a cleaned customer row becomes a numeric row."""

    features: FeatureParams
    onehot: OneHotParams
    scaler: ScaleParams
    dropped: list[str]

    def names(self) -> list[str]:
        return [*self.scaler.columns, *self.onehot.names()]


@dataclass(frozen=True)
class Bundle:
    """A trained model with every fitted parameter that scoring new raw data needs."""

    matrix: MatrixParams
    model: PipelineModel
    fills: FillValues | None = None
    bounds: Bounds | None = None


def fit_matrix(
    train: DataFrame, reference_features: bool = False, max_categories: int = MAX_CATEGORIES
) -> tuple[MatrixParams, DataFrame]:
    """Fit features, encoder and scaler on the training part; also returns its numeric form.

    ``reference_features`` keeps the columns that give the label away; a text column with more than
    ``max_categories`` values is an error.
    """
    features = fit_features(train)
    dropped = [] if reference_features else list(LEAKING)
    wide = apply_features(train, features).drop(*dropped)
    text, numeric = columns_by_type(wide, NOT_FEATURES)
    params = MatrixParams(features, fit_onehot(wide, text, max_categories), fit_scaler(wide, numeric), dropped)
    return params, to_matrix(train, params)


def to_matrix(df: DataFrame, params: MatrixParams) -> DataFrame:
    """Numeric form of cleaned rows: one projection with frozen parameters."""
    wide = apply_features(df, params.features).drop(*params.dropped)
    return apply_scaler(apply_onehot(wide, params.onehot), params.scaler)


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced weights: rows by the number of classes times the rows of the class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows"), F.count("*")).first()
    weight = F.lit(float(total[0] or 0)) / (F.lit(float(total[1] or 1)) * F.col("rows"))
    return counts.select(label, "rows", weight.alias("weight"))


def weight_column(weights: list[Row], label: str = LABEL) -> Column:
    """The balanced weight of each row; classes are few, so they become literals."""
    weight = F.lit(1.0)
    for row in weights:
        weight = F.when(F.col(label) == row[label], F.lit(row["weight"])).otherwise(weight)
    return weight


@contextmanager
def _held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a training matrix on executors while an iterative fit reads it again and again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def _training_rows(
    matrix: DataFrame, names: Sequence[str], balanced: bool, partitions: int = PARTITIONS, key: str = "customer_id"
) -> DataFrame:
    """Features, label and weight, dealt by the hash of the customer and ordered within each part."""
    weights = class_weights(matrix).collect()
    weight = weight_column(weights) if balanced else F.lit(1.0)
    extra = [F.col("fold")] if "fold" in matrix.columns else []
    rows = matrix.select(
        *[F.col(f"`{n}`").cast("double").alias(n) for n in names],
        F.col(LABEL).cast("double").alias("label"),
        weight.alias("weight"),
        *extra,
        F.col(key).alias("_key"),
    )
    return rows.repartition(partitions, "_key").sortWithinPartitions("_key").drop("_key")


def _assembler(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features")


def classifier(name: str, seed: int = 42, **options: object):
    """An unfitted classifier by display name."""
    require_known(name, MODELS, "model")
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if name == "Logistic Regression":
        return LogisticRegression(**{**common, "maxIter": 100, "standardization": False, **options})
    if name == "Decision Tree":
        return DecisionTreeClassifier(**{**common, "maxDepth": 10, "seed": seed, **options})
    if name == "Random Forest":
        forest = {
            "numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "sqrt", "seed": seed,
            "maxMemoryInMB": 1024, "cacheNodeIds": True, "checkpointInterval": 10,
        }
        return RandomForestClassifier(**{**common, **forest, **options})
    return GBTClassifier(**{**common, "maxIter": 20, "maxDepth": 5, "seed": seed, **options})


def without_summary(fitted):
    """A fitted classifier without its training summary: that holds the session, which cannot be sent to tasks once it observed a table."""
    if getattr(fitted, "hasSummary", False):
        fitted._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return fitted


def train_model(
    matrix: DataFrame,
    names: Sequence[str],
    name: str = "Random Forest",
    balanced: bool = True,
    seed: int = 42,
    partitions: int = PARTITIONS,
    **options: object,
) -> PipelineModel:
    """Fit one model on a numeric training table; the forest has 100 trees of depth 10.

    The same rows, seed and number of ``partitions`` give the same model on every machine; raise the number for
    tables whose parts would not fit an executor.
    """
    require_columns(matrix, [*names, LABEL])
    shared_folder(matrix.sparkSession)  # long lineages of tree fitting are cut there
    with _held(_training_rows(matrix, names, balanced, partitions)) as rows:
        fitted = Pipeline(stages=[_assembler(names), classifier(name, seed, **options)]).fit(rows)
    without_summary(fitted.stages[-1])
    return fitted


def train_bundle(
    train: DataFrame,
    reference_features: bool = False,
    fills: FillValues | None = None,
    bounds: Bounds | None = None,
    max_categories: int = MAX_CATEGORIES,
    **options: object,
) -> Bundle:
    """Fit the whole chain on the training part of a cleaned table."""
    params, matrix = fit_matrix(train, reference_features, max_categories)
    model = train_model(matrix, params.names(), **options)
    return Bundle(params, model, fills, bounds)


def _scored_rows(matrix: DataFrame, names: Sequence[str], model: PipelineModel) -> DataFrame:
    # A number that is missing in a new row counts as the center of its column.
    numeric = matrix.withColumns({n: F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names})
    assembler, fitted = model.stages
    rows = assembler.transform(numeric)
    if isinstance(fitted, TREES):
        # A tree asks for one feature per node; the assembler's sparse vectors search for each of them.
        rows = rows.withColumn("features", array_to_vector(vector_to_array("features")))
    return fitted.transform(rows)


def predict(df: DataFrame, bundle: Bundle, probability: bool = False) -> DataFrame:
    """Add predicted_churn, and churn_probability on request, to cleaned rows with all their columns.

    The numeric form and the class are computed beside the original columns in the same row, so
    nothing is joined back.
    """
    carried = df.withColumn("_row", F.struct(*df.columns))
    marked = _scored_rows(to_matrix(carried, bundle.matrix), bundle.matrix.names(), bundle.model)
    added = [F.col("prediction").cast("bigint").alias("predicted_churn")]
    if probability:
        added.append(vector_to_array("probability")[1].alias("churn_probability"))
    return marked.select("_row.*", *added)


def risk_level(probability: Column | str, low: float = 0.33, high: float = 0.66) -> Column:
    """Low, Medium or High."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p.isNull(), None).when(p < low, "Low").when(p < high, "Medium").otherwise("High")


def feature_importance(bundle: Bundle) -> DataFrame:
    """Feature names by decreasing importance in the fitted trees."""
    fitted = bundle.model.stages[-1]
    values = fitted.featureImportances.toArray().tolist()
    pairs = sorted(zip(bundle.matrix.names(), values, strict=True), key=lambda p: (-p[1], p[0]))
    rows = [(i + 1, n, float(v)) for i, (n, v) in enumerate(pairs)]
    return SparkSession.active().createDataFrame(rows, "place bigint, feature string, importance double")


def _metric_row(scored: DataFrame) -> dict[str, float]:
    report = {r["class"]: r for r in classification_report(scored, "label", "pred").collect()}
    one = report.get("1")
    return {
        "accuracy": report["accuracy"]["f1"],
        "precision": one["precision"] if one else 0.0,
        "recall": one["recall"] if one else 0.0,
        "f1": one["f1"] if one else 0.0,
    }


def compare_models(
    train: DataFrame, test: DataFrame, names: Sequence[str], models: Sequence[str] = MODELS, **options: dict
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the churned class, and ROC AUC, best F1 first.

    ``options`` gives settings per model, with blanks in the model name written as underscores.
    """
    rows = []
    area = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", labelCol="label", numBins=0)
    shared_folder(train.sparkSession)
    assembled = _assembler(names).transform(_training_rows(train, names, balanced=True))
    checked = _assembler(names).transform(_training_rows(test, names, balanced=False))
    with _held(assembled.select("features", "label", "weight")) as known, _held(checked.select("features", "label")) as new:
        for name in models:
            fitted = without_summary(classifier(name, **options.get(name.replace(" ", "_"), {})).fit(known))
            scored = fitted.transform(new)
            marked = scored.select(
                F.col("label").cast("bigint").alias("label"), F.col("prediction").cast("bigint").alias("pred")
            )
            rows.append({"model": name, **_metric_row(marked), "roc_auc": area.evaluate(scored)})
    rows.sort(key=lambda r: (-r["f1"], r["model"]))
    fields = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double"
    return train.sparkSession.createDataFrame(rows, fields)
