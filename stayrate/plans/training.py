"""From the raw table to a trained model, its evaluation and the scored table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate import schema
from stayrate.operators import metrics
from stayrate.operators.features import apply_features
from stayrate.operators.model import Bundle, predict, train_bundle
from stayrate.operators.split import assign_test
from stayrate.plans.preprocess import Prepared, prepare
from stayrate.session import stage
from stayrate.sources.artifacts import save_bundle
from stayrate.sources.files import export_scored


@dataclass(frozen=True)
class Trained:
    """What training leaves behind."""

    bundle: Bundle
    table: DataFrame
    train: DataFrame
    test: DataFrame
    accuracy: DataFrame
    report: DataFrame


def train_on(prepared: Prepared, reference_features: bool = False, seed: int = 42, **options: object) -> Trained:
    """Split, fit features, encoder and scaler on the training part, train and evaluate.

    The table is staged with its split, since every fit reads the training part again.
    """
    marked = stage(assign_test(prepared.table, seed=seed), "split")
    train, test = (marked.where(t).drop("is_test") for t in (~F.col("is_test"), F.col("is_test")))
    bundle = train_bundle(
        train, reference_features, fills=prepared.fills, bounds=prepared.bounds, seed=seed, **options
    )
    predicted = predict(test, bundle)
    return Trained(
        bundle, marked.drop("is_test"), train, test,
        metrics.accuracy(predicted), metrics.classification_report(predicted),
    )


def scored_table(prepared: DataFrame, bundle: Bundle, probability: bool = False) -> DataFrame:
    """Cleaned rows with segment, engagement and prediction, in the order of the export."""
    marked = apply_features(predict(prepared, bundle, probability), bundle.matrix.features)
    extra = ["churn_probability"] if probability else []
    return marked.select(*[f.name for f in schema.scored_schema()], *extra)


def run_training(
    raw: DataFrame,
    model_path: str | None = None,
    export_path: str | None = None,
    reference_features: bool = False,
    fit_on: str = "all",
    **options: object,
) -> Trained:
    """The whole job: clean, cap, split, train, and given paths save the bundle and the export."""
    trained = train_on(prepare(raw, fit_on=fit_on), reference_features, **options)
    if model_path is not None:
        save_bundle(raw.sparkSession, trained.bundle, model_path)
    if export_path is not None:
        export_scored(scored_table(trained.table, trained.bundle), export_path)
    return trained
