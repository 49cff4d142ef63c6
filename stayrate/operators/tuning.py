"""Search for model settings, everything fitted inside folds.

In every fold the whole chain, from fill values to the encoder, learns from the other folds only, so nothing of a
validation row reaches its model; the fold's matrices are staged, and all settings are tried on them.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.errors import InputError
from stayrate.operators.checks import columns_by_type, require_columns, require_known
from stayrate.operators.clean import dedupe_first, nan_to_null
from stayrate.operators.dictionary import EncodeStep
from stayrate.operators.model import LABEL, LEAKING, NOT_FEATURES, PARTITIONS, class_weights, classifier, weight_column, without_summary
from stayrate.operators.split import assign_folds
from stayrate.operators.steps import CapStep, CleanStep, EngineerStep, ScaleStep, Step
from stayrate.session import shared_folder, stage

# How each model is tuned
METHODS = {
    "Logistic Regression": "grid",
    "Decision Tree": "grid",
    "Random Forest": "random",
    "Gradient Boosting": "random",
}

Draw = Callable[[random.Random], object]


@dataclass(frozen=True)
class Between:
    """Whole numbers from ``low`` to ``high``, or with ``log`` any numbers, evenly by their logarithm."""

    low: float
    high: float
    log: bool = False

    def __call__(self, rng: random.Random) -> object:
        if self.log:
            return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))
        return rng.randint(int(self.low), int(self.high))


@dataclass(frozen=True)
class OneOf:
    values: tuple

    def __call__(self, rng: random.Random) -> object:
        return rng.choice(self.values)


#: What is tried by default: values of a grid, or distributions.
RANGES: dict[str, dict[str, Sequence | Draw]] = {
    "Logistic Regression": {"regParam": (0.0, 0.001, 0.01, 0.1), "elasticNetParam": (0.0, 0.5, 1.0)},
    "Decision Tree": {"maxDepth": (3, 5, 10), "minInstancesPerNode": (1, 5, 20)},
    "Random Forest": {"numTrees": Between(50, 200), "maxDepth": Between(4, 14), "minInstancesPerNode": Between(1, 20),
                      "featureSubsetStrategy": OneOf(("sqrt", "log2", "onethird"))},
    "Gradient Boosting": {"maxIter": Between(10, 60), "maxDepth": Between(2, 6), "stepSize": Between(0.02, 0.3, True),
                          "subsamplingRate": OneOf((0.6, 0.8, 1.0))},
}


def grid_settings(ranges: dict[str, Sequence]) -> list[dict[str, object]]:
    """Every combination of the values."""
    return [dict(zip(ranges, values, strict=True)) for values in itertools.product(*ranges.values())]


def drawn_settings(ranges: dict[str, Sequence | Draw], draws: int, seed: int) -> list[dict[str, object]]:
    """``draws`` different settings; the same seed draws the same ones, and a plain sequence is drawn from evenly."""
    rng, found = random.Random(seed), {}
    for _ in range(100 * draws):
        one = {k: v(rng) if callable(v) else rng.choice(list(v)) for k, v in ranges.items()}
        found.setdefault(repr(one), one)
        if len(found) == draws:
            break
    return list(found.values())


def settings_of(name: str, draws: int = 10, seed: int = 42, ranges: dict | None = None) -> list[dict[str, object]]:
    """The settings that a model's method tries."""
    require_known(name, tuple(METHODS), "model")
    ranges = ranges or RANGES[name]
    return drawn_settings(ranges, draws, seed) if METHODS[name] == "random" else grid_settings(ranges)


def chain(leaking: bool = False, method: str = "standard") -> list[Step]:
    """The fitted steps between raw rows and the matrix: clean, cap, engineer, scale, encode."""
    skip = [*NOT_FEATURES, "_key"]
    return [
        CleanStep(), CapStep(), EngineerStep(without=[] if leaking else list(LEAKING)),
        ScaleStep(skip=skip, method=method), EncodeStep(skip=skip),
    ]


def assembled(df: DataFrame, encoded: str = "encoded", weights: list | None = None) -> DataFrame:
    """_key, label, weight, features (sparse) of the rows that a chain returned."""
    numeric = columns_by_type(df, NOT_FEATURES)[1]
    inputs = [*numeric, *([encoded] if encoded in df.columns else [])]
    wide = VectorAssembler(inputCols=inputs, outputCol="features").transform(df)
    weight = weight_column(weights) if weights else F.lit(1.0)
    return wide.select(F.col("customer_id").alias("_key"), F.col(LABEL).cast("double").alias("label"), weight.alias("weight"), "features")


def fit_chain(rows: DataFrame, steps: Sequence[Step]) -> tuple[PipelineModel, DataFrame]:
    """The fitted steps and what they make of ``rows``, staged where a later step learns from it and its making is not light."""
    fitted = []
    for i, step in enumerate(steps):
        fitted.append(step.fit(rows))
        rows = fitted[-1].transform(rows)
        if i + 1 < len(steps) and not fitted[-1].light:
            rows = stage(rows, "chain")
    return PipelineModel(fitted), rows


def fold_matrices(rows: DataFrame, fold: int, steps: Sequence[Step], partitions: int = PARTITIONS) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The chain fitted without ``fold``, and the staged matrices of the other folds and of ``fold``."""
    seen, held = (rows.where(c).drop("fold") for c in (F.col("fold") != fold, F.col("fold") == fold))
    fitted, known = fit_chain(seen, steps)
    train = assembled(known, weights=class_weights(known).collect())  # a row a class
    train = stage(train.repartition(partitions, "_key").sortWithinPartitions("_key"), "fold_train")
    return fitted, train, stage(assembled(fitted.transform(held)), "fold_held")


def search_settings(
    raw: DataFrame,
    name: str = "Random Forest",
    settings: Sequence[dict[str, object]] | None = None,
    folds: int = 5,
    draws: int = 10,
    seed: int = 42,
    steps: Callable[[], Sequence[Step]] = chain,
    parallelism: int = 4,
    partitions: int = 8,
) -> DataFrame:
    """place, settings, mean_f1, worst_f1 of every setting, best mean F1 of the churned class first, ties by text.

    ``raw`` are raw customer rows; repeated customers and rows without label are left out first. Folds are stratified
    by label, told by the hash of the customer. A matrix has ``partitions`` parts, whatever the machine. Grid or random search, as the model's method says, unless ``settings``
    are given.
    """
    require_columns(raw, [LABEL, "customer_id"])
    spark = raw.sparkSession
    shared_folder(spark)
    settings = list(settings) if settings is not None else settings_of(name, draws, seed)
    unique = dedupe_first(nan_to_null(raw)).where(F.col(LABEL).isNotNull() & F.col("customer_id").isNotNull())
    rows = stage(assign_folds(unique, folds, seed=seed), "folds")
    if rows.select("fold").distinct().count() < folds:
        raise InputError(f"too few rows for {folds} folds")
    f1 = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, labelCol="label")
    found: dict[int, list[float]] = {i: [] for i in range(len(settings))}
    for fold in range(folds):
        _, train, held = fold_matrices(rows, fold, steps(), partitions)
        train, held = train.persist(), held.persist()

        def tried(i: int, train: DataFrame = train, held: DataFrame = held) -> float:
            return f1.evaluate(without_summary(classifier(name, seed, **settings[i]).fit(train)).transform(held))

        pool = ThreadPool(min(parallelism, len(settings)) or 1)
        try:
            for i, value in enumerate(pool.map(inheritable_thread_target(spark)(tried), range(len(settings)))):
                found[i].append(value)
        finally:
            pool.close()
            train.unpersist()
            held.unpersist()
    said = [(", ".join(f"{k}={v:.4g}" if isinstance(v, float) else f"{k}={v}" for k, v in s.items()), found[i]) for i, s in enumerate(settings)]
    said.sort(key=lambda r: (-sum(r[1]), r[0]))
    out = [(i + 1, s, sum(v) / folds, min(v)) for i, (s, v) in enumerate(said)]
    return spark.createDataFrame(out, "place bigint, settings string, mean_f1 double, worst_f1 double")
