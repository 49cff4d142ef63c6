"""Reproducible stratified parts of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.selection import MAX_CLASSES, hash_cuts, key_hash, part_number
from stayrate.operators.checks import require_columns


def assign_parts(
    df: DataFrame,
    shares: Sequence[float],
    label: str = "churn",
    key: str = "customer_id",
    seed: int = 42,
    column: str = "part",
    max_classes: int = MAX_CLASSES,
) -> DataFrame:
    """Number the parts cut at the cumulative ``shares`` of every class, exact to one row per class.

    More than ``max_classes`` labels are an error.
    """
    require_columns(df, [label, key])
    cuts = hash_cuts(df, label, key, seed, shares, max_classes)
    hashed = df.withColumn("_hash", key_hash(key, seed))
    return hashed.withColumn(column, part_number(label, F.col("_hash"), cuts)).drop("_hash")


def assign_test(
    df: DataFrame, test_share: float = 0.2, label: str = "churn", key: str = "customer_id", seed: int = 42
) -> DataFrame:
    """Add ``is_test``: true for ``round(test_share * rows)`` rows of every class."""
    parts = assign_parts(df, [test_share], label, key, seed, "_part")
    return parts.withColumn("is_test", F.col("_part") == 0).drop("_part")


def assign_folds(
    df: DataFrame, folds: int = 5, label: str = "churn", key: str = "customer_id", seed: int = 42
) -> DataFrame:
    """Add ``fold``: equally large stratified folds numbered from 0."""
    return assign_parts(df, [i / folds for i in range(1, folds)], label, key, seed, "fold")


def stratified_split(
    df: DataFrame, test_share: float = 0.2, label: str = "churn", key: str = "customer_id", seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Training part and test part; both are filters over ``df``."""
    marked = assign_test(df, test_share, label, key, seed)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where("is_test").drop("is_test")
