"""Most frequent values and distinct values of several columns in one distributed count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.errors import InputError


def pairs_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, value of every column of every row that has a value."""
    pairs = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")))
        for c in columns
    ])
    return df.select(F.explode(F.array_compact(pairs)).alias("p")).select("p.name", "p.value")


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The mode of each column, the smallest on ties; ``None`` for a column without values.

    Values are counted per partition before the shuffle, so neither a frequent value nor a column
    with very many values ends up in one task.
    """
    counts = pairs_of(df, columns).groupBy("name", "value").agg(F.count("*").alias("n"))
    best = counts.groupBy("name").agg(F.min(F.struct(-F.col("n"), F.col("value"))).alias("best"))
    found = {row["name"]: row["best"]["value"] for row in best.collect()}
    return {c: found.get(c) for c in columns}


def categories(df: DataFrame, columns: list[str], most: int) -> dict[str, list[str]]:
    """Sorted distinct values of each column; more than ``most`` in any of them is an error."""
    # one value more than all columns may have together is enough to know that one has too many
    values = pairs_of(df, columns).distinct().limit(most * len(columns) + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for name, value in values:
        found[name].append(value)
    wide = [c for c, v in found.items() if len(v) > most]
    if wide:
        raise InputError(f"more than {most} categories: {', '.join(wide)}")
    return {c: sorted(v) for c, v in found.items()}
