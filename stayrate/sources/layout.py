"""Bucketed tables: rows of one key lie in one file, so that grouping and joining by it need no shuffle."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from stayrate.errors import StorageError
from stayrate.operators.checks import require_columns

BUCKETS = 64


def write_bucketed(df: DataFrame, table: str, key: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` as a catalog table bucketed and sorted by ``key``, and read it; ``path`` puts its files elsewhere.

    The rows are dealt out once, as Spark deals them for a join, so a bucket is one file. Tables with the same number of
    buckets join without a shuffle.
    """
    require_columns(df, [key])
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    try:
        (writer.option("path", path) if path else writer).saveAsTable(table)
    except PySparkException as e:
        raise StorageError(f"cannot write table {table}: {e}") from e
    return df.sparkSession.table(table)
