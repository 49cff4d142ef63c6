"""CSV and parquet files with fixed schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate import schema
from stayrate.errors import StorageError
from stayrate.operators.checks import require_columns

CORRUPT = "_corrupt_record"
# Texts keep their blanks, and a quote inside a text is doubled.
_CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _csv(spark: SparkSession, path: str, fields: T.StructType, corrupt: bool) -> DataFrame:
    """Columns are found by name in the header, whatever their order and whatever else is there.

    All files under ``path`` must have the header of the first; Spark checks that when it reads them.
    """
    reader = spark.read.options(**_CSV).option("mode", "PERMISSIVE").option("enforceSchema", False)
    kinds = {f.name: f.dataType for f in fields}
    names = list(kinds)
    try:
        header = reader.csv(path).columns
        absent = [n for n in names if n not in header]
        if absent:
            raise StorageError(f"{path} has no column {', '.join(absent)}")
        order = [T.StructField(n, kinds.get(n, T.StringType())) for n in header]
        if corrupt:
            order.append(T.StructField(CORRUPT, T.StringType()))
            names.append(CORRUPT)
            reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        return reader.schema(T.StructType(order)).csv(path).select(*names)
    except AnalysisException as e:
        raise StorageError(f"cannot read {path}: {e}") from e


def scan_base_csv(spark: SparkSession, path: str, corrupt: bool = True) -> DataFrame:
    """The 13 base columns of a file and, unless ``corrupt`` is off, the text of lines with unreadable cells."""
    return _csv(spark, path, schema.BASE_SCHEMA, corrupt)


def _write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**_CSV).csv(path)


def write_raw_csv(df: DataFrame, path: str) -> None:
    """The 32 columns in table order."""
    require_columns(df, schema.ALL_COLUMNS)
    _write_csv(df.select(*schema.ALL_COLUMNS), path)


def scan_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A file written by :func:`write_raw_csv`."""
    return _csv(spark, path, schema.raw_schema(), corrupt=False)


def write_clean(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Cleaned rows as parquet, or as CSV."""
    if kind == "csv":
        _write_csv(df, path)
    else:
        df.write.mode("overwrite").format(kind).save(path)


def export_scored(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Scored rows as CSV; ``one_file`` writes them through one task and is meant for small tables."""
    columns = [f.name for f in schema.scored_schema()]
    require_columns(df, columns)
    _write_csv(df.select(*columns), path, one_file)


def scan_scored(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """The scored table, dates as timestamps."""
    fields = schema.scored_schema()
    if kind == "csv":
        return _csv(spark, path, fields, corrupt=False)
    try:
        return spark.read.schema(fields).format(kind).load(path)
    except AnalysisException as e:
        raise StorageError(f"cannot read {path}: {e}") from e


def options_of(df: DataFrame, column: str) -> list[str]:
    """Sorted distinct values for a filter list."""
    rows = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()
    return [r[0] for r in rows]
