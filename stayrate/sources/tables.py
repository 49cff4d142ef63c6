"""Tables: create, replace, read. A replaced table is a view over the newest of its versions."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from stayrate import schema
from stayrate.errors import StorageError
from stayrate.operators.clean import nan_to_null

WRITE_BATCH = 5_000


def _folder(spark: SparkSession, table: str) -> str:
    """Where the versions of a table lie: beside the tables of the warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{table.replace('.', '/')}.versions"


def _is_view(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType == "VIEW"


def _point(spark: SparkSession, table: str, path: str) -> None:
    """Let the name stand for the version at ``path``: one step in the catalog."""
    if spark.catalog.tableExists(table) and not _is_view(spark, table):
        spark.sql(f"DROP TABLE {table}")  # once: a table that was not written here becomes versioned
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM parquet.`{path}`")


def versions(spark: SparkSession, table: str = "customers") -> list[str]:
    """Folders of the versions that are still there, in order of their names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, table))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in system.listStatus(folder)) if system.exists(folder) else []


def current_version(spark: SparkSession, table: str = "customers") -> str | None:
    """The folder that the table reads now, or nothing for a table that is not versioned."""
    if not _is_view(spark, table):
        return None
    files = spark.table(table).inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def create_schema(spark: SparkSession, table: str = "customers") -> None:
    """Create the customer table, empty, if there is none."""
    if not spark.catalog.tableExists(table):
        write_table(spark.createDataFrame([], schema.raw_schema()), table)


def write_table(df: DataFrame, table: str = "customers", keep: int = 2) -> None:
    """Replace the whole table at once, whatever its columns were.

    The rows are written as a new version, and only then the name is pointed at it: a write that fails leaves the old
    table as it was, and readers see the old or the new rows, never a mixture. The ``keep`` newest versions by time of
    writing stay, so that queries that began on the one before can end.
    """
    spark = df.sparkSession
    path = f"{_folder(spark, table)}/{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        _point(spark, table, path)
    except PySparkException as e:
        _drop(spark, [path])
        raise StorageError(f"cannot write table {table}: {e}") from e
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told = [(system.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(p)).getModificationTime(), p) for p in versions(spark, table) if not p.endswith(path[-32:])]
    _drop(spark, [p for _, p in sorted(told)[: max(0, len(told) - keep + 1)]])


def _drop(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scan_table(spark: SparkSession, table: str = "customers") -> DataFrame:
    """The whole table, NaN read as missing; filters and column choices reach the scan."""
    try:
        return nan_to_null(spark.table(table))
    except AnalysisException as e:
        raise StorageError(f"cannot read table {table}: {e}") from e


def write_jdbc(df: DataFrame, url: str, table: str = "customers", **properties: str) -> None:
    """Replace a database table in batches of 5,000 rows."""
    options = {"batchsize": str(WRITE_BATCH), **properties}
    try:
        df.write.mode("overwrite").jdbc(url, table, properties=options)
    except PySparkException as e:
        raise StorageError(f"cannot write table {table}: {e}") from e


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str = "customers",
    split_by: str | None = None,
    low: int | str = 0,
    high: int | str = 0,
    parts: int = 1,
    **properties: str,
) -> DataFrame:
    """Read a database table, in parallel over ranges of a numeric or date column when one is given."""
    split = {} if split_by is None else {
        "column": split_by, "lowerBound": low, "upperBound": high, "numPartitions": parts
    }
    try:
        return nan_to_null(spark.read.jdbc(url, table, properties=properties, **split))
    except PySparkException as e:
        raise StorageError(f"cannot read table {table}: {e}") from e
