"""Base file to customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators.checks import require_columns
from stayrate.operators.derive import Factors, customers_from_base
from stayrate import schema
from stayrate.sources.files import scan_base_csv, write_raw_csv


def augment(base: DataFrame, anchor: str | None = None, factors: Factors = Factors()) -> DataFrame:
    """The 32 columns; dates count back from ``anchor`` (yyyy-MM-dd), by default from today."""
    require_columns(base, schema.BASE_SCHEMA.names)
    day = F.current_date() if anchor is None else F.lit(anchor).cast("date")
    return customers_from_base(base, day, factors)


def generate(spark: SparkSession, base_path: str, raw_path: str, anchor: str | None = None, factors: Factors = Factors()) -> None:
    """Read the base file and write the raw customer file."""
    write_raw_csv(augment(scan_base_csv(spark, base_path), anchor, factors), raw_path)
