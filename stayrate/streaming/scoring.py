"""Scoring of new customer rows with a trained bundle, in batch or as they arrive.

Every step but one uses frozen parameters and works row by row. The one is to keep a customer's first row: a stream
remembers which customers have come, a flag each, in the state that its checkpoint holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stayrate import schema
from stayrate.errors import NotFittedError
from stayrate.operators.model import Bundle
from stayrate.plans.preprocess import prepare_frozen
from stayrate.plans.training import scored_table


def first_rows(arrivals: DataFrame, key: str = "customer_id", order: str = schema.INGEST_ORDER) -> DataFrame:
    """A stream of the first row of each key: of the first micro-batch that has the key, the row that comes first by ``order``.

    Where files arrive in that order, this is what :func:`~stayrate.operators.clean.dedupe_first` keeps of all of them.
    Rows without a key are left out. The state grows by a flag per key; rows pass through it as JSON, types unchanged.
    """
    rows = arrivals.where(F.col(key).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), F.to_json(F.struct("*")).alias("row"))

    def first(_: tuple, found: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        parts = ((pd.notna(o), int(o) if pd.notna(o) else 0, r) for part in found for o, r in zip(part["order"], part["row"], strict=True))
        best = min(parts)  # a missing order comes first, as in a batch
        state.update((True,))
        yield pd.DataFrame({"row": [best[2]]})

    kept = rows.groupBy("key").applyInPandasWithState(first, "row string", "seen boolean", "append", GroupStateTimeout.NoTimeout)
    return kept.select(F.from_json("row", arrivals.schema).alias("row")).select("row.*")


def score(raw: DataFrame, bundle: Bundle, probability: bool = False) -> DataFrame:
    """Clean and score the first row of each customer, labelled or not, in a batch or in a stream; rows without an id
    are left out."""
    if bundle.fills is None or bundle.bounds is None:
        raise NotFittedError("the bundle has no fill values or bounds to clean new rows with")
    if raw.isStreaming:
        raw = first_rows(raw)
    clean = prepare_frozen(raw, bundle.fills, bundle.bounds, unique=not raw.isStreaming)
    return scored_table(clean, bundle, probability)


def read_arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stream of raw customer files; the schema is fixed and files are taken in bounded batches."""
    return (
        spark.readStream.schema(schema.raw_schema(with_ingest_order=True))
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def start_scoring(
    arrivals: DataFrame,
    bundle: Bundle,
    sink: str,
    checkpoint: str,
    name: str = "scoring",
    available_now: bool = False,
) -> StreamingQuery:
    """Append scored rows as parquet files, each exactly once for as long as the ``checkpoint`` folder is kept."""
    writer = score(arrivals, bundle, probability=True).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", sink).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
