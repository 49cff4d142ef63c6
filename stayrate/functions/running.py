"""Running totals over a whole table in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.session import stage

#: Rows that one task adds up, on average.
PER_TASK = 1_000_000


def running_totals(
    df: DataFrame, order: str, totals: dict[str, str], descending: bool = False, per_task: int = PER_TASK
) -> DataFrame:
    """Add ``totals[column]``: the sum of ``column`` over all rows up to and including this one.

    ``df`` has one row per value of ``order``. One window over the table would put all of it in one
    task; here the rows are cut into value ranges of about ``per_task`` rows, each is summed on its
    own and starts from the totals of the ranges before it. The ranges are staged, since another
    sample could cut them elsewhere; their totals, one row per range, meet in the driver.
    """
    ranges = max(8, -(-df.count() // per_task))
    banded = stage(df.repartitionByRange(ranges, order).withColumn("_band", F.spark_partition_id()), "ranges")
    sums = banded.groupBy("_band").agg(*[F.sum(c).alias(c) for c in totals]).collect()
    before, starts = dict.fromkeys(totals, 0), []
    for row in sorted(sums, key=lambda r: r["_band"], reverse=descending):
        starts.append((row["_band"], *before.values()))
        before = {c: n + row[c] for c, n in before.items()}
    fields = ", ".join(["_band int", *[f"`_{c}` {banded.agg(F.sum(c)).schema[0].dataType.simpleString()}" for c in totals]])
    by = F.col(order).desc() if descending else F.col(order).asc()
    window = Window.partitionBy("_band").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    # one row per range, so the hint is bounded by the number of tasks
    placed = banded.join(F.broadcast(df.sparkSession.createDataFrame(starts, fields)), "_band")
    summed = placed.withColumns({name: F.sum(c).over(window) + F.col(f"_{c}") for c, name in totals.items()})
    return summed.drop("_band", *[f"_{c}" for c in totals])
