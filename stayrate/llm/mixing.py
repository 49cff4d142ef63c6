"""Mixing sources to target weights along a curriculum.

Each source has a weight that changes over training, from ``first`` at the start to ``last`` at the end. Its integral
up to time t, scaled to the source's target, is the source's demand of words at t. The documents of a source stand in
a fixed random order; the words before a document are its place in that order, and the time at which the demand
reaches its place is its training position. The second time through a source continues the same count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import WORD, whole_row, whole_text
from stayrate.session import stage

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Bits of the order that each of the two counting passes resolves; a cut is found to 2 ** -24 of a source.
BITS = 12


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, share: float, limit: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight, target from rows (source, source_size), one per source.

    Targets add up to ``share`` times all sizes, in proportion to the weights, but none exceeds ``limit`` times its
    source's size: the excess goes to the others by weight, until none is above. Sources without words get 0.
    """
    # one row per source: the numbering is over names, not over documents
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    now = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth)).withColumn("cap", limit * F.col("source_size"))
    now = stage(now, "sources")
    total = share * float(now.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # level: target per unit of weight; it rises as sources reach their caps
        capped, rest = now.agg(
            F.sum(F.when(F.col("cap") <= level * F.col("weight"), F.col("cap"))),
            F.sum(F.when(F.col("cap") > level * F.col("weight"), F.col("weight"))),
        ).first()
        new = max(0.0, total - (capped or 0.0)) / rest if rest else level
        if new <= level:
            break
        level = new
    return now.withColumn("target", F.least("cap", level * F.col("weight"))).drop("cap")


def _order(columns: list[Column]) -> Column:
    """Place in the fixed random order, 0 to 2**48 - 1."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 16)


def _prefix(rows: DataFrame, bucket: Column) -> DataFrame:
    """source, bucket, size of the bucket and words of the source before it; buckets are bounded by 2**BITS a source."""
    per = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    return per.withColumn("before", F.sum("words").over(w) - F.col("words"))


def plan(sized: DataFrame, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """From (source, size, place): per source its target and cut, and the words before each interval of the order.

    A source's target is ``full`` times all its words and a rest; documents whose place is below ``cut`` are taken
    once more than ``full``. The cut lies where the words before it come nearest to the rest, found by counting words
    per interval of the order, then per interval of the interval that holds it: no ranking of a source's documents.
    """
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, limit, weights)
    size, goal = F.col("source_size"), F.col("target")
    targets = targets.withColumn("full", F.when(size > 0, F.floor(goal / size + 1e-12)).otherwise(0))
    targets = stage(targets.withColumn("rest", F.when(size > 0, goal - F.col("full") * size).otherwise(0.0)), "targets")
    coarse = stage(_prefix(sized, F.shiftrightunsigned("place", 48 - BITS)), "order")
    t = targets.select(F.col("source").alias("_s"), "rest")
    same = F.col("source").eqNullSafe(F.col("_s"))
    holds = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))
    at = coarse.join(t, same).filter(holds).select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.col("before").alias("_before"), "rest")
    inside = sized.join(at, same & (F.shiftrightunsigned("place", 48 - BITS) == F.col("_b")))
    fine = inside.groupBy("source", "_b", "_before", "rest", F.shiftrightunsigned("place", 48 - 2 * BITS).alias("bucket")).agg(F.sum("size").alias("words"))
    upto = F.col("_before") + F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    ends = fine.withColumn("upto", upto)
    # cut behind the interval whose end is nearest to the rest, or before the first one
    off = F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), (F.col("bucket") + 1).alias("cut"))
    best = ends.groupBy("source", "_b", "_before", "rest").agg(F.min(off).alias("best"))
    none = F.col("rest") - F.col("_before") <= F.col("best.off")
    cut = F.when(none, F.shiftleft("_b", BITS)).otherwise(F.col("best.cut"))
    cuts = best.select(F.col("source").alias("_s"), cut.alias("cut"))
    planned = targets.join(cuts, same, "left").drop("_s").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))
    return stage(planned, "cuts"), coarse


def demand_time(share: Column, first: Column, last: Column) -> Column:
    """Time t in 0 to 1 at which a weight going from ``first`` to ``last`` has had ``share`` of its integral.

    The integral is first * t + (last - first) * t * t / 2; the smaller root in the form that also holds for equal weights.
    """
    need = share * (first + last) / 2
    root = F.sqrt(F.greatest(first * first + 2 * (last - first) * need, F.lit(0.0)))
    return F.when(first + root > 0, F.least(F.lit(1.0), 2 * need / (first + root))).otherwise(share)


def mix(documents: DataFrame, size: Column, share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS,
        carry: list[str] | None = None) -> DataFrame:
    """Per document: row (its ``carry`` columns, default all), size, source_size, target, taken, positions (an array).

    The weight of a source at the start of training is the one that ``weights`` gives it and moves to the mean of the
    weights at the end: heavy sources come early, light ones late. Documents of one source stand in an order given by
    a hash of id and text, so reruns agree; rows equal in both share a place and are taken together. A missing text
    has size 0, a missing source is a source of its own (the last by name), a missing id counts in the hash like any
    value. Documents of size 0 have copies and positions but take no words. An empty table gives no rows. Columns of
    the table may have any names. Texts are read twice only where they are carried.
    """
    text = whole_text()
    own = documents.select(*carry) if carry is not None else documents
    base = documents.select(whole_row(own), F.col("source").cast("string").alias("source"),
                            size.alias("size"), _order([F.col("doc_id"), text]).alias("place"))
    if "text" in own.columns:
        sized = stage(base.select("source", "size", "place"), "sizes")
    else:
        sized = base = stage(base, "sizes")
    targets, order = plan(sized, share, limit, weights)
    t = targets.withColumnRenamed("source", "_s")
    o = order.select(F.col("source").alias("_o"), F.col("bucket").alias("_b"), "words", "before")
    # a row per source, and at most 2**BITS rows per source; Spark broadcasts either only below its threshold
    rows = base.join(t, F.col("source").eqNullSafe(F.col("_s"))).join(
        o, F.col("source").eqNullSafe(F.col("_o")) & (F.shiftrightunsigned("place", 48 - BITS) == F.col("_b")))
    copies = (F.col("full") + F.when(F.shiftrightunsigned("place", 48 - 2 * BITS) < F.col("cut"), 1).otherwise(0)).cast("int")
    within = F.pmod("place", F.lit(1 << (48 - BITS)).cast("long")) / float(1 << (48 - BITS))
    place = F.col("before") + within * F.col("words")
    mean = F.lit(sum(weights) / len(weights))
    def when(k: Column) -> Column:
        share_then = F.when(F.col("target") > 0, (place + k * F.col("source_size")) / F.greatest("target", F.col("source_size") * F.col("copies"))).otherwise(0.0)
        return demand_time(F.least(share_then, F.lit(1.0)), F.col("weight"), mean)
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), when))
    rows = rows.withColumn("copies", copies)
    rows = rows.withColumn("positions", F.coalesce(positions, F.array().cast("array<double>")))
    return rows.select("row", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "positions")


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, and the positions of its copies in training."""
    out = mix(documents.select("doc_id", "text", "source"), words(whole_text()), carry=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "positions")


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The documents in training order, each as often as the mix takes it; columns as before.

    Documents that are not taken are absent. Sorted by position over range partitions, ties by id. A missing text,
    source or id, repeats and an empty table count as in :func:`mix`; columns may have any names.
    """
    out = mix(documents, words(whole_text()))
    each = out.select("row", F.explode("positions").alias("at"))
    key = [F.col("at")] + ([F.col("row.doc_id")] if "doc_id" in documents.columns else [])
    return each.repartitionByRange(*key).sortWithinPartitions(*key).select("row.*")
