"""Exact stratified picks by hash, found by counting instead of by sorting a whole class.

Every row gets a 60-bit hash of its key. The picked rows of a class are those with its smallest
hashes; the cut-off is found by counting rows per hash prefix, then per longer prefix inside the one
prefix that holds the cut-off. Each pass is a scan with a bounded aggregate, so a class with most of
the rows costs no more than a small one, and picking is a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.errors import InputError

BITS = 60
STEP = 12
MAX_CLASSES = 100


def key_hash(key: str, seed: int) -> Column:
    """First 60 bits of the MD5 of key and seed; the same rows are picked on every run and layout."""
    digest = F.md5(F.concat_ws("|", F.col(key), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_cuts(
    df: DataFrame, stratum: str, key: str, seed: int, shares: Sequence[float], max_classes: int = MAX_CLASSES
) -> dict[object, list[int]]:
    """Per class, the hash below which ``round(share * rows)`` of its rows lie, for each share.

    Rows with equal hash stay on one side, so a repeated key is never split between two parts. More than
    ``max_classes`` classes are an error, found by the first count itself.
    """
    hashed = df.select(F.col(stratum).alias("stratum"), key_hash(key, seed).alias("h"))
    sizes: dict[object, int] = {}
    open_cuts: dict[tuple[object, int], tuple[int, int]] = {}  # (class, share) -> (prefix, rows to take inside)
    cuts: dict[object, list[int]] = {}
    known = 0
    while known < BITS:
        step = min(STEP, BITS - known)
        prefix = F.shiftright("h", BITS - known - step)
        scope = hashed
        if known:
            # only the prefixes that hold a cut are counted further
            inside = {(c, p) for (c, _), (p, _) in open_cuts.items()}
            parent = F.shiftright("h", BITS - known)
            test = F.lit(False)
            for value, p in inside:
                test = test | (F.col("stratum").eqNullSafe(F.lit(value)) & (parent == F.lit(p)))
            scope = hashed.where(test)
        counted: dict[object, dict[int, int]] = {}
        counts = scope.groupBy("stratum", prefix.alias("p")).count()
        if not known:
            # a class has at most 2 ** step prefixes, so one row beyond that for all classes shows one class too many
            counts = counts.limit((max_classes << step) + 1)
        for row in counts.collect():
            counted.setdefault(row["stratum"], {})[row["p"]] = row["count"]
        if len(counted) > max_classes:
            raise InputError(f"{stratum} has more than {max_classes} classes")
        if not known:
            sizes = {c: sum(v.values()) for c, v in counted.items()}
            for c, n in sizes.items():
                cuts[c] = [0] * len(shares)
                for i, share in enumerate(shares):
                    open_cuts[c, i] = (0, int(share * n + 0.5))
        still: dict[tuple[object, int], tuple[int, int]] = {}
        for (c, i), (parent_prefix, take) in open_cuts.items():
            taken = 0
            first = parent_prefix << step
            cut = (first + (1 << step)) << (BITS - known - step)
            for p in sorted(x for x in counted.get(c, {}) if x >> step == parent_prefix):
                rows = counted[c][p]
                if taken == take:
                    cut = p << (BITS - known - step)
                    break
                if taken + rows > take:
                    if known + step == BITS:  # equal hashes: keep them together, nearest size
                        cut = p if take - taken < taken + rows - take else p + 1
                    else:
                        still[c, i] = (p, take - taken)
                        cut = -1
                    break
                taken += rows
            if cut >= 0:
                cuts[c][i] = cut
        open_cuts = still
        known += step
        if not open_cuts:
            break
    return cuts


def part_number(stratum: str, h: Column, cuts: dict[object, list[int]]) -> Column:
    """Index of the part of each row: how many cuts of its class lie at or below its hash."""
    result = F.lit(None).cast("int")
    for value, limits in cuts.items():
        passed = F.lit(0)
        for limit in limits:
            passed = passed + (h >= F.lit(limit)).cast("int")
        result = F.when(F.col(stratum).eqNullSafe(F.lit(value)), passed).otherwise(result)
    return result
