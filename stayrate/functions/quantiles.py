"""Exact quantiles of many columns without sorting a table or gathering it in one task.

A wanted rank lies
in a gap between two known values, at first in the whole range. A sketch of the rows inside the gap
proposes values close to the rank, a counting pass tells how many rows lie below and at each of them,
and the rank is either met or falls into a smaller gap. The first sketch is taken with the extent, and
where the accuracy of a sketch bounds the rows between two proposed values by the limit, the counting
pass brings them along: two scans settle 10^8 rows. Every proposed value leaves the gap, so each
round makes progress, by a factor of about a thousand unless values repeat: three rounds of
column-pruned, shuffle-free scans settle 10^11 rows. What reaches the driver is a few numbers per
round and the values of at most ``GAP_LIMIT`` rows, shared by all gaps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP_LIMIT = 200_000
ACCURACY = 10_000
REACH = 4.0  # how many sketch errors around a rank the proposed values lie

Known = dict[tuple[str, int], float]


@dataclass
class _Gap:
    """Rows of a column strictly between two values, and the wanted ranks (0-based) among them."""

    column: str
    low: float | None
    high: float | None
    below: int
    rows: int
    ranks: list[int] = field(default_factory=list)

    def holds(self) -> Column:
        value = F.col(self.column)
        tests = [value.isNotNull()]
        if self.low is not None:
            tests.append(value > F.lit(self.low))
        if self.high is not None:
            tests.append(value < F.lit(self.high))
        return reduce(lambda a, b: a & b, tests)

    def shares(self, accuracy: int) -> list[float]:
        """Fractions of the gap's rows in pairs, a little below and above each run of neighbouring ranks."""
        reach = REACH / accuracy
        found: list[float] = []
        ranks = sorted(self.ranks)
        for r in ranks:
            middle = (r - self.below + 0.5) / self.rows
            if r - 1 not in ranks:
                found.append(max(0.0, middle - reach))
            if r + 1 not in ranks:
                found.append(min(1.0, middle + reach))
        return found


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    gap_limit: int = GAP_LIMIT,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; ``None`` where a column has no values.

    Missing values and NaN are left out. Between the values at two ranks the quantile is
    ``low + (high - low) * share``, unrounded. The table is read several times, so stage one that is
    costly to compute.
    """
    if not wanted:
        return {}
    doubles = {c: F.col(c).cast("double") for c in wanted}
    slim = df.select(*[F.when(~F.isnan(v), v).alias(c) for c, v in doubles.items()])
    return _by_narrowing(slim, wanted, gap_limit, accuracy)


def _by_narrowing(
    slim: DataFrame, wanted: dict[str, list[float]], gap_limit: int, accuracy: int
) -> dict[str, list[float | None]]:
    reach = REACH / accuracy
    around = {c: [s for p in fractions for s in (max(0.0, p - reach), min(1.0, p + reach))] for c, fractions in wanted.items()}
    extent = slim.agg(
        *[f(c).alias(f"{n}{i}") for i, c in enumerate(wanted) for n, f in
          (("n", F.count), ("lo", F.min), ("hi", F.max))],
        *[F.percentile_approx(c, shares, accuracy).alias(f"s{i}") for i, (c, shares) in enumerate(around.items())],
    ).first()
    known: Known = {}
    gaps: list[_Gap] = []
    last = {c: extent[f"n{i}"] - 1 for i, c in enumerate(wanted)}
    for i, (column, fractions) in enumerate(wanted.items()):
        if last[column] < 0:
            continue
        known[column, 0], known[column, last[column]] = extent[f"lo{i}"], extent[f"hi{i}"]
        ranks = {k for p in fractions for k in _neighbours(p, last[column])}
        open_ranks = sorted(r for r in ranks if (column, r) not in known)
        if open_ranks:
            gaps.append(_Gap(column, None, None, 0, last[column] + 1, open_ranks))

    limit = gap_limit // max(1, sum(len(g.ranks) for g in gaps))  # every gap holds a rank, so the total is bounded
    wide = [g for g in gaps if g.rows > limit]
    narrow = [g for g in gaps if g.rows <= limit]
    sketched = {c: extent[f"s{i}"] for i, c in enumerate(wanted)}
    proposed = [sketched[g.column] for g in wide]
    while wide:
        smaller = _count(slim, wide, proposed or _sketch(slim, wide, accuracy), accuracy, limit, known)
        proposed = []
        narrow += [g for g in smaller if g.rows <= limit]
        wide = [g for g in smaller if g.rows > limit]
    _look_up(slim, narrow, known)

    found: dict[str, list[float | None]] = {}
    for column, fractions in wanted.items():
        found[column] = [None] * len(fractions)
        for k, p in enumerate(fractions if last[column] >= 0 else []):
            low_rank, high_rank = _neighbours(p, last[column])
            low, high = known[column, low_rank], known[column, high_rank]
            share = p * last[column] - low_rank
            found[column][k] = low if low == high else low + (high - low) * share
    return found


def _neighbours(fraction: float, last: int) -> tuple[int, int]:
    rank = min(int(math.floor(fraction * last)), last)
    return rank, min(rank + 1, last)


def _sketch(slim: DataFrame, gaps: list[_Gap], accuracy: int) -> list[list[float]]:
    """Per gap pairs of values, a little below and above each run of its ranks."""
    sketches = slim.agg(*[
        F.percentile_approx(F.when(g.holds(), F.col(g.column)), g.shares(accuracy), accuracy).alias(f"s{i}")
        for i, g in enumerate(gaps)
    ]).first()
    return [list(values) for values in sketches]


def _count(slim: DataFrame, gaps: list[_Gap], sketched: list[list[float]], accuracy: int, limit: int, known: Known) -> list[_Gap]:
    """One pass over all gaps that counts at the proposed values; returns the smaller gaps.

    A sketch is off by at most one row in ``accuracy``, so few rows lie between the values of a pair. Where that bound
    is within the limit they come along, and the ranks among them are known.
    """
    proposed = [sorted(set(values)) for values in sketched]
    few = [(2 * REACH + 2) / accuracy * g.rows + 2 <= limit for g in gaps]
    pairs = [sorted({(a, b) for a, b in zip(v[::2], v[1::2], strict=True) if a < b}) if f else [] for v, f in zip(sketched, few, strict=True)]
    row = slim.agg(*[
        F.count_if(test).alias(f"{name}{i}_{k}")
        for i, g in enumerate(gaps)
        for k, v in enumerate(proposed[i])
        for name, test in (("lt", F.col(g.column) < F.lit(v)), ("eq", F.col(g.column) == F.lit(v)))
    ], *[
        F.collect_list(F.when((F.col(g.column) > F.lit(a)) & (F.col(g.column) < F.lit(b)), F.col(g.column))).alias(f"in{i}_{j}")
        for i, g in enumerate(gaps)
        for j, (a, b) in enumerate(pairs[i])
    ]).first()
    smaller: list[_Gap] = []
    for i, g in enumerate(gaps):
        ends = [(v, row[f"lt{i}_{k}"], row[f"eq{i}_{k}"]) for k, v in enumerate(proposed[i])]
        for v, lt, eq in ends:
            known.update({(g.column, r): v for r in g.ranks if lt <= r < lt + eq})
        upto_value = {v: lt + eq for v, lt, eq in ends}
        for j, (a, _) in enumerate(pairs[i]):
            between, start = sorted(row[f"in{i}_{j}"]), upto_value[a]
            known.update({(g.column, r): between[r - start] for r in g.ranks if 0 <= r - start < len(between)})
        lows = [(g.low, g.below), *[(v, lt + eq) for v, lt, eq in ends]]
        highs = [*[(v, lt) for v, lt, _ in ends], (g.high, g.below + g.rows)]
        for (low, below), (high, upto) in zip(lows, highs, strict=True):
            ranks = [r for r in g.ranks if below <= r < upto and (g.column, r) not in known]
            if ranks:
                smaller.append(_Gap(g.column, low, high, below, upto - below, ranks))
    return smaller


def _look_up(slim: DataFrame, gaps: list[_Gap], known: Known) -> None:
    """The values at the ranks in small gaps, from counts of the distinct values there.

    Rows outside all gaps are filtered out first.
    """
    if not gaps:
        return
    tests = [g.holds() for g in gaps]
    hits = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(i).alias("gap"), F.col(g.column).alias("value")))
        for i, (g, test) in enumerate(zip(gaps, tests, strict=True))
    ]))
    rows = slim.where(reduce(lambda a, b: a | b, tests))
    counted = rows.select(F.explode(hits).alias("hit")).groupBy("hit.gap", "hit.value").count()
    pairs: list[list[tuple[float, int]]] = [[] for _ in gaps]
    for i, value, n in counted.collect():
        pairs[i].append((value, n))
    for g, found in zip(gaps, pairs, strict=True):
        found.sort()
        ends = g.below + np.cumsum([n for _, n in found])
        for r, place in zip(g.ranks, np.searchsorted(ends, g.ranks, side="right"), strict=True):
            known[g.column, r] = found[place][0]
