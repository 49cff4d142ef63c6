"""Second-order factorization machines over sets of hashed features.

A document is a set of feature ids below ``BUCKETS``; each of its n ids has the value n ** -0.25, whatever it tells. With
x the values, w weights and v factors, the score is the logistic function of b + sum w_i x_i + (|sum v_i x_i|^2 -
sum |v_i x_i|^2) / 2, so all pairs cost no more than the ids.

The fit minimises the log loss over a bounded labelled sample plus penalties. Each round is one job: every partition of
the sample adds up the gradient over the ids that its rows hold, and the driver, which holds one number a bucket and
factor, takes a quasi-Newton step. Small penalties serve texts that few terms tell apart; large ones leave labels that
no single term explains to the pairs. Which of ``PENALTIES`` it is, the loss on an eighth of the sample says.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.common import remainder
from stayrate.session import stage

#: Bound of the hash space, so of what the driver and each task hold of a machine.
BUCKETS = 1 << 16
FACTORS = 4
#: Partitions of the sample.
PARTS = 6
#: Evaluations of loss and gradient in choosing the penalties, and again in the fit on all rows.
ROUNDS = 60
#: Penalties on the size of a weight, on its square and on the square of a factor.
PENALTIES = ((0.05, 0.01, 10.0), (0.0, 5.0, 5.0))
#: Share of the sample, one in so many ids, that chooses among the penalties.
CHOOSING = 8
POWER = -0.25
#: Steps that the approximation of the curvature remembers.
MEMORY = 5

Features = Callable[[dict[str, list]], Iterator[np.ndarray]]
Searching = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Machine:
    """Weights (one a bucket) and factors (buckets x factors)."""

    intercept: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of ``n`` documents, the value of each id, and per document the sum of factors times values."""
        values = (np.bincount(rows, minlength=n)[rows].astype(np.float64)) ** POWER
        out = self.intercept + np.bincount(rows, self.weights[ids] * values, n)
        sums = np.zeros((n, self.factors.shape[1]))
        for k in range(sums.shape[1]):
            v = self.factors[ids, k] * values
            sums[:, k] = np.bincount(rows, v, n)
            out += 0.5 * (sums[:, k] ** 2 - np.bincount(rows, v * v, n))
        return out, values, sums

    def scores(self, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` documents; ``ids[i]`` belongs to document ``rows[i]``."""
        return _logistic(self.raw(ids, rows, n)[0])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def machine(point: np.ndarray, buckets: int) -> Machine:
    return Machine(float(point[0]), point[1 : 1 + buckets], point[1 + buckets :].reshape(buckets, -1))


def slopes(m: Machine, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, apart: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """Log loss of the rows and of those kept ``apart``, and of the former the slopes: in the intercept, and of each bucket in weight and factors."""
    z, values, sums = m.raw(ids, rows, len(labels))
    losses, buckets = np.logaddexp(0, z) - labels * z, len(m.weights)
    off = np.where(apart, 0.0, _logistic(z) - labels)
    pull = off[rows] * values
    columns = [np.bincount(ids, pull, buckets)]
    for k in range(sums.shape[1]):
        columns.append(np.bincount(ids, pull * (sums[rows, k] - m.factors[ids, k] * values), buckets))
    return float(losses[~apart].sum()), float(losses[apart].sum()), float(off.sum()), np.stack(columns, axis=1)


def search(point: np.ndarray, lasso: np.ndarray, rounds: int, tolerance: float = 1e-5) -> Searching:
    """Minimise f(point) + sum of lasso * |point|: yields points, is sent f and its gradient, returns the last point.

    Limited-memory quasi-Newton steps; where ``lasso`` is positive a step stays on its side of zero and may end there.
    """
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, slope = yield point
    value += lasso @ np.abs(point)
    while rounds > 0:
        lo, hi = slope - lasso, slope + lasso
        steepest = np.where(point > 0, hi, np.where(point < 0, lo, np.where(hi < 0, hi, np.maximum(lo, 0))))
        way, shares = steepest.copy(), []
        for s, y, r in reversed(steps):
            shares.append(r * (s @ way))
            way -= shares[-1] * y
        way *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.linalg.norm(steepest)))
        for (s, y, r), share in zip(steps, reversed(shares), strict=True):
            way += s * (share - r * (y @ way))
        way = np.where((lasso > 0) & (way * steepest <= 0), 0, -way)
        if way @ steepest >= 0:
            steps, way = [], -steepest / max(1.0, float(np.linalg.norm(steepest)))
        side, length = np.where(point != 0, np.sign(point), -np.sign(steepest)), 1.0
        while True:
            there = point + length * way
            there = np.where((lasso > 0) & (there * side < 0), 0, there)
            new, new_slope = yield there
            new, rounds = new + lasso @ np.abs(there), rounds - 1
            if new <= value + 1e-4 * (steepest @ (there - point)) or rounds <= 0:
                break
            length *= 0.4
        if new > value:
            break
        s, y = there - point, new_slope - slope
        if s @ y > 1e-10:
            steps = [*steps, (s, y, 1 / (s @ y))][-MEMORY:]
        close = value - new < tolerance * abs(new)
        point, value, slope = there, new, new_slope
        if close:
            break
    return point


def _sums(rows: DataFrame, points: list[tuple[np.ndarray, bool]], buckets: int) -> list[tuple[float, float, np.ndarray]]:
    """Per point: its loss on the rows it is fitted on, on the others, and its gradient. A flag says that it is fitted on all rows.

    Every partition sends one row a point: the slopes at the ids that it holds.
    """
    sent = rows.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, pa.schema([("_label", pa.int32()), ("_apart", pa.bool_()), ("ids", pa.list_(pa.int32()))])).combine_chunks()
        labels, apart = (whole.column(c).to_numpy() for c in ("_label", "_apart"))
        lists = whole.column("ids").combine_chunks()
        ids, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(labels)), lists.value_lengths().to_numpy())
        out, held = [], np.flatnonzero(np.bincount(ids, minlength=buckets))
        for k, (point, on_all) in enumerate(sent.value):
            loss, other, first, columns = slopes(machine(point, buckets), ids, row, labels, apart & (not on_all))
            out.append((k, loss, other, first, held.astype("<i4").tobytes(), columns[held].astype("<f8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["point", "loss", "other", "first", "ids", "slopes"])

    kinds = "point long, loss double, other double, first double, ids binary, slopes binary"
    found = rows.select("_label", "_apart", "ids").mapInArrow(run, kinds).toArrow().to_pylist()
    sent.destroy()
    out = []
    for k, (point, _) in enumerate(points):
        loss, other, slope = 0.0, 0.0, np.zeros(len(point))
        wide = slope[1 + buckets :].reshape(buckets, -1)
        for r in (r for r in found if r["point"] == k):
            held = np.frombuffer(r["ids"], "<i4")
            columns = np.frombuffer(r["slopes"], "<f8").reshape(len(held), 1 + wide.shape[1])
            loss, other = loss + r["loss"], other + r["other"]
            slope[0] += r["first"]
            slope[1 + held] += columns[:, 0]
            wide[held] += columns[:, 1:]
        out.append((loss, other, slope))
    return out


def _fitted(rows: DataFrame, penalties: tuple, on_all: bool, starts: list[np.ndarray], buckets: int, rounds: int) -> list[tuple[float, np.ndarray]]:
    """Per penalty the loss on the rows that are kept apart, and the point; all are sought side by side."""
    lassos, ridges, rest = [], [], len(starts[0]) - 1 - buckets
    for size, square, factor in penalties:
        lassos.append(np.concatenate([[0.0], np.full(buckets, size), np.zeros(rest)]))
        ridges.append(np.concatenate([[0.0], np.full(buckets, square), np.full(rest, factor)]))
    searches = [search(start.copy(), lasso, rounds) for start, lasso in zip(starts, lassos, strict=True)]
    asked, out = {k: next(s) for k, s in enumerate(searches)}, {}
    while asked:
        found = _sums(rows, [(p, on_all) for p in asked.values()], buckets)
        for (k, p), (loss, _, slope) in zip(list(asked.items()), found, strict=True):
            try:
                asked[k] = searches[k].send((loss + 0.5 * float(ridges[k] @ (p * p)), slope + ridges[k] * p))
            except StopIteration as end:
                out[k] = end.value
                del asked[k]
    points = [out[k] for k in range(len(penalties))]
    return [(other, p) for p, (_, other, _) in zip(points, _sums(rows, [(p, on_all) for p in points], buckets), strict=True)]


def fit(sample: DataFrame, columns: tuple[str, ...], features: Features, factors: int = FACTORS, rounds: int = ROUNDS,
        penalties: tuple = PENALTIES, buckets: int = BUCKETS, seed: int = 7) -> Machine:
    """Fit on rows with ``_id``, ``_label`` 0 or 1 and ``columns``; ``features`` yields one array of distinct ids per row.

    A sample without both classes gives a machine that says the share of class 1, or 0.5 without rows.
    """
    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.tolist() for x in features({c: b.column(c).to_pylist() for c in columns})]
            yield pa.RecordBatch.from_arrays([b.column("_label").cast(pa.int32()), b.column("_apart"), pa.array(ids, pa.list_(pa.int32()))], ["_label", "_apart", "ids"])

    marked = sample.select("_label", (remainder("_id", CHOOSING) == 1).alias("_apart"), *columns)
    rows = stage(marked.mapInArrow(ids_of, "_label int, _apart boolean, ids array<int>").repartition(PARTS), "features")
    n1, n = rows.agg(F.sum("_label"), F.count("*")).first()
    odds = np.log(((n1 or 0) + 0.5) / (n - (n1 or 0) + 0.5))
    if not n1 or n1 == n:
        return Machine(float(odds), np.zeros(buckets), np.zeros((buckets, factors)))
    drawn = np.random.default_rng(seed).normal(0, 0.1, buckets * factors)
    start = np.concatenate([[odds], np.zeros(buckets), drawn])
    rows = rows.persist()
    try:
        held = np.zeros(buckets, bool)
        held[[r["id"] for r in rows.select(F.explode("ids").alias("id")).distinct().collect()]] = True  # at most ``buckets``
        tried = _fitted(rows, penalties, False, [start] * len(penalties), buckets, rounds)
        best = min(range(len(penalties)), key=lambda k: tried[k][0])
        found = machine(_fitted(rows, (penalties[best],), True, [tried[best][1]], buckets, rounds)[0][1], buckets)
    finally:
        rows.unpersist()
    return Machine(found.intercept, np.where(held, found.weights, 0.0), np.where(held[:, None], found.factors, 0.0))


def score(documents: DataFrame, columns: tuple[str, ...], features: Features, fitted: Machine, keys: tuple[str, ...] = ("doc_id",),
          name: str = "score") -> DataFrame:
    """Columns ``keys`` of every row, and the score between 0 and 1 as column ``name``.

    One pass without a shuffle; the machine, bounded by its buckets, goes to the tasks with their code.
    """
    carried = documents.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    schema = T.StructType([*carried.schema.fields[: len(keys)], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                found = list(features({c: part.column(f"c{i}").to_pylist() for i, c in enumerate(columns)}))
                rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
                ids = np.concatenate(found) if found else np.empty(0, np.int64)
                values = fitted.scores(ids, rows, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(values)], schema.names)

    return carried.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("score").alias(name))
