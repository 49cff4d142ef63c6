"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in halves and each half is quantised with its own centroids, so K centroids a half give K * K
cells. A query walks the cells by the sum of the two squared distances, with a heap over pairs of sorted centroid
lists, until the cells hold the asked share of the index; all their entries are reranked by exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.session import stage

#: Centroids per half, and the rows that they are fitted on at most.
CENTROIDS, FITTED = 64, 8192
#: Share of the index that a query's cells hold; vectors without any structure need this much for a recall of 0.9.
SHARE = 0.5
#: Vectors in a shard, and queries that meet a shard at once, on average.
SHARD, TOGETHER = 8192, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of rows that take part, each once.

    Left out are rows without id, vectors that are null, zero or hold null or non-finite components, and vectors of
    another length than most have.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull())
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(finite & F.exists("embedding", lambda x: x != 0))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("embedding") == (usual["n"] if usual else 0)).distinct()


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which loses no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _distances(x: np.ndarray, centroids: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    half = centroids[0].shape[1]
    return [(z * z).sum(axis=1)[:, None] - 2 * z @ c.T + (c * c).sum(axis=1) for z, c in zip((x[:, :half], x[:, half:]), centroids, strict=True)]


def walk(left: np.ndarray, right: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Numbers of the cells by ascending sum of distances, until they hold ``enough`` entries; empty ones are skipped."""
    a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
    x, y = left[a].tolist(), right[b].tolist()
    width, counts = len(b), counts.tolist()
    heap, found, held = [(x[0] + y[0], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
        if j + 1 < len(b):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
    return found


def fit_centroids(vectors: DataFrame, size: int, k: int = CENTROIDS, fitted: int = FITTED, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves of unit vectors, from the ``fitted`` vectors that come first by hash."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    sample = stage(vectors.orderBy(F.xxhash64("embedding")).limit(fitted).select(F.transform("embedding", lambda x: x / norm).alias("x")), "sample")
    half = max(1, size // 2)
    out = []
    for first, n in ((1, half), (half + 1, size - half)):
        part = sample.select(array_to_vector(F.slice("x", first, n)).alias("features"))
        model = KMeans(k=k, seed=seed, maxIter=10).fit(part) if n else None
        out.append(np.array(model.clusterCenters()) if model else np.zeros((1, 0)))
    return out[0], out[1]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, share: float = SHARE, centroids: int = CENTROIDS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each vector whose id is divisible by ``every``.

    Equal vectors are one entry with its ``k`` + 1 smallest ids, which is all that any answer can name, and equal
    queries are searched once; so a vector that a third of the rows have costs one entry. Cells of one shard are
    stored together, cells beyond the size of a shard are split, and queries meet shards in bounded blocks. Ties go to
    the smaller id. Rows that take no part are said at :func:`usable`; repeated rows count once; other columns are
    ignored; an empty table gives no rows.
    """
    rows = stage(usable(vectors).withColumn("entry", F.xxhash64("embedding")), "vectors")
    spark = rows.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], schema)
    size = len(first["embedding"])
    own = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= k + 1)
    entries = few.groupBy("entry", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = stage(entries, "entries")
    asked = rows.filter(F.col("vec_id") % every == 0)
    total = entries.count()
    pair = fit_centroids(entries, size, min(centroids, total))
    cells = len(pair[0]) * len(pair[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left, right = _distances(unit(_matrix(b.column("embedding"), size)), pair)
                cell = left.argmin(axis=1) * len(pair[1]) + right.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    index = stage(entries.mapInArrow(assign, "entry long, embedding array<double>, ids array<long>, cell int"), "index")
    counts = np.zeros(cells, np.int64)
    for r in index.groupBy("cell").count().collect():  # at most K * K rows
        counts[r["cell"]] = r["count"]
    # neighbouring cells share a shard; a cell larger than a shard has several of its own
    shard, parts, now, filled = np.zeros(cells, np.int32), np.ones(cells, np.int32), 0, 0
    for c in range(cells):
        if filled and filled + counts[c] > SHARD:
            now, filled = now + 1, 0
        shard[c], parts[c] = now, max(1, -(-int(counts[c]) // SHARD))
        filled += counts[c]
        if parts[c] > 1:
            now, filled = now + int(parts[c]), 0
    literal = lambda a: F.element_at(F.lit([int(v) for v in a]), F.col("cell") + 1)
    placed = index.withColumn("shard", (literal(shard) + F.pmod(F.col("entry"), literal(parts))).cast("int"))

    def together(names: tuple[str, ...], types: tuple[pa.DataType, ...]):
        def run(table: pa.Table) -> pa.Table:
            return pa.table([table.column("shard")[:1].combine_chunks(), *(pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, t in zip(names, types, strict=True))], ["shard", *names])
        return run

    real, whole = pa.list_(pa.float64()), pa.int64()
    shards = placed.groupBy("shard").applyInArrow(
        together(("entry", "embedding", "ids", "cell"), (whole, real, pa.list_(whole), pa.int32())),
        "shard int, entry array<long>, embedding array<array<double>>, ids array<array<long>>, cell array<int>")
    queries = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "embedding")
    enough = max(k + 1, int(np.ceil(share * total)))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                left, right = _distances(unit(_matrix(part.column("embedding"), size)), pair)
                at, to, lists = [], [], []
                for i in range(part.num_rows):
                    by: dict[int, list[int]] = {}
                    for c in walk(left[i], right[i], counts, enough):
                        for p in range(parts[c]):
                            by.setdefault(int(shard[c]) + p, []).append(c)
                    at += [i] * len(by)
                    to += by
                    lists += by.values()
                rows_ = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("entry").take(rows_), part.column("embedding").take(rows_), pa.array(to, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["query", "vector", "shard", "cells"])

    met = queries.mapInArrow(visits, "query long, vector array<double>, shard int, cells array<int>")
    blocks = max(1, -(-queries.count() // TOGETHER))
    met = met.groupBy("shard", F.pmod("query", F.lit(blocks)).alias("_block")).applyInArrow(
        together(("query", "vector", "cells"), (whole, real, pa.list_(pa.int32()))), "shard int, query array<long>, vector array<array<double>>, cells array<array<int>>")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x, cell = scaled(np.array(row["embedding"], np.float64)), np.array(row["cell"])
                norms, lowest = np.sqrt((x * x).sum(axis=1)), np.array([i[0] for i in row["ids"]], np.int64)
                out: list[tuple] = []
                for q, vector, visited in zip(row["query"], row["vector"], row["cells"], strict=True):
                    v = scaled(np.array([vector], np.float64))[0]
                    at = np.flatnonzero(np.isin(cell, visited))
                    s = (x[at] * v).sum(axis=1) / (norms[at] * np.sqrt((v * v).sum()))
                    best = at[top := np.lexsort((lowest[at], -s))[: k + 1]]
                    out += [(q, row["ids"][i], float(score)) for i, score in zip(best, s[top], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], whole), pa.array([o[1] for o in out], pa.list_(whole)), pa.array([o[2] for o in out], pa.float64())], ["query", "ids", "score"])

    scored = shards.join(met, "shard").mapInArrow(rerank, "query long, ids array<long>, score double")
    named = scored.select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = named.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).join(lists, "query")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("rank", "f")).select(
        F.col("query_id").cast("long").alias("query_id"), (F.col("rank") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def neighbour_report(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
