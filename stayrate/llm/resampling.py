"""Importance resampling towards a target: hashed features, log-ratio gains, Gumbel top-k, by bit-sliced aggregation.

The features of a text fall into ``BUCKETS`` buckets. A bucket's gain is the logarithm of its share in the target over
its share in the documents; a document's weight is the sum of the gains of its features. The counts of a document are
written as planes, plane j holding bit j of all its counts, one bit a bucket; magnitudes of positive and of negative
gains are planes likewise. A weight is then exact: the sum over pairs of planes (j, i) of 2**(j+i) times the number of
bits set in both, those of the negative gains taken off. With a Gumbel deviate of the id added, the documents of
highest score are a draw without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import alnum_words, whole_text
from stayrate.session import stage

BUCKETS = 10000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Documents whose planes are in memory at once; a plane has BUCKETS / 8 bytes.
TOGETHER = 128


def bucket_counts(found: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``longest`` words, ascending, and how many runs fall into each."""
    hashed = [crc32(b" ".join(found[k : k + n])) for n in range(1, longest + 1) for k in range(len(found) - n + 1)] if longest > 1 else list(map(crc32, found))
    return np.unique(np.array(hashed, np.int64) % buckets, return_counts=True)


def counted(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``texts`` but the text, and n_words, n_features, buckets and counts of the whole text."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                rows = []
                for text in part.column("text").to_pylist():
                    found = alnum_words(text or "")
                    at, n = bucket_counts(found, longest, buckets)
                    rows.append((len(found), int(n.sum()), at, n))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in rest), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))],
                    [*rest, "n_words", "n_features", "buckets", "counts"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema.fields if f.name != "text")
    return texts.select(*rest, "text").mapInArrow(run, kinds + "n_words long, n_features long, buckets array<int>, counts array<long>")


def totals(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: each task adds up its own, so a bucket has one row a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (b.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            np.add.at(total, at, n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = rows.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the documents, by bucket."""
    s, t, n = documents.astype(np.float64), target.astype(np.float64), len(documents)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def planes(values: np.ndarray) -> np.ndarray:
    """Bits of non-negative numbers as planes: values of shape (..., buckets) give (number of bits, ..., 64-bit words)."""
    bits = int(values.max(initial=0)).bit_length()
    pad = -values.shape[-1] % 64
    wide = np.pad(values, [(0, 0)] * (values.ndim - 1) + [(0, pad)])
    packed = [np.packbits((wide >> j & 1).astype(bool), axis=-1).view(np.uint64) for j in range(bits)]
    return np.stack(packed) if packed else np.empty((0, *wide.shape[:-1], wide.shape[-1] // 64), np.uint64)


def sums(counts: np.ndarray, signed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Per row of ``counts`` (documents x buckets) the sum of counts times gains; ``signed``: planes of positive and negative gains."""
    out = np.zeros(len(counts), np.int64)
    for j, own in enumerate(planes(counts)):
        for sign, gain in zip((1, -1), signed, strict=True):
            for i, plane in enumerate(gain):
                out += sign * (np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) << (i + j))
    return out


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` with ``weight`` in place of buckets and counts."""
    signed = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))
    rest = [c for c in rows.columns if c not in ("buckets", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b.column("counts").value_lengths().to_numpy())])
            at, n = (b.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            out = np.zeros(b.num_rows, np.int64)
            # documents with like largest counts have equally many planes
            largest = np.zeros(b.num_rows, np.int64)
            np.maximum.at(largest, np.repeat(np.arange(b.num_rows), np.diff(ends)), n)
            for some in batched(np.argsort(largest, kind="stable").tolist(), TOGETHER):
                dense = np.zeros((len(some), len(gain)), np.int64)
                for k, d in enumerate(some):
                    dense[k, at[ends[d] : ends[d + 1]]] = n[ends[d] : ends[d + 1]]
                out[list(some)] = sums(dense, signed)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(out)], [*rest, "weight"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in rest)
    return rows.mapInArrow(run, f"{kinds}, weight long")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(1000 times a standard Gumbel deviate) told by the key; a missing key counts as empty."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000) * F.log(-F.log(uniform)))


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the highest scores, ties to smaller doc_id, null for documents not drawn.

    Only documents with at least ``least`` words take part, ``percent`` of a hundred of them are drawn. They are cut
    into ranges of (score, doc_id), each range numbers its rows, and starts behind the ranges before it.
    """
    enter = scored.filter(F.col("n_words") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = stage(enter.select("doc_id", "n_features", "weight", "score").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row a range
    parts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    cut, before, starts = sum(parts.values()) * percent // 100, 0, []
    for part in sorted(parts):
        starts.append((part, before))
        before += parts[part]
    start = scored.sparkSession.createDataFrame(starts, "_part int, _start long")
    numbered = ranged.join(start, "_part").withColumn("rank", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    ranked = numbered.withColumn("rank", F.when(F.col("rank") <= cut, F.col("rank")))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, longest: int = LONGEST,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the rank is null where it is not drawn.

    Whole texts of ``documents`` and of ``target`` count, a missing one as empty: it has no features and weight 0.
    Rows that repeat are documents of their own, ties of score go to the smaller doc_id, then to any; a missing doc_id
    comes last among equal scores. An empty table of documents gives no rows; with an empty target the gains compare
    with an even spread. Columns besides doc_id and text are ignored.
    """
    rows = stage(counted(documents.select("doc_id", whole_text().alias("text")), longest, buckets), "buckets")
    wanted = totals(counted(target.select(whole_text().alias("text")), longest, buckets), buckets)
    gain = gains(totals(rows, buckets), wanted)
    scored = weights(rows, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return drawn(stage(scored, "weights"), percent, least)


def drawn_documents(documents: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The documents that are drawn, all columns; takes what :func:`resampled` takes. Rows without doc_id are left out."""
    picked = resampled(documents, target, **how).filter("rank is not null").select("doc_id").distinct()
    return documents.join(picked, "doc_id", "left_semi").select(*documents.columns)


def resample_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(documents, benchmark)


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: an expression for it over the UTF-8 of ``text``, with the column ``steps`` of :func:`resample_sql`."""
    octets = f"list_transform(range(1, length(hex(encode({text}))) + 1, 2), lambda p: ('0x' || substr(hex(encode({text})), p, 2))::BIGINT)"
    step = "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295::BIGINT), 4294967295)"


def resample_sql() -> str:
    """DuckDB SQL for :func:`resample_report`."""
    words_of = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH crc_table AS (
      SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps),
    d AS (SELECT row_number() OVER () AS nth, doc_id, {words_of} AS found FROM documents),
    t AS (SELECT unnest({words_of}) AS w FROM benchmark),
    each AS (SELECT nth, unnest(found) AS w FROM d),
    known AS (SELECT w, {crc32_sql('w')} % {BUCKETS} AS bucket FROM (SELECT w FROM each UNION SELECT w FROM t), crc_table),
    s AS (SELECT bucket, count(*) AS n FROM each JOIN known USING (w) GROUP BY bucket),
    b AS (SELECT bucket, count(*) AS n FROM t JOIN known USING (w) GROUP BY bucket),
    sizes AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM b), 0)::DOUBLE AS t),
    gain AS (
      SELECT bucket, floor(1000 * ln((coalesce(b.n, 0) + 1)::DOUBLE * (sizes.s + {BUCKETS})
        / ((s.n + 1)::DOUBLE * (sizes.t + {BUCKETS}))))::BIGINT AS g
      FROM s LEFT JOIN b USING (bucket), sizes),
    weighed AS (SELECT nth, sum(g)::BIGINT AS weight FROM each JOIN known USING (w) JOIN gain USING (bucket) GROUP BY nth),
    scored AS (
      SELECT doc_id, len(found)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, nth,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
          / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN weighed USING (nth)),
    placed AS (
      SELECT nth, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {PERCENT} // 100 THEN r END::BIGINT AS rank
    FROM scored LEFT JOIN placed USING (nth)
    """
