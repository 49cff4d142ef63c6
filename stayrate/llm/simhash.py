"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit position gets a non-zero vector of r+1 bits, and each non-zero vector t gives a table: its mask
holds the positions whose vector has odd inner product with t. Up to r positions span at most r dimensions, so some t
is orthogonal to all of them: two fingerprints that differ in at most r bits agree under the mask of some table. A
bucket of more than ``LIMIT`` fingerprints is dealt out again by the same rule over the bits outside its mask, which
keeps the guarantee; after the last level only a few bits are left, which bounds the bucket by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import lower_ascii, whole_row, whole_text
from stayrate.llm.components import connected
from stayrate.session import stage

SEED = 42
LIMIT = 256
LEVELS = 4


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bits that more than half of the shingles' XXH64 have; 0 for a text without words."""
    words = lower_ascii(text).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    last = ends[-n:].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 15)], last[k : k + (1 << 15)], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    return F.pandas_udf(lambda s: pd.Series([fingerprint(x, shingle) for x in s], dtype="int64"), "long")(text)


@cache
def masks(path: tuple[int, ...], radius: int, bits: int = 64) -> tuple[int, ...]:
    """Masks of the tables below a bucket reached by ``path``; each holds the bits fixed so far too."""
    fixed = 0
    for level in range(len(path)):
        fixed = masks(path[:level], radius, bits)[path[level]]
    free = [i for i in range(bits) if not fixed >> i & 1]
    tables = (1 << radius + 1) - 1
    return tuple(fixed | sum(1 << i for j, i in enumerate(free) if ((1 + j % tables) & t).bit_count() % 2) for t in range(1, tables + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(level: int, radius: int) -> list[int]:
    """Masks of a level by path number."""
    paths: list[tuple[int, ...]] = [()]
    for _ in range(level):
        paths = [(*p, t) for p in paths for t in range((1 << radius + 1) - 1)]
    return [_signed(m) for p in paths for m in masks(p, radius)]


def _stars(radius: int):
    """From rows sorted by bucket: a row (u, v) ties each fingerprint to the smallest of its component in the bucket."""
    def ties(x: np.ndarray) -> Iterator[tuple[int, int]]:
        near = np.bitwise_count(x[:, None].view(np.uint64) ^ x[None, :].view(np.uint64)) <= radius
        label = np.arange(len(x))
        while True:
            new = np.where(near, label[None, :], len(x)).min(axis=1)
            if (new == label).all():
                break
            label = new
        return ((int(a), int(x[k])) for a, k in zip(x, label, strict=True) if a != x[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, open_ = None, []
        def out(pairs):
            pairs = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])
        for b in batches:
            path, key, fp = (b.column(c).to_numpy() for c in ("path", "key", "fp"))
            if not len(fp):
                continue
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
            found: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)], strict=True):
                if at != (path[lo], key[lo]):
                    if len(open_) > 1:
                        found += ties(np.array(open_, np.int64))
                    at, open_ = (path[lo], key[lo]), []
                open_ += fp[lo:hi].tolist()
            yield out(found)
        if len(open_) > 1:
            yield out(ties(np.array(open_, np.int64)))
    return run


def links(fingerprints: DataFrame, radius: int = 3, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) between distinct longs ``fp`` that connect all pairs differing in at most ``radius`` bits.

    Within a bucket a component is told by ties to its smallest member, so a bucket of n gives less than n rows.
    """
    tables = (1 << radius + 1) - 1
    rows = fingerprints.select("fp", F.lit(0).alias("path"))
    found = None
    for level in range(LEVELS):
        each = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
        rows = rows.select("fp", (F.col("path") * tables).alias("_p"), each.alias("_t")).select("fp", (F.col("_p") + F.col("_t")).alias("path"))
        mask = F.element_at(F.lit(_tables(level, radius)), F.col("path") + 1)
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(mask))
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1")
        rows = stage(rows.join(sizes, ["path", "key"]), "buckets")
        ready = rows if level == LEVELS - 1 else rows.filter(F.col("n") <= limit)
        pairs = ready.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(_stars(radius), "u long, v long")
        found = pairs if found is None else found.union(pairs)
        rows = rows.filter(F.col("n") > limit).select("fp", "path")
        if level == LEVELS - 1 or rows.isEmpty():
            return found
    return found


def groups(fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """Per distinct ``fp``: component_id, the smallest doc_id reachable, and first, the row (doc_id, fp, h) that represents it.

    ``fingerprints`` has doc_id, fp and h, a hash of the text. Rows without doc_id count as largest; a component without any
    id has the id null. Of rows that share the smallest id, the one with the smallest fingerprint, then hash, represents.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("fp"), F.col("h"))).alias("first")
    distinct = stage(fingerprints.groupBy("fp").agg(first), "fingerprints")
    stars = connected(links(distinct.select("fp"), radius))
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "first")
    best = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(best, "root").select("fp", F.col("first.doc_id").alias("component_id"), "first")


def fingerprinted(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) and h, a hash of the whole text, of every document; each text is read once."""
    text = whole_text()
    return stage(documents.select("doc_id", fingerprint_column(text, shingle).alias("fp"), F.xxhash64(text).alias("h")), "simhash")


def near_duplicates(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id of every document.

    Whole texts count, a missing one as empty. Texts without words have fingerprint 0 and are linked like any other.
    Repeated rows stay and get the same result; an empty table gives no rows; other columns are ignored.
    """
    rows = fingerprinted(documents, shingle)
    return rows.join(groups(rows, radius).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One document of each component, all columns, whatever their names: that with the smallest doc_id.

    Rows without doc_id stay only where their component has no id at all, and then one of them. Of rows that repeat the
    doc_id that stays, the one with the smallest fingerprint, then hash of the text, stays; of rows equal in id and text,
    any one. Missing texts count as empty, nulls in other columns stay as they are, an empty table gives no rows.
    """
    rows = fingerprinted(documents, shingle)
    chosen = stage(groups(rows, radius).select(F.col("first.doc_id").alias("rep"), F.col("first.h").alias("rep_h")).distinct(), "representatives")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("h") == F.col("rep_h"))
    marked = documents.select(whole_row(documents), "doc_id", F.xxhash64(whole_text()).alias("h"))
    kept = marked.join(chosen, same, "left_semi")
    if not rows.join(chosen, same, "left_semi").groupBy("doc_id", "h").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "h"])
    return kept.select("row.*")


def simhash_report(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    out = near_duplicates(documents.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
