"""Exact duplicates through an extendible-hash index on shared files.

A text is normalised by deleting its ASCII blanks; its key is a 64-bit hash of what is left. A bucket is a range of
keys: all that begin with its bits, as many as its depth. An overfull bucket splits at the next bit, and where it was
as deep as the directory, the directory doubles, so that it has a slot for each beginning of the deepest bucket. The
loads of all buckets that one round can reach are counted together, ``STEP`` doublings a round.

Texts are dealt out by bucket, key and content, so that copies that one task reads travel once and a group of any size
has no task of its own; there equal bytes become one member of the chain of their key, other bytes the next. The pages
of the index lie in key ranges, each owned by the task that writes it, and hold per member its key, place in the chain,
digest, number of rows and the row that stays; they never hold texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import whole_text
from stayrate.session import stage

#: Keys that a bucket holds before it splits.
CAPACITY = 4096
#: Levels that a round counts.
STEP = 8
BITS = 64
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def key_of(content: Column, bits: int = BITS) -> Column:
    """Hash of the content, cut to its first ``bits`` bits."""
    h = F.xxhash64(content)
    return h if bits == BITS else F.shiftleft(F.shiftrightunsigned(h, BITS - bits), BITS - bits)


def beginning(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key as a number."""
    return F.shiftrightunsigned(key, BITS - depth) if depth else F.lit(0).cast("long")


def buckets(keys: DataFrame, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """depth, prefix, load of the buckets that hold the distinct ``key``; none holds over ``capacity`` keys."""
    total = keys.count()
    if total <= capacity:
        return keys.sparkSession.createDataFrame([(0, 0, total)], "depth int, prefix long, load long")
    done, low, full = None, 0, None
    while full is None or not full.isEmpty():
        top = min(bits, low + STEP)
        inside = keys if full is None else keys.join(full, beginning(F.col("key"), low) == F.col("prefix"), "left_semi")
        slots = inside.groupBy(beginning(F.col("key"), top).alias("at")).agg(F.count("*").alias("n"))
        each = slots.select(F.explode(F.sequence(F.lit(low + 1), F.lit(top))).alias("depth"), "at", "n")
        levels = each.groupBy("depth", F.expr(f"shiftrightunsigned(at, {top} - depth)").alias("prefix")).agg(F.sum("n").alias("load"))
        # the bucket that a bucket was split from holds the two halves
        halves = Window.partitionBy("depth", F.shiftrightunsigned("prefix", 1))
        levels = stage(levels.withColumn("before", F.sum("load").over(halves)), "levels")
        fit = levels.filter((F.col("load") <= capacity) & (F.col("before") > capacity)).select("depth", "prefix", "load")
        done = fit if done is None else done.union(fit)
        full = levels.filter((F.col("depth") == top) & (F.col("load") > capacity)).select("prefix")
        low = top
    return done


def directory(found: DataFrame) -> tuple[DataFrame, int]:
    """slot, depth and bucket (its smallest key) for every slot in use, and the directory's depth."""
    found = stage(found, "buckets")
    deepest = found.agg(F.max("depth")).first()[0]
    first, each = f"shiftleft(prefix, {deepest} - depth)", f"shiftleft(1L, {deepest} - depth)"
    slots = F.explode(F.expr(f"sequence({first}, {first} + {each} - 1)"))
    lowest = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(prefix, {BITS} - depth)"))
    return stage(found.select(slots.alias("slot"), "depth", lowest.alias("bucket")), "directory"), deepest


def placed(keyed: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``keyed`` with the bucket of its ``key``; the directory has a row a slot, so Spark sends it to all tasks while it is small."""
    return keyed.withColumn("slot", beginning(F.col("key"), depth)).join(slots.select("slot", "bucket"), "slot").drop("slot")


@dataclass(frozen=True)
class Index:
    """``directory``: slot, depth, bucket; ``pages``: bucket, key, place, digest, rows, keep_id, keep_row; both on shared files."""

    directory: DataFrame
    depth: int
    pages: DataFrame
    bits: int = BITS

    def find(self, documents: DataFrame) -> DataFrame:
        """doc_id, keep_id, rows of those ``documents``, indexed or not, whose text is in the index."""
        content = normalised(whole_text())
        keyed = documents.select("doc_id", key_of(content, self.bits).alias("key"), F.sha2(content, 256).alias("digest"))
        held = self.pages.select("bucket", "key", "digest", "keep_id", "rows")
        return placed(keyed, self.directory, self.depth).join(held, ["bucket", "key", "digest"]).select("doc_id", "keep_id", "rows")


def entries(documents: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, row (a number of its own), key, digest, n_chars of every row of ``documents``; no texts."""
    text = whole_text()
    content = normalised(text)
    return stage(documents.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), key_of(content, bits).alias("key"),
        F.sha2(content, 256).alias("digest"), F.char_length(text).alias("n_chars")), "entries")


def indexed(documents: DataFrame, rows: DataFrame, capacity: int = CAPACITY, bits: int = BITS) -> Index:
    """The index of ``documents``; ``rows`` are their :func:`entries`."""
    slots, depth = directory(buckets(stage(rows.select("key").distinct(), "keys"), capacity, bits))
    content = normalised(whole_text())
    texts = placed(documents.select(key_of(content, bits).alias("key"), content.alias("content")), slots, depth)
    # grouping by the content compares bytes; before the shuffle each task combines the copies that it has read
    chains = texts.groupBy("bucket", "key", "content").agg(F.count("*").alias("rows"))
    members = stage(chains.select("bucket", "key", F.sha2("content", 256).alias("digest"), "rows"), "members")
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    best = rows.groupBy("key", "digest").agg(F.min(order).alias("best"))
    best = best.select("key", "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("digest")) - 1
    pages = members.join(best, ["key", "digest"]).withColumn("place", place)
    pages = pages.select("bucket", "key", "place", "digest", "rows", "keep_id", "keep_row")
    return Index(slots, depth, stage(pages.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "place"), "pages"), bits)


def exact_duplicates(documents: DataFrame, capacity: int = CAPACITY, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Whole texts count, a missing one as empty, and texts of blanks only equal the empty one. Of equal texts the row
    with most code points stays, then the smallest doc_id; a missing doc_id comes last; of rows that repeat both, any
    one stays and the others are dropped. A group has one row with ``kept``. An empty table gives no rows. Columns
    besides doc_id and text are ignored. ``bits`` cuts the keys, so that other texts share them.
    """
    rows = entries(documents, bits)
    pages = indexed(documents, rows, capacity, bits).pages.select("key", "digest", "rows", "keep_id", "keep_row")
    return rows.join(pages, ["key", "digest"]).select(
        "doc_id", "keep_id", F.col("rows").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def copies_report(documents: DataFrame) -> DataFrame:
    return exact_duplicates(documents.select("doc_id", "text"))


def copies_sql() -> str:
    """DuckDB SQL for :func:`copies_report`."""
    return r"""
    WITH n AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
      row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY k ORDER BY length(t) DESC, doc_id)
    """
