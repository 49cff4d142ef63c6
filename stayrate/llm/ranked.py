"""Ranked lexical search: a frequency-ordered prefix tree of documents, searched by branch and bound.

Of a document only the terms that occur in some item matter: its vector of (term, occurrences), terms by falling
document frequency. Documents whose vectors begin alike share a path of the tree; sorting them over ranges brings them
together, so a task's run of sorted documents is the tree, a node being an interval of it. For the documents below a
node, the largest number of occurrences of each term and the smallest length norm m bound every score, as a score
rises with the occurrences and falls with m. The depth-first walk keeps the best documents per item, goes into a node
only for the items whose bound reaches their worst kept score, and leaves it where no item is left. Nothing is lost:
a bound equal to the worst kept score is followed, as the tie may go to a smaller doc_id.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import alnum_words, whole_text
from stayrate.session import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: (item, term) pairs that are searched together; more items make more passes.
PER_BLOCK = 200_000
#: Most frequent terms whose presence deals documents out over ranges; bounds what the sampling of ranges sends to the driver.
FIRST = 256
#: Entries of vectors in one tree.
ENTRIES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame) -> DataFrame:
    """nth (a number of the row), item_id, term, times."""
    found = F.regexp_extract_all(F.translate(whole_text(), UPPER, LOWER), F.lit(TERM), F.lit(0))
    numbered = items.select(F.monotonically_increasing_id().alias("nth"), "item_id", found.alias("found"))
    rows = numbered.select("nth", "item_id", F.explode("found").alias("term"))
    return stage(rows.groupBy("nth", "item_id", "term").agg(F.count("*").alias("times")), "items")


def vectors(documents: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the whole text), ids and tfs of those in ``terms``."""
    sent = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                n, ids, tfs = [], [], []
                for text in part.column("text").to_pylist():
                    found = alnum_words(text)
                    held = {known[w]: c for w, c in Counter(found).items() if w in known}
                    n.append(len(found))
                    ids.append(list(held))
                    tfs.append(list(held.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                    ["doc_id", "n", "ids", "tfs"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out = stage(texts.mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<int>"), "vectors")
    sent.unpersist()
    return out


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each term; each task adds up its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for b in batches:
            total += np.bincount(b.column("ids").flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["id", "n"])

    out = np.zeros(terms, np.int64)
    for r in rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row a term
        out[r["id"]] = r["n"]
    return out


def in_frequency_order(rows: DataFrame, place: np.ndarray, norm: Column) -> DataFrame:
    """doc_id, m, and terms (their places by falling frequency, ascending) with tfs, of documents that hold any.

    ``path`` has a bit for each of the ``FIRST`` terms, set where it is missing: documents whose paths through the tree
    begin alike are neighbours by it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tfs = b.column("ids"), b.column("tfs")
            lengths = ids.value_lengths().to_numpy()
            at, row = place[ids.flatten().to_numpy()], np.repeat(np.arange(b.num_rows), lengths)
            order = np.lexsort((at, row))
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (at, tfs.flatten().to_numpy())]
            bits = np.ones((b.num_rows, FIRST), bool)
            bits[row[at < FIRST], at[at < FIRST]] = False
            path = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("m"), path, *lists], ["doc_id", "m", "path", "terms", "tfs"])

    some = rows.filter(F.size("ids") > 0).select("doc_id", norm.alias("m"), "ids", "tfs")
    return some.mapInArrow(run, "doc_id long, m long, path binary, terms array<int>, tfs array<int>")


@dataclass(frozen=True)
class Items:
    """Terms by place: weight, and from starts[t] to starts[t + 1] the items that hold the term, and how often."""

    weights: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    number: int

    def scores(self, terms: np.ndarray, tfs: np.ndarray, m: int) -> np.ndarray:
        """Per item, the score of a document with these terms: a bound, if they are the largest of several."""
        tfs = tfs.astype(np.int64)
        worth = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m))
        first, lengths = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)
        out = np.zeros(self.number, np.int64)
        np.add.at(out, self.items[at], np.repeat(worth, lengths) * self.times[at])
        return out


class Best:
    """The ``top`` best documents of each item so far; ``least``: the score that a further one must reach."""

    def __init__(self, number: int, top: int):
        self.top, self.heaps, self.least = top, [[] for _ in range(number)], np.ones(number, np.int64)

    def put(self, scores: np.ndarray, active: np.ndarray, doc_ids: list[int | None]) -> None:
        """Documents of equal score, ids ascending, a missing one last."""
        for item in active[scores[active] >= self.least[active]].tolist():
            heap, score = self.heaps[item], int(scores[item])
            for d in doc_ids:
                key = (score, d is not None, -(d or 0))
                if len(heap) < self.top:
                    heapq.heappush(heap, key)
                elif key > heap[0]:
                    heapq.heapreplace(heap, key)
                else:
                    break
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, d in heap:
                yield item, -d if known else None, score


def walk(items: Items, best: Best, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, doc_ids: list[int | None]) -> int:
    """Search the tree of documents sorted by (terms, tfs, m, id); ``ends``: where their entries end. Says how many nodes were entered."""
    off, entered = np.concatenate([[0], ends]), 0
    most = np.zeros(len(items.weights), np.int64)
    stack = [(0, len(m), np.arange(items.number))]
    while stack:
        lo, hi, active = stack.pop()
        own, counts = terms[off[lo] : off[hi]], tfs[off[lo] : off[hi]]
        if hi - lo > 1:
            np.maximum.at(most, own, counts)
            held = np.unique(own)
            bound = items.scores(held, most[held], int(m[lo:hi].min()))
            most[held] = 0
        else:
            bound = items.scores(own, counts, int(m[lo]))
        active = active[bound[active] >= best.least[active]]
        if not len(active):
            continue
        entered += 1
        if hi - lo == 1:
            best.put(bound, active, doc_ids[lo:hi])
            continue
        a, b = terms[off[lo] : off[lo + 1]], terms[off[hi - 1] : off[hi]]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        depth = int(differ[0]) if len(differ) else short  # length of the path that all share
        longer = lo + int(np.searchsorted(off[lo + 1 : hi + 1] - off[lo:hi] > depth, True))
        at = lo
        while at < longer:  # documents that end here: those with equal occurrences and m have the same scores
            like = at + 1
            while like < longer and m[like] == m[at] and (tfs[off[like] : off[like + 1]] == tfs[off[at] : off[at + 1]]).all():
                like += 1
            best.put(items.scores(a, tfs[off[at] : off[at + 1]], int(m[at])), active, doc_ids[at:like])
            at = like
        if longer < hi:
            branch = terms[off[longer:hi] + depth]
            cuts = longer + np.flatnonzero(branch[1:] != branch[:-1]) + 1
            stack += zip([longer, *cuts.tolist()], [*cuts.tolist(), hi], [active] * (len(cuts) + 1), strict=True)
    return entered


def searched(rows: DataFrame, items: Items, top: int, entries: int = ENTRIES) -> DataFrame:
    """item (its number), doc_id, score: of every task the ``top`` best documents of each item."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, held = Best(sent.value.number, top), [], 0

        def grown() -> None:
            t = pa.Table.from_batches(waiting).combine_chunks()
            flat = [t.column(c).combine_chunks() for c in ("terms", "tfs")]
            ends = np.cumsum(flat[0].value_lengths().to_numpy())
            walk(sent.value, best, ends, *(x.flatten().to_numpy() for x in flat), t.column("m").to_numpy(), t.column("doc_id").to_pylist())

        for b in batches:
            waiting.append(b)
            held += len(b.column("terms").flatten())
            if held >= entries:
                grown()
                waiting, held = [], 0
        if waiting:
            grown()
        found = list(zip(*best.rows(), strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], ["item", "doc_id", "score"])

    order = [F.col("terms"), F.col("tfs"), F.col("m"), F.col("doc_id").asc_nulls_last()]
    # copies of a text, however many, are dealt out by doc_id
    ranged = rows.repartitionByRange("path", "doc_id").drop("path").sortWithinPartitions(*order)
    out = stage(ranged.mapInArrow(run, "item int, doc_id long, score long"), "found")
    sent.unpersist()
    return out


def _block(documents: DataFrame, pairs: list[tuple[int, str, int]], top: int) -> DataFrame:
    """nth, doc_id, score for the items of ``pairs`` (nth, term, times)."""
    spark = documents.sparkSession
    number = {t: i for i, t in enumerate(sorted({p[1] for p in pairs}))}
    rows = vectors(documents, {t.encode("utf-8", "surrogatepass"): i for t, i in number.items()})
    n, total = rows.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(rows, len(number))
    place = np.empty(len(number), np.int64)
    place[np.lexsort((np.arange(len(number)), -df))] = np.arange(len(number))
    weights = np.empty(len(number), np.int64)
    weights[place] = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    nths = sorted({p[0] for p in pairs})
    of = {x: i for i, x in enumerate(nths)}
    entries = np.array([(place[number[t]], of[x], c) for x, t, c in pairs], np.int64)
    entries = entries[np.lexsort((entries[:, 1], entries[:, 0]))]
    starts = np.searchsorted(entries[:, 0], np.arange(len(number) + 1))
    items = Items(weights, starts, entries[:, 1].copy(), entries[:, 2].copy(), len(nths))
    norm = F.expr(f"100 - 75 + (75 * n * {n}L) div {max(1, total)}L")
    found = searched(in_frequency_order(rows, place, norm), items, top)
    return found.join(spark.createDataFrame(list(enumerate(nths)), "item int, nth long"), "item").select("nth", "doc_id", "score")


def ranked_documents(documents: DataFrame, items: DataFrame, top: int = TOP, per_block: int = PER_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: per row of ``items`` the ``top`` documents with the highest scores above 0.

    Whole texts count; a missing one has no terms. Equal scores go to the smaller doc_id, a missing one last. Rows that
    repeat are documents, or items, of their own, so a repeated item_id comes with the documents of each of its rows. Items
    without terms, or whose terms no document holds, have no rows; nor has an empty table. ids of documents are whole
    numbers. Other columns are ignored. Items are taken in blocks of about ``per_block`` (item, term) pairs, dealt by
    hash: a block's pairs, and what they say of each term, are sent to the tasks.
    """
    asked = item_terms(items)
    blocks = max(1, -(-asked.count() // per_block))
    block = F.pmod(F.xxhash64("nth"), F.lit(blocks))
    found = None
    for k in range(blocks):
        pairs = [tuple(r) for r in asked.filter(block == k).select("nth", "term", "times").collect()]  # about per_block rows
        if pairs:
            some = _block(documents, pairs, top)
            found = some if found is None else found.unionByName(some)
    if found is None:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = Window.partitionBy("nth").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(asked.select("nth", "item_id").distinct(), "nth").select("item_id", "rank", "doc_id", "score")


def ranked_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return ranked_documents(documents, benchmark)


def ranked_sql() -> str:
    """DuckDB SQL for :func:`ranked_report`."""
    def terms(column: str) -> str:
        return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"

    return f"""
    WITH d AS (SELECT row_number() OVER () AS nth, doc_id, {terms('text')} AS t FROM documents),
    sizes AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
    q AS (SELECT item, item_id, term, count(*) AS times FROM (
      SELECT item, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS item, item_id, {terms('text')} AS t FROM benchmark)) GROUP BY ALL),
    tf AS (SELECT nth, term, count(*) AS tf FROM (SELECT nth, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
    w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, sizes GROUP BY term, docs),
    m AS (SELECT nth, doc_id, 100 - 75 + (75 * len(t)::BIGINT * docs) // terms AS m FROM d, sizes WHERE len(t) > 0),
    s AS (SELECT item, item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (nth) GROUP BY item, item_id, nth, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}
    """
