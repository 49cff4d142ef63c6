"""Ranked search, exact duplicates and resampling: against DuckDB on odd rows, and their parts against plain loops."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stayrate.llm import copies, ranked, resampling
from stayrate.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "word Other " * 20000 + "x" * 5000
TEXTS = [None, "", " \n ", "One two", "onetwo", "one, two! three", "one  two", "é✓ ünï 9x", LONG, "One two", "two two two one " * 9, "TWO one " * 12]


def odd(spark, empty=False):
    """Rows with clashing names, a repeated row and, last, texts that tie."""
    rows = [] if empty else [(i, t, i, "k", 1.5, i % 3) for i, t in enumerate(TEXTS)] + [(3, "One two", 3, "k", 1.5, 0)]
    rows += [] if empty else [(100 + i, "tie one words of equal length here " * 4, 1, "", 0.0, 0) for i in range(15)]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, key string, score double, rank int")


def asked(spark, empty=False):
    rows = [] if empty else [(1, "one TWO two absent", 5), (2, None, 1), (3, "", 1), (3, "words here", 1), (None, "two", 0), (1, "one TWO two absent", 5)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def duck(sql, documents, benchmark):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    con.register("benchmark", benchmark.toArrow())
    cur = con.execute(sql)
    return sorted(map(str, ({c[0]: v for c, v in zip(cur.description, r)} for r in cur.fetchall())))


def spark_rows(df, names):
    return sorted(str({n: r[n] for n in names}) for r in df.collect())


@pytest.mark.parametrize("name", ["ranked", "copies", "resampling"])
def test_odd_rows(spark, name):
    run, sql, names = {
        "ranked": (ranked.ranked_report, ranked.ranked_sql(), ["item_id", "rank", "doc_id", "score"]),
        "copies": (lambda d, b: copies.copies_report(d), copies.copies_sql(), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]),
        "resampling": (resampling.resample_report, resampling.resample_sql(), ["doc_id", "n_features", "weight", "score", "rank"]),
    }[name]
    d, b = odd(spark), asked(spark)
    assert spark_rows(run(d, b), names) == duck(sql, d, b)
    assert run(odd(spark, True), b).collect() == []
    assert set(run(odd(spark, True), asked(spark, True)).columns) == set(names)
    without_id = d.withColumn("doc_id", F.lit(None).cast("long"))
    assert run(without_id, b).count() == run(d, b).count()


def test_search_without_items(spark):
    assert ranked.ranked_report(odd(spark), asked(spark, True)).collect() == []


def test_items_in_blocks(spark):
    d, b = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    assert sorted(ranked.ranked_documents(d, b).collect()) == sorted(ranked.ranked_documents(d, b, per_block=300).collect())


def test_walk_finds_the_best_and_leaves_subtrees():
    rng = np.random.default_rng(4)
    v, number, top = 40, 6, 5
    docs = sorted((sorted(set(rng.geometric(0.15, rng.integers(1, 9)).clip(1, v) - 1)), int(rng.integers(25, 90)), i) for i in range(1500))
    tfs = {i: rng.integers(1, 6, len(t)) for t, _, i in docs}
    docs.sort(key=lambda d: (d[0], tfs[d[2]].tolist(), d[1], d[2]))
    times = rng.integers(0, 3, (v, number)) * (rng.random((v, number)) < 0.3)
    at, item = np.nonzero(times)
    items = ranked.Items(np.arange(100, 100 + v), np.searchsorted(at, np.arange(v + 1)), item, times[at, item], number)
    best = ranked.Best(number, top)
    ends = np.cumsum([len(d[0]) for d in docs])
    entered = ranked.walk(items, best, ends, np.concatenate([d[0] for d in docs]), np.concatenate([tfs[d[2]] for d in docs]), np.array([d[1] for d in docs]), [d[2] for d in docs])
    want = []
    for q in range(number):
        scores = [(sum(int(times[t, q]) * (100 + t) * (10**9 * int(c) // (1000 * int(c) + 8 * m)) for t, c in zip(terms, tfs[i])), -i) for terms, m, i in docs]
        want += [(q, -i, s) for s, i in sorted(scores, reverse=True)[:top] if s > 0]
    assert sorted(best.rows()) == sorted(want)
    assert entered < len(docs)


@pytest.mark.parametrize("capacity,bits", [(4, 64), (3, 12), (2, 4)])
def test_small_buckets_and_colliding_keys(spark, capacity, bits):
    d = table(spark, SF, "documents")
    assert sorted(copies.exact_duplicates(d, capacity, bits).collect()) == sorted(copies.exact_duplicates(d).collect())
    rows = copies.entries(d, bits)
    keys = rows.select("key").distinct()
    found = copies.buckets(keys, capacity, bits).collect()
    assert sum(b["load"] for b in found) == keys.count() and max(b["load"] for b in found) <= capacity
    slots, depth = copies.directory(copies.buckets(keys, capacity, bits))
    assert copies.placed(keys, slots, depth).count() == keys.count()
    assert slots.groupBy("slot").count().filter("count > 1").isEmpty()
    pages = copies.indexed(d, rows, capacity, bits).pages
    assert bits == 64 or pages.filter("place > 0").count() > 0  # chains hold other texts


def test_index_finds_later_documents(spark):
    d = table(spark, SF, "documents")
    index = copies.indexed(d, copies.entries(d))
    old = d.orderBy("doc_id").first()
    new = spark.createDataFrame([(900001, "\t" + old["text"].replace(" ", "  ")), (900002, "not in there at all")], "doc_id long, text string")
    out = index.find(new).collect()
    want = {r["doc_id"]: r["keep_id"] for r in copies.copies_report(d).collect()}
    assert [(r["doc_id"], r["keep_id"]) for r in out] == [(900001, want[old["doc_id"]])]


def test_bit_planes_add_up():
    rng = np.random.default_rng(2)
    counts, gain = rng.geometric(0.01, (7, 1000)) * (rng.random((7, 1000)) < 0.2), rng.integers(-9000, 9000, 1000)
    signed = resampling.planes(np.maximum(gain, 0)), resampling.planes(np.maximum(-gain, 0))
    assert (resampling.sums(counts, signed) == counts @ gain).all()


def test_runs_of_words(spark):
    d = spark.createDataFrame([(1, "a b c a b")], "doc_id long, text string")
    row = resampling.counted(d, longest=3).first()
    assert (row["n_words"], row["n_features"], sum(row["counts"])) == (5, 5 + 4 + 3, 12)


def test_drawn_documents(spark):
    d = table(spark, SF, "documents")
    out = resampling.resampled(d, table(spark, SF, "benchmark"))
    ranks = [r["rank"] for r in out.collect() if r["rank"]]
    long_enough = resampling.counted(d.select("doc_id", "text")).filter("n_words >= 20").count()
    assert sorted(ranks) == list(range(1, long_enough // 10 + 1))
    kept = resampling.drawn_documents(d, table(spark, SF, "benchmark"))
    assert kept.columns == d.columns and kept.count() == len(ranks)


def test_scores_bound_those_of_less_occurrences():
    items = ranked.Items(np.array([5, 7]), np.array([0, 1, 2]), np.array([0, 0]), np.array([1, 2]), 1)
    bound = items.scores(np.array([0, 1]), np.array([4, 9]), 30)
    assert all((items.scores(np.array([0, 1]), np.array([a, b]), m) <= bound).all() for a in range(1, 5) for b in range(1, 10) for m in (30, 31, 80))
    assert items.scores(np.array([], np.int64), np.array([], np.int64), 30).tolist() == [0]
