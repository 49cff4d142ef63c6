"""Nulls, empty texts and tables, repeated rows, clashing names: no operator fails, each has its defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stayrate.llm import interpolation, licenses, lines, mixing, neighbours, packing, quality, secrets, simhash, toxicity

LONG = "word " * 5000 + "x" * 5000
TEXTS = [None, "", " \n ", "one", "password=abcdefghijkl12 user=bob", LONG, "same words here again", "same words here again", "ünï ✓ \U0001f600 text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, target string, h string, fp string"


def documents(spark, empty=False):
    rows = [] if empty else [(i, t, None, [None, "a", "b"][i % 3], None, 0.5, "x", "y", "z") for i, t in enumerate(TEXTS)]
    if rows:
        rows += [rows[4], rows[6], (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, empty=False):
    rows = [] if empty else [(i, i % 2, (i + 1) % 2) for i in range(len(TEXTS))] + [(None, 1, 1), (3, None, None), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


REPORTS = {
    "toxicity": lambda d, l: toxicity.toxicity_report(d, l), "quality": lambda d, l: quality.quality_report(d, l),
    "lines": lambda d, l: lines.line_report(d, l), "secrets": lambda d, l: secrets.secret_report(d),
    "interpolation": lambda d, l: interpolation.score_report(d), "simhash": lambda d, l: simhash.simhash_report(d),
    "mixing": lambda d, l: mixing.mix_report(d), "licenses": lambda d, l: licenses.license_report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_one_row_per_row(spark, name):
    d = documents(spark)
    out = REPORTS[name](d, labels(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in d.collect())
    assert REPORTS[name](documents(spark, True), labels(spark, True)).count() == 0


@pytest.mark.parametrize("step", [
    lambda d, l: toxicity.drop_toxic(d, l), lambda d, l: simhash.keep_one(d), lambda d, l: secrets.redact(d), lambda d, l: mixing.mixed_documents(d)])
def test_filters_keep_the_columns(spark, step):
    d = documents(spark)
    assert step(d, labels(spark)).columns == d.columns
    assert step(documents(spark, True), labels(spark, True)).collect() == []
    step(d, labels(spark)).collect()


INSIDE = ("_id", "_fp", "_own", "_h", "_spans", "_hash", "_score", "_size", "_positions", "row", "h", "fp", "rep", "rep_h", "of", "of_h", "spans",
          "score", "k0", "c0", "size", "place", "target", "positions", "at", "copies", "none", "first", "root", "path", "key", "label", "_label")


@pytest.mark.parametrize("step", ["toxicity", "keep_one", "redact", "mixed"])
def test_stages_with_the_names_used_inside(spark, step):
    run = {"toxicity": lambda d: toxicity.drop_toxic(d, labels(spark)), "keep_one": simhash.keep_one, "redact": secrets.redact, "mixed": mixing.mixed_documents}[step]
    plain = documents(spark).select("doc_id", "text", "source").filter("doc_id is not null")
    named = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in INSIDE])
    out = run(named)
    assert out.columns == named.columns
    rows = out.collect()
    assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in INSIDE)
    assert sorted(str(r["doc_id"]) + str(r["text"]) for r in rows) == sorted(str(r["doc_id"]) + str(r["text"]) for r in run(plain).collect())


def test_which_of_repeated_ids_stays(spark):
    d = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c d e f", "y"), (1, "a b c", "x"), (None, "a b c", "z"), (2, None, "q")], "doc_id long, text string, other string")
    out = simhash.keep_one(d).collect()
    assert sorted((r["doc_id"], r["other"]) for r in out) in ([(1, "x"), (2, "q")], [(1, "y"), (2, "q")], [(1, "x"), (1, "y"), (2, "q")])
    assert sorted(map(str, out)) == sorted(map(str, simhash.keep_one(d.repartition(7)).collect()))


def test_packing_of_odd_rows(spark):
    out = packing.packed_report(documents(spark)).collect()
    assert sum(r["piece"] == 0 for r in out) == len(TEXTS) + 3
    assert packing.packed_report(documents(spark, True)).count() == 0


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 1.0]), (6, [1.0]), (None, [1.0, 2.0]), (0, [1.0, 0.0])]
    v = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    out = neighbours.neighbour_report(v).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out] == [(0, 1, 5)] and out[0]["score"] == pytest.approx(0.5**0.5)
    assert neighbours.neighbour_report(v.limit(0)).count() == 0


def test_without_labels(spark):
    assert {r["score"] for r in toxicity.toxicity_report(documents(spark), labels(spark, True)).collect()} == {0.5}
