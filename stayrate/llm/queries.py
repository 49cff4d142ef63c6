"""The operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stayrate.llm import copies, interpolation, licenses, lines, mixing, neighbours, packing, quality, ranked, resampling, secrets, simhash, toxicity
from stayrate.llm.common import table


def _docs(f: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*(table(spark, sf_dir, t) for t in ("documents", *more)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": _docs(toxicity.toxicity_report, "labels"),
    "op2_secrets": _docs(secrets.secret_report),
    "op3_lines": _docs(lines.line_report, "labels"),
    "op4_interpolation": _docs(interpolation.score_report),
    "op5_packing": _docs(packing.packed_report),
    "op6_simhash": _docs(simhash.simhash_report),
    "op7_mixing": _docs(mixing.mix_report),
    "op8_neighbours": lambda spark, sf_dir: neighbours.neighbour_report(table(spark, sf_dir, "embeddings")),
    "op9_quality": _docs(quality.quality_report, "labels"),
    "op10_licenses": _docs(licenses.license_report),
    "op11_ranked": _docs(ranked.ranked_report, "benchmark"),
    "op12_copies": _docs(copies.copies_report),
    "op13_resampling": _docs(resampling.resample_report, "benchmark"),
    "pipeline": corpus_pipeline.run,
}

#: DuckDB SQL where it can express the query.
ORACLES: dict[str, str] = {
    "op10_licenses": licenses.license_sql(), "op11_ranked": ranked.ranked_sql(), "op12_copies": copies.copies_sql(), "op13_resampling": resampling.resample_sql(),
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
