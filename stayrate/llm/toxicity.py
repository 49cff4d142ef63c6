"""Toxicity: a factorization machine over hashed terms.

The fit takes a bounded sample of labelled documents; every text is scored whole. Terms are the lower-case words without the punctuation around them, and the first four letters of longer words, so
that inflected forms of an insult share a term. Pairs of terms get their weight from the product of their factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm import factorization
from stayrate.llm.common import labelled_sample, remainder, whole_row

AROUND = ".,;:!?()[]{}\"'«»“”„…*#"
PREFIX = 4


def terms(rows: dict[str, list]) -> Iterator[np.ndarray]:
    for text in rows["text"]:
        words = {w.strip(AROUND) for w in (text or "").lower().split()}
        words |= {f"{w[:PREFIX]}*" for w in words if len(w) > PREFIX}
        words.discard("")
        found = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words))
        yield np.unique(found & (factorization.BUCKETS - 1))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 4000, divisor: int | None = 5) -> factorization.Machine:
    """A machine from at most ``per_class`` labelled documents of each class, without ids whose crc32 leaves remainder 0."""
    return factorization.fit(labelled_sample(documents, labels, "toxic", per_class, divisor), ("text",), terms)


def toxicity_scores(documents: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("doc_id",), name: str = "score", **fitting) -> DataFrame:
    """``keys`` of every document and its score (0 to 1, higher: toxic) as column ``name``.

    Whole texts are scored. A missing text counts as empty; empty texts get the score of no terms; without labels of
    both classes all documents get the same score; an empty table gives no rows; repeated rows stay; other columns
    are carried if named in ``keys``, else ignored.
    """
    return factorization.score(documents, ("text",), terms, fit(documents, labels, **fitting), keys, name)


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below ``threshold``, all columns, whatever their names.

    Nulls, empty texts, repeats and empty tables count as in :func:`toxicity_scores`: a repeated row stays or goes with
    the others like it, a score equal to ``threshold`` goes. Nulls in other columns stay as they are.
    """
    rows = documents.select(whole_row(documents), "text")
    scored = factorization.score(rows, ("text",), terms, fit(documents.select("doc_id", "text"), labels), ("row",))
    return scored.filter(F.col("score") < threshold).select("row.*")


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) for every document."""
    scored = toxicity_scores(documents, labels)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
