"""Quality: a factorization machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm import factorization
from stayrate.llm.common import labelled_sample, remainder

#: Upper ends of the intervals that shares of a text fall into.
STEPS = np.array([0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99])
SYMBOLS = "#*$%&|<>"


def structure(text: str, n_chars: int | None) -> list[str]:
    """Names of the intervals that the statistics of a text fall into; ``n_chars`` is the stored length."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {
        "upper": sum(map(str.isupper, words)) / n,
        "title": sum(map(str.istitle, words)) / n,
        "symbols": sum(map(text.count, SYMBOLS)) / n,
        "marks": text.count("!") / n,
        "stops": (text.count(".") + text.count(",")) / n,
        "digits": sum(map(str.isdigit, words)) / n,
        "distinct": len(counts) / n,
        "top": max(counts.values(), default=0) / n,
        "again": sum(a == b for a, b in zip(words, words[1:])) / n,
        "blank": text.count(" ") / chars,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
    }
    found = [f"{k}={np.searchsorted(STEPS, v)}" for k, v in shares.items()]
    found += [f"words={len(words).bit_length()}", f"line={(len(words) // max(1, len(lines))).bit_length()}", f"length={round(2 * chars / n)}"]
    # the metadata: the length that the table states, and whether it is that of the text
    found += ["stated=none" if n_chars is None else f"stated={max(0, int(n_chars)).bit_length()}", f"agrees={n_chars == len(text)}"]
    return found


def features(rows: dict[str, list]) -> Iterator[np.ndarray]:
    for text, n_chars in zip(rows["text"], rows["n_chars"], strict=True):
        text = text or ""
        names = {f"w:{w}" for w in text.split()}
        names.update(f"s:{x}" for x in structure(text, n_chars))
        found = np.fromiter((crc32(x.encode("utf-8", "surrogatepass")) for x in names), np.int64, len(names))
        yield np.unique(found & (factorization.BUCKETS - 1))


def quality_scores(documents: DataFrame, labels: DataFrame, per_class: int = 4000, divisor: int | None = 5) -> DataFrame:
    """doc_id and score (0 to 1, higher: good) of every document.

    Inputs are the words, statistics of the whole text and the stored ``n_chars`` (where the table has it, and it is a
    number). The machine is fitted on at most ``per_class`` labelled documents of each class, without ids whose crc32
    leaves remainder 0 by ``divisor``. A missing text counts as empty; without labels of both classes all documents
    get the same score; an empty table gives no rows; repeated rows stay; other columns are ignored.
    """
    stated = F.expr("try_cast(n_chars as bigint)") if "n_chars" in documents.columns else F.lit(None).cast("bigint")
    texts, columns = documents.select("doc_id", "text", stated.alias("n_chars")), ("text", "n_chars")
    machine = factorization.fit(labelled_sample(texts, labels, "quality", per_class, divisor, columns), columns, features)
    return factorization.score(texts, columns, features, machine)


def quality_report(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) for every document."""
    scored = quality_scores(documents, labels)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
