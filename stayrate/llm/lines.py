"""Content and boilerplate lines by a linear-chain conditional random field.

Every line with a word has features (intervals of a few shares and counts). The field scores a sequence of labels by
the weights of each line's features under its label and by the weight of each pair of neighbouring labels; Viterbi
decoding finds the best sequence. A document is retained if enough of its words stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.common import labelled_sample, word_list

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_STEPS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_KINDS = 8
FEATURES = _KINDS * (len(_STEPS) + 1) + 12 + 2
#: Lines per training sequence, and training lines per document.
WINDOW, LINES = 32, 128


def line_features(lines: list[str]) -> np.ndarray:
    """One row of feature numbers per line."""
    out = np.empty((len(lines), _KINDS + 2), np.int32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        words = line.split() or [line]
        n = len(words)
        distinct = len(set(words))
        shares = (
            sum(map(str.isupper, words)) / n,
            min(1.0, sum(map(line.count, SYMBOLS)) / n),
            min(1.0, line.count("!") / n),
            1 - distinct / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            min(1.0, (line.count(".") + line.count(",")) / n),
            sum(map(str.isdigit, words)) / n,
            min(1.0, len(line) / n / 20),
        )
        at = np.searchsorted(_STEPS, shares)
        out[i, :_KINDS] = at + np.arange(_KINDS) * (len(_STEPS) + 1)
        out[i, _KINDS] = _KINDS * (len(_STEPS) + 1) + min(11, n.bit_length())
        out[i, _KINDS + 1] = FEATURES - 2 + (line in seen)
        seen.add(line)
    return out


@dataclass(frozen=True)
class Field:
    """Weights of features by label (0 boilerplate, 1 content), of pairs of labels and of the first label."""

    emit: np.ndarray
    pair: np.ndarray
    first: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """Most likely labels of the lines of a text."""
        scores = self.emit[features].sum(axis=1)
        best, back = self.first + scores[0], np.empty((len(scores), 2), np.int8)
        (a, b), (c, d) = self.pair.tolist()
        x, y = best.tolist()
        for t, (s0, s1) in enumerate(scores[1:].tolist(), 1):
            to0, to1 = (0, x + a) if x + a >= y + c else (1, y + c), (0, x + b) if x + b > y + d else (1, y + d)
            back[t] = to0[0], to1[0]
            x, y = to0[1] + s0, to1[1] + s1
        labels = np.empty(len(scores), np.int8)
        labels[-1] = int(y >= x)  # ties are content
        for t in range(len(scores) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a ridge, by gradient steps of adapted size over all sequences at once.

    Sequences have at most ``WINDOW`` lines. Without any the weights are those of no evidence, content preferred.
    """
    emit, pair, first = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.array([0.0, 1e-3])
    if not features:
        return Field(emit, pair, first)
    s, width = len(features), max(map(len, features))
    x = np.zeros((s, width, features[0].shape[1]), np.int32)
    y, on = np.zeros((s, width), np.int64), np.zeros((s, width), bool)
    for i, (f, label) in enumerate(zip(features, labels, strict=True)):
        x[i, : len(f)], y[i, : len(f)], on[i, : len(f)] = f, label, True
    n = on.sum()
    real = np.eye(2)[y] * on[:, :, None]
    step = [np.zeros_like(w) for w in (emit, pair, first)]
    square = [np.zeros_like(w) for w in (emit, pair, first)]
    for r in range(1, rounds + 1):
        scores = emit[x].sum(axis=2)
        alpha, beta = np.zeros((s, width, 2)), np.zeros((s, width, 2))
        alpha[:, 0] = first + scores[:, 0]
        for t in range(1, width):
            go = _log_sum(alpha[:, t - 1, :, None] + pair, 1) + scores[:, t]
            alpha[:, t] = np.where(on[:, t, None], go, alpha[:, t - 1])
        z = _log_sum(alpha[:, -1], 1)
        for t in range(width - 2, -1, -1):
            go = _log_sum(pair + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(on[:, t + 1, None], go, beta[:, t + 1])
        p = np.exp(alpha + beta - z[:, None, None]) * on[:, :, None]
        off = real - p
        g_emit = np.stack([np.bincount(x.ravel(), np.repeat(off[:, :, k].ravel(), x.shape[2]), FEATURES) for k in (0, 1)], axis=1)
        g_pair = np.zeros((2, 2))
        for t in range(1, width):
            both = on[:, t]
            q = np.exp(alpha[both, t - 1, :, None] + pair + (scores[both, t] + beta[both, t])[:, None, :] - z[both, None, None])
            g_pair += (real[both, t - 1, :, None] * real[both, t, None, :] - q).sum(axis=0)
        for k, (w, g) in enumerate(((emit, g_emit), (pair, g_pair), (first, off[:, 0].sum(axis=0)))):
            g = g / n - ridge * w
            step[k] = 0.9 * step[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            w += rate * (step[k] / (1 - 0.9**r)) / (np.sqrt(square[k] / (1 - 0.99**r)) + 1e-6)
    return Field(emit, pair, first)


def text_lines(text: str) -> list[str]:
    """Lines, parted at line feeds, that have a word."""
    return [x for x in text.split("\n") if x.strip(BLANKS)]


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1500) -> Field:
    """A field from at most ``per_class`` labelled documents of each class and ``LINES`` lines of each.

    There are no labels of lines: each line gets the quality label of its document, and the field learns which lines
    and neighbours make out either.
    """
    sample = labelled_sample(documents, labels, "quality", per_class)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [line_features(text_lines(x or "")[:LINES]).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id").cast(pa.string()), b.column("_label").cast(pa.int32()), pa.array(f, pa.binary())], ["id", "label", "lines"])

    rows = sample.mapInArrow(found, "id string, label int, lines binary").orderBy("id", "label", "lines").collect()
    xs, ys = [], []
    for r in rows:
        f = np.frombuffer(r["lines"], np.int32).reshape(-1, _KINDS + 2)
        for k in range(0, len(f), WINDOW):
            xs.append(f[k : k + WINDOW])
            ys.append(np.full(len(xs[-1]), r["label"]))
    return fit_field(xs, ys)


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words that stand in a window of ``window`` words found twice or more."""
    if len(words) <= window:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        # renumbered each time, so that the product cannot overflow
        key = np.unique(key * len(number) + ids[k : len(ids) - window + 1 + k], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    cover = np.zeros(len(ids), bool)
    for k in range(window):
        cover[k : len(ids) - window + 1 + k] |= twice
    return int(cover.sum())


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_report(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows. Others are kept if at
    least ``threshold`` of the words stand in lines decoded as content. Whole texts count; a missing or empty text has
    no words and fails; repeated rows stay; an empty table gives no rows; without labels every line is content.
    """
    field = documents.sparkSession.sparkContext.broadcast(fit(documents.select("doc_id", "text"), labels))

    def one(text: str) -> tuple:
        words, lines = word_list(text), text_lines(text)
        n, repeated = len(words), repeated_words(words)
        failed = n < 50 or 100 * repeated > 50 * n
        share = None
        if n:
            marks = field.value.decode(line_features(lines))
            size = np.fromiter((len(word_list(x)) for x in lines), np.int64, len(lines))
            share = float((size * marks).sum() / n)
        return (n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
                failed, not failed and share >= threshold, share)

    kind = documents.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in REPORT],
                           T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("content_share", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * len(REPORT) + [pa.bool_(), pa.bool_(), pa.float64()]
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                rows = [one(x or "") for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], schema.names)

    return documents.select("doc_id", "text").mapInArrow(run, schema)
