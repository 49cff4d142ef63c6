"""Deleted interpolation: n-gram estimates mixed by how often the context was seen.

Tokens are hashed to 64 bits. Documents are gathered into blocks, written once; a block sends each of its distinct
n-grams with its count to the bucket of the n-gram's hash, the buckets add up and send the corpus counts back, and the
block scores its documents. What moves is one entry per block and distinct n-gram, not one per token, so a token that
makes up a third of the corpus costs one entry per block.

The mixture weights of a context depend on the power of two of its count. Part of the training documents is held out;
expectation-maximisation finds the weights under which the estimates of the rest make the held-out counts likeliest.
For scoring the estimates use all training documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.common import lower_ascii, remainder, whole_text
from stayrate.session import stage

#: Tokens after which a block is closed, and entries that a bucket holds on average.
BLOCK, BUCKET = 1_000_000, 2_000_000
#: No word has these bytes: the end of a text, and the places before its first word.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b"", b" "))
#: What a document is for: estimates, held-out counts, scoring only.
ESTIMATE, HELD, OTHER = 0, 1, 2
CLASSES = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(x: np.ndarray) -> bytes:
    """Bytes of an array, those of equal weight together and compressed; most high bytes are zero."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    raw = pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Ascending keys as differences, which need fewer bytes; :func:`numpy.cumsum` gives them back."""
    return np.diff(keys, prepend=np.uint64(0))


def grams(hashes: np.ndarray, lengths: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length 1 to ``order``: keys of the n-grams at each place, and which places have one.

    Every text has ``order`` - 1 begin marks before its words and the end after them.
    """
    total = lengths + order
    starts = np.cumsum(total) - total
    h = np.full(int(total.sum()), BEGIN, np.uint64)
    h[starts + total - 1] = END
    first = np.cumsum(lengths) - lengths
    h[np.arange(len(hashes)) + np.repeat(starts + order - 1 - first, lengths)] = hashes
    place = np.arange(len(h)) - np.repeat(starts, total)
    out = [(h, place >= 0)]
    for n in range(2, order + 1):
        shorter, key = out[-1][0], np.zeros(len(h), np.uint64)
        key[1:] = _mix(shorter[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        out.append((key, place >= n - 1))
    return out


def blocks(documents: DataFrame, role, held_out, size: int = BLOCK) -> DataFrame:
    """Rows of documents: block, role, doc_ids, held_out, lengths, vocabulary (hashes) and words (places in it)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", whole_text().alias("text"), role.cast("int").alias("role"), held_out.alias("held_out"))
    names = ["block", "role", "doc_ids", "held_out", "lengths", "vocabulary", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()
        open_: dict[int, tuple[list, list, list, list]] = {}
        filled: dict[int, int] = {}
        id_type = None

        def close(role: int) -> pa.RecordBatch:
            nonlocal made
            ids, held, texts, lengths = open_.pop(role)
            number = {w: i for i, w in enumerate(set().union(*texts))}
            words = np.fromiter((number[w] for t in texts for w in t), np.int32, sum(lengths))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
            made += 1
            return pa.RecordBatch.from_arrays([
                pa.array([f"{task}-{made}"]), pa.array([role], pa.int32()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([lengths], pa.list_(pa.int64())), pa.array([packed(hashes)], pa.binary()), pa.array([packed(words)], pa.binary())], names)

        for b in batches:
            id_type = b.column("doc_id").type
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                for doc, text, role, held in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "role", "held_out")), strict=True):
                    words = lower_ascii(text).split()
                    ids, flags, texts, lengths = open_.setdefault(role, ([], [], [], []))
                    ids.append(doc), flags.append(held), texts.append(words), lengths.append(len(words))
                    filled[role] = filled.get(role, 0) + len(words) + 1
                    if filled[role] >= size:
                        filled[role] = 0
                        yield close(role)
        for role in list(open_):
            yield close(role)

    schema = f"block string, role int, doc_ids array<{kind}>, held_out array<boolean>, lengths array<bigint>, vocabulary binary, words binary"
    return rows.mapInArrow(run, schema)


def _grams_of(row: dict, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    vocabulary = unpacked(row["vocabulary"], np.uint64)
    return grams(vocabulary[unpacked(row["words"], np.int32)], np.array(row["lengths"], np.int64), order)


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ascending distinct keys by bucket, and where each bucket ends."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def _messages(order: int, buckets: int):
    names = ["bucket", "block", "gram", "role", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                for n, (keys, has) in enumerate(_grams_of(row, order), 1):
                    distinct, counts = np.unique(keys[has], return_counts=True)
                    by, ends = _dealt(distinct, buckets)
                    distinct, counts = distinct[by], counts[by].astype(np.int64)
                    spans = [(k, lo, hi) for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if hi > lo]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([k for k, _, _ in spans], pa.int32()), pa.array([row["block"]] * len(spans)),
                        pa.array([n] * len(spans), pa.int32()), pa.array([row["role"]] * len(spans), pa.int32()),
                        pa.array([packed(steps(distinct[lo:hi])) for _, lo, hi in spans], pa.binary()),
                        pa.array([packed(counts[lo:hi].astype(np.int32)) for _, lo, hi in spans], pa.binary())], names)
    return run, "bucket int, block string, gram int, role int, keys binary, counts binary"


def _added(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's n-grams, aligned with the keys of each message; a row without block has the sums.

    ``first``, the counts of the estimating documents alone, goes to held-out blocks only; no other needs it.
    """
    rows, out, sums = table.to_pylist(), [], []
    bucket = rows[0]["bucket"]
    for gram in sorted({r["gram"] for r in rows}):
        own = [r for r in rows if r["gram"] == gram]
        keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in own]
        counts = np.concatenate([unpacked(r["counts"], np.int32) for r in own]).astype(np.float64)
        role = np.repeat([r["role"] for r in own], [len(k) for k in keys])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        first = np.bincount(at, counts * (role == ESTIMATE), len(distinct)).astype(np.int64)
        every = first + np.bincount(at, counts * (role == HELD), len(distinct)).astype(np.int64)
        if gram == 1:
            real = distinct != BEGIN
            sums.append((int(every[real].sum()), int(first[real].sum()), int((every[real] > 0).sum())))
        lo = 0
        for r, k in zip(own, keys, strict=True):
            part, lo = at[lo : lo + len(k)], lo + len(k)
            out.append((r["block"], r["role"], gram, bucket, packed(first[part]) if r["role"] == HELD else b"", packed(every[part]), 0, 0, 0))
    for every, first, types in sums:
        out.append((None, OTHER, 0, bucket, b"", b"", every, first, types))
    return pa.Table.from_pylist([dict(zip(ANSWER, r, strict=True)) for r in out], schema=pa.schema([
        ("block", pa.string()), ("role", pa.int32()), ("gram", pa.int32()), ("bucket", pa.int32()), ("first", pa.binary()), ("every", pa.binary()),
        ("tokens", pa.int64()), ("first_tokens", pa.int64()), ("types", pa.int64())]))


ANSWER = ("block", "role", "gram", "bucket", "first", "every", "tokens", "first_tokens", "types")


def _counted(left: pa.Table, right: pa.Table, order: int, buckets: int, column: str) -> Iterator[tuple[dict, list[np.ndarray]]]:
    """The block's row, and per n-gram length the corpus counts at every place (0 where there is none)."""
    answers = right.select(["gram", "bucket", column]).to_pylist()
    for row in left.to_pylist():
        counts = []
        for n, (keys, has) in enumerate(_grams_of(row, order), 1):
            distinct, at = np.unique(keys[has], return_inverse=True)
            by, _ = _dealt(distinct, buckets)
            said = sorted((a for a in answers if a["gram"] == n), key=lambda a: a["bucket"])
            values = np.empty(len(distinct), np.int64)
            values[by] = np.concatenate([unpacked(a[column], np.int64) for a in said])
            full = np.zeros(len(keys), np.int64)
            full[has] = values[at]
            counts.append(full)
        yield row, counts


def _tokens(row: dict, counts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams ending at each token, lengths 1 to ``order``, and of their contexts, lengths 2 on."""
    lengths = np.array(row["lengths"], np.int64) + order
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place >= order - 1)
    return np.array([c[at] for c in counts]), np.array([c[at - 1] for c in counts[:-1]]).reshape(order - 1, len(at))


def _class(context):
    """Class of a context by the power of two of its count; 0 for one that was never seen."""
    return np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, CLASSES - 1), 0)


def learn(held: DataFrame, order: int, tokens: int, types: int, rounds: int = 20, tolerance: float = 1e-3) -> np.ndarray:
    """Mixture weights by class: columns are the uniform share and the lengths 1 to ``order``.

    ``held`` has n (held-out occurrences), class, c1.., x2.. (counts of n-grams and contexts). A round adds up the
    posterior shares of the components per class, at most 64 rows; a pseudo-count keeps classes without data even.
    """
    weights = np.full((CLASSES, order + 1), 1.0 / (order + 1))
    weights[0, 2:] = 0  # the longest context was never seen
    weights /= weights.sum(axis=1, keepdims=True)
    prior = weights.copy()
    part = [F.lit(1.0 / (types + 1)), F.col("c1") / float(max(1, tokens))]
    part += [F.when(F.col(f"x{n}") > 0, F.col(f"c{n}") / F.col(f"x{n}")).otherwise(0.0) for n in range(2, order + 1)]
    for _ in range(rounds):
        shares = [F.element_at(F.array(*[F.lit(float(w)) for w in weights[:, k]]), F.col("class") + 1) * p for k, p in enumerate(part)]
        rows = held.select("class", "n", *[s.alias(f"s{k}") for k, s in enumerate(shares)])
        total = sum((F.col(f"s{k}") for k in range(1, order + 1)), F.col("s0"))
        sums = rows.groupBy("class").agg(*[F.sum(F.col("n") * F.col(f"s{k}") / total).alias(f"t{k}") for k in range(order + 1)]).collect()
        new = prior.copy()
        for r in sums:
            new[r["class"]] += [r[f"t{k}"] for k in range(order + 1)]
        new /= new.sum(axis=1, keepdims=True)
        change, weights = np.abs(new - weights).max(), new
        if change < tolerance:
            break
    return weights


def interpolated_scores(documents: DataFrame, order: int = 2, divisor: int = 7, left_out: int = 2, held: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Training documents are those whose crc32 does not leave ``left_out`` by ``divisor``; those that leave ``held``
    give the held-out counts. A missing text is empty (its end is its only token), a missing id counts as the empty
    text for the remainder. Repeated rows are separate documents. Without training documents every count is 0 and the
    scores come from the uniform share alone. An empty table gives no rows; other columns are ignored.
    """
    rest = remainder("doc_id", divisor)
    role = F.when(rest == left_out, OTHER).when(rest == held, HELD).otherwise(ESTIMATE)
    rows = stage(blocks(documents, role, rest == left_out), "blocks")
    size = rows.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(8, int(size * order) // BUCKET)
    run, schema = _messages(order, buckets)
    answers = stage(rows.mapInArrow(run, schema).groupBy("bucket").applyInArrow(
        _added, "block string, role int, gram int, bucket int, first binary, every binary, tokens long, first_tokens long, types long"), "counts")
    tokens, first_tokens, types = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("first_tokens"), F.sum("types")).first())
    answers = answers.filter(F.col("block").isNotNull())
    spare = [f"c{n}" for n in range(1, order + 1)] + [f"x{n}" for n in range(2, order + 1)]

    def held_counts(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row, counts in _counted(left, right, order, buckets, "first"):
            c, x = _tokens(row, counts, order)
            seen = pa.table(dict(zip(spare, [*c, *x], strict=True))).group_by(spare).aggregate([([], "count_all")])
            last = seen.column(spare[-1]).to_numpy() if order > 1 else np.zeros(len(seen), np.int64)
            made.append(pa.table([seen.column("count_all"), pa.array(_class(last)), *(seen.column(s) for s in spare)], ["n", "class", *spare]))
        return pa.concat_tables(made) if made else pa.table({c: pa.array([], pa.int64()) for c in ("n", "class", *spare)})

    own = rows.filter(F.col("role") == HELD)
    asked = answers.filter(F.col("role") == HELD).select("block", "gram", "bucket", "first")
    # each held block meets its answers; counts that agree are added up before the rounds
    together = own.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(held_counts, ", ".join(f"{c} long" for c in ("n", "class", *spare)))
    learnt = stage(together.groupBy("class", *spare).agg(F.sum("n").alias("n")), "held_counts")
    weights = learn(learnt.withColumn("class", F.col("class").cast("int")), order, first_tokens, types)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for row, counts in _counted(left, right, order, buckets, "every"):
            c, x = _tokens(row, counts, order)
            w = weights[_class(x[-1]) if order > 1 else np.zeros(c.shape[1], np.int64)]
            p = w[:, 0] / (types + 1) + w[:, 1] * c[0] / max(1, tokens)
            for n in range(2, order + 1):
                p += w[:, n] * np.where(x[n - 2] > 0, c[n - 1] / np.maximum(x[n - 2], 1), 0.0)
            n_tokens = np.array(row["lengths"], np.int64) + 1
            at = np.cumsum(n_tokens) - n_tokens
            ids = left.schema.field("doc_ids").type.value_type
            made.append(pa.table([
                pa.array(row["doc_ids"], ids), pa.array(row["held_out"]), pa.array(n_tokens), pa.array(np.add.reduceat((c[0] > 0).astype(np.int64), at)),
                pa.array(np.full(len(at), tokens)), pa.array(np.add.reduceat(np.log10((c[0] + 1.0) / (tokens + types + 1.0)), at)),
                pa.array(np.add.reduceat(np.log10(p), at))], names))
        return pa.concat_tables(made)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.select("block", "gram", "bucket", "every").groupBy("block")).applyInArrow(scores, schema)


def score_report(documents: DataFrame) -> DataFrame:
    return interpolated_scores(documents.select("doc_id", "text"))
