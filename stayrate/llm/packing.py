"""Best-fit packing of tokenized documents into sequences of fixed length, in bulk-synchronous rounds.

Lengths and gaps are whole numbers up to the capacity, and documents of one length are interchangeable, so the sorted
documents and gaps are runs: at most ``capacity`` lengths, each with a count. A round takes the longest length left.
Its documents sweep to their successor, the smallest gap that holds them; those that want the same gap are told apart
by rank; gaps are updated, and the round repeats until the length is placed, opening sequences where no gap is left.
This is best-fit decreasing. The rounds work on runs only (a histogram bounded by the capacity, whatever the corpus)
and yield intervals of ranks; documents get their rank from a distributed sort by length and find their sequence and
offset by it in one join.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stayrate.llm.common import whole_text
from stayrate.session import stage

CAPACITY = 1024
END = 2
#: About as many pieces are ranked by one task.
RANKED = 200_000
#: Longest word that the table of ranks encodes; its time grows with the square of a word.
LONG_WORD = 2048


@cache
def _encoders(vocabulary: str, ranks: str):
    full = Tokenizer.from_file(vocabulary)
    marks = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return full, fast, marks


def encode(text: str, vocabulary: str, ranks: str) -> np.ndarray:
    """Ids of a text; both files hold the same vocabulary, and the faster library serves all but odd texts.

    Marks such as that of the end of a text get their own id where they stand in a text.
    """
    full, fast, marks = _encoders(vocabulary, ranks)
    words = text.split()
    if any(m in text for m in marks) or max(map(len, words), default=0) > LONG_WORD or len(text) - sum(map(len, words)) > 2 * len(words) + LONG_WORD:
        return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")
    return np.array(fast.encode_ordinary(text), "<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: all full but the first, which holds what is left over."""
    first = n % capacity
    return [(0, first)] * (first > 0) + [(k, capacity) for k in range(first, n, capacity)]


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: tokens of the whole text and the end mark, cut to the capacity."""
    vocabulary = vocabulary or str(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = ranks or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = documents.select("doc_id", whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, 256) for k in range(0, b.num_rows, 256)):
                at, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(text, vocabulary, ranks), np.array([END], "<u4"))
                    for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                        at.append(i)
                        rows.append((k, start, n, crc32(ids[start : start + n].tobytes())))
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweeps(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Moves (length, first rank, end rank, per sequence, first sequence, offset) from the number of pieces per length.

    The pieces with rank r in a move go to sequence first + (r - first rank) // per, beside each other from the offset.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs of sequences (first, number)
    gaps: list[int] = []  # those that have runs, ascending
    moves, opened = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[k]
            else:
                gap, per = capacity, capacity // length
                first, number = opened, -(-left // per)
                opened += number
            per = gap // length
            whole = min(number, left // per)
            if whole:
                moves.append((length, rank, rank + whole * per, per, first, capacity - gap))
                rank, left = rank + whole * per, left - whole * per
                put(gap - per * length, first, whole)
            if number > whole and left:  # the last sequence takes fewer; left < per, as whole is not all of the run
                moves.append((length, rank, rank + left, per, first + whole, capacity - gap))
                put(gap - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(gap, first + whole, number - whole)
    return moves


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 0 within each length. Rows of one length are dealt out by hash, so a common one is split."""
    n = rows.count()
    parts = max(1, -(-n // RANKED))
    keys = [F.col(c) for c in ("doc_id", "piece", "ids_crc32")]
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    # at most capacity times parts rows, one per length and deal
    sizes = dealt.groupBy("length", "deal").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("deal")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "deal").orderBy(*keys)
    placed = dealt.withColumn("nth", F.row_number().over(own) - 1)
    return placed.join(before, ["length", "deal"]).withColumn("rank", F.col("before") + F.col("nth")).drop("deal", "before", "nth")


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Whole texts are tokenized; a missing or empty text is the end mark alone. Only documents longer than the capacity
    are cut. Repeated rows and rows without id are packed like any other. An empty table gives no rows; columns
    besides doc_id and text are ignored.
    """
    rows = stage(pieces(documents, capacity, vocabulary, ranks), "pieces")
    # at most one row per length up to the capacity
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves = documents.sparkSession.createDataFrame(sweeps(counts, capacity), "length long, from long, upto long, per long, first long, at long")
    found = ranked(rows).join(F.broadcast(moves), "length").filter("rank >= from and rank < upto")
    nth = F.col("rank") - F.col("from")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("per"))).alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).alias("offset"))


def packed_report(documents: DataFrame) -> DataFrame:
    return pack(documents.select("doc_id", "text"))
