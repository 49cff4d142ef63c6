"""What several operators of this folder share: columns of texts, staging, bounded label samples."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.session import stage

#: Words are runs of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as string; a missing one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; a missing id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(divisor).cast("bigint"))


def word_list(text: str) -> list[bytes]:
    """Words of a text; bytes.split() parts at exactly the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower()


def whole_row(documents: DataFrame) -> Column:
    """All columns of a row as one, so that columns of any name stand beside those used inside; ``row.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")


# bytes.translate table: A-Z become a-z; all bytes but letters, digits and those of characters beyond ASCII become blanks
_ALNUM = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def alnum_words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII in UTF-8, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, divisor: int | None = None,
                    columns: Iterable[str] = ("text",)) -> DataFrame:
    """At most ``per_class`` labelled documents of each class, the same ones on every run.

    Rows of ``labels`` without id or label are left out; of several labels of an id the largest counts. With
    ``divisor``, ids whose crc32 leaves remainder 0 are left out. The picked ids, at most two times ``per_class``
    rows, are broadcast, so that the texts are scanned in place. Of rows that repeat an id one is taken, that with the
    largest hash; each task picks its own first.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .filter(F.col("_id").isNotNull() & F.col("_label").isin(0, 1)).groupBy("_id").agg(F.max("_label").alias("_label"))
    )
    if divisor:
        known = known.filter(remainder("_id", divisor) != 0)
    parts = [known.filter(F.col("_label") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    texts = documents.select(F.col("doc_id").alias("_id"), *columns)
    one = F.max_by(F.struct(*columns), F.xxhash64(*columns)).alias("_one")
    rows = texts.join(picked, "_id").groupBy("_id", "_label").agg(one)
    return stage(rows.select("_id", "_label", *[F.col(f"_one.{c}").alias(c) for c in columns]), "labelled")
