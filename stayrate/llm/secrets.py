"""Secrets: base patterns, and multipart credentials linked within a scope.

Strong parts are reported wherever they stand: assigned values, access keys, hexadecimal strings. Weak parts (a user
or client name, a bare mixed token, an address) mean nothing alone. An interval join within ``SCOPE`` code points ties
identifiers to secrets and addresses; a weak part is reported only where the parts complete each other: an identifier
and a secret of which one is strong, or both weak with an address beside them.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.common import whole_row, whole_text
from stayrate.session import stage

# Kind, pattern, group whose length counts, least length of that group
BASE = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", r"([0-9a-f]{16,})", 1, 16),
)
WEAK = (
    ("user", r"(?i:user_?name|user|login|client_?id|access_?key_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9@._-]+)", 1, 3),
    ("bare", r"([A-Za-z0-9+/_-]{20,})", 1, 20),
    ("endpoint", r"((?i:https?|jdbc:[a-z0-9]+|s3|ftp|mongodb|postgresql|mysql|redis|amqp)://[^\x20\x09-\x0D\"'<>]+)", 1, 8),
)
KINDS = BASE + WEAK
#: Largest distance between the starts of two parts of one credential.
SCOPE = 512


def _found(kind: int, text: Column) -> Column:
    """Per match: length of the text before it (after the last match), its length, and whether it counts."""
    name, pattern, group, least = KINDS[kind]
    pat = F.lit(pattern)
    whole, part = F.regexp_extract_all(text, pat, F.lit(0)), F.regexp_extract_all(text, pat, F.lit(group))
    counts = F.transform(part, lambda x: (F.char_length(x) >= least) & (
        x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]") if name == "bare" else F.lit(True)))
    zipped = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("len"), counts.alias("counts"),
    )
    made = F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["counts"].alias("counts")))
    return F.when(_possible(text)[name] & text.rlike(pattern), made)


def _possible(text: Column) -> dict[str, Column]:
    """Per kind, what a text must have to hold a reported span of it; cheap tests before the patterns.

    A user name, a bare token and an address are reported only beside an identifier, so texts without any identifier
    are not searched for the last two.
    """
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    access = F.contains(text, F.lit("AKIA"))
    identifier = access | (assigned & text.rlike(KINDS[len(BASE)][1]))
    return {"assign": assigned, "access": access, "hex": F.lit(True), "user": assigned, "bare": identifier,
            "endpoint": F.contains(text, F.lit("://")) & identifier}


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), kind, start, end of every base and weak candidate, once for each distinct row.

    Splitting at a pattern gives the gaps between its matches; a running sum of gaps and matches gives positions in
    code points, end exclusive. Only lengths are shuffled, never texts.
    """
    texts = documents.select("doc_id", whole_text().alias("text"))
    lists = texts.select("doc_id", F.xxhash64("text").alias("h"), *[_found(k, F.col("text")).alias(f"k{k}") for k in range(len(KINDS))])
    some = lists.filter(F.coalesce(*[F.col(f"k{k}") for k in range(len(KINDS))]).isNotNull())
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,counts:boolean>>")
    every = F.concat(*[F.coalesce(F.col(f"k{k}").cast("array<struct<kind:int,i:int,gap:int,len:int,counts:boolean>>"), empty) for k in range(len(KINDS))])
    rows = some.select("doc_id", "h", F.inline(every))
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("i")
    rows = rows.withColumn("again", F.coalesce(F.lag("i").over(w) == F.col("i"), F.lit(False)))  # the row is repeated
    step = F.when(F.col("again"), 0).otherwise(F.col("gap").cast("long") + F.col("len"))
    rows = rows.withColumn("end", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("counts and not again").select("doc_id", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Pairs of rows of one document whose starts are at most ``scope`` apart; columns of ``right`` get a prefix r_.

    An equi-join on intervals of ``scope`` code points: each left row looks into its interval and the two beside it.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], F.floor(F.col("start") / scope).alias("r_at"))
    l = left.withColumn("at", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("start") / scope) + d)))
    same = F.col("doc_id").eqNullSafe(F.col("r_doc_id")) & (F.col("h") == F.col("r_h")) & (F.col("at") == F.col("r_at"))
    return l.join(r, same & (F.abs(F.col("start") - F.col("r_start")) <= scope)).drop("at", "r_at", "r_doc_id", "r_h")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Credentials: doc_id, h, identifier and secret (start, end, kind) and whether an address stands beside them.

    ``found`` are :func:`candidates`. A pair of weak parts counts only with an address.
    """
    number = {k[0]: i for i, k in enumerate(KINDS)}
    ids = found.filter(F.col("kind").isin(number["access"], number["user"]))
    secrets = found.filter(F.col("kind").isin(number["assign"], number["hex"], number["bare"]))
    ends = found.filter(F.col("kind") == number["endpoint"])
    beside = _near(ids, ends, scope).select("doc_id", "h", "kind", "start", F.lit(True).alias("address")).distinct()
    pairs = _near(ids, secrets, scope)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "h", "kind", "start")]
    pairs = pairs.alias("p").join(beside.alias("b"), same[0] & same[1] & same[2] & same[3], "left").select("p.*", F.coalesce("b.address", F.lit(False)).alias("address"))
    strong = (F.col("kind") == number["access"]) | F.col("r_kind").isin(number["assign"], number["hex"])
    return pairs.filter(strong | F.col("address"))


def secret_spans(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, h, kind, start, end of all reported spans: base ones, and weak ones that belong to a credential.

    A weak span that overlaps a base span is left out, as the base span says it. Texts count whole, missing ones as
    empty. h is the hash of the text, so rows that repeat a doc_id with another text stay apart; identical rows share
    their spans. An empty table gives no rows.
    """
    found = stage(candidates(documents), "candidates")
    n = len(BASE)
    own = Window.partitionBy("doc_id", "h").orderBy("start")
    before = F.max(F.when(F.col("kind") < n, F.col("end"))).over(own.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("kind") < n, F.col("start"))).over(own.rangeBetween(0, Window.unboundedFollowing))
    clear = found.withColumn("before", before).withColumn("after", after)
    clear = clear.filter((F.col("kind") < n) | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("after") >= F.col("end"), F.lit(True))))
    clear = stage(clear.drop("before", "after"), "parts")
    links = stage(linked(clear, scope), "credentials")
    parts = links.select("doc_id", "h", "kind", "start", "end").union(links.select("doc_id", "h", "r_kind", "r_start", "r_end"))
    ids = links.select("doc_id", "h", "kind", "start", "end").distinct()
    ends = _near(ids, clear.filter(F.col("kind") == len(KINDS) - 1), scope).select("doc_id", "h", "r_kind", "r_start", "r_end")
    weak = parts.union(ends).filter(F.col("kind") >= n).distinct()
    return clear.filter(F.col("kind") < n).unionByName(weak)


def redact(documents: DataFrame, mark: str = "[secret]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by ``mark``; all else, columns of any other name included, as it was.

    Overlapping spans become one mark. ``n_chars``, where the table has it, becomes the length of a changed text.
    Only texts that match some pattern are shuffled, to meet their spans; a missing text stays missing. Rows that repeat
    are changed alike; an empty table gives no rows.
    """
    spans = secret_spans(documents, scope)
    own = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("part", F.when(F.col("start") < reach, 0).otherwise(1))
    spans = spans.withColumn("part", F.sum("part").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "h", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = merged.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "spans")
    text = whole_text()
    test = _possible(text)
    some = functools.reduce(operator.or_, [test[name] & text.rlike(pattern) for name, pattern, _, _ in KINDS])
    marked = documents.filter(some).select(whole_row(documents), "doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    joined = marked.join(lists, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left")
    at, text = F.col("spans"), F.col("text")
    pieces = F.transform(at, lambda s, i: F.concat(
        F.substring(text, (F.when(i == 0, 0).otherwise(at[i - 1]["end"]) + 1).cast("int"),
                    (s["start"] - F.when(i == 0, 0).otherwise(at[i - 1]["end"])).cast("int")), F.lit(mark)))
    rest = F.substring(text, (F.element_at(at, -1)["end"] + 1).cast("int"), F.char_length(text))
    joined = joined.withColumn("text", F.when(at.isNotNull(), F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("row.text")))
    changed = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed["n_chars"] = F.when(at.isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    return documents.filter(~some).unionByName(joined.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns]))


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    documents = documents.select("doc_id", "text")
    spans = secret_spans(documents)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    said = F.concat_ws(":", F.element_at(names, F.col("kind") + 1), F.col("start").cast("string"), F.col("end").cast("string"))
    each = F.struct("start", "kind", said.alias("said"))
    n = len(BASE)
    listed = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    per = spans.groupBy("doc_id", "h").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k][0]}") for k in range(n)],
        listed(F.collect_list(F.when(F.col("kind") < n, each))).alias("base"), listed(F.collect_list(each)).alias("spans"),
    )
    per = per.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h")
    rows = documents.select("doc_id", F.xxhash64(whole_text()).alias("h"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", *[zero(f"n_{KINDS[k][0]}") for k in range(n)],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )
