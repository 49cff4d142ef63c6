"""Evaluation of predictions. Every report starts from counts combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.running import running_totals
from stayrate.session import stage


def accuracy(df: DataFrame, label: str = "churn", pred: str = "predicted_churn") -> DataFrame:
    """Share of correct predictions."""
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def confusion_counts(df: DataFrame, label: str = "churn", pred: str = "predicted_churn") -> DataFrame:
    """Rows per pair of label and prediction."""
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str = "churn", pred: str = "predicted_churn") -> DataFrame:
    """One row per label with the rows predicted 0 and 1."""
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col(pred) == 0).alias("predicted_0"),
        F.count_if(F.col(pred) == 1).alias("predicted_1"),
    )


def _share(part, whole):
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, label: str = "churn", pred: str = "predicted_churn") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    The table is read once; all further steps work on at most classes squared rows. In the accuracy
    row all three figures are the accuracy.
    """
    cells = confusion_counts(df, label, pred)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), zero.alias("named"), hit.alias("hits")),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), F.col("n").alias("named"), zero.alias("hits")),
    )
    per = (
        cells.select(F.explode(sides).alias("s")).select("s.*")
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "named", "hits")])
        .withColumns({
            "precision": _share(F.col("hits"), F.col("named")),
            "recall": _share(F.col("hits"), F.col("support")),
        })
        .withColumn("f1", _share(
            F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")
        ))
    )
    figures = ("precision", "recall", "f1")
    totals = per.rollup("class").agg(
        F.grouping("class").alias("whole"),
        F.sum("support").alias("support"),
        F.sum("hits").alias("hits"),
        *[F.avg(c).alias(c) for c in figures],
        *[_share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"{c}_w") for c in figures],
    )

    def line(name, values):
        return F.struct(
            name.cast("string").alias("class"),
            *[v.alias(c) for c, v in zip(figures, values, strict=True)],
            F.col("support").cast("bigint").alias("support"),
        )

    right = _share(F.col("hits"), F.col("support"))
    summary = F.array(
        line(F.lit("accuracy"), [right] * 3),
        line(F.lit("macro avg"), [F.col(c) for c in figures]),
        line(F.lit("weighted avg"), [F.col(f"{c}_w") for c in figures]),
    )
    single = F.array(line(F.col("class"), [F.col(c) for c in figures]))
    return totals.select(F.explode(F.when(F.col("whole") == 1, summary).otherwise(single)).alias("r")).select("r.*")


def _curve(df: DataFrame, label: str, score: str) -> tuple[DataFrame, int, int]:
    """Per distinct score, positives and negatives with at least that score; and both totals.

    The counts per score are staged, so the scored table itself is read once.
    """
    counted = (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("threshold"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) == 0).alias("neg"),
        )
    )
    kept = stage(counted, "scores")
    pos, neg = kept.agg(F.sum("pos"), F.sum("neg")).first()
    return running_totals(kept, "threshold", {"pos": "tp", "neg": "fp"}, descending=True), pos or 0, neg or 0


def roc_auc(df: DataFrame, label: str = "churn", score: str = "risk_score") -> DataFrame:
    """Area under the ROC curve; equal scores count half. Missing when a class is absent.

    The number of ordered pairs is added up from counts per distinct score, as decimals, since it
    grows with the square of the rows.
    """
    big = "decimal(38,1)"
    curve, pos, neg = _curve(df, label, score)
    # a negative is beaten by positives of higher scores and half beaten by those of its own score
    above = (F.col("tp") - F.col("pos")).cast("decimal(18,0)") + F.col("pos").cast("decimal(18,0)") * F.lit("0.5").cast("decimal(2,1)")
    won = F.sum((F.col("neg").cast("decimal(18,0)") * above).cast(big)).cast("double")
    return curve.agg(F.try_divide(won, F.lit(float(pos) * float(neg))).alias("roc_auc"))


def roc_points(df: DataFrame, label: str = "churn", score: str = "risk_score") -> DataFrame:
    """False and true positive rate at every score threshold."""
    curve, pos, neg = _curve(df, label, score)
    return curve.select(
        "threshold",
        F.try_divide(F.col("fp").cast("double"), F.lit(float(neg))).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.lit(float(pos))).alias("tpr"),
    )


def pr_points(df: DataFrame, label: str = "churn", score: str = "risk_score") -> DataFrame:
    """Precision and recall at every score threshold."""
    curve, pos, _ = _curve(df, label, score)
    return curve.select(
        "threshold",
        F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.lit(float(pos))).alias("recall"),
    )
