"""Binary metrics, AUC with tied scores, ROC points, metric deltas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.ids import running

METRICS = ("auc", "f1", "precision", "recall", "accuracy", "mcc")


def _auc(scored: DataFrame) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties one half; NaN for one class."""
    per = scored.groupBy("score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg")
    )
    per = running(per, ["score"], {"neg_upto": F.col("neg")})
    got = per.agg(
        F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    return got.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n"))).otherwise(F.lit(float("nan"))).alias("auc"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of AUC, F1, precision, recall, accuracy, MCC and counts of (score, label in {0, 1}).

    A score above the threshold is a hit. Undefined ratios are 0. No rows are an error.
    """
    hit, true = F.col("score") > threshold, F.col("label") == 1

    def count(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    c = scored.agg(count(hit & true).alias("tp"), count(hit & ~true).alias("fp"), count(~hit & true).alias("fn"), count(~hit & ~true).alias("tn"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    out = c.select(
        F.when(n == 0, F.raise_error(F.lit("no scored rows"))).otherwise(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp + tn, n).alias("accuracy"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), "tp", "fp", "fn", "tn",
    )
    return _auc(scored).join(F.broadcast(out))  # one row each


def roc_points(scored: DataFrame) -> DataFrame:
    """(score, fpr, tpr) of every distinct score as a threshold, highest first."""
    per = scored.groupBy("score").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") != 1).cast("long")).alias("neg")
    )
    total = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    per = running(per, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")})
    out = per.join(F.broadcast(total))  # one row
    return out.select("score", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def metric_delta(left: DataFrame, right: DataFrame, on: Sequence[str] = (), tolerance: float = 5e-3, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Keys, the largest absolute difference over the metrics, and whether it is within tolerance."""
    a, b = left.alias("a"), right.alias("b")
    if on:
        both = a.join(b, list(on))
    else:
        if len(left.take(2)) > 1 or len(right.take(2)) > 1:
            raise ValueError("without keys each side must be one row")
        both = a.join(F.broadcast(b))  # one row each
    delta = F.greatest(*(F.abs(F.col(f"a.{m}") - F.col(f"b.{m}")) for m in metrics))
    return both.select(*on, delta.alias("delta"), (delta <= tolerance).alias("passed"))


def epoch_loss(batches: DataFrame, by: Sequence[str] = ("epoch", "phase")) -> DataFrame:
    """Mean of batch losses weighted by their examples."""
    return batches.groupBy(*by).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))
