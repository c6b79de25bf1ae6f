"""Link scores of node pairs, a fitted link classifier, attributions, and comparison with stored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.encode import bce_with_logits, dot, hard_decision
from linkloom.operators.skew import hub_join


def with_ends(edges: DataFrame, nodes: DataFrame, vector: str = "h") -> DataFrame:
    """Edges with the vectors of both ends as ``a`` and ``b``; edges without a vector are left out. Hubs are met in slices."""
    a = nodes.select(F.col("id").alias("src"), F.col(vector).alias("a"))
    b = nodes.select(F.col("id").alias("dst"), F.col(vector).alias("b"))
    return hub_join(hub_join(edges, a, "src"), b, "dst", counted=edges)


def score_links(edges: DataFrame, nodes: DataFrame, vector: str = "h", threshold: float = 0.5) -> DataFrame:
    """Add score (dot product), predicted (score > threshold) and, with a label, the loss."""
    out = with_ends(edges, nodes, vector).withColumn("score", dot(F.col("a"), F.col("b"))).drop("a", "b")
    out = out.withColumn("predicted", hard_decision(F.col("score"), threshold))
    return out.withColumn("loss", bce_with_logits(F.col("score"), F.col("label"))) if "label" in edges.columns else out


def link_features(edges: DataFrame, nodes: DataFrame, vector: str = "h", extra: Sequence[str] = ()) -> DataFrame:
    """Element-wise product of the ends' vectors, with further numeric edge columns, as ``features``."""
    both = with_ends(edges, nodes, vector)
    f = F.zip_with("a", "b", lambda x, y: x * y)
    if extra:
        f = F.concat(f, F.array(*(F.col(c).cast("double") for c in extra)))
    return both.withColumn("features", array_to_vector(f)).drop("a", "b")


def fit_links(features: DataFrame, reg: float = 0.01, max_iter: int = 30) -> LogisticRegressionModel:
    return LogisticRegression(regParam=reg, maxIter=max_iter, featuresCol="features", labelCol="label").fit(features)


def sweep(train: DataFrame, val: DataFrame, test: DataFrame, grid: Sequence[dict]) -> list[tuple[dict, LogisticRegressionModel, dict[str, DataFrame]]]:
    """A model per setting, with its metrics table per phase (Training, Validation, Testing)."""
    from linkloom.operators.metrics import binary_metrics

    out = []
    for setting in grid:
        model = fit_links(train, **setting)
        phases = {}
        for phase, df in (("Training", train), ("Validation", val), ("Testing", test)):
            scored = model.transform(df).select(vector_to_array("probability")[1].alias("score"), "label")
            phases[phase] = binary_metrics(scored)
        out.append((setting, model, phases))
    return out


def attributions(features: DataFrame, model: LogisticRegressionModel, baseline: Sequence[float] | None = None) -> DataFrame:
    """Exact contribution of each feature to a linear score: coefficient x (value - baseline)."""
    coef = [float(c) for c in model.coefficients]
    base = [float(b) for b in baseline] if baseline is not None else [0.0] * len(coef)
    lit = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(b).alias("b")) for c, b in zip(coef, base, strict=True)))
    return features.withColumn("attribution", F.zip_with(lit, vector_to_array("features"), lambda k, x: k["c"] * (x - k["b"])))


def largest_cell(rows: DataFrame, vector: str, row_id: str) -> DataFrame:
    """(row_id, pos, value) of the largest element over all rows; the first row and place of equals."""
    cells = rows.select(row_id, F.posexplode(vector).alias("pos", "value")).where("value is not null")
    best = cells.agg(F.max_by(F.struct(row_id, "pos", "value"), F.struct("value", -F.col(row_id), -F.col("pos"))).alias("b"))
    return best.select("b.*")


def top_features(rows: DataFrame, vector: str, k: int = 10) -> DataFrame:
    """(pos, importance) of the k largest sums of absolute values."""
    cells = rows.select(F.posexplode(vector).alias("pos", "value"))
    return cells.groupBy("pos").agg(F.sum(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "pos").limit(k)
