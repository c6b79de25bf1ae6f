"""The whole pass of a link model over typed nodes, and its evaluation against a stored row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.encode import frequencies, position_encoding
from linkloom.operators.experiments import expected_metrics
from linkloom.operators.link import score_links
from linkloom.operators.matrix import affine
from linkloom.operators.metrics import METRICS, binary_metrics, metric_delta
from linkloom.operators.propagate import from_centre, propagate_types


def encode_nodes(nodes: dict[str, DataFrame], weight, bias: Sequence[float] | None = None, freqs: Column | None = None, group: Sequence[str] = ()) -> dict[str, DataFrame]:
    """(id, h) of every type: the position through a dense layer with ReLU, then the attributes.

    ``nodes`` maps a type to (id, x, y, attributes). Positions are taken from the centre of all types
    together, per ``group`` (a batch or a split) or of everything. A null coordinate gives a null vector.
    """
    everyone = reduce(DataFrame.unionByName, (df.select(*group, "x", "y") for df in nodes.values()))
    place = position_encoding(F.col("x"), F.col("y"), frequencies() if freqs is None else freqs)
    out = {}
    for kind, df in nodes.items():
        placed = from_centre(df, group, everyone).select("id", "attributes", place.alias("place"))
        placed = affine(placed, ["id", "attributes"], {"place": weight}, "e", bias, relu=True)
        out[kind] = placed.select("id", F.concat("e", "attributes").alias("h"))
    return out


def link_model(
    nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], links: DataFrame, target: str, encoder: dict, layers: Sequence[dict],
    skip: dict | None = None, threshold: float = 0.5,
) -> DataFrame:
    """Scores of the pairs ``links`` of one node type: encoded nodes, a stack of layers, dot products.

    ``encoder`` holds the arguments of ``encode_nodes``; ``layers`` and ``skip`` are those of ``propagate_types``.
    """
    h = propagate_types(encode_nodes(nodes, **encoder), edges, layers, skip)
    return score_links(links, h[target], threshold=threshold)


def evaluate(scored: DataFrame, log: DataFrame, size: int, dropout: float, phase: str, threshold: float = 0.5, tolerance: float = 5e-3) -> DataFrame:
    """Metrics of a scored split beside the first stored row of its setting: keys, metrics, delta, passed.

    No scored rows are an error; a setting that the log lacks gives no row.
    """
    keys = ["size", "dropout", "phase"]
    setting = [F.lit(v).cast(t).alias(k) for k, v, t in zip(keys, (size, dropout, phase), ("int", "double", "string"), strict=True)]
    got = binary_metrics(scored, threshold).select(*setting, *METRICS)
    stored = expected_metrics(got.select(*keys), log)
    return got.join(metric_delta(got, stored, keys, tolerance), keys)
