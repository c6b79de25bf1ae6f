"""Message passing over edge tables: neighbour means, attention, stacks of layers.

Vectors are array<double> of any width. Layers are matrix products per Arrow batch, sums and attention are states
merged per task before the one shuffle of vectors by target (``matrix``). Joins meet a hub in slices (``skew``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.encode import relu
from linkloom.operators.components import checkpoint
from linkloom.operators.matrix import NUMBER, VECTOR, affine, map_vectors, softmax_means, vector_means, vector_sums, weights
from linkloom.operators.skew import hub_join

LAYERS = ("sage", "gat")


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def zeros(dims: int) -> Column:
    return F.array_repeat(F.lit(0.0), dims)


def centre(nodes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Mean x and y over all node types, per group (or of the whole table)."""
    return nodes.groupBy(*group).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def from_centre(nodes: DataFrame, group: Sequence[str] = (), of: DataFrame | None = None) -> DataFrame:
    """x and y less the centre of the node's group; the centre is that of the rows ``of``, if given."""
    mid = centre(nodes if of is None else of, group)
    out = nodes.join(F.broadcast(mid)) if not group else nodes.join(mid, list(group))  # one row
    return out.withColumns({"x": F.col("x") - F.col("cx"), "y": F.col("y") - F.col("cy")}).drop("cx", "cy")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, dims: int, to: DataFrame | None = None) -> DataFrame:
    """(id, mean) of the vectors ``h`` at the sources of a node's incoming edges; zeros for none.

    The nodes that receive are those of ``to``, or ``nodes`` itself. A source without a vector is passed over.
    """
    got = hub_join(edges.select("src", "dst"), nodes.select(F.col("id").alias("src"), "h"), "src")
    got = vector_means(got, "dst", "h", dims, "mean").withColumnRenamed("dst", "id")
    return (nodes if to is None else to).select("id").join(got, "id", "left").withColumn("mean", F.coalesce("mean", zeros(dims)))


def sage(nodes: DataFrame, edges: DataFrame, w_neighbour, w_self, bias=None, to: DataFrame | None = None) -> DataFrame:
    """(id, h): W_l mean(neighbours) + W_r own vector, of the nodes ``to`` (or ``nodes``)."""
    both = (nodes if to is None else to).select("id", "h").join(neighbour_mean(nodes, edges, len(w_neighbour[0]), to), "id")
    return affine(both, ["id"], {"mean": w_neighbour, "h": w_self}, "h", bias)


def gat(nodes: DataFrame, edges: DataFrame, weight, att_src, att_dst, bias=None, slope: float = 0.2, to: DataFrame | None = None, weight_to=None) -> DataFrame:
    """(id, h): softmax over incoming edges of the leaky attention logits, one head, no self-loops.

    The nodes that receive are those of ``to`` (or ``nodes``); their own vectors are projected by
    ``weight_to`` (or ``weight``). Edges meet the target's number first and the source's vector then, so vectors
    are shuffled by target once, as merged states.
    """
    dims = len(weight)
    to = nodes if to is None else to

    def project(params: tuple, x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        z = x["h"] @ params[0].T
        return {"z": z, "logit": z @ params[1]}

    w, w_to = weights(weight), weights(weight if weight_to is None else weight_to)
    z = map_vectors(nodes, ["id"], {"h": w.shape[1]}, {"z": VECTOR, "logit": NUMBER}, project, (w, weights(att_src)))
    own = map_vectors(to, ["id"], {"h": w_to.shape[1]}, {"logit": NUMBER}, project, (w_to, weights(att_dst)))
    narrow = edges.select("src", "dst")
    e = hub_join(narrow, own.select(F.col("id").alias("dst"), F.col("logit").alias("ld")), "dst")
    e = hub_join(e, z.select(F.col("id").alias("src"), "z", F.col("logit").alias("ls")), "src", counted=narrow)
    raw = F.col("ls") + F.col("ld")
    e = e.select("dst", "z", F.when(raw > 0, raw).otherwise(slope * raw).alias("logit"))
    s = softmax_means(e, "dst", "logit", "z", dims, "h").withColumnRenamed("dst", "id")
    h = F.coalesce("h", zeros(dims))
    if bias is not None:
        h = add(h, F.lit([float(b) for b in bias]))
    return to.select("id").join(s, "id", "left").select("id", h.alias("h"))


def hetero_sum(messages: Sequence[DataFrame], dims: int) -> DataFrame:
    """Sum of the relations' messages (id, h) per node."""
    return vector_sums(reduce(DataFrame.unionByName, messages), "id", "h", dims, "h")


def propagate(nodes: DataFrame, edges: dict[str, DataFrame], layers: Sequence[dict], skip: dict[int, Sequence[Sequence[float]]] | None = None) -> DataFrame:
    """Vectors (id, h) of nodes of one type after a stack of layers.

    ``edges`` maps a relation to (src, dst); each layer has ``kind`` and the weights of its kind, shared by
    the relations. The rest is as in ``propagate_types``.
    """
    relations = {("", r, ""): e for r, e in edges.items()}
    each = [
        {"kind": layer["kind"], "weights": dict.fromkeys(relations, {k: v for k, v in layer.items() if k != "kind"})} for layer in layers
    ]
    return propagate_types({"": nodes}, relations, each, {i: {"": w} for i, w in (skip or {}).items()})[""]


def propagate_types(
    nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], layers: Sequence[dict],
    skip: dict[int, dict[str, Sequence[Sequence[float]]]] | None = None,
) -> dict[str, DataFrame]:
    """Vectors of the nodes of every type after a stack of layers.

    ``nodes`` maps a type to (id, h); ``edges`` maps (source type, relation, target type) to (src, dst). Each
    layer has ``kind`` (``sage`` or ``gat``; another is an error) and ``weights`` by relation; the messages of
    the relations into a type are summed. A type that no relation leads to has no vector after the
    layer, and sends nothing from there on. ``skip`` adds a projection, by type, of the layer's own input at
    the layers named. ReLU follows every layer but the last. Each layer is cut by a checkpoint.
    """
    for layer in layers:
        if layer["kind"] not in LAYERS:
            raise ValueError(f"unknown layer: {layer['kind']}")
    h = nodes
    for i, layer in enumerate(layers, 1):
        step, rows = (sage, "w_self") if layer["kind"] == "sage" else (gat, "weight")
        got: dict[str, list[DataFrame]] = {}
        dims: dict[str, int] = {}
        for (source, rel, target), e in edges.items():
            if source in h and target in h:
                own = layer["weights"][source, rel, target]
                dims[target] = len(own[rows])
                got.setdefault(target, []).append(step(h[source], e, **own, to=h[target]))
        after = {}
        for kind, messages in got.items():
            out = hetero_sum(messages, dims[kind])
            if skip and i in skip:
                base = affine(h[kind], ["id"], {"h": skip[i][kind]}, "s")
                out = out.join(base, "id").select("id", add(F.col("h"), F.col("s")).alias("h"))
            after[kind] = checkpoint(out.withColumn("h", relu(F.col("h"))) if i < len(layers) else out)
        h = after
    return h
