"""Features of positions and vectors as column expressions over array<double>."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import cos, exp, log, pi, sin

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequencies(count: int = 16, low: float = 1_000.0, high: float = 10_000.0, kind: str = "geometric", seed: int = 0) -> Column:
    """Frequencies as a literal array: reciprocals of radii from ``low`` to ``high`` in geometric
    steps, or ``random`` ones, uniform in (0, 1) by a seeded hash times ``high``.

    One frequency alone is that of ``low``. Another kind is an error.
    """
    if kind == "geometric":
        step = log(high / low) / (count - 1) if count > 1 else 0.0
        return F.array(*(F.lit(1.0 / (low * exp(k * step))) for k in range(count)))
    if kind == "random":
        return F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda k: F.pmod(F.xxhash64(F.lit(seed), k), F.lit(1 << 30)) / float(1 << 30) * high,
        )
    raise ValueError(f"unknown kind of frequencies: {kind}")


def position_encoding(x: Column, y: Column, freqs: Column, ffn: Callable[[Column], Column] | None = None) -> Column:
    """Sine and cosine of the position along three axes 120 degrees apart, at every frequency.

    For each frequency: sin, cos along axis 0, then axis 1, then axis 2. ``ffn`` is applied to
    the whole array. A null coordinate gives null.
    """
    along = [x * cos(2 * pi * k / 3) + y * sin(2 * pi * k / 3) for k in range(3)]
    out = F.flatten(F.transform(freqs, lambda f: F.array(*(g(a * f) for a in along for g in (F.sin, F.cos)))))
    out = F.when(x.isNotNull() & y.isNotNull(), out)
    return ffn(out) if ffn else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def dense_layer(e: Column, weights: Sequence[Sequence[float]], bias: Sequence[float] | None = None, relu: bool = True) -> Column:
    """W e + b, cut at 0 with ``relu``; null for a null vector, a null element or another length.

    The weights are literals, for a few of them; ``operators.matrix`` has the layer of any width.
    """
    sums = [dot(F.array(*(F.lit(float(w)) for w in row)), e) for row in weights]
    out = [v + F.lit(float(bias[i]) if bias is not None else 0.0) for i, v in enumerate(sums)]
    return F.when(sums[0].isNotNull(), F.array(*(F.greatest(v, F.lit(0.0)) if relu else v for v in out)))


def relu(e: Column) -> Column:
    return F.transform(e, lambda v: F.greatest(v, F.lit(0.0)))


def hard_decision(score: Column, threshold: float = 0.5) -> Column:
    return (score > threshold).cast("int")


def bce_with_logits(score: Column, label: Column) -> Column:
    """Binary cross entropy of a raw score, without overflow."""
    return F.greatest(score, F.lit(0.0)) - score * label + F.log1p(F.exp(-F.abs(score)))


def one_hot(value: Column, vocabulary: Sequence[str] | Sequence[int]) -> Column:
    """1.0 at the place of the value, all zeros for null or unknown values."""
    return F.array(*(F.coalesce((value == F.lit(v)).cast("double"), F.lit(0.0)) for v in vocabulary))


def quantile_bin(value: Column, edges: Sequence[float]) -> Column:
    """Number of inner edges below the value: intervals are (left, right], the lowest included."""
    return F.when(value.isNotNull(), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value)))
