"""Value semantics: NaN goes left, thresholds are strict, data are FLOAT, sums are DOUBLE.

Spark holds NaN to be larger than any number, so every comparison with a threshold goes through gt(); a literal that
meets a FLOAT column is cast, as FLOAT with DOUBLE would be computed in DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def single(value: float) -> Column:
    """A FLOAT literal."""
    return F.lit(float(np.float32(value))).cast("float")


def single_sql(value: float) -> str:
    """The same as SQL text, in the shortest form that reads back as this float."""
    return f"CAST({np.float32(value)!s} AS FLOAT)"


def gt(x: Column, threshold: Column) -> Column:
    """x > threshold; NaN and null go left."""
    return F.coalesce(~F.isnan(x) & (x > threshold), F.lit(False))


def is_finite(x: Column) -> Column:
    return F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(F.lit(0.0).cast("float"))


def weighted_sum(terms: Sequence[tuple[Column, float]], threshold: float) -> Column:
    """Terms in order in FLOAT, then the negated threshold: the left side of an oblique condition."""
    total: Column | None = None
    for x, weight in terms:
        part = x * single(weight)
        total = part if total is None else total + part
    total = single(0.0) if total is None else total
    return total + single(-threshold)


ACTIVATIONS = {
    "IDENTITY": lambda v: v,
    "TANH": F.tanh,
    "LOGISTIC": lambda v: 1 / (1 + F.exp(-v)),
    "RELU": lambda v: F.greatest(v, F.lit(0.0)),
}
#: Activations over several inputs: the smallest or largest of them, or one of two sums by the sign of a third.
AGGREGATES = ("MINIMUM", "MAXIMUM", "IF")


def squash(name: str, x: Column) -> Column:
    """A neuron's activation of the sum of its inputs."""
    if name not in ACTIVATIONS:
        raise ValueError(f"no activation {name}")
    return ACTIVATIONS[name](x)


def unsquash(name: str, y: Column) -> Column:
    """What goes into an activation to get y; null where nothing does. Of an aggregate, y itself: its correction is measured at its output."""
    kinds = {
        "IDENTITY": lambda v: v,
        "TANH": lambda v: F.when(F.abs(v) < 1, 0.5 * F.log((1 + v) / (1 - v))),
        "LOGISTIC": lambda v: F.when((v > 0) & (v < 1), F.log(v / (1 - v))),
        "RELU": lambda v: F.when(v > 0, v),
    } | {k: (lambda v: v) for k in AGGREGATES}
    if name not in kinds:
        raise ValueError(f"no activation {name}")
    return kinds[name](y)


def if_kernel(condition: Column, positive: Column, negative: Column, bias: Column) -> Column:
    """One of two sums with a bias: the positive one if the condition is above 0; NaN and null take the negative one."""
    return F.when(gt(condition, F.lit(0.0)), positive + bias).otherwise(negative + bias)


#: Draws are numbers of so many bits.
DRAW_BITS = 52


def draw_number(key: Column, seed: int) -> Column:
    """A number below 2 ** DRAW_BITS that depends on the key and the seed only: the first digits of an MD5, so other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, DRAW_BITS // 4), 16, 10).cast("long")


def drawn(key: Column, seed: int, share: Column | float) -> Column:
    """A Bernoulli draw that depends on the key and the seed only, not on partitions or order."""
    share = F.lit(float(share)) if isinstance(share, (int, float)) else share
    return draw_number(key, seed) < share * float(1 << DRAW_BITS)
