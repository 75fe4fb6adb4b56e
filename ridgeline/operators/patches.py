"""Correction trees: small nested conditions that compile to one column, and their folds.

A node is {"correction": c} or {"terms": [(feature, weight), ...], "threshold": t, "left": node, "right": node};
a condition holds (right) if the terms' sum in FLOAT exceeds the threshold, NaN goes left.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import gt, single, weighted_sum


def leaf(correction: float) -> dict:
    return {"correction": correction}


def split(feature: int, threshold: float, left: dict, right: dict) -> dict:
    return {"terms": [(feature, 1.0)], "threshold": threshold, "left": left, "right": right}


def oblique(terms: Sequence[tuple[int, float]], threshold: float, left: dict, right: dict) -> dict:
    return {"terms": list(terms), "threshold": threshold, "left": left, "right": right}


def stump_of(row) -> dict:
    """A row of search_stumps as a node."""
    return split(row.feature, row.threshold, leaf(row.left_correction), leaf(row.right_correction))


def condition(node: dict, feature: Callable[[int], Column]) -> Column:
    terms = node["terms"]
    if len(terms) == 1 and terms[0][1] == 1.0:
        return gt(feature(terms[0][0]), single(node["threshold"]))
    return gt(weighted_sum([(F.coalesce(feature(i), single(0.0)), w) for i, w in terms], node["threshold"]), single(0.0))


def value_of(node: dict, feature: Callable[[int], Column] | None = None) -> Column:
    """The correction of a record, as one FLOAT column; features are f0, f1, ... unless given."""
    feature = feature or (lambda i: F.col(f"f{i}"))
    if "correction" in node:
        return single(node["correction"])
    return F.when(condition(node, feature), value_of(node["right"], feature)).otherwise(value_of(node["left"], feature))


def bin_column(i: int, packed: bool = False) -> Column:
    """The bin of a feature: its own column, or a byte of all features' binary."""
    return F.conv(F.hex(F.substring("bins", i + 1, 1)), 16, 10).cast("int") if packed else F.col(f"b{i}")


def value_on_bins(node: dict, edges: Sequence[Sequence[float]], packed: bool = False) -> Column | None:
    """The same from bins b0, b1, ... (or packed ones); None if a threshold is no edge or a split is oblique."""
    if "correction" in node:
        return single(node["correction"])
    if len(node["terms"]) != 1 or node["terms"][0][1] != 1.0:
        return None
    i = node["terms"][0][0]
    if node["threshold"] not in edges[i]:
        return None
    left, right = value_on_bins(node["left"], edges, packed), value_on_bins(node["right"], edges, packed)
    if left is None or right is None:
        return None
    return F.when(bin_column(i, packed) > edges[i].index(node["threshold"]), right).otherwise(left)


def values(node: dict, inputs: dict, n: int):
    """The correction of n records in numpy, inputs f0, f1, ... given as arrays: as a merged neuron computes it, in DOUBLE, NaN to the left."""
    import numpy as np

    if "correction" in node:
        return np.full(n, float(node["correction"]))
    total = sum((inputs[f"f{i}"] * float(w) for i, w in node["terms"]), np.zeros(n)) - float(node["threshold"])
    return np.where(total > 0, values(node["right"], inputs, n), values(node["left"], inputs, n))


def apply(rows: DataFrame, node: dict, value: Column | None = None) -> DataFrame:
    """Residuals after the correction, in FLOAT."""
    return rows.withColumn("residual", F.col("residual") - (value_of(node) if value is None else value))


def nodes(node: dict) -> Iterator[dict]:
    yield node
    if "terms" in node:
        yield from nodes(node["left"])
        yield from nodes(node["right"])


def depth(node: dict) -> int:
    return 0 if "correction" in node else 1 + max(depth(node["left"]), depth(node["right"]))


def splits(node: dict) -> int:
    return sum("terms" in n for n in nodes(node))


def largest(node: dict) -> float:
    return max(abs(n["correction"]) for n in nodes(node) if "correction" in n)


def zero_leaves(node: dict) -> int:
    return sum(n.get("correction") == 0 for n in nodes(node))


def features(node: dict) -> list[int]:
    return sorted({i for n in nodes(node) for i, _ in n.get("terms", ())})


def scaled(node: dict, by: float) -> dict:
    if "correction" in node:
        return leaf(node["correction"] * by)
    return node | {"left": scaled(node["left"], by), "right": scaled(node["right"], by)}


def scaled_gain(gain: float, by: float) -> float:
    """What of a gain a scaled correction keeps."""
    return gain * (2 * by - by * by) if by >= 0 else -abs(gain)


def scaled_gain_column(gain: Column, by: Column) -> Column:
    """The same over columns."""
    return F.when(by >= 0, gain * (2 * by - by * by)).otherwise(-F.abs(gain))


def patch_id(node: dict, output: int = 0) -> str:
    """Content id: 16 hexadecimal digits of the canonical JSON's SHA-256."""
    return hashlib.sha256(json.dumps([output, node], sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def combo_id(ids: Sequence[str]) -> str:
    return hashlib.sha256("+".join(ids).encode()).hexdigest()[:16]


def combo_id_column(ids: Column) -> Column:
    """The same of a column of arrays."""
    return F.substring(F.sha2(F.array_join(ids, "+"), 256), 1, 16)


def feature_union(features: Column) -> Column:
    """The distinct features of several patches (an array of arrays), ascending."""
    return F.array_sort(F.array_distinct(F.flatten(features)))


def folds(rows: DataFrame, key: str, tree: str) -> DataFrame:
    """key, id, depth, splits, zero_leaves, largest, features of the patches that a column has as JSON."""
    import pyarrow as pa

    about = [("id", pa.string()), ("depth", pa.int32()), ("splits", pa.int32()), ("zero_leaves", pa.int32()), ("largest", pa.float64()), ("features", pa.list_(pa.int32()))]

    def make(parts):
        for part in parts:
            found = [json.loads(t) for t in part.column(1).to_pylist()]
            made = [(patch_id(n), depth(n), splits(n), zero_leaves(n), largest(n), features(n)) for n in found]
            columns = zip(*made) if made else [()] * len(about)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, about))], names=[key, *(n for n, _ in about)])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, tree).mapInArrow(make, f"`{key}` {kind}, id string, depth int, splits int, zero_leaves int, largest double, features array<int>")
