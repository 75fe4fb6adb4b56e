"""Quantile bins: exact edges of a bounded stride sample, and bin numbers as expressions.

Edges come from value counts: equal values are one row before the window sees them, and the stride sample bounds how
many rows a feature has there. A stride counts records by position, not by key: keys may be sparse or have a pattern.
A bin number is a balanced CASE over the edges, which stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import is_finite, single_sql
from ..plans.store import written

#: Rows that edges are taken from, at most (the stride is rounded up).
SAMPLE_ROWS = 65_536


def stride_for(rows: int, target: int) -> int:
    return max(1, -(-rows // target)) if target else 1


#: Bits that a row's place in its range has in an id that grows with the rows.
PLACE_BITS = 33


def numbered(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """key, position: 0, 1, ... in the order of the keys, without a global sort. Keys alone are dealt to ranges (as many as Spark makes partitions, so a range doesn't grow with the corpus) and written with their places; what the ranges before hold is added."""
    placed = rows.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    held = written(placed, "keys").withColumn("_range", F.shiftrightunsigned("_at", PLACE_BITS))
    passed, before = 0, []
    for r in sorted(held.groupBy("_range").count().collect()):  # a row for each range
        before.append((r["_range"], passed))
        passed += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "_range long, _before long")
    return held.join(F.broadcast(offsets), "_range").select(key, (F.col("_before") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)).alias("position"))


def every(rows: DataFrame, k: int, phase: int = 0, order: Sequence[str] = ("record_id",), bounded: bool = False) -> DataFrame:
    """The rows whose position and phase add up to a multiple of k; all rows for k = 1, without counting. Positions are found on the first column of the order alone, and only rows of the keys that are hit are looked at: further columns of the order part rows that share one. bounded: the hits are few enough to be sent to every task."""
    if k <= 1:
        return rows
    if "position" in rows.columns:
        return rows.where((F.col("position") + phase) % k == 0)
    key, rest = order[0], list(order[1:]) or [order[0]]
    places = numbered(rows, key)
    hit = places.where((F.col("position") + phase) % k == 0).select(key).distinct()
    hit = F.broadcast(hit) if bounded else hit
    starts = places.join(hit, key, "left_semi").groupBy(key).agg(F.min("position").alias("_start"), F.count("*").alias("_n"))
    shared = starts.where("_n > 1").take(1)  # narrow rows; keys that records share are rare
    near = rows.join(F.broadcast(starts) if bounded else starts, key)
    if not shared:
        return near.select(*rows.columns)
    place = F.col("_start") + F.row_number().over(W.partitionBy(key).orderBy(*rest)) - 1
    return near.withColumn("_place", place).where((F.col("_place") + phase) % k == 0).select(*rows.columns)


def stride_sample(corpus: DataFrame, target: int = SAMPLE_ROWS, features: Sequence[str] = ()) -> DataFrame:
    """Every k-th record by position, target of them at most. Features break the ties of a key that some records share."""
    return every(corpus, stride_for(corpus.count(), target), order=["record_id", *features], bounded=target <= SAMPLE_ROWS)


def project(rows: DataFrame, features: Sequence[str], chosen: Sequence[int], keep: Sequence[str] = ("record_id",)) -> DataFrame:
    """The chosen features only, numbered anew from f0."""
    return rows.select(*keep, *[F.col(features[i]).alias(f"f{n}") for n, i in enumerate(chosen)])


def long_form(rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """feature (position), value and the kept columns: one row for each cell."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)])
    return rows.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.feature", "cell.value")


def value_counts(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, value, n of the finite values; -0.0 is 0.0."""
    cells = long_form(rows, features).where(is_finite(F.col("value")))
    return cells.groupBy("feature", (F.col("value") + F.lit(0.0).cast("float")).alias("value")).agg(F.count("*").alias("n"))


def edges_of(counts: DataFrame, bins: int, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """keys, bin, threshold: the values at positions b * n / bins of the sorted values, ties once, below the maximum.

    A run of equal values from position s to before e holds such a position if some b has s <= b * n div bins < e, which
    is a comparison of two rounded quotients: no position has to be listed.
    """
    order = W.partitionBy(*keys).orderBy("value")
    total = W.partitionBy(*keys)
    runs = counts.withColumn("e", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(total)).withColumn("top", F.max("value").over(total))
    up = lambda at: F.expr(f"({at} * {bins} + all - 1) div all")
    found = runs.where((F.greatest(F.lit(1), up("(e - n)")) <= F.least(F.lit(bins - 1), up("e") - 1)) & (F.col("value") < F.col("top")))
    return found.select(*keys, (F.row_number().over(order) - 1).alias("bin"), F.col("value").alias("threshold"))


#: Features whose edges one task works out at a time, and features beyond which that is done in numpy.
BLOCK_FEATURES, BLOCKS_FROM = 64, 32


def build_edges(corpus: DataFrame, features: Sequence[str], bins: int, target: int = SAMPLE_ROWS) -> DataFrame:
    """feature, bin, threshold: exact quantile edges of the stride sample. Many features go in blocks, so no row is ever made of each record and feature."""
    sample = stride_sample(corpus.select("record_id", *features), target, features if len(features) <= BLOCKS_FROM else ())
    return blocked_edges(sample.select(F.array(*features).alias("x")), len(features), bins) if len(features) > BLOCKS_FROM else edges_of(value_counts(sample, features), bins)


def blocked_edges(sample: DataFrame, width: int, bins: int) -> DataFrame:
    """The same of a bounded sample whose features are in an array x: batches are cut into blocks of features, column after column; the task of a block has the block's columns whole, and sorts each."""
    import numpy as np
    import pyarrow as pa

    def cut(parts):
        for part in parts:
            x = part.column(0)
            if len(x):
                cells = x.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)
                blocks = [np.ascontiguousarray(cells[:, at : at + BLOCK_FEATURES].T) for at in range(0, width, BLOCK_FEATURES)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "cells"])

    def edges(block: int, held: list):
        wide = min(BLOCK_FEATURES, width - block * BLOCK_FEATURES)
        columns = np.concatenate([np.frombuffer(h, np.float32).reshape(wide, -1) for h in held], axis=1)
        for i, column in enumerate(columns):
            own = np.sort(column[np.isfinite(column)] + np.float32(0.0))  # -0.0 is 0.0
            n = len(own)
            if n:
                found = np.unique(own[np.minimum(np.arange(1, bins) * n // bins, n - 1)])
                for b, t in enumerate(found[found < own[-1]].tolist()):
                    yield block * BLOCK_FEATURES + i, b, t

    def make(parts):
        now, held, out = None, [], []
        for part in parts:
            for block, cells in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if block != now:
                    out += edges(now, held) if held else []
                    now, held = block, []
                held.append(cells)
        out += edges(now, held) if held else []
        if out:
            f, b, t = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(b, pa.int32()), pa.array(t, pa.float32())], names=["feature", "bin", "threshold"])

    dealt = sample.mapInArrow(cut, "block int, cells binary").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(make, "feature int, bin int, threshold float")


def collect_edges(edges: DataFrame, features: int) -> list[list[float]]:
    """Edges by feature on the driver: at most bins - 1 for each."""
    out: list[list[float]] = [[] for _ in range(features)]
    for r in edges.orderBy("feature", "bin").collect():
        out[r.feature].append(r.threshold)
    return out


def bin_sql(name: str, edges: Sequence[float]) -> str:
    """How many edges lie below the value, NaN and null in bin 0, as a balanced CASE."""

    def part(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN {name} > {single_sql(edges[mid])} THEN {part(mid + 1, high)} ELSE {part(low, mid)} END"

    return f"CASE WHEN {name} IS NULL OR isnan({name}) THEN 0 ELSE {part(0, len(edges))} END"


def bin_of(name: str, edges: Sequence[float]) -> Column:
    return F.expr(bin_sql(name, edges)).cast("int")


def bin_rows(corpus: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]], keep: Sequence[str] = ("record_id", "residual")) -> DataFrame:
    """The kept columns and b0.., the bins of the features."""
    return corpus.select(*keep, *[bin_of(f, e).alias(f"b{i}") for i, (f, e) in enumerate(zip(features, edges))])


def effective_bins(edges: DataFrame) -> DataFrame:
    """feature, effective_bins: one more than its edges."""
    return edges.groupBy("feature").agg((F.count("*") + 1).alias("effective_bins"))


def occupancy(binned: DataFrame, feature: int) -> DataFrame:
    """bin, records of one feature."""
    return binned.groupBy(F.col(f"b{feature}").alias("bin")).agg(F.count("*").alias("records"))


def feature_scale(edges: DataFrame) -> DataFrame:
    """feature, scale: the edges' interquartile distance; 1 with fewer than four edges or none that is positive."""
    listed = edges.groupBy("feature").agg(F.array_sort(F.collect_list("threshold")).alias("e"))
    n = F.size("e")
    span = F.get("e", F.expr("3 * size(e) div 4").cast("int")) - F.get("e", F.expr("size(e) div 4").cast("int"))
    return listed.select("feature", F.when((n >= 4) & (span > 0) & is_finite(span), span).otherwise(F.lit(1.0).cast("float")).alias("scale"))
