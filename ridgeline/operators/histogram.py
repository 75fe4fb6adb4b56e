"""Residual histograms and the search for stumps.

A histogram is a hash aggregate: partial sums on the map side shrink any corpus to features x bins rows before the
shuffle. The search runs on that small table: dense bins, prefix sums by feature, three kinds of stump, rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["left-only", "right-only", "two-leaf"]


@dataclass(frozen=True)
class Controls:
    min_leaf: float = 50.0
    max_correction: float = 100.0
    min_gain: float = 0.0
    top_k: int = 16
    max_per_feature: int = 0
    kinds: tuple[str, ...] = tuple(KINDS)


def histogram(binned: DataFrame, features: int, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """keys, feature, bin, n, s, q: weights, weighted residuals and their squares, in DOUBLE. Rows have a column for each feature's bin, or all in one (packed), then without keys."""
    if "bins" in binned.columns and not keys:
        return packed_histogram(binned, features, weight=weight)
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"b{i}").alias("bin")) for i in range(features)])
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    r = F.col("residual").cast("double")
    rows = binned.select(*keys, w.alias("w"), (w * r).alias("wr"), (w * r * r).alias("wrr"), F.explode(cells).alias("cell"))
    return rows.groupBy(*keys, F.col("cell.feature").alias("feature"), F.col("cell.bin").alias("bin")).agg(F.sum("w").alias("n"), F.sum("wr").alias("s"), F.sum("wrr").alias("q"))


#: Bins that a byte can number.
BYTE = 256


def pack_bins(rows: DataFrame, edges: Sequence[Sequence[float]], keep: Sequence[str] = ("record_id", "residual")) -> DataFrame:
    """The kept columns and bins: one byte for each feature of the array x, in one binary. The form for hundreds of features, as Spark reads and hands on one column instead of hundreds; a feature has at most 255 edges."""
    import numpy as np
    import pyarrow as pa

    if max(map(len, edges), default=0) >= BYTE:
        raise ValueError("a packed feature has at most 255 edges")
    bounds, n = [np.array(e, dtype=np.float32) for e in edges], len(keep)

    def make(parts):
        for part in parts:
            x = cells_of(part.column(n), len(bounds)).astype(np.float32, copy=False)
            bins = np.empty(x.shape, dtype=np.uint8)
            for i, e in enumerate(bounds):
                bins[:, i] = np.where(np.isnan(x[:, i]), 0, np.searchsorted(e, x[:, i], side="left"))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array([r.tobytes() for r in bins], pa.binary())], names=[*keep, "bins"])

    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("bins", T.BinaryType())])
    return rows.select(*keep, "x").mapInArrow(make, schema)


def cells_of(column, width: int):
    """A column of arrays or binaries as records x features; an error for one of another width."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    packed = pa.types.is_binary(column.type)
    lengths = (pc.binary_length if packed else pc.list_value_length)(column)
    if lengths.null_count or (lengths.to_numpy() != width).any():
        raise ValueError(f"a record isn't {width} wide")
    if not packed:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset] if len(column) else 0
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if len(column) and width else np.zeros(0, dtype=np.uint8)
    return data[start : start + len(column) * width].reshape(-1, width)


def packed_histogram(rows: DataFrame, features: int, leaves: Sequence[tuple[int, Sequence]] | None = None, weight: str | None = None) -> DataFrame:
    """(leaf,) feature, bin, n, s, q of packed rows: each task adds up a table of features x bins for each leaf in numpy, and a row for each feature of it is sent. leaves: (number, path) of those to sum up."""
    import numpy as np
    import pyarrow as pa

    paths = [(0, ())] if leaves is None else list(leaves)
    schema = pa.schema([("leaf", pa.int32()), ("feature", pa.int32()), ("sums", pa.binary())])

    def partial(parts):
        sums = {k: np.zeros((features, 3, BYTE)) for k, _ in paths}
        for part in parts:
            if not part.num_rows:
                continue
            bins = cells_of(part.column(0), features)
            r, w = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for k, path in paths:
                own = np.ones(len(bins), dtype=bool)
                for feature, bin_, _, right in path:
                    own &= (bins[:, feature] > bin_) == right
                some, rs, ws = (bins, r, w) if not path else (bins[own], r[own], w[own])
                for at in range(0, len(some), 1 << 13):
                    v, u = rs[at : at + (1 << 13)], ws[at : at + (1 << 13)]
                    even, uv = bool((u == 1.0).all()), u * v
                    uvv = uv * v
                    for table, cells in zip(sums[k], np.ascontiguousarray(some[at : at + (1 << 13)].T)):  # a feature's bins lie together
                        cells = cells.astype(np.intp)
                        table[0] += np.bincount(cells, None if even else u, BYTE)
                        table[1] += np.bincount(cells, uv, BYTE)
                        table[2] += np.bincount(cells, uvv, BYTE)
        for k, held in sums.items():
            filled = [np.flatnonzero(t[0]) for t in held]  # what is sent of a feature: its filled bins and their sums
            if any(map(len, filled)):
                packed = [f.astype(np.uint8).tobytes() + t[:, f].tobytes() for f, t in zip(filled, held)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(features, k, dtype=np.int32)), pa.array(np.arange(features, dtype=np.int32)), pa.array(packed, pa.binary())], schema=schema)

    def merged(parts):
        held: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            for k, feature, sums in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                sums = sums.as_py()
                n = len(sums) // 25  # a byte and three sums for each filled bin
                table = held.setdefault((k, feature), np.zeros((3, BYTE)))
                table[:, np.frombuffer(sums, np.uint8, n)] += np.frombuffer(sums[n:]).reshape(3, n)
        for (k, feature), sums in held.items():
            bins = np.flatnonzero(sums[0])
            columns = [np.full(len(bins), k, dtype=np.int32), np.full(len(bins), feature, dtype=np.int32), bins.astype(np.int32), *sums[:, bins]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["leaf", "feature", "bin", "n", "s", "q"])

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sent = rows.select("bins", F.col("residual").cast("double").alias("r"), w.alias("w")).mapInArrow(partial, "leaf int, feature int, sums binary")
    made = sent.repartition("leaf", "feature").mapInArrow(merged, "leaf int, feature int, bin int, n double, s double, q double")
    return made.drop("leaf") if leaves is None else made


def wide_histogram(rows: DataFrame, edges: Sequence[Sequence[float]]) -> DataFrame:
    """The same for hundreds of features in an array x: Arrow batches binned and summed in numpy, one partial table a task. A record whose array is null or of another width is an error."""
    import numpy as np
    import pyarrow as pa

    bounds = [np.array(e, dtype=np.float32) for e in edges]
    width, most = len(bounds), max((len(e) for e in edges), default=0) + 1

    def partial(parts):
        sums = np.zeros((3, width * most))
        offsets = np.arange(width)[:, None] * most
        for part in parts:
            if not part.num_rows:
                continue
            x = np.ascontiguousarray(cells_of(part.column(0), width).astype(np.float32, copy=False).T)
            r = part.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            bins = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(bounds, x)])
            bins[np.isnan(x)] = 0
            cells = (bins + offsets).ravel()
            for k, w in enumerate((None, r, r * r)):
                sums[k] += np.bincount(cells, weights=None if w is None else np.tile(w, width), minlength=width * most)
        held = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array((held // most).astype(np.int32)), pa.array((held % most).astype(np.int32)), *(pa.array(s[held]) for s in sums)], names=["feature", "bin", "n", "s", "q"])

    fitting = rows.select("x", "residual")
    made = fitting.mapInArrow(partial, "feature int, bin int, n double, s double, q double")
    return made.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def merge(*parts: DataFrame) -> DataFrame:
    """Histograms add up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("feature", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def subtract(parent: DataFrame, child: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sibling's histogram (of each key); counts and squares stay at 0 or above."""
    c = child.select(*keys, "feature", "bin", F.col("n").alias("cn"), F.col("s").alias("cs"), F.col("q").alias("cq"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    return parent.join(c, [*keys, "feature", "bin"], "left").select(
        *keys, "feature", "bin", F.greatest(F.col("n") - zero("cn"), F.lit(0.0)).alias("n"), (F.col("s") - zero("cs")).alias("s"), F.greatest(F.col("q") - zero("cq"), F.lit(0.0)).alias("q")
    )


def prefix_scan(hist: DataFrame, edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, bin, threshold, nl, sl, nr, sr for every threshold, also after an empty bin."""
    group = [*keys, "feature"]
    totals = hist.groupBy(*group).agg(F.sum("n").alias("nt"), F.sum("s").alias("st"))
    dense = totals.join(edges, "feature").join(hist.select(*group, "bin", "n", "s"), [*group, "bin"], "left").fillna(0.0, ["n", "s"])
    left = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    scan = dense.withColumn("nl", F.sum("n").over(left)).withColumn("sl", F.sum("s").over(left))
    return scan.select(*group, "bin", "threshold", "nl", "sl", (F.col("nt") - F.col("nl")).alias("nr"), (F.col("st") - F.col("sl")).alias("sr"))


def with_threshold(hist: DataFrame, edges: DataFrame) -> DataFrame:
    """feature, bin, threshold, n of the bins that end at an edge: all but each feature's last."""
    return hist.join(edges, ["feature", "bin"]).select("feature", "bin", "threshold", "n")


def leaf_means(sums: DataFrame, most: float) -> DataFrame:
    """leaf, correction: the clamped mean of each leaf's residuals, from its sums n and s."""
    return sums.select("leaf", clamped(F.col("s"), F.col("n"), most).alias("correction"))


def clamped(s: Column, n: Column, most: float) -> Column:
    return F.when(n > 0, F.greatest(F.least(s / n, F.lit(most)), F.lit(-most))).otherwise(0.0)


def gain(c: Column, s: Column, n: Column) -> Column:
    """Squared error saved by the correction c."""
    return 2 * c * s - n * c * c


def split_kinds(scan: DataFrame, controls: Controls) -> DataFrame:
    """A row for each threshold and kind that passes the controls."""
    sides = scan.where("nl > 0 AND nr > 0").withColumn("cl", clamped(F.col("sl"), F.col("nl"), controls.max_correction)).withColumn("cr", clamped(F.col("sr"), F.col("nr"), controls.max_correction))
    sides = sides.withColumn("gl", gain(F.col("cl"), F.col("sl"), F.col("nl"))).withColumn("gr", gain(F.col("cr"), F.col("sr"), F.col("nr")))
    zero = F.lit(0.0)

    def kind(name: str) -> Column:
        left, right = name != "right-only", name != "left-only"
        pick = lambda on, c: F.col(c) if on else zero
        ok = (F.col("nl") >= controls.min_leaf if left else F.lit(True)) & (F.col("nr") >= controls.min_leaf if right else F.lit(True))
        return F.struct(
            F.lit(KINDS.index(name)).alias("kind_no"),
            F.lit(name).alias("kind"),
            pick(left, "cl").cast("float").alias("left_correction"),
            pick(right, "cr").cast("float").alias("right_correction"),
            (pick(left, "gl") + pick(right, "gr")).alias("gain"),
            (pick(left, "nl") + pick(right, "nr")).alias("affected_records"),
            ok.alias("ok"),
        )

    out = sides.withColumn("k", F.explode(F.array(*[kind(k) for k in controls.kinds])))
    keys = [c for c in scan.columns if c not in ("bin", "threshold", "nl", "sl", "nr", "sr", "feature")]
    found = out.select(*keys, "feature", "bin", "threshold", "k.*", F.col("nl").alias("left_records"), F.col("nr").alias("right_records"))
    return found.where(F.col("ok") & (F.abs("gain") < float("inf")) & (F.col("gain") >= controls.min_gain) & (F.col("gain") > 0)).drop("ok")


def rank_keys() -> list[Column]:
    return [F.desc("gain"), F.asc("feature"), F.asc("bin"), F.asc("kind_no")]


def search_stumps(hist: DataFrame, edges: DataFrame, controls: Controls = Controls()) -> DataFrame:
    """The top_k stumps: gain falling, then feature, bin and kind."""
    found = split_kinds(prefix_scan(hist, edges), controls)
    if controls.max_per_feature:
        own = W.partitionBy("feature").orderBy(*rank_keys())
        found = found.withColumn("place", F.row_number().over(own)).where(F.col("place") <= controls.max_per_feature).drop("place")
    return found.orderBy(*rank_keys()).limit(controls.top_k)


def best_by_leaf(hist: DataFrame, edges: DataFrame, controls: Controls) -> DataFrame:
    """The best two-leaf split of each leaf: one row for each."""
    found = split_kinds(prefix_scan(hist, edges, ["leaf"]), Controls(controls.min_leaf, controls.max_correction, controls.min_gain, kinds=("two-leaf",)))
    return found.withColumn("place", F.row_number().over(W.partitionBy("leaf").orderBy(*rank_keys()))).where("place = 1").drop("place")


def splits_at(hist: DataFrame, edges: DataFrame, controls: Controls, places: Sequence[tuple[int, int]]) -> DataFrame:
    """The two-leaf splits of each leaf at given (feature, bin), as far as they pass the controls."""
    found = split_kinds(prefix_scan(hist, edges, ["leaf"]), Controls(controls.min_leaf, controls.max_correction, controls.min_gain, kinds=("two-leaf",)))
    return found.where(F.struct("feature", "bin").isin([F.struct(F.lit(f).alias("feature"), F.lit(b).alias("bin")) for f, b in places]))


def explained_variance(hist: DataFrame) -> DataFrame:
    """feature, explained: variance between bins."""
    means = hist.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return hist.join(means, "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("mean"), 2)).alias("explained"))
