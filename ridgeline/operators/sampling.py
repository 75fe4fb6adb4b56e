"""Search samples, feature selection, and the search set that they make. Draws depend on the record and the seed, never on partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import drawn
from .binning import bin_of, every, stride_for
from .histogram import explained_variance
from .residuals import at_positions, kth

STRATA = 4


def stride(rows: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Every k-th record by position."""
    return every(rows, stride_for(rows.count(), target)).withColumn("weight", F.lit(1.0).cast("float"))


def uniform(rows: DataFrame, target: int, seed: int) -> DataFrame:
    p = min(1.0, target / max(1, rows.count()))
    return rows.where(drawn(F.col("record_id"), seed, p)).withColumn("weight", F.lit(1.0).cast("float"))


def strata_bounds(rows: DataFrame) -> list[tuple[float, int]]:
    """The (absolute residual, record_id) with which the second, third and fourth quarter of the rising order begin, at s * n div 4; records of equal residual are parted by their id."""
    n = rows.count()
    if n < STRATA:
        return []
    starts = {s: s * n // STRATA for s in range(1, STRATA)}
    values = at_positions(rows, {str(s): n - 1 - at for s, at in starts.items()})
    a = F.abs("residual")
    below = rows.agg(*[F.count_if(a < F.lit(values[str(s)]).cast("float")).alias(f"n{s}") for s in starts]).first()
    out = []
    for s, at in starts.items():
        ties = rows.where(a == F.lit(values[str(s)]).cast("float"))
        out.append((values[str(s)], kth(ties, "record_id", at - below[f"n{s}"])))
    return out


def with_stratum(rows: DataFrame, bounds: Sequence[tuple[float, int]]) -> DataFrame:
    """stratum: how many of the bounds a record reaches."""
    out, a = F.lit(0), F.abs("residual")
    for value, record in bounds:
        v = F.lit(value).cast("float")
        out = out + F.when((a > v) | ((a == v) & (F.col("record_id") >= record)), 1).otherwise(0)
    return rows.withColumn("stratum", out)


def stratified(rows: DataFrame, target: int, seed: int) -> DataFrame:
    """The same number expected of each quarter of the absolute residuals; weight is the inverse of the chance."""
    n = rows.count()
    marked = with_stratum(rows, strata_bounds(rows))
    per = max(1, -(-target // STRATA))
    share = F.lit(1.0)
    for s in range(STRATA):
        size = (s + 1) * n // STRATA - s * n // STRATA
        share = F.when(F.col("stratum") == s, F.lit(min(1.0, per / size) if size else 1.0)).otherwise(share)
    return marked.withColumn("share", share).where(drawn(F.col("record_id"), seed, F.col("share"))).withColumn("weight", (1 / F.col("share")).cast("float"))


def with_chance(rows: DataFrame, target: int) -> DataFrame:
    """chance: in proportion to the absolute residual, so that target records are expected."""
    a = F.abs("residual").cast("double") + 1e-6
    total = rows.agg(F.sum(a).alias("t")).first().t or 1.0
    return rows.withColumn("chance", F.least(F.lit(1.0), a / F.lit(total) * target))


def weighted(rows: DataFrame, target: int, seed: int) -> DataFrame:
    return with_chance(rows, target).where(drawn(F.col("record_id"), seed, F.col("chance"))).withColumn("weight", (1 / F.col("chance")).cast("float"))


SAMPLERS = {"stride": stride, "uniform": uniform, "stratified": stratified, "weighted": weighted}


def random_features(features: int, fraction: float, seed: int) -> list[int]:
    """A share of the features (one at least), drawn by the MD5 of number and seed."""
    n = max(1, min(features, -int(-features * fraction // 1)))
    return sorted(sorted(range(features), key=lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest())[:n])


def error_ranked(hist: DataFrame, keep: int) -> DataFrame:
    """feature of the most explained variance, as many as are kept; ties to the smaller number."""
    return explained_variance(hist).orderBy(F.desc("explained"), "feature").limit(keep).select("feature")


def search_set(rows: DataFrame, features: Sequence[str], listed: Sequence[Sequence[float]], *, sampler: str = "stride", target: int = 0, seed: int = 0, chosen: Sequence[int] | None = None) -> DataFrame:
    """record_id, residual, weight and the bins of the sampled records (all, for a target of 0): what a search reads. Rows that have bins keep them as they are (b0, b1, ..., or packed in one); others get b0, b1, ... Features that aren't chosen have bin 0 for all, so they never split; packed ones are left out by leaving out their edges."""
    sampled = SAMPLERS[sampler](rows, target, seed) if target else rows.withColumn("weight", F.lit(1.0).cast("float"))
    if "bins" in rows.columns:
        return sampled.select("record_id", "residual", "weight", "bins")
    able = set(range(len(features)) if chosen is None else chosen)
    if features and f"b{len(features) - 1}" in rows.columns:
        return sampled.select("record_id", "residual", "weight", *[(F.col(f"b{i}") if i in able else F.lit(0)).alias(f"b{i}") for i in range(len(features))])
    bins: list[Column] = [(bin_of(f, e) if i in able else F.lit(0)).alias(f"b{i}") for i, (f, e) in enumerate(zip(features, listed))]
    return sampled.select("record_id", "residual", "weight", *bins)


def raw_rows(corpus: DataFrame, searched: DataFrame) -> DataFrame:
    """The records of a search set with their raw values and its weights, in place of any weight of their own."""
    return corpus.drop("weight").join(searched.select("record_id", "weight"), "record_id")
