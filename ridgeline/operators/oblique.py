"""Splits along a line through several features.

The best threshold of a projection is found by bounds: sums of cells of its range say what any split within a cell can
gain at most, and only cells that may hold the best are cut further. All projections of a search are evaluated together.

Where every threshold is wanted (running_sums), records are summed by projected value, so equal values are one row. Values
can be as many as records, so the running sum is taken in ranges: sums within a range, plus what the ranges before it
hold. Ranges are cut at approximate quantiles and no range is larger than its share.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import single, weighted_sum
from .binning import bin_of
from .histogram import Controls

RANGES = 64
#: Lines of one evaluation: more would outgrow generated code.
TOGETHER = 64


def project(corpus: DataFrame, terms: Sequence[tuple[int, float]]) -> DataFrame:
    """value (FLOAT) and residual of each record; a missing feature reads as 0."""
    parts = [(F.coalesce(F.col(f"f{i}"), single(0.0)), w) for i, w in terms]
    return corpus.select(weighted_sum(parts, 0.0).alias("value"), "residual")


def running_sums(projected: DataFrame, ranges: int = RANGES) -> DataFrame:
    """value, nl, sl (sums up to the value), nr, sr."""
    values = projected.groupBy("value").agg(F.count("*").cast("double").alias("n"), F.sum("residual").alias("s"))
    bounds = values.select(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first().q or []
    ranged = values.withColumn("range", bin_of("value", sorted(set(bounds))))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("rn"), F.sum("s").alias("rs"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("rn").over(before), F.lit(0.0)).alias("n0"), F.coalesce(F.sum("rs").over(before), F.lit(0.0)).alias("s0"), F.sum("rn").over(W.partitionBy(F.lit(1))).alias("nt"), F.sum("rs").over(W.partitionBy(F.lit(1))).alias("st"))
    within = W.partitionBy("range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    scan = ranged.join(F.broadcast(offsets), "range").withColumn("nl", F.col("n0") + F.sum("n").over(within)).withColumn("sl", F.col("s0") + F.sum("s").over(within))
    return scan.select("value", "nl", "sl", (F.col("nt") - F.col("nl")).alias("nr"), (F.col("st") - F.col("sl")).alias("sr"))


#: Groups that a round of a search sums up, at most; bits of a value's place, beyond which values are groups of their own.
GROUPS, PLACE_BITS = 1 << 16, 44
#: Gains that differ by this share are equal: sums of residuals differ so with the order that they are added in.
SAME = 1e-9


@dataclass
class Line:
    """A projection while its best threshold is looked for: totals, the range of its finite values, the cells that may hold the best (number: sums before it), and the best so far."""

    nt: float
    st: float
    low: float
    high: float
    cells: dict
    best: tuple | None = None

    def side(self, s: float, n: float, most: float) -> tuple[float, float]:
        """(correction, gain) of a side of sums s and n."""
        c = max(-most, min(most, s / n))
        return c, 2 * c * s - n * c * c

    def tried(self, value: float, n: float, s: float, controls: Controls) -> None:
        """The split behind a value, if it is allowed and better: ties go to the smaller value."""
        right = self.nt - n
        if n < controls.min_leaf or right < controls.min_leaf or n <= 0 or right <= 0:
            return
        (cl, gl), (cr, gr) = self.side(s, n, controls.max_correction), self.side(self.st - s, right, controls.max_correction)
        if gl + gr > 0 and (self.best is None or (gl + gr, -value) > (self.best[0], -self.best[1])):
            self.best = gl + gr, value, cl, cr, n, right

    def bound(self, n0: float, s0: float, n: float, up: float, down: float, controls: Controls) -> float:
        """No split within a cell of n, whose residuals above and below 0 sum up to `up` and `down`, gains more: a side gains the more, the larger its sum and the smaller its number."""
        if n0 + n < controls.min_leaf or self.nt - n0 < controls.min_leaf:
            return 0.0
        gain = lambda s, least: self.side(s, max(least, controls.min_leaf, 1e-9), controls.max_correction)[1]
        left = max(abs(s0 + up), abs(s0 + down))
        right = max(abs(self.st - s0 - up), abs(self.st - s0 - down))
        return gain(left, n0) + gain(right, self.nt - n0 - n)


def best_thresholds(corpus: DataFrame, lines: Sequence[Sequence[tuple[int, float]]], controls: Controls, one: bool = False, groups: int = GROUPS) -> DataFrame:
    """line (its number), threshold, gain, ...: for each projection that has one the two-leaf split of the largest gain; one: of all of them the best only, the first of equal ones.

    Each round sums up the records of cells of a projection's range, and what the sums of a cell allow bounds the gain of
    any split within: cells that can't hold the best are left, the others are cut further, down to single values. So
    what is shuffled and what comes to the driver are sums of `groups` cells at most for a round, however many
    records there are. A projected NaN goes left, as it does when a patch is applied.
    """
    spark = corpus.sparkSession
    value = lambda terms: weighted_sum([(F.coalesce(F.col(f"f{i}"), single(0.0)), w) for i, w in terms], 0.0)
    every = F.array(*[F.struct(F.lit(n).alias("line"), value(terms).alias("value")) for n, terms in enumerate(lines)])
    w = F.col("weight").cast("double") if "weight" in corpus.columns else F.lit(1.0)
    rows = corpus.select(w.alias("w"), (w * F.col("residual").cast("double")).alias("wr"), F.explode(every).alias("c")).select("w", "wr", "c.line", F.col("c.value").cast("double").alias("v"))
    finite, zero = F.abs("v") < float("inf"), F.lit(0.0)
    low = F.isnan("v") | (F.col("v") == float("-inf"))
    about = rows.groupBy("line").agg(F.sum("w").alias("nt"), F.sum("wr").alias("st"), F.sum(F.when(low, F.col("w")).otherwise(zero)).alias("n0"), F.sum(F.when(low, F.col("wr")).otherwise(zero)).alias("s0"), F.min(F.when(finite, F.col("v"))).alias("low"), F.max(F.when(finite, F.col("v"))).alias("high"), F.sum(F.when(finite, F.col("w"))).alias("nf"), F.sum(F.when(finite, F.col("wr"))).alias("sf"))
    state = {}
    for r in about.collect():  # a row for each line
        if r.low is not None:
            state[r.line] = x = Line(r.nt, r.st, r.low, r.high, {0: (r.n0, r.s0)} if r.low < r.high else {})
            if r.low == r.high:
                x.tried(r.high, r.n0 + r.nf, r.s0 + r.sf, controls)
    bits = 0
    while any(x.cells for x in state.values()):
        open_cells = [(i, c) for i, x in state.items() for c in x.cells]
        step = max(1, min(8, (groups // len(open_cells)).bit_length() - 1))
        exact = bits + step > PLACE_BITS
        ranges = spark.createDataFrame([(i, x.low, x.high - x.low) for i, x in state.items() if x.cells], "line int, low double, span double")
        placed = rows.where(finite).join(F.broadcast(ranges), "line").withColumn("at", (F.col("v") - F.col("low")) / F.col("span"))
        cell = lambda b: F.least(F.floor(F.col("at") * float(1 << b)), F.lit((1 << b) - 1))
        if bits:
            wanted = spark.createDataFrame(open_cells, "line int, cell long")
            placed = placed.withColumn("cell", cell(bits)).join(F.broadcast(wanted), ["line", "cell"], "left_semi")  # as many rows as groups at most
        keys = ["line", cell(bits).alias("cell"), F.col("v").alias("part") if exact else cell(bits + step).cast("double").alias("part")]
        sums = placed.groupBy(*keys).agg(F.sum("w").alias("n"), F.sum("wr").alias("s"), F.sum(F.greatest("wr", zero)).alias("up"), F.sum(F.least("wr", zero)).alias("down"), F.min("v").alias("first"), F.max("v").alias("last"))
        found: dict[int, list] = {}
        for r in sorted(sums.collect(), key=lambda r: (r.line, r.cell, r.part)):
            found.setdefault(r.line, []).append(r)
        further: dict[int, list] = {i: [] for i in state}
        for i, own in found.items():
            x, now = state[i], None
            for r in own:
                if r.cell != now:
                    now, (n, s) = r.cell, x.cells[r.cell]
                if r.first < r.last:
                    further[i].append((x.bound(n, s, r.n, r.up, r.down, controls), int(r.part), n, s))
                n, s = n + r.n, s + r.s
                x.tried(r.last, n, s, controls)
        most = max((x.best[0] for x in state.values() if x.best), default=0.0)
        for i, x in state.items():
            least = most * (1 - SAME) if one else x.best[0] if x.best else 0.0
            x.cells = {part: (n, s) for bound, part, n, s in further[i] if bound > 0 and bound >= least}
        bits += step
    best = [(i, x.best) for i, x in state.items() if x.best]
    if one and best:
        most = max(b[0] for _, b in best)
        best = [min((i, b) for i, b in best if b[0] >= most * (1 - SAME))]
    found = [(i, b[1], b[0], b[2], b[3], b[4], b[5]) for i, b in best]
    return spark.createDataFrame(found, "line int, threshold float, gain double, left_correction float, right_correction float, left_records double, right_records double")


def best_threshold(corpus: DataFrame, terms: Sequence[tuple[int, float]], controls: Controls) -> DataFrame:
    """One row: the same of one projection."""
    return best_thresholds(corpus, [terms], controls).drop("line")


def combinations(scales: Sequence[float], seed_feature: int, count: int, seed: int) -> list[list[tuple[int, float]]]:
    """The feature that a search starts from with each partner at half its scale, both signs, and so many random combinations of two or three features."""
    out = [[(seed_feature, 1 / scales[seed_feature]), (j, sign * 0.5 / scales[j])] for j in range(len(scales)) if j != seed_feature for sign in (1, -1)]
    rng = random.Random(seed)
    for _ in range(count if len(scales) > 1 else 0):
        chosen = rng.sample(range(len(scales)), rng.randint(2, min(3, len(scales))))
        out.append([(i, rng.uniform(-1, 1) / scales[i]) for i in chosen])
    return out


def search(corpus: DataFrame, scales: Sequence[float], controls: Controls, seed_feature: int, rounds: int = 2, random_lines: int = 0, seed: int = 0) -> tuple[list[tuple[int, float]], object]:
    """Start from the best of the combinations, then change one weight by a fifth while it helps: all changes of a round in one evaluation. Give it a sample (a search set's raw rows), as each record is expanded to every line."""

    def best_of(lines):
        best = ([], None)
        for at in range(0, len(lines), TOGETHER):
            found = best_thresholds(corpus, lines[at : at + TOGETHER], controls, True).first()
            if found and (best[1] is None or found.gain > best[1].gain * (1 + SAME)):
                best = lines[at + found.line], found
        return best

    terms, best = best_of(combinations(scales, seed_feature, random_lines, seed))
    for _ in range(rounds if best else 0):
        changed = [[(i, w * factor if j == k else w) for j, (i, w) in enumerate(terms)] for k in range(len(terms)) for factor in (0.8, 1.25)]
        other, found = best_of(changed)
        if not found or found.gain <= best.gain * (1 + SAME):
            break
        terms, best = other, found
    return terms, best
