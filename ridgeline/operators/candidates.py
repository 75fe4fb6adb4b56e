"""From discoveries to candidates: scaled, one-sided and shifted variants, random stumps, and stacks of several.

A candidate's strategy says how it was found; that of a stack of k is combo/<k>:<strategy of its first>.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patches
from .histogram import KINDS

SCALES = (0.5, 1.5)


@dataclass(frozen=True)
class Candidate:
    id: str
    strategy: str
    parts: tuple
    gain: float


def expand(stumps: DataFrame, edges: DataFrame, scales: Sequence[float] = SCALES, jitter: int = 1) -> DataFrame:
    """Stumps (place, feature, bin, threshold, left_correction, right_correction, gain) and their variants, in this order: as found, scaled, one side only, threshold moved to a neighbouring edge (whose gain isn't known)."""
    base = ["place", "feature", "bin", "threshold", "left_correction", "right_correction", "gain"]
    found = stumps.select(*base)

    def variant(df, phase, step, strategy, **changes):
        out = df.withColumn("phase", F.lit(phase)).withColumn("step", F.lit(step)).withColumn("strategy", F.lit(strategy))
        for name, value in changes.items():
            out = out.withColumn(name, value)
        return out.select("phase", "step", "place", "strategy", *base[1:])

    parts = [variant(found, 1, 0, "stump")]
    for i, scale in enumerate(s for s in scales if s != 1.0):
        by = F.lit(float(np.float32(scale))).cast("float")
        kept = patches.scaled_gain_column(F.col("gain"), F.lit(float(scale)))
        parts.append(variant(found, 2, i, "stump/scale", left_correction=F.col("left_correction") * by, right_correction=F.col("right_correction") * by, gain=kept))
    two = found.where("left_correction <> 0 AND right_correction <> 0")
    zero = F.lit(0.0).cast("float")
    parts.append(variant(two, 3, 0, "stump/one-sided", left_correction=zero))
    parts.append(variant(two, 3, 1, "stump/one-sided", right_correction=zero))
    moves = [m for j in range(1, jitter + 1) for m in (-j, j)]
    for i, move in enumerate(moves):
        near = edges.select("feature", (F.col("bin") - move).alias("bin"), F.col("threshold").alias("moved"))
        parts.append(variant(found.join(near, ["feature", "bin"]), 4, i, "stump/shifted", threshold=F.col("moved"), bin=F.col("bin") + move, gain=F.lit(0.0)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nonzero(stumps: DataFrame) -> DataFrame:
    """Those that correct something."""
    return stumps.where(F.greatest(F.abs("left_correction"), F.abs("right_correction")) > 0)


def distinct_ids(rows: DataFrame) -> DataFrame:
    """id and first_position of each patch that is named, however often."""
    return rows.groupBy("id").agg(F.min("position").alias("first_position"))


def of_nodes(found: Sequence[tuple[dict, str, float]]) -> list[Candidate]:
    """Candidates of (tree, strategy, gain)."""
    return [Candidate(patches.patch_id(node), strategy, (node,), gain) for node, strategy, gain in found]


def of_rows(rows) -> list[Candidate]:
    """Candidates of expanded rows."""
    return of_nodes([(patches.stump_of(r), r.strategy, r.gain) for r in rows])


def select(found: Sequence[Candidate], most: int = 0, avoid: Sequence[str] = (), merge=None) -> tuple[list[Candidate], list[tuple[str, str]]]:
    """(candidates, discarded as (id, reason)): the first of each content that corrects something, isn't to be avoided and can be merged; `most` of them at most (0: all). merge: what raises if a patch can't be merged into the model."""
    out, discarded, seen, avoid = [], [], set(), set(avoid)
    for c in found:
        if most and len(out) >= most:
            break
        if c.id in seen:
            continue
        seen.add(c.id)
        if all(patches.largest(p) == 0 for p in c.parts):
            discarded.append((c.id, "corrects nothing"))
        elif c.id in avoid:
            discarded.append((c.id, "failed lately"))
        else:
            try:
                if merge:
                    merge(c)
                out.append(c)
            except ValueError as error:
                discarded.append((c.id, str(error)))
    return out, discarded


def distinct(rows) -> list[Candidate]:
    """Candidates of expanded rows, without those that correct nothing or repeat another's content."""
    return select(of_rows(rows))[0]


def draw(what: str, number: int, seed: int) -> float:
    """In [0, 1), by an MD5 that SQL can repeat."""
    return int(hashlib.md5(f"{what}:{number}:{seed}".encode()).hexdigest()[:13], 16) / (1 << 52)


def random_stumps(edges: Sequence[Sequence[float]], count: int, most: float, seed: int, kinds: Sequence[str] = KINDS) -> list[Candidate]:
    """Stumps at random edges with random corrections, each of one of the kinds. Features without edges have none."""
    out, able = [], [i for i, e in enumerate(edges) if e]
    for n in range(count if able else 0):
        i, kind = able[int(draw("feature", n, seed) * len(able))], kinds[int(draw("kind", n, seed) * len(kinds))]
        left, right = ((2 * draw(side, n, seed) - 1) * most for side in ("left", "right"))
        at = edges[i][int(draw("edge", n, seed) * len(edges[i]))]
        node = patches.split(i, at, patches.leaf(0.0 if kind == "right-only" else left), patches.leaf(0.0 if kind == "left-only" else right))
        out.append(Candidate(patches.patch_id(node), "random", (node,), 0.0))
    return out


def label(strategies: Sequence[str]) -> str:
    return strategies[0] if len(strategies) == 1 else f"combo/{len(strategies)}:{strategies[0]}"


def label_column(parts: Column, strategy: Column) -> Column:
    """The same of columns: how many parts, and the first one's strategy."""
    return F.when(parts > 1, F.concat(F.lit("combo/"), parts.cast("string"), F.lit(":"), strategy)).otherwise(strategy)


def stack(chosen: Sequence[Candidate]) -> Candidate:
    return Candidate(patches.combo_id([c.id for c in chosen]), label([c.strategy for c in chosen]), tuple(p for c in chosen for p in c.parts), sum(c.gain for c in chosen))


def combos(candidates: Sequence[Candidate], most: int = 4) -> list[Candidate]:
    """Stacks of the first two, three, ... candidates that read different sets of features."""
    chosen, seen = [], set()
    for c in candidates:
        key = tuple(sorted({f for p in c.parts for f in patches.features(p)}))
        if key not in seen:
            seen.add(key)
            chosen.append(c)
    return [stack(chosen[:k]) for k in range(2, min(most, len(chosen)) + 1)]
