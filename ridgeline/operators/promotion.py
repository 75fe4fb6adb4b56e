"""Scores of many candidates in one pass, the sampled screen, and the strict promotion that follows it.

A scorer is any function of (rows, candidates as (id, patches)) that gives (score, error, records) by id, with an entry
named baseline for no correction; score_all is the one that computes them here.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patches
from .binning import every

#: Candidates of one aggregate: more columns would outgrow generated code.
TOGETHER = 32
#: Cost of a hidden unit in a score; a split adds two.
UNIT_COST, UNITS_OF_SPLIT = 1e-7, 2

SCORES = T.StructType([T.StructField("candidate_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("error", T.DoubleType()), T.StructField("record_count", T.LongType())])


def squared_error(value: Column) -> Column:
    d = (F.col("residual") - value).cast("double")
    return F.avg(d * d)


def score_all(rows: DataFrame, candidates: Sequence[tuple[str, list[dict]]], carried: int = 0) -> dict[str, tuple[float, float, int, int]]:
    """(score, error, records, records that it corrects) of the baseline and of each candidate (a list of patches), measured over the same rows; the baseline is in every pass. carried: splits of what was accepted before, which go on to cost what they did."""
    out: dict[str, tuple[float, float, int, int]] = {}
    every = list(candidates)
    paid = UNIT_COST * UNITS_OF_SPLIT * carried
    for at in range(0, max(1, len(every)), TOGETHER):
        some = every[at : at + TOGETHER]
        columns = [F.count("*").alias("records"), squared_error(F.lit(0.0).cast("float")).alias("c_base")]
        for i, (_, parts) in enumerate(some):
            value = patches.value_of(parts[0])
            for p in parts[1:]:
                value = value + patches.value_of(p)
            columns += [squared_error(value).alias(f"c{i}"), F.count_if(value != 0).alias(f"n{i}")]
        r = rows.agg(*columns).first()
        out["baseline"] = (1 - (r.c_base or 0.0) - paid, r.c_base, r.records, 0)
        for i, (name, parts) in enumerate(some):
            cost = UNIT_COST * UNITS_OF_SPLIT * sum(patches.splits(p) for p in parts)
            out[name] = (1 - (r[f"c{i}"] or 0.0) - cost - paid, r[f"c{i}"], r.records, r[f"n{i}"])
    return out


#: By id: (score, error, records), and how many records are corrected where the scorer counts them.
Scores = dict[str, tuple]
Scorer = Callable[[DataFrame, Sequence[tuple[str, list[dict]]]], Scores]


def checked(scores: Scores, wanted: Sequence[str] = ()) -> Scores:
    """Scores as they are, if they can be used: an error for a missing baseline or candidate and for any that isn't finite."""
    missing = [k for k in ("baseline", *wanted) if k not in scores]
    if missing:
        raise ValueError(f"the scorer gave no {missing[0]}")
    odd = [k for k, v in scores.items() if v[0] is None or not math.isfinite(v[0])]
    if odd:
        raise ValueError(f"the score of {odd[0]} isn't finite")
    return scores


def join_scores(listed: DataFrame, scores: DataFrame) -> DataFrame:
    """Listed candidates with what is known of their scores: all stay, by iteration and id."""
    return listed.join(scores, ["iteration", "id"], "left")


def scores_frame(spark: SparkSession, scores: Scores) -> DataFrame:
    return spark.createDataFrame([(k, *v[:3]) for k, v in sorted(scores.items())], SCORES)


def screen_sample(rows: DataFrame, rate: float, phase: int) -> DataFrame:
    """Every k-th record by position, k = 1 / rate; another phase gives other records."""
    return every(rows, max(1, round(1 / rate)) if rate > 0 else 1, phase)


def rank_screen(scores: dict[str, tuple], count: int, threshold: float = 0.0) -> list[tuple[str, float]]:
    """(candidate, delta) above the threshold, the largest first, ties by id."""
    base = scores["baseline"][0]
    deltas = [(k, v[0] - base) for k, v in scores.items() if k != "baseline"]
    return sorted((x for x in deltas if x[1] > threshold), key=lambda x: (-x[1], x[0]))[:count]


def bypass(names: Sequence[str], count: int, seed: int) -> list[str]:
    """Some of the rejected, in an order that depends on the name and seed only."""
    import hashlib

    return sorted(names, key=lambda n: hashlib.sha256(f"{seed}:{n}".encode()).digest())[:count]


def parity(local: float, other: float, absolute: float = 1e-9, relative: float = 1e-6) -> bool:
    return abs(local - other) <= absolute + relative * abs(other)


def vetoed(base: float, stored: float | None, drift: float = 1e-9) -> bool:
    """Whether the baseline isn't the one that is stored any more, so nothing may be accepted."""
    return stored is not None and abs(base - stored) > drift


def promote(rows: DataFrame, candidates: Sequence[tuple[str, list[dict]]], *, rate: float = 0.05, phase: int = 0, count: int = 8, screen_threshold: float = 0.0, bypass_count: int = 1, min_improvement: float = 0.0, stored_baseline: float | None = None, drift: float = 1e-9, seed: int = 0, scorer: Scorer = score_all, sample: Callable[[], DataFrame] | None = None) -> dict:
    """Screen on a sample, score those promoted over all rows with the baseline in the same pass, and name a winner or none.

    Some of those that the screen rejects are scored too (bypass): one of them that clears the bar is a false negative
    of the screen; one that was promoted and doesn't is a false positive. sample: gives the screen's rows, where they are
    kept in a way that a sample can be read from.
    """
    known, began, screen_ms = dict(candidates), time.monotonic(), None
    screened, extra = None, []
    chosen = list(known)
    if len(known) > count:
        screened = checked(scorer(sample() if sample else screen_sample(rows, rate, phase), candidates), chosen)
        now = time.monotonic()
        screen_ms, began = round(1000 * (now - began)), now
        ranked = [k for k, _ in rank_screen(screened, count, screen_threshold)]
        extra = bypass([k for k in known if k not in ranked], bypass_count, seed)
        chosen = [*ranked, *extra]
    full = checked(scorer(rows, [(k, known[k]) for k in chosen]), chosen)
    base = full["baseline"][0]
    deltas = {k: full[k][0] - base for k in chosen}
    able = sorted((k for k in chosen if deltas[k] > min_improvement), key=lambda k: (-deltas[k], k))
    drifted = vetoed(base, stored_baseline, drift)
    return {
        "screen": screened,
        "promoted": chosen,
        "full": full,
        "deltas": deltas,
        "bypass": extra,
        "screen_ms": screen_ms,
        "full_ms": round(1000 * (time.monotonic() - began)),
        "drift": None if stored_baseline is None else base - stored_baseline,
        "false_positives": sum(deltas[k] <= min_improvement for k in chosen if k not in extra),
        "false_negatives": sum(deltas[k] > min_improvement for k in extra),
        "winner": None if drifted or not able else able[0],
        "veto": drifted,
    }
