"""The run log's economics: totals, by strategy, backend and depth, and the way of the score.

Experiments: iteration, timestamp, baseline_score, search_ms, screen_ms, full_ms, winner, improvement, accepted, and
candidates (array of struct). What can't be measured is null, never 0.

A log has one record a line, of four kinds (record): header, baseline, experiment and summary; line is its number, as
files have no order of their own. LOG is the schema of all of them together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


CANDIDATE = "struct<id:string,strategy:string,backend:string,depth:int,features:array<int>,predicted_gain:double,affected_records:double,affected_fraction:double,promoted:boolean,bypass:boolean,screen_delta:double,full_delta:double>"
LOG = (
    "line long, record string, timestamp long, seed long, score double, iteration long, baseline_score double, search_ms long, merge_ms long, screen_ms long, full_ms long, "
    f"generated long, discarded array<struct<id:string,reason:string>>, candidates array<{CANDIDATE}>, screened long, promoted long, bypassed long, full_scored long, winner string, improvement double, accepted boolean, "
    "false_positives long, false_negatives long, error string, veto boolean, stop string, opening_score double, final_score double, wall_ms long"
)


def experiments_of(log: DataFrame) -> DataFrame:
    return log.where("record = 'experiment'")


def parts_of_report() -> list[tuple[str, Column, Callable]]:
    """(name, aggregate, how two of them become one) of what a report is made from: each is a minimum, a maximum or a sum, so parts of a log can be summed up apart."""
    kind = lambda name: F.col("record") == name
    exp, base, end = kind("experiment"), kind("baseline"), kind("summary")
    at = lambda cond, value: F.when(cond & value.isNotNull(), F.struct(F.col("line"), value.alias("v")))
    won = exp & F.col("accepted") & F.col("winner").isNotNull() & F.col("improvement").isNotNull()
    score = F.when(base, F.col("score")).otherwise(F.col("final_score"))
    out = [
        ("start", F.min(at(kind("header"), F.col("timestamp"))), F.min),
        ("last", F.max(at(exp, F.col("timestamp"))), F.max),
        ("first_baseline", F.min(at(base, F.col("score"))), F.min),
        ("first_opening", F.min(at(end, F.col("opening_score"))), F.min),
        ("closing", F.max(at(base | end, score)), F.max),
        ("stop", F.max(at(end, F.col("stop"))), F.max),
        ("wall", F.max(at(end, F.col("wall_ms"))), F.max),
        ("iterations", F.count_if(exp), F.sum),
        ("acceptances", F.count_if(won), F.sum),
        ("failures", F.count_if(exp & F.col("error").isNotNull()), F.sum),
        ("vetoes", F.count_if(exp & F.coalesce("veto", F.lit(False))), F.sum),
        ("generated", F.sum(F.when(exp, F.col("generated"))), F.sum),
        ("discarded", F.sum(F.when(exp, F.size("discarded"))), F.sum),
        ("first", F.min(F.when(won, F.col("timestamp"))), F.min),
    ]
    return out + [(c, F.sum(F.when(exp, F.col(c))), F.sum) for c in ("screened", "promoted", "bypassed", "full_scored", "false_positives", "false_negatives", "search_ms", "merge_ms", "screen_ms", "full_ms")]


def summed(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The parts of the report of some records of a log, for each run that `by` tells apart."""
    return log.groupBy(*by).agg(*[value.alias(name) for name, value, _ in parts_of_report()])


def combined(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The parts of several stretches of a log as those of all of it."""
    return parts.groupBy(*by).agg(*[how(name).alias(name) for name, _, how in parts_of_report()])


def finished(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report that its parts make."""
    whole = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    found = parts.select(
        *by,
        F.col("start.v").alias("start"),
        F.col("last.v").alias("last"),
        F.coalesce("first_baseline.v", "first_opening.v").alias("opening_score"),
        F.col("closing.v").alias("final_score"),
        F.col("stop.v").alias("stop"),
        F.col("wall.v").alias("wall"),
        *[whole(c) for c in ("iterations", "acceptances", "failures", "vetoes", "generated", "discarded", "screened", "promoted", "bypassed", "full_scored", "false_positives", "false_negatives", "search_ms", "merge_ms", "screen_ms", "full_ms")],
        "first",
    )
    wall = F.coalesce(F.when(F.col("wall") > 0, F.col("wall")), F.greatest(F.col("last") - F.col("start"), F.lit(0)) * 1000)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    found = found.withColumn("wall_ms", wall).withColumn("improvement", F.col("final_score") - F.col("opening_score")).withColumn("first_acceptance_ms", F.greatest(F.col("first") - F.col("start"), F.lit(0)) * 1000)
    minutes = F.col("wall_ms") / 60_000.0
    return found.withColumns(
        {
            "improvement_per_hour": ratio("improvement", minutes / 60),
            "searches_per_minute": ratio("iterations", minutes),
            "candidates_per_minute": ratio("generated", minutes),
            "search_share": ratio("search_ms", (F.col("search_ms") + F.col("screen_ms") + F.col("full_ms")).cast("double")),
            "false_positive_rate": ratio("false_positives", F.col("promoted").cast("double")),
            "false_negative_rate": ratio("false_negatives", F.col("bypassed").cast("double")),
        }
    ).drop("start", "last", "first", "wall")


def report(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row over a whole log (or for each run): scores, counts, times, rates. The first header starts the run; the first baseline (or the summary) opens it, the last record of these closes it; an experiment whose baseline disagrees with the stored one is marked as a veto."""
    return finished(summed(log, by), by)


def first_acceptance(experiments: DataFrame) -> DataFrame:
    """One row: when the first improvement was accepted."""
    return experiments.where("accepted").agg(F.min("timestamp").alias("first_acceptance"))


def compare(experiments: DataFrame, run: str = "run") -> DataFrame:
    """A row for each run: iterations, acceptances, improvement."""
    won = F.col("accepted")
    return experiments.groupBy(run).agg(F.count("*").alias("iterations"), F.count_if(won).alias("acceptances"), F.sum(F.when(won, F.col("improvement"))).alias("improvement"))


def totals(experiments: DataFrame, start: int) -> DataFrame:
    """One row. Times are in milliseconds; differences of times stop at 0."""
    won = F.col("accepted") & F.col("winner").isNotNull() & F.col("improvement").isNotNull()
    wall = F.greatest(F.max("timestamp") - F.lit(start), F.lit(0)) * 1000
    found = experiments.agg(
        F.count("*").alias("iterations"),
        F.count_if(won).alias("acceptances"),
        F.sum(F.size("candidates")).cast("long").alias("candidates"),
        F.sum(F.size(F.filter("candidates", lambda c: c.promoted))).cast("long").alias("promoted"),
        F.sum("search_ms").alias("search_ms"),
        (F.sum("screen_ms") + F.sum("full_ms")).alias("scorer_ms"),
        wall.alias("wall_ms"),
        F.sum(F.when(won, F.col("improvement"))).alias("improvement"),
        (F.greatest(F.min(F.when(won, F.col("timestamp"))) - F.lit(start), F.lit(0)) * 1000).alias("first_acceptance_ms"),
    )
    hour = F.col("wall_ms") / 3_600_000.0
    return found.withColumn("improvement_per_hour", F.try_divide("improvement", hour)).withColumn("search_share", F.try_divide(F.col("search_ms").cast("double"), (F.col("search_ms") + F.col("scorer_ms")).cast("double")))


def exploded(experiments: DataFrame) -> DataFrame:
    return experiments.select("iteration", "winner", "improvement", "accepted", F.explode("candidates").alias("c")).select("iteration", "winner", "improvement", "accepted", "c.*")


def by_group(experiments: DataFrame) -> DataFrame:
    """dimension (strategy | backend | depth), name, generated, promoted, full_scored, winners, accepted_gain, mean_delta: one expansion for all three."""
    rows = exploded(experiments)
    won = F.col("accepted") & (F.col("winner") == F.col("id"))
    keys = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("name")) for d, v in (("strategy", F.col("strategy")), ("backend", F.col("backend")), ("depth", F.concat(F.lit("depth"), F.col("depth").cast("string"))))])
    return (
        rows.withColumn("k", F.explode(keys))
        .groupBy(F.col("k.dimension").alias("dimension"), F.col("k.name").alias("name"))
        .agg(F.count("*").alias("generated"), F.count_if("promoted").alias("promoted"), F.count("full_delta").alias("full_scored"), F.count_if(won).alias("winners"), F.coalesce(F.sum(F.when(won, F.col("improvement"))), F.lit(0.0)).alias("accepted_gain"), F.avg("full_delta").alias("mean_delta"))
    )


def winners(experiments: DataFrame) -> DataFrame:
    """iteration, id, strategy, depth, improvement of each accepted winner that is among its candidates."""
    return exploded(experiments).where("accepted AND winner = id").select("iteration", "id", "strategy", "depth", "improvement")


def trajectory(experiments: DataFrame) -> DataFrame:
    """step, iteration, score after each acceptance; acceptances are as many as iterations at most."""
    won = experiments.where("accepted AND winner IS NOT NULL AND improvement IS NOT NULL")
    return won.select(F.row_number().over(W.orderBy("iteration")).alias("step"), "iteration", (F.col("baseline_score") + F.col("improvement")).alias("score"))


def carried_forward(experiments: DataFrame) -> DataFrame:
    """iteration, previous_best: the best delta of the iteration before (iterations are numbered without gaps) that wasn't accepted."""
    best = exploded(experiments).groupBy("iteration").agg(F.max(F.when(~(F.col("accepted") & (F.col("winner") == F.col("id"))), F.col("full_delta"))).alias("near"))
    return best.select("iteration").join(best.select((F.col("iteration") + 1).alias("iteration"), F.col("near").alias("previous_best")), "iteration", "left")


def affected_fraction(affected, weighted_total, records):
    total = F.when(weighted_total > 0, weighted_total).otherwise(records)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(affected, total))), F.lit(0.0))
