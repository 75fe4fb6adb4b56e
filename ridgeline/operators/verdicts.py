"""The shared verdict store: what was tried on which model, and how it ended.

Rows: position, id, incumbent, outcome (accepted | rejected), delta, at_unix (seconds), host, inputs, outputs, members (the
ids of a stack's patches; null or empty for a patch of its own), notes. Everything is an aggregate by id or by (id,
incumbent), so partial aggregates keep hot ids small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .merging import PREFIX, SHARED


def accepted():
    return F.col("outcome") == "accepted"


def age(now: int):
    """Seconds since a verdict; 0 for one from the future."""
    return F.greatest(F.lit(now) - F.col("at_unix"), F.lit(0))


def known_failures(verdicts: DataFrame, now: int, retry_after: int) -> DataFrame:
    """id of what never won and failed lately."""
    found = verdicts.groupBy("id").agg(F.max(F.when(~accepted(), F.col("at_unix"))).alias("at_unix"), F.bool_or(accepted()).alias("won"))
    return found.where(~F.col("won") & F.col("at_unix").isNotNull() & (age(now) < retry_after)).select("id")


def evidence(verdicts: DataFrame) -> DataFrame:
    """id, wins, losses, best_delta, best_at (the best win, the later of equals), last_at, last_position."""
    win = F.struct(F.col("delta"), F.col("at_unix"), F.col("position"))
    last = F.struct(F.col("at_unix"), F.col("position"))
    return (
        verdicts.groupBy("id")
        .agg(F.count_if(accepted()).alias("wins"), F.count_if(~accepted()).alias("losses"), F.max(F.when(accepted(), win)).alias("best"), F.max(last).alias("last"))
        .select("id", "wins", "losses", F.col("best.delta").alias("best_delta"), F.col("best.at_unix").alias("best_at"), F.col("last.at_unix").alias("last_at"), F.col("last.position").alias("last_position"))
    )


def tried(verdicts: DataFrame, incumbent: str) -> DataFrame:
    return verdicts.where(F.col("incumbent") == incumbent).select("id").distinct()


def merged_patch_id(neuron: Column) -> Column:
    """The patch that a neuron's name says it belongs to; null for other names and for constants that patches share."""
    found = F.nullif(F.regexp_extract(neuron, f"^{PREFIX}([^-]+)-.+$", 1), F.lit(""))
    return F.nullif(found, F.lit(SHARED))


def shared_ids(one: DataFrame, other: DataFrame) -> DataFrame:
    """id of what both have."""
    return one.select("id").intersect(other.select("id"))


def members(verdicts: DataFrame) -> DataFrame:
    """id, member of each patch of each verdict; a patch of its own is its only member."""
    own = F.array("id")
    listed = F.when(F.size("members") > 0, F.col("members")).otherwise(own) if "members" in verdicts.columns else own
    return verdicts.select("id", F.explode(listed).alias("member")).distinct()


def open_ids(verdicts: DataFrame, incumbent: str, carried: DataFrame) -> DataFrame:
    """id of what wasn't tried on a model and of which it doesn't carry all members."""
    left = members(verdicts).join(carried.select(F.col("id").alias("member")).distinct(), "member", "left_anti").select("id").distinct()
    return left.join(tried(verdicts, incumbent), "id", "left_anti")


def replay_rank() -> list[Column]:
    """Wins by delta, then those whose wait is over, the oldest first; ties by id."""
    win = F.col("kind") == "win"
    return [F.when(win, 0).otherwise(1).asc(), F.when(win, -F.col("best_delta")).asc(), F.when(~win, F.col("last_at")).asc(), F.col("id").asc()]


def ranked(found: DataFrame, now: int, retry_after: int) -> DataFrame:
    """Evidence with its kind: a win that wasn't rejected more often than accepted, or what was tried long enough ago; the rest goes."""
    kind = F.when((F.col("wins") > 0) & (F.col("losses") <= F.col("wins")), "win").when(F.greatest(F.lit(now) - F.col("last_at"), F.lit(0)) >= retry_after, "retry")
    return found.withColumn("kind", kind).where("kind IS NOT NULL")


def choose(verdicts: DataFrame, incumbent: str, inputs: int, carried: DataFrame, now: int, retry_after: int, most: int, outputs: int | None = None) -> DataFrame:
    """place, id, kind (win | retry), delta, at_unix: what to replay on a model of so many inputs and outputs. Wins by delta, then those whose wait is over, the oldest first; not what the model has tried, nor what it carries all members of."""
    own = verdicts.where(F.col("inputs") == inputs)
    if outputs is not None:
        own = own.where(F.col("outputs") == outputs)
    found = ranked(evidence(own).join(open_ids(own, incumbent, carried), "id", "left_semi"), now, retry_after)
    order = replay_rank()
    top = found.orderBy(*order).limit(most)
    delta, at = F.when(F.col("kind") == "win", F.col("best_delta")), F.when(F.col("kind") == "win", F.col("best_at")).otherwise(F.col("last_at"))
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).select("place", "id", "kind", delta.alias("delta"), at.alias("at_unix"))


def newest(verdicts: DataFrame) -> DataFrame:
    """The newest verdict of each (id, incumbent); the later position of equals."""
    own = W.partitionBy("id", "incumbent").orderBy(F.desc("at_unix"), F.desc("position"))
    return verdicts.withColumn("copy", F.row_number().over(own))


def marked(verdicts: DataFrame, now: int, accepted_after: int, rejected_after: int) -> DataFrame:
    """verdicts with fate: duplicate, stale-accepted, stale-rejected or fresh."""
    stale = F.when(accepted(), age(now) >= accepted_after).otherwise(age(now) >= rejected_after)
    return newest(verdicts).withColumn("fate", F.when(F.col("copy") > 1, "duplicate").when(stale & accepted(), "stale-accepted").when(stale, "stale-rejected").otherwise("fresh")).drop("copy")


def prune(verdicts: DataFrame, now: int, accepted_after: int, rejected_after: int, most: int = 0) -> DataFrame:
    """verdicts with fate, where fresh ones beyond the newest `most` are over-cap and the rest are kept. The cap is a cut by (at_unix, position), found as the smallest of a top-n."""
    found = marked(verdicts, now, accepted_after, rejected_after)
    fate = F.when(F.col("fate") != "fresh", F.col("fate")).otherwise("kept")
    if most:
        newest_first = found.where("fate = 'fresh'").orderBy(F.desc("at_unix"), F.desc("position")).limit(most)
        cut = newest_first.agg(F.min(F.struct("at_unix", "position")).alias("cut")).first().cut
        if cut is not None:
            older = (F.col("at_unix") < cut.at_unix) | (F.col("at_unix") == cut.at_unix) & (F.col("position") < cut.position)
            fate = F.when((F.col("fate") == "fresh") & older, "over-cap").otherwise(fate)
    return found.withColumn("fate", fate)


def unfiled(verdicts: DataFrame, filed: DataFrame) -> DataFrame:
    """What isn't filed yet for its (id, incumbent)."""
    return verdicts.join(filed.select("id", "incumbent").distinct(), ["id", "incumbent"], "left_anti")


#: Notes of a verdict that are filed, at most, and the characters of one.
NOTES, NOTE_LENGTH = 8, 200


def to_file(tested: DataFrame, filed: DataFrame) -> DataFrame:
    """Verdicts that are worth filing: those of a full score (full_delta isn't null) that aren't filed for their (id, incumbent), with their notes trimmed."""
    notes = F.transform(F.slice(F.coalesce("notes", F.array().cast("array<string>")), 1, NOTES), lambda n: F.substring(n, 1, NOTE_LENGTH))
    return unfiled(tested.where(F.col("full_delta").isNotNull()), filed).withColumn("notes", notes).withColumn("delta", F.col("full_delta")).drop("full_delta")


def counts_of(marked_rows: DataFrame) -> DataFrame:
    """fate, verdicts of a plan."""
    return marked_rows.groupBy("fate").agg(F.count("*").alias("verdicts"))


def by_host(verdicts: Sequence[DataFrame]) -> DataFrame:
    """host, verdicts, ids over the stores of several hosts."""
    whole = verdicts[0]
    for v in verdicts[1:]:
        whole = whole.unionByName(v, allowMissingColumns=True)
    return whole.groupBy("host").agg(F.count("*").alias("verdicts"), F.countDistinct("id").alias("ids"))


def safe_name(name):
    """A path component: letters, digits, - and _; `unknown` if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(name, "[^A-Za-z0-9_-]", "-"), F.lit("-")), F.lit("")), F.lit("unknown"))
