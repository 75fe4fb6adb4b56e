"""The improvement loop: bins once, then search, expand, screen, promote and accept until nothing helps.

A search looks at a search set (a sample with its bins and weights) and finds stumps, trees, lines and boosted bundles;
variants, stacks, what nearly won the round before and what won elsewhere join them, and what is known to fail leaves.
The corpus is laid out once (layout.py); a round writes its records' residuals beside it and nothing else, so no round's
plan holds the rounds before it. What comes to the driver is a few ranked discoveries and a score for each candidate.

With a model and targets a candidate's score is that of the model with the candidate merged (grafted.py), the next
round's residuals and baseline are those of the merged model, and verdicts are filed under the model that was tested.
What a search fits is what has to go into the output's sum, as far as that is finite.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import binning, candidates, grafted, histogram, merging, oblique, patches, promotion, residuals, sampling, trees, verdicts
from ..operators.candidates import Candidate
from ..operators.histogram import Controls
from ..operators.residuals import Model
from ..sources import artifacts, files
from . import store
from .interrupt import Interrupted, interruptible
from .layout import Layout


@dataclass(frozen=True)
class Search:
    """What a round looks for, and where."""

    sampler: str = "stride"
    records: int = 0  # of a search set; 0: all
    feature_share: float = 1.0  # random features of a round
    depth: int = 1  # of trees; 1: stumps only
    best_first: bool = False
    roots: int = 1  # trees that start from the best stumps of so many features
    lines: int = 0  # random lines besides the best feature with each partner; 0: no lines at all
    boost: int = 1  # stumps of a boosted bundle; 1: none
    stacks: int = 4
    most: int = 64  # candidates of a round: stacks first, then as many single ones as there is room for


@dataclass(frozen=True)
class Memory:
    """A store of verdicts that hosts share: its root, the corpus's and the host's name there, and how long a failure isn't tried again."""

    root: str
    corpus: str
    host: str
    incumbent: str = ""
    retry_after: int = 7 * 86_400
    replay: int = 8


@dataclass(frozen=True)
class Sinks:
    """Where a run leaves what it accepts, as it accepts it: the best model so far, a folder of winners (one file each), and a bundle of all of them."""

    best: str = ""
    winners: str = ""
    bundle: str = ""


@dataclass
class Outcome:
    stop: str = ""
    accepted: list = field(default_factory=list)  # of (id, strategy, parts, improvement)
    scores: list = field(default_factory=list)
    log: list = field(default_factory=list)
    residuals: DataFrame | None = None
    model: Model | None = None


#: Boosted stumps after which what they leave is written: plans hold so many at most.
WRITTEN_AFTER = 8


def boost(binned: DataFrame, edges: DataFrame, listed, width: int, controls: Controls, rounds: int, first: dict | None = None) -> list[dict]:
    """Stumps found one after another, each on what the ones before leave. first: what they start from, in place of the best stump; its thresholds are edges."""
    out: list[dict] = []
    now = binned
    weight = "weight" if "weight" in binned.columns else None
    for i in range(rounds):
        best = first if first and not out else histogram.search_stumps(histogram.histogram(now, width, weight=weight), edges, controls).first()
        if best is None:
            break
        node = best if best is first else patches.stump_of(best)
        out.append(node)
        now = patches.apply(now, node, patches.value_on_bins(node, listed, "bins" in binned.columns))
        if len(out) % WRITTEN_AFTER == 0 and i + 1 < rounds:
            now = store.written(now, "boosted")
    return out


def discoveries(rows: DataFrame, searched: DataFrame, features: Sequence[str], edges: DataFrame, listed, controls: Controls, search: Search, seed: int, choose: Callable[[list[Candidate]], dict | None] = lambda singles: None) -> tuple[list[Candidate], list[Candidate]]:
    """(single candidates, bundles) of one round: stumps and their variants, trees, lines; prefixes of a boosted bundle. choose: of the single candidates, the patch that boosting starts from; none: the best stump."""
    width = len(features)
    hist = histogram.histogram(searched, width, weight="weight").persist()
    ranked = histogram.search_stumps(hist, edges, controls)
    ranked = ranked.withColumn("place", F.row_number().over(W.orderBy(*histogram.rank_keys())))
    singles = candidates.of_rows(candidates.expand(candidates.nonzero(ranked), edges).orderBy("phase", "step", "place").collect())
    found = []
    best = histogram.search_stumps(hist, edges, Controls(controls.min_leaf, controls.max_correction, controls.min_gain, max(1, search.roots), 1)).collect()
    hist.unpersist()
    if search.depth > 1 and best:
        name = "best-first" if search.best_first else "level"
        roots = [None, *((r.feature, r.bin) for r in best[1 : search.roots])]
        for grown in trees.grow_trees(searched, edges, width, controls, search.depth, search.best_first, roots):
            for tree in grown:
                if tree.depth > 1:
                    found.append((tree.node(controls.max_correction), f"tree/{name}/{tree.depth}", tree.gain))
    if search.lines and best and width > 1:
        scales = {r.feature: r.scale for r in binning.feature_scale(edges).collect()}
        raw = sampling.raw_rows(rows, searched).persist()
        terms, line = oblique.search(raw, [scales.get(i, 1.0) for i in range(width)], controls, best[0].feature, 2, search.lines, seed)
        raw.unpersist()
        if line:
            found.append((patches.oblique(terms, line.threshold, patches.leaf(line.left_correction), patches.leaf(line.right_correction)), "oblique", line.gain))
    singles = [*candidates.of_nodes(sorted(found, key=lambda x: -x[2])), *singles]
    bundle = candidates.of_nodes([(node, "boosted", 0.0) for node in boost(searched, edges, listed, width, controls, search.boost, choose(singles))]) if search.boost > 1 else []
    return singles, [candidates.stack(bundle[:k]) for k in range(2, len(bundle) + 1)]


def replayed(known: DataFrame, memory: Memory, model: Model | None, inputs: int, outputs: int, now: int, incumbent: str | None = None) -> list[Candidate]:
    """What won on other models, as candidates. incumbent: the model now, where it isn't the one that the memory started with."""
    spark = known.sparkSession
    carried = spark.createDataFrame([(x,) for x in sorted(merging.merged_ids(model))] if model else [], "id string")
    chosen = verdicts.choose(known, memory.incumbent if incumbent is None else incumbent, inputs, carried, now, memory.retry_after, memory.replay, outputs)
    parts = known.where("parts IS NOT NULL").groupBy("id").agg(F.max("parts").alias("parts"))
    return [Candidate(r.id, "replay", tuple(json.loads(r.parts)), 0.0) for r in chosen.join(parts, "id").orderBy("place").collect()]


def failing(known: DataFrame, found: Sequence[Candidate], now: int, retry_after: int) -> set[str]:
    """Which of some candidates are known to fail."""
    ids = known.sparkSession.createDataFrame([(c.id,) for c in found], "id string")
    return {r.id for r in ids.join(verdicts.known_failures(known, now, retry_after), "id", "left_semi").collect()}


def additive(model: Model, output: int) -> bool:
    """Whether a correction of an output is added to it as it is."""
    name = model.outputs[output]
    return merging.anchor_of(model, name) == merging.Anchor(name, 1.0, model.squash_of(name)) and model.squash_of(name) in ("IDENTITY", "IF")


def corrections(base: DataFrame, model: Model, targets: Sequence[str]) -> DataFrame:
    """record_id, slot, _r0, _r1, ...: what has to go into each output's sum to reach its target; 0 where that isn't finite."""
    return base_columns(model.columns(base), [residuals.wanted(model, i, y) for i, y in enumerate(targets)])


def base_columns(rows: DataFrame, values) -> DataFrame:
    return rows.select("record_id", "slot", *[v.alias(f"_r{i}") for i, v in enumerate(values)])


def run(
    corpus: DataFrame,
    features: list[str],
    *,
    bins: int = 32,
    controls: Controls = Controls(),
    search: Search = Search(),
    iterations: int = 10,
    patience: int = 1,
    count: int = 8,
    rate: float = 0.2,
    min_improvement: float = 0.0,
    seed: int = 0,
    outputs: Sequence[str] = ("residual",),
    model: Model | None = None,
    targets: Sequence[str] = (),
    memory: Memory | None = None,
    sinks: Sinks = Sinks(),
    log: files.LogWriter | None = None,
    scorer: promotion.Scorer | None = None,
    failures: int = 3,
    seconds: float | None = None,
    cancelled: Callable[[], bool] = lambda: False,
    clock: Callable[[], float] = time.time,
) -> Outcome:
    """Improve until nothing helps, or a limit is reached. Record ids are whole numbers that no two records share.

    outputs: the residual columns that rounds take in turn. model: a graph that corrections are merged into; what can't be
    merged is no candidate. targets: the model's targets by output; with them residuals and scores are the merged
    model's, without them a model has to add corrections to its output as they are. scorer: another way to score; at the
    start its error has to agree with ours. cancelled is asked while jobs run, and ends the one that runs.
    """
    spark, width, began = corpus.sparkSession, len(features), clock()
    through = model is not None and bool(targets)
    if through and len(targets) != len(model.outputs):
        raise ValueError("a target for each output of the model")
    if model is not None and not through:
        if odd := [i for i in range(len(outputs)) if not additive(model, i)]:
            raise ValueError(f"corrections of output {odd[0]} don't add up there: the run needs its targets")
    names = list(targets) if through else list(outputs)
    out = Outcome(model=model)
    bundle = artifacts.Bundle(width)

    def note(record: str, **fields) -> None:
        out.log.append({"record": record} | fields)
        if log:
            log.append(record, **fields)

    try:
        with interruptible(spark, cancelled):
            improve(spark, corpus, features, width, names, through, out, bundle, note, bins, controls, search, iterations, patience, count, rate, min_improvement, seed, memory, sinks, scorer, failures, seconds, began, clock)
    except Interrupted:
        out.stop = "cancelled"
    out.stop = out.stop or "iterations"
    note("summary", timestamp=int(clock()), stop=out.stop, opening_score=out.scores[0] if out.scores else None, final_score=out.scores[-1] if out.scores else None, wall_ms=ms(clock() - began))
    if sinks.bundle:
        bundle.write(spark, sinks.bundle)
    return out


def improve(spark, corpus, features, width, names, through, out, bundle, note, bins, controls, search, iterations, patience, count, rate, min_improvement, seed, memory, sinks, scorer, failures, seconds, began, clock) -> None:
    """The rounds of a run; what they find goes into out."""
    k = max(1, round(1 / rate)) if rate > 0 else 1
    edges = store.written(binning.build_edges(corpus, features, bins), "edges")
    listed = binning.collect_edges(edges, width)
    lay = Layout(corpus, features, listed, names, k)
    lay.put(corrections(lay.base, out.model, names) if through else base_columns(lay.base, [F.col(c) for c in names]))
    paid, carried, idle, broken = [0] * len(names), [], 0, 0  # paid: splits accepted by output
    scores: dict[str, float] = {}

    def measured(output: int, phase: int | None = None) -> DataFrame:
        """The rows that scores are measured on; those of a screen, if it has a phase."""
        if through and scorer is None:
            return lay.base if phase is None else lay.every(lay.base, k, phase)
        return lay.rows(f"_r{output}") if phase is None else lay.rows(f"_r{output}", k, phase)

    def score_of(output: int) -> promotion.Scorer:
        if scorer:
            return scorer
        if through:
            return grafted.scorer(out.model, output, names[output], paid[output])
        return lambda rows, found: promotion.score_all(rows, found, paid[output])

    def merges(output: int):
        return (lambda c: merging.merge_all(out.model, c.parts, output, inputs=width)) if out.model else None

    def baseline(output: int) -> tuple:
        return promotion.checked(score_of(output)(measured(output), []))["baseline"]

    def incumbent() -> str:
        """What verdicts are filed under: the model as it is now."""
        if out.model:
            return out.model.checksum
        return patches.combo_id([memory.incumbent, *(x[0] for x in out.accepted)]) if out.accepted else memory.incumbent

    for i, name in enumerate(names):
        own = baseline(i)
        scores[name] = own[0]
        if scorer:
            ours = grafted.scorer(out.model, i, name)(lay.base, []) if through else promotion.score_all(lay.rows(f"_r{i}"), [])
            if own[1] is not None and not promotion.parity(ours["baseline"][1] or 0.0, own[1]):
                out.stop = "no parity"
    opening = sum(scores.values()) / len(scores)
    out.scores.append(opening)
    note("header", timestamp=int(clock()), seed=seed)
    note("baseline", score=opening)
    for iteration in range(iterations):
        if seconds is not None and clock() - began >= seconds:
            out.stop = out.stop or "timeout"
        elif broken >= failures:
            out.stop = "scorer failures"
        if out.stop:
            break
        output = iteration % len(names)
        own_seed = seed * 1_000_003 + iteration
        rows = lay.rows(f"_r{output}")
        started = clock()
        chosen = sampling.random_features(width, search.feature_share, own_seed) if search.feature_share < 1 else None
        searched = sampling.search_set(rows, features, listed, sampler=search.sampler, target=search.records, seed=own_seed, chosen=chosen)
        if search.records:
            searched = store.written(searched, "search-set")
        able = edges if chosen is None else edges.where(F.col("feature").isin(chosen))
        known = files.read_verdicts(spark, memory.root, memory.corpus) if memory else None
        again = replayed(known, memory, out.model, width, len(names), int(clock()), incumbent()) if memory else []
        avoid: set[str] = set()

        def choose(found: list[Candidate]) -> dict | None:
            """The first patch of the round that isn't known to fail, replays first, and that bins can tell."""
            if memory:
                avoid.update(failing(known, [*again, *found], int(clock()), memory.retry_after))
            able = (c.parts[0] for c in [*again, *found] if c.id not in avoid and len(c.parts) == 1)
            return next((p for p in able if patches.largest(p) > 0 and patches.value_on_bins(p, listed) is not None), None)

        singles, bundles = discoveries(rows, searched, features, able, listed, controls, search, own_seed, choose)
        first = singles[0] if singles else None
        stacks = [*bundles, *candidates.combos(candidates.select(singles)[0], search.stacks)]
        if carried:
            singles = [*singles, *carried]
            stacks += [candidates.stack(x) for x in (carried, [first, *carried] if first else []) if len(x) > 1]
        singles = [*again, *singles]
        if memory:
            avoid.update(failing(known, [*singles, *stacks], int(clock()), memory.retry_after))
        searched_ms, started = ms(clock() - started), clock()
        kept, discarded = candidates.select(stacks, avoid=avoid, merge=merges(output))
        room = max(0, search.most - len(kept))
        alone, more = candidates.select(singles, room, avoid, merges(output)) if room else ([], [])
        every, discarded = [*alone, *kept], [*discarded, *more]
        base = {"timestamp": int(clock()), "iteration": iteration, "baseline_score": scores[names[output]], "search_ms": searched_ms, "merge_ms": ms(clock() - started), "generated": len(singles) + len(stacks), "discarded": [{"id": i, "reason": r} for i, r in discarded]}
        if not every:
            note("experiment", **base, accepted=False)
            out.stop = "no candidates"
            break
        try:
            found = promotion.promote(
                measured(output), [(c.id, list(c.parts)) for c in every], rate=rate, phase=iteration, count=count, min_improvement=min_improvement, seed=own_seed,
                stored_baseline=scores[names[output]], scorer=score_of(output), sample=lambda: measured(output, iteration),
            )
        except ValueError as error:  # a scorer that gives no usable score fails this round, not the run
            broken += 1
            note("experiment", **base, accepted=False, error=str(error))
            continue
        broken = 0
        by_id, winner = {c.id: c for c in every}, found["winner"]
        screened = len(every) if found["screen"] else 0
        note(
            "experiment",
            **base,
            full_ms=found["full_ms"],
            screen_ms=found["screen_ms"],
            candidates=[entry(c, found) for c in every],
            screened=screened,
            promoted=len(found["promoted"]) - len(found["bypass"]) if screened else 0,
            bypassed=len(found["bypass"]),
            full_scored=len(found["promoted"]),
            winner=winner,
            improvement=found["deltas"][winner] if winner else None,
            accepted=winner is not None,
            false_positives=found["false_positives"],
            false_negatives=found["false_negatives"],
            error="the baseline disagrees with the stored one" if found["veto"] else None,
            veto=found["veto"] or None,
        )
        if memory and not found["veto"]:
            file(found, by_id, memory, width, len(names), int(clock()), spark, incumbent())
        near = sorted((x for x in found["promoted"] if x != winner and found["deltas"][x] > 0), key=lambda x: (-found["deltas"][x], x))
        carried = [] if winner is None else [Candidate(c.id, f"again:{c.strategy}", c.parts, c.gain) for c in (by_id[x] for x in near[:2]) if len(c.parts) == 1]
        if winner is None:
            idle += 1
            if idle > patience:
                out.stop = "no improvement"
                break
            continue
        idle, best = 0, by_id[winner]
        if out.model:
            out.model, _ = merging.merge_all(out.model, best.parts, output, inputs=width)
        paid[output] += sum(patches.splits(p) for p in best.parts)
        if through:
            lay.put(corrections(lay.base, out.model, names))
        else:
            rows = lay.base.join(lay.beside.drop("slot").hint("shuffle_hash"), "record_id").withColumn("residual", F.col(f"_r{output}"))
            for part in best.parts:
                rows = patches.apply(rows, part)
            lay.put(base_columns(rows, [F.col("residual" if i == output else f"_r{i}") for i in range(len(names))]))
        for i in range(len(names)) if through else [output]:  # what a shared graph does to other outputs counts too
            scores[names[i]] = baseline(i)[0]
        out.accepted.append((best.id, best.strategy, best.parts, found["deltas"][best.id]))
        out.scores.append(sum(scores.values()) / len(scores))
        deliver(spark, out, best, sinks, bundle, iteration)
    if through:
        left = out.model.columns(lay.base)
        out.residuals = left.withColumns({f"residual{i or ''}": (F.col(y) - F.col(p)).cast("float") for i, (y, (_, p, _)) in enumerate(zip(names, out.model.names()))})
    else:
        out.residuals = lay.base.drop(*names).join(lay.beside.drop("slot").withColumnsRenamed({f"_r{i}": name for i, name in enumerate(names)}), "record_id")


def deliver(spark, out: Outcome, best: Candidate, sinks: Sinks, bundle, iteration: int) -> None:
    """What an acceptance leaves behind."""
    bundle.accept(best.parts, out.scores[-1])
    if sinks.best and out.model:
        artifacts.write_best(spark, out.model, {"score": artifacts.score_text(out.scores[-1]), "round": str(iteration), "patch": best.id}, sinks.best)
    if sinks.winners:
        text = json.dumps({"round": iteration, "id": best.id, "strategy": best.strategy, "parts": best.parts, "improvement": out.accepted[-1][3], "score": out.scores[-1]})
        files.storage.write_text(spark, text, f"{sinks.winners.rstrip('/')}/winner-{iteration:06d}.json")


def ms(seconds: float) -> int:
    return round(1000 * seconds)


def entry(c: Candidate, found: dict) -> dict:
    """A candidate as the log has it."""
    base = (found["screen"] or {}).get("baseline", (None,))[0]
    known, full = (found["screen"] or {}).get(c.id), found["full"].get(c.id)
    return {
        "id": c.id,
        "strategy": c.strategy,
        "backend": "spark",
        "depth": max(patches.depth(p) for p in c.parts),
        "features": sorted({f for p in c.parts for f in patches.features(p)}),
        "predicted_gain": c.gain,
        "promoted": c.id in found["promoted"],
        "bypass": c.id in found["bypass"],
        "affected_records": float(full[3]) if full and len(full) > 3 else None,
        "affected_fraction": full[3] / full[2] if full and len(full) > 3 and full[2] else None,
        "screen_delta": known[0] - base if known else None,
        "full_delta": found["deltas"].get(c.id),
    }


def file(found: dict, by_id: dict[str, Candidate], memory: Memory, inputs: int, outputs: int, now: int, spark, incumbent: str) -> None:
    """Append the verdicts of a round's full scores that aren't filed yet, under the model that they were tested on: the winner is accepted, whatever else would have helped is not."""
    rows = []
    for name, delta in found["deltas"].items():
        c = by_id[name]
        own = [patches.patch_id(p) for p in c.parts]
        rows.append((name, "accepted" if name == found["winner"] else "rejected", delta, incumbent, now, inputs, outputs, own if len(own) > 1 else None, json.dumps(c.parts), [c.strategy]))
    tested = spark.createDataFrame(rows, "id string, outcome string, full_delta double, incumbent string, at_unix long, inputs int, outputs int, members array<string>, parts string, notes array<string>")
    filed = files.read_verdicts(spark, memory.root, memory.corpus)
    files.append_verdicts(verdicts.to_file(tested, filed), memory.root, memory.corpus, memory.host)


def promote_dump(rows: DataFrame, dump: str, **how) -> dict:
    """A boosted model's trees as one candidate on the way that any other takes; trees of a single leaf have no split and stay behind."""
    nodes = [n for n in files.boosted_trees(dump) if "terms" in n]
    c = candidates.stack(candidates.of_nodes([(n, "import", 0.0) for n in nodes]))
    return promotion.promote(rows, [(c.id, list(c.parts))], **how)
