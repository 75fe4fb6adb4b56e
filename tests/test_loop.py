"""The improvement loop end to end, and trees against a plain search."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import binning, histogram, merging, oblique, patches, promotion, runlog, sampling, trees, verdicts
from ridgeline.operators.histogram import Controls
from ridgeline.operators.residuals import Model
from ridgeline.plans import layout, loop
from ridgeline.sources import artifacts, files
from tests.test_operators import corpus, edges_for

CONTROLS = Controls(min_leaf=20, max_correction=1, top_k=4, max_per_feature=2)


@pytest.fixture(scope="module")
def interaction(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3, 2000)).astype(np.float32)
    return corpus(spark, x, np.where((x[0] > 0) & (x[1] > 0), 0.6, 0)).persist()


def test_trees_win_on_an_interaction_and_the_log_reports_it(spark, interaction, tmp_path):
    path = f"file://{tmp_path}/log"
    model = Model([{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}], "o")
    look = loop.Search(depth=2, lines=2, boost=2, roots=2, most=24)
    memory = loop.Memory(f"file://{tmp_path}/store", "c", "h", incumbent=model.checksum)
    found = loop.run(interaction, ["f0", "f1", "f2"], bins=32, controls=CONTROLS, search=look, iterations=2, count=6, model=model, memory=memory, log=files.LogWriter(spark, path))
    first = found.accepted[0]
    assert any(patches.depth(p) > 1 for p in first[2]) and found.scores[-1] > 1 - 0.2 * (1 - found.scores[0]) and found.scores == sorted(found.scores)
    log = files.read_log(spark, path, runlog.LOG)
    r = runlog.report(log).first()
    assert (r.iterations, r.acceptances, r.opening_score, r.final_score, r.stop) == (2, len(found.accepted), found.scores[0], found.scores[-1], found.stop)
    assert r.generated > r.full_scored > 0 and r.promoted + r.bypassed == r.full_scored and r.vetoes == 0
    names = {g.name for g in runlog.by_group(runlog.experiments_of(log)).collect() if g.dimension == "strategy"}
    assert {"stump", "oblique"} <= names and any(n.startswith("tree/") for n in names) and any(n.startswith("combo/") for n in names)
    candidates = log.where("record = 'experiment'").orderBy("line").first().candidates
    assert len(candidates) <= 24
    # the merged model corrects as the patches do
    x = {f"f{i}": np.array([r[f"f{i}"] for r in interaction.orderBy("record_id").collect()], dtype=float) for i in range(3)}
    (_, before), (_, after) = model.forward(x, 2000)["o"], found.model.forward(x, 2000)["o"]
    left = np.array([r.residual for r in found.residuals.orderBy("record_id").collect()])
    was = np.array([r.residual for r in interaction.orderBy("record_id").collect()])
    assert after - before == pytest.approx(was - left, abs=1e-5)
    # what was tried is filed once, with what it takes to replay it
    filed = files.read_verdicts(spark, memory.root, "c")
    assert filed.count() == filed.select("id", "incumbent").distinct().count() and {v.outcome for v in filed.collect()} <= {"accepted", "rejected"}
    assert {x[0] for x in found.accepted} <= {v.id for v in filed.where("outcome = 'accepted'").collect()}
    other = loop.Memory(memory.root, "c", "h2", incumbent="another")
    again = loop.replayed(filed, other, model, 3, 1, 10**10)
    assert first[0] in {c.id for c in again} and all(c.strategy == "replay" for c in again)
    assert first[0] not in {c.id for c in loop.replayed(filed, memory, model, 3, 1, 10**10)}  # tried on this one
    assert first[0] not in {c.id for c in loop.replayed(filed, other, merging.merge_all(model, first[2])[0], 3, 1, 10**10)}  # carried


X = [("f0", 0.5), ("f1", 0.3)]
NONLINEAR = {
    "TANH": Model([{"id": "o", "squash": "TANH", "bias": 0.1, "in": X}], "o"),
    "LOGISTIC": Model([{"id": "h", "squash": "RELU", "bias": 0.0, "in": X}, {"id": "o", "squash": "LOGISTIC", "bias": 0.0, "in": [("h", 1.0)]}], "o"),
    "MINIMUM": Model([{"id": "top", "type": "constant", "bias": 0.4}, {"id": "h", "squash": "IDENTITY", "bias": 0.0, "in": X}, {"id": "o", "squash": "MINIMUM", "bias": 0.0, "in": [("h", 0.5), ("top", 1.0)]}], "o"),
    "IF": Model([{"id": "o", "squash": "IF", "bias": 0.0, "in": [("f2", 1.0, "condition"), *((s, w, "positive") for s, w in X), *((s, -w, "negative") for s, w in X)]}], "o"),
}


@pytest.mark.parametrize("kind", sorted(NONLINEAR))
def test_the_loop_scores_what_the_merged_model_does(spark, kind, tmp_path):
    rng = np.random.default_rng(11)
    x = rng.uniform(-1, 1, (3, 1500)).astype(np.float32)
    model = NONLINEAR[kind]
    _, out = model.forward({f"f{i}": v.astype(float) for i, v in enumerate(x)}, 1500)["o"]
    y = np.clip(out + 0.25 * (x[1] > 0.2) - 0.2 * (x[2] > 0), 0.02, 0.98) if kind == "LOGISTIC" else np.clip(out + 0.25 * (x[1] > 0.2) - 0.2 * (x[2] > 0), -0.98, 0.98)
    rows = corpus(spark, x, y).withColumnRenamed("residual", "y")
    memory = loop.Memory(f"file://{tmp_path}/store", "c", "h", incumbent=model.checksum)
    sinks = loop.Sinks(f"file://{tmp_path}/best.json", f"file://{tmp_path}/winners", f"file://{tmp_path}/bundle.json")
    found = loop.run(rows, ["f0", "f1", "f2"], bins=16, controls=CONTROLS, search=loop.Search(depth=2, most=12), iterations=3, count=4, model=model, targets=["y"], memory=memory, sinks=sinks)
    assert len(found.accepted) >= 2
    # each score is the error of the model that was merged then, and what it cost
    now, splits = model, 0
    for step, (name, _, parts, improvement) in enumerate([(None, None, (), 0.0), *found.accepted]):
        now, splits = merging.merge_all(now, parts)[0], splits + sum(patches.splits(p) for p in parts)
        _, out = now.forward({f"f{i}": v.astype(float) for i, v in enumerate(x)}, 1500)["o"]
        error = float(np.mean((y.astype(np.float32) - out.astype(np.float32)).astype(float) ** 2))
        assert found.scores[step] == pytest.approx(1 - error - 2e-7 * splits, abs=1e-6)
        if step:
            assert found.scores[step] - found.scores[step - 1] == pytest.approx(improvement, abs=1e-9)
    assert found.model.checksum == now.checksum and found.scores[-1] - found.scores[0] == pytest.approx(sum(a[3] for a in found.accepted), abs=1e-9)
    left = found.residuals.agg(F.avg(F.col("residual").cast("double") ** 2).alias("m")).first().m
    assert left == pytest.approx(error, abs=1e-6)
    # one accepted verdict a round, each under the model that it was tested on
    won = {v.incumbent: v.id for v in files.read_verdicts(spark, memory.root, "c").where("outcome = 'accepted'").collect()}
    now, want = model, {}
    for name, _, parts, _ in found.accepted:
        want[now.checksum] = name
        now = merging.merge_all(now, parts)[0]
    assert won == want and files.read_verdicts(spark, memory.root, "c").select("incumbent").distinct().count() == len(found.log) - 3
    # what an acceptance leaves behind
    assert artifacts.read_model(spark, sinks.best).checksum == found.model.checksum
    assert [json.loads(p.read_text())["id"] for p in sorted((tmp_path / "winners").glob("*.json"))] == [a[0] for a in found.accepted]
    assert len(json.loads((tmp_path / "bundle.json").read_text())["accepted"]) == len(found.accepted)


def test_a_model_that_bends_corrections_needs_targets_and_a_scorer_has_to_agree(spark, interaction):
    with pytest.raises(ValueError, match="targets"):
        loop.run(interaction, ["f0", "f1", "f2"], model=NONLINEAR["TANH"])
    with pytest.raises(ValueError, match="share an id"):
        loop.run(interaction.unionByName(interaction.limit(1)), ["f0", "f1", "f2"], bins=4)
    odd = lambda rows, found: {k: (v[0], v[1] + 0.1, v[2]) for k, v in promotion.score_all(rows, found).items()}
    assert loop.run(interaction, ["f0", "f1", "f2"], bins=4, scorer=odd).stop == "no parity"


def test_a_cancelled_run_ends_in_the_middle_of_a_pass(spark, interaction):
    asked, began = [], time.time()

    def slow(rows, found):
        if found:
            asked.append(True)
            rows.sparkSession.range(0, 4, 1, 4).mapInArrow(lambda parts: (time.sleep(60) or p for p in parts), "id long").count()
        return promotion.score_all(rows, found)

    found = loop.run(interaction, ["f0", "f1", "f2"], bins=8, controls=CONTROLS, count=2, scorer=slow, cancelled=lambda: bool(asked))
    assert found.stop == "cancelled" and found.log[-1]["record"] == "summary" and time.time() - began < 55
    assert spark.range(10).count() == 10


def test_rounds_write_residuals_only_and_join_without_a_shuffle(spark):
    rng = np.random.default_rng(2)
    rows = corpus(spark, rng.normal(size=(4, 400)), rng.normal(size=400)).repartition(3)
    listed, _ = edges_for(spark, rows, 4, 8)
    lay = layout.Layout(rows, ["f0", "f1", "f2", "f3"], listed, ["residual"], slots=5, buckets=4)
    lay.put(loop.base_columns(lay.base, [F.col("residual")]))
    assert lay.beside.columns == ["record_id", "_r0", "slot"]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lay.rows("_r0", 5, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Join" in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull(slot" in plan.replace("slot#", "slot") or "slot" in plan
    want = sorted(r.record_id for r in promotion.screen_sample(rows, 0.2, 2).collect())
    assert sorted(r.record_id for r in lay.rows("_r0", 5, 2).collect()) == want
    assert sorted(r.record_id for r in lay.rows("_r0", 3, 1).collect()) == sorted(r.record_id for r in binning.every(rows, 3, 1).collect())
    assert len(lay.every(lay.base, 5, 2).inputFiles()) < len(lay.base.inputFiles())


def test_wide_corpora_are_searched_in_packed_form(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(6, 800)).astype(np.float32)
    rows = corpus(spark, x, 0.5 * (x[3] > 0.3) + 0.4 * (x[5] > 0))
    how = dict(bins=16, controls=CONTROLS, iterations=2, count=4, search=loop.Search(depth=2, boost=3, most=16, feature_share=0.9))
    plain = loop.run(rows, [f"f{i}" for i in range(6)], **how)
    monkeypatch.setattr(layout, "PACKED_FROM", 2)
    packed = loop.run(rows, [f"f{i}" for i in range(6)], **how)
    assert [a[0] for a in packed.accepted] == [a[0] for a in plain.accepted] and len(plain.accepted) == 2


def test_several_trees_grow_as_they_would_alone_in_fewer_passes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.round(rng.uniform(-1, 1, (3, 900)), 2).astype(np.float32)
    rows = corpus(spark, x, 0.5 * (x[0] > 0.2) + 0.3 * ((x[1] > 0) & (x[2] > 0)) + rng.normal(0, 0.1, 900))
    listed, table = edges_for(spark, rows, 3, 12)
    binned = binning.bin_rows(rows, ["f0", "f1", "f2"], listed)
    packed = histogram.pack_bins(rows.withColumn("x", F.array("f0", "f1", "f2")), listed)
    roots = [None, (1, 5), (2, 3), (0, 4)]
    shape = lambda grown: [[[(leaf.path, leaf.n) for leaf in t.leaves] for t in g] for g in grown]
    for best_first in (False, True):
        alone = [trees.grow_tree(binned, table, 3, CONTROLS, 3, best_first, root) for root in roots]
        passes = []
        whole = trees.histograms
        monkeypatch.setattr(trees, "histograms", lambda *a: passes.append(1) or whole(*a))
        together = trees.grow_trees(binned, table, 3, CONTROLS, 3, best_first, roots)
        monkeypatch.setattr(trees, "histograms", whole)
        assert shape(together) == shape(alone) and len(passes) <= (3 if not best_first else 7)
        assert shape(trees.grow_trees(packed, table, 3, CONTROLS, 3, best_first, roots)) == shape(alone)
    assert not spark.sparkContext._jsc.getPersistentRDDs().size() or all(not df.is_cached for df in (binned, packed))


def test_discoveries_gain_what_they_say(spark, interaction):
    names = ["f0", "f1", "f2"]
    edges = binning.build_edges(interaction, names, 16)
    listed = binning.collect_edges(edges, 3)
    searched = sampling.search_set(interaction, names, listed, target=0)
    look = loop.Search(depth=2, lines=2, boost=3, roots=2)
    singles, bundles = loop.discoveries(interaction, searched, names, edges, listed, CONTROLS, look, 1)
    known = [c for c in singles if c.strategy in ("stump", "stump/scale", "oblique") or c.strategy.startswith("tree/")]
    assert {"stump", "stump/scale", "oblique", "tree/level/2"} <= {c.strategy for c in known} and [len(c.parts) for c in bundles] == [2, 3]
    every = [*known, *bundles]

    def left(parts):
        now = F.col("residual").cast("double")
        for p in parts:
            now = now - patches.value_of(p)
        return F.sum(now * now)

    total, *errors = interaction.agg(left(()).alias("total"), *[left(c.parts).alias(f"e{i}") for i, c in enumerate(every)]).first()
    for c, error in zip(known, errors):
        assert total - error == pytest.approx(c.gain, rel=1e-4, abs=1e-4), c.strategy
    assert total > errors[-2] >= errors[-1]  # a longer bundle leaves no more
    tree = max(c.gain for c in known if c.strategy.startswith("tree/"))
    assert tree > max(c.gain for c in known if c.strategy == "stump")


def test_known_failures_are_left_out(spark, interaction, tmp_path):
    root = f"file://{tmp_path}/store"
    plain = loop.run(interaction, ["f0", "f1", "f2"], bins=16, controls=CONTROLS, iterations=1, count=4)
    best = plain.accepted[0][0]
    rows = spark.createDataFrame([(best, "rejected", -1.0, "m", 10**10, 3, 1)], "id string, outcome string, delta double, incumbent string, at_unix long, inputs int, outputs int")
    files.append_verdicts(rows, root, "c", "other")
    found = loop.run(interaction, ["f0", "f1", "f2"], bins=16, controls=CONTROLS, iterations=1, count=4, memory=loop.Memory(root, "c", "h"))
    experiment = next(x for x in found.log if x["record"] == "experiment")
    assert {"id": best, "reason": "failed lately"} in experiment["discarded"] and best not in {c["id"] for c in experiment["candidates"]}


def test_boosting_starts_from_what_may_be_tried(spark, interaction, tmp_path):
    root, how = f"file://{tmp_path}/store", dict(bins=16, controls=CONTROLS, iterations=1, count=8, search=loop.Search(boost=3))
    bundles = lambda found: [json.loads(v.parts) for v in files.read_verdicts(spark, root, "c").where("host = 'h'").collect() if v.members and "boosted" in v.notes[0]]
    plain = loop.run(interaction, ["f0", "f1", "f2"], **how)
    experiment = next(x for x in plain.log if x["record"] == "experiment")
    best = next(c["id"] for c in experiment["candidates"] if c["strategy"] == "stump")
    rows = spark.createDataFrame([(best, "rejected", -1.0, "m", 10**10, 3, 1)], "id string, outcome string, delta double, incumbent string, at_unix long, inputs int, outputs int")
    files.append_verdicts(rows, root, "c", "other")
    found = loop.run(interaction, ["f0", "f1", "f2"], **how, memory=loop.Memory(root, "c", "h"))
    boosted = bundles(found)
    assert boosted and all(patches.patch_id(parts[0]) != best for parts in boosted)
    listed, table = edges_for(spark, interaction, 3, 16)
    binned = binning.bin_rows(interaction, ["f0", "f1", "f2"], listed)
    first = patches.split(2, listed[2][3], patches.leaf(-0.25), patches.leaf(0.25))
    grown = loop.boost(binned, table, listed, 3, CONTROLS, 3, first)
    assert grown[0] == first and len(grown) == 3 and grown[1:] != loop.boost(binned, table, listed, 3, CONTROLS, 2)


def test_outputs_take_turns(spark):
    i = np.arange(600)
    rows = corpus(spark, [(i % 17) / 17, np.where(i % 2, 1, -1)], np.zeros(600)).drop("residual")
    rows = rows.withColumn("r0", F.when(F.col("f1") > 0, 0.5).otherwise(0.0).cast("float")).withColumn("r1", F.when(F.col("f0") > 0.5, 0.4).otherwise(0.0).cast("float"))
    found = loop.run(rows, ["f0", "f1"], bins=16, controls=CONTROLS, iterations=2, count=4, outputs=["r0", "r1"])
    assert [patches.features(p[2][0]) for p in found.accepted] == [[1], [0]] and found.scores[-1] > 0.999
    left = found.residuals.agg(F.max(F.abs("r0")), F.max(F.abs("r1"))).first()
    assert max(left) < 0.05


def test_the_loop_stops_when_it_is_told_to_and_outlives_a_bad_score(spark, interaction):
    how = dict(bins=8, controls=CONTROLS, count=2)
    assert loop.run(interaction, ["f0", "f1", "f2"], **how, cancelled=lambda: True).stop == "cancelled"
    times = iter(range(0, 10_000, 100))
    assert loop.run(interaction, ["f0", "f1", "f2"], **how, seconds=50, clock=lambda: next(times)).stop == "timeout"

    def failing(rows, candidates):
        scores = promotion.score_all(rows, candidates)
        return scores if not candidates else {"baseline": scores["baseline"]}

    found = loop.run(interaction, ["f0", "f1", "f2"], **how, iterations=9, failures=2, scorer=failing)
    assert found.stop == "scorer failures" and [x.get("error") is not None for x in found.log if x["record"] == "experiment"] == [True, True]


def plain_best(bins, r, rows, edges, controls):
    """The two-leaf split of the largest gain of some records, by trying all."""
    out = []
    for f, e in enumerate(edges):
        for b in range(len(e)):
            left = rows & (bins[f] <= b)
            right = rows & (bins[f] > b)
            n = left.sum(), right.sum()
            if min(n) < max(1, controls.min_leaf):
                continue
            gain = 0.0
            for side in (left, right):
                s, k = r[side].sum(), side.sum()
                c = max(-controls.max_correction, min(controls.max_correction, s / k))
                gain += 2 * c * s - k * c * c
            if gain > 0:
                out.append((-round(gain, 9), f, b, left, right))
    return min(out, key=lambda x: x[:3]) if out else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_first_and_rooted_trees_equal_a_plain_search(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.uniform(-1, 1, (3, 900)), 2).astype(np.float32)
    r = (0.5 * (x[0] > 0.2) + 0.3 * ((x[1] > 0) & (x[2] > 0)) + rng.normal(0, 0.1, 900)).astype(np.float32)
    rows = corpus(spark, x, r)
    listed, table = edges_for(spark, rows, 3, 12)
    bins = [np.searchsorted(np.array(e, dtype=np.float32), v, side="left") for e, v in zip(listed, x)]
    controls = Controls(min_leaf=30, max_correction=1)
    binned = binning.bin_rows(rows, ["f0", "f1", "f2"], listed)
    whole = np.ones(900, dtype=bool)
    for root in (None, (1, 5)):
        leaves = [whole]
        want = []
        while len(leaves) < 4:  # level by level to depth 2: the root's split, then each side's best
            first = plain_best(bins, r.astype(float), whole, listed, controls) if root is None else None
            side = (first[3], first[4]) if root is None else (bins[1] <= 5, bins[1] > 5)
            leaves = list(side)
            want.append(sorted(int(s.sum()) for s in leaves))
            parts = [plain_best(bins, r.astype(float), s, listed, controls) for s in side]
            leaves = [p for s, b in zip(side, parts) for p in ((b[3], b[4]) if b else (s,))]
            want.append(sorted(int(s.sum()) for s in leaves))
            break
        found = trees.grow_tree(binned, table, 3, controls, 2, False, root)
        assert [sorted(int(leaf.n) for leaf in t.leaves) for t in found] == want
    # best-first: the leaf of the largest gain is split, one after another, until a path is as deep as allowed
    open_, done, splits = [(whole, 0)], {}, 0
    while True:
        options = [(plain_best(bins, r.astype(float), s, listed, controls), i) for i, (s, _) in enumerate(open_)]
        options = [(b[:3], i, b) for b, i in options if b]
        if not options:
            break
        _, i, b = min(options, key=lambda o: o[0])
        s, depth = open_[i]
        open_[i : i + 1] = [(b[3], depth + 1), (b[4], depth + 1)]
        splits += 1
        deepest = max(d for _, d in open_)
        done[deepest] = sorted(int(s.sum()) for s, _ in open_)
        if deepest >= 3 or splits >= 7:
            break
    found = {t.depth: sorted(int(leaf.n) for leaf in t.leaves) for t in trees.grow_tree(binned, table, 3, controls, 3, True)}
    assert found == done


def test_weights_count_in_searches(spark):
    rng = np.random.default_rng(5)
    rows = corpus(spark, rng.normal(size=(2, 500)), rng.normal(size=500)).withColumn("weight", (F.col("record_id") % 3 + 1).cast("float"))
    listed, table = edges_for(spark, rows, 2, 8)
    twice = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int")))).drop("weight", "copy")
    keep = ("record_id", "residual", "weight")
    a = trees.grow_tree(binning.bin_rows(rows, ["f0", "f1"], listed, keep), table, 2, CONTROLS, 2)
    b = trees.grow_tree(binning.bin_rows(twice, ["f0", "f1"], listed), table, 2, CONTROLS, 2)
    assert [[leaf.path for leaf in t.leaves] for t in a] == [[leaf.path for leaf in t.leaves] for t in b] and [t.gain for t in a] == pytest.approx([t.gain for t in b])
    lines = [[(0, 1.0), (1, 0.5)], [(0, 1.0), (1, -2.0)], [(1, 1.0)]]
    one, two = (sorted(map(tuple, oblique.best_thresholds(df, lines, CONTROLS).collect())) for df in (rows, twice))
    assert len(one) == 3 and all(x == pytest.approx(y, rel=1e-6) for x, y in zip(one, two))
    found = sampling.search_set(rows.drop("weight"), ["f0", "f1"], listed, target=100, chosen=[1])
    assert found.where("b0 <> 0").count() == 0 and found.count() == 100 and {s.feature for s in histogram.search_stumps(histogram.histogram(found, 2, weight="weight"), table, CONTROLS).collect()} <= {1}


def test_lines_by_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(2, 400)), 1).astype(np.float32)
    r = (0.5 * (x[0] - x[1] > 0.3) + rng.normal(0, 0.2, 400)).astype(np.float32)
    rows = corpus(spark, x, r)
    for terms in ([(0, 1.0), (1, -1.0)], [(0, 0.5), (1, 0.25)]):
        v = sum(x[i] * np.float32(w) for i, w in terms)
        best = max((sum(2 * c * s - k * c * c for s, k in ((r[m].astype(float).sum(), m.sum()) for m in (v <= t, v > t)) for c in [max(-1, min(1, s / k))]), -t) for t in np.unique(v)[:-1] if min((v <= t).sum(), (v > t).sum()) >= 20)
        got = oblique.best_threshold(rows, terms, CONTROLS).first()
        assert (got.gain, got.threshold) == (pytest.approx(best[0]), pytest.approx(-best[1]))
    terms, best = oblique.search(rows, [1.0, 1.0], CONTROLS, 0, random_lines=6, seed=1)
    assert best.gain >= oblique.best_threshold(rows, [(0, 1.0), (1, -0.5)], CONTROLS).first().gain


@pytest.mark.parametrize("kind", ["noise", "step", "ties", "odd"])
def test_bounded_search_finds_the_best_of_all_thresholds(spark, kind):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2, 1500)).astype(np.float32)
    if kind == "ties":
        x = np.round(x, 1).astype(np.float32)
    r = rng.normal(0, 0.3, 1500) + (0.4 * (x[0] + x[1] > 0.7) if kind == "step" else 0)
    if kind == "odd":
        x[0, ::50], x[0, 1::50], x[0, 2::50], x[1, 7] = np.nan, np.inf, -np.inf, 1e30
    rows = corpus(spark, x, r.astype(np.float32)).persist()
    lines = [[(0, 1.0)], [(0, 1.0), (1, 0.5)], [(1, -2.0), (0, 0.25)], [(1, 0.0)]]
    controls = Controls(min_leaf=15, max_correction=0.2)
    want = {}
    for i, terms in enumerate(lines):
        with np.errstate(invalid="ignore"):
            v = np.zeros(1500, dtype=np.float32) if not terms else sum((x[k] * np.float32(w) for k, w in terms[1:]), x[terms[0][0]] * np.float32(terms[0][1])).astype(np.float32)
        options = []
        for t in np.unique(v[np.isfinite(v)]):
            right = v > t  # NaN goes left
            sides = [(r.astype(np.float32)[m].astype(float).sum(), m.sum()) for m in (~right, right)]
            if min(k for _, k in sides) >= 15:
                gain = sum(2 * c * s - k * c * c for s, k in sides for c in [max(-0.2, min(0.2, s / k))])
                if gain > 0:
                    options.append((gain, -float(t)))
        if options:
            want[i] = max(options)
    for groups in (1 << 16, 64):
        found = {b.line: b for b in oblique.best_thresholds(rows, lines, controls, groups=groups).collect()}
        assert {i: (pytest.approx(g), pytest.approx(-t)) for i, (g, t) in want.items()} == {i: (b.gain, b.threshold) for i, b in found.items()}
    top = oblique.best_thresholds(rows, lines, controls, one=True).collect()
    assert [b.line for b in top] == [max(want, key=lambda i: want[i][0])]
    rows.unpersist()


def test_a_log_that_grows_is_read_as_a_stream(spark, tmp_path):
    from ridgeline.streaming import residual_stream

    path = f"file://{tmp_path}/log"
    writer = files.LogWriter(spark, path)
    writer.append("header", timestamp=5)
    writer.append("experiment", iteration=0, accepted=True)
    name = "grown"
    how = lambda: residual_stream.appended_log(spark, path, runlog.LOG).groupBy("record").count().writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    how()
    assert {r.record: r["count"] for r in spark.table(name).collect()} == {"header": 1, "experiment": 1}
    with pytest.raises(Exception):
        (tmp_path / "log" / "bad.txt").write_text("no json\n")
        files.read_log(spark, path, runlog.LOG).collect()
    assert verdicts.NOTES == 8


def test_packed_bins_give_the_same_histograms_and_trees(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 700)).astype(np.float32)
    x[2, ::9] = np.nan
    rows = corpus(spark, x, rng.normal(size=700)).withColumn("weight", (F.col("record_id") % 3 + 1).cast("float"))
    listed, table = edges_for(spark, rows, 5, 9)
    names, keep = [f"f{i}" for i in range(5)], ("record_id", "residual", "weight")
    plain = binning.bin_rows(rows, names, listed, keep).repartition(3)
    arrays = rows.withColumn("x", F.array(*names))
    packed = histogram.pack_bins(arrays, listed, keep).repartition(3)
    assert packed.columns == [*keep, "bins"] and {r.record_id: list(r.bins) for r in packed.collect()} == {r.record_id: [r[f"b{i}"] for i in range(5)] for r in plain.collect()}
    for weight in (None, "weight"):
        want, got = ({(r.feature, r.bin): (r.n, r.s, r.q) for r in histogram.histogram(df, 5, weight=weight).collect()} for df in (plain, packed))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    grown = [[(leaf.path, leaf.n) for leaf in t.leaves] for t in trees.grow_tree(plain, table, 5, CONTROLS, 3)]
    assert [[(leaf.path, leaf.n) for leaf in t.leaves] for t in trees.grow_tree(packed, table, 5, CONTROLS, 3)] == grown
    with pytest.raises(ValueError):
        histogram.pack_bins(arrays, [list(range(256))])
    with pytest.raises(Exception, match="isn't 5 wide"):
        histogram.pack_bins(arrays.withColumn("x", F.array("f0")), listed).collect()
