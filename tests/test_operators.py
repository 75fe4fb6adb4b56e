"""Hand-made and planted cases of the analysis operators."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import semantics as sem
from ridgeline.operators import binning, candidates, histogram, oblique, patches, promotion, residuals, sampling, trees, verdicts
from ridgeline.operators.histogram import Controls
from ridgeline.plans import loop
from ridgeline.sources import files

NAN, INF = float("nan"), float("inf")


def corpus(spark, columns, residual):
    rows = [(i, *(float(c[i]) for c in columns), float(residual[i])) for i in range(len(residual))]
    names = ", ".join(f"f{i} float" for i in range(len(columns)))
    return spark.createDataFrame(rows, f"record_id long, {names}, residual float")


def edges_for(spark, rows, width, bins):
    listed = binning.collect_edges(binning.build_edges(rows, [f"f{i}" for i in range(width)], bins), width)
    return listed, spark.createDataFrame([(i, b, t) for i, own in enumerate(listed) for b, t in enumerate(own)], "feature int, bin int, threshold float")


@pytest.mark.parametrize(
    ("values", "bins", "want"),
    [([1] * 100 + [2] * 100, 8, [1.0]), ([3] * 50, 8, []), (list(range(8)), 4, [2.0, 4.0, 6.0]), ([1, 2, 3, NAN, INF, -INF], 2, [2.0]), ([NAN], 4, [])],
)
def test_quantile_edges(spark, values, bins, want):
    rows = corpus(spark, [values], [0] * len(values))
    assert binning.collect_edges(binning.build_edges(rows, ["f0"], bins), 1) == [want]


def test_edges_equal_sorted_positions(spark):
    rng = np.random.default_rng(4)
    values = np.round(rng.normal(size=500), 1).astype(np.float32)
    order = np.sort(values)
    want = sorted({float(order[min(b * 500 // 16, 499)]) for b in range(1, 16)} - {float(order[-1])})
    assert binning.collect_edges(binning.build_edges(corpus(spark, [values], values), ["f0"], 16), 1)[0] == pytest.approx(want)


def test_bins_send_nan_and_ties_left(spark):
    rows = corpus(spark, [[-INF, 0.5, 1.0, 1.5, 2.0, 3.0, INF, NAN]], [0] * 8)
    got = [r.b for r in rows.orderBy("record_id").select(binning.bin_of("f0", [1.0, 2.0]).alias("b")).collect()]
    assert got == [0, 0, 0, 1, 1, 2, 2, 0]
    right = [r.g for r in rows.orderBy("record_id").select(sem.gt(F.col("f0"), sem.single(1)).alias("g")).collect()]
    assert right == [False, False, False, True, True, True, True, False]


def test_residuals_by_hand(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.0, 1.5), (1, 2.0, 0.0, 1.0), (2, -1.0, 0.0, -1.0), (3, 0.5, 0.0, 0.0)], "record_id long, f0 float, f1 float, y float")
    model = residuals.Model([{"id": "o", "squash": "IDENTITY", "bias": 0, "in": [("f0", 1.0)]}], "o")
    found = residuals.compute_residuals(rows, model)
    assert [r.residual for r in found.orderBy("record_id").collect()] == [0.5, -1.0, 0.0, -0.5]
    s = residuals.stats(found).first()
    assert (s.mean, s.sse, s.mse, s.non_finite) == (-0.25, 1.5, 0.375, 0)
    with pytest.raises(ValueError):
        residuals.Model([{"id": "o", "squash": "IDENTITY", "bias": 0, "in": [("h", 1.0)]}], "o")


def test_corrections_before_a_logistic_output(spark):
    rows = spark.createDataFrame([(0, 0.3, 0.8), (1, -0.2, 0.2), (2, 0.1, 1.0)], "record_id long, f0 float, y float")
    model = residuals.Model([{"id": "o", "squash": "LOGISTIC", "bias": 0.1, "in": [("f0", 2.0)]}], "o")
    got = residuals.compute_residuals(rows, model).orderBy("record_id").collect()
    for r, (x, y) in zip(got[:2], ((0.3, 0.8), (-0.2, 0.2))):
        h = 0.1 + 2 * x
        assert r.correction == pytest.approx(math.log(y / (1 - y)) - h, abs=1e-5)
        assert r.residual == pytest.approx(y - 1 / (1 + math.exp(-h)), abs=1e-6)
    assert got[2].correction == 0.0


def test_models_round_trip_and_take_corrections(spark):
    rows = spark.createDataFrame([(0, 0.3, 0.8), (1, -0.2, 0.2)], "record_id long, f0 float, y float")
    model = residuals.Model([{"id": "h", "squash": "RELU", "bias": 0.5, "in": [("f0", 1.0)]}, {"id": "o", "squash": "LOGISTIC", "bias": 0.1, "in": [("h", 2.0)]}], "o")
    again = residuals.Model.from_json(model.to_json())
    correction = residuals.compute_residuals(rows, again).select("record_id", "correction")
    exact = again.corrected(rows.join(correction, "record_id"), F.col("correction"))
    assert all(r.prediction == pytest.approx(r.y, abs=1e-6) for r in exact.collect())


def test_positions_of_the_falling_order(spark):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=997) * 10, 1).astype(np.float32)
    values[:20] = 0
    rows = corpus(spark, [values], values)
    order = np.sort(np.abs(values))[::-1]
    got = residuals.quantiles(rows)
    for p in (0.5, 0.9, 0.99, 0.999):
        assert got[f"p{p * 100:g}"] == order[math.floor((1 - p) * 996 + 0.5)]
    share = residuals.top_share(rows).first().share
    assert share == pytest.approx((order[:9].astype(float) ** 2).sum() / (order.astype(float) ** 2).sum())


def brute_stumps(columns, r, least, most):
    out = []
    for f, c in enumerate(columns):
        for t in sorted(set(c))[:-1]:
            left, right = r[c <= t], r[c > t]
            gain = 0.0
            for side in (left, right):
                m = min(most, max(-most, side.mean()))
                gain += 2 * m * side.sum() - len(side) * m * m
            if min(len(left), len(right)) >= least:
                out.append((gain, f, t))
    return max(out)


def test_histogram_search_equals_brute_force_when_each_value_has_a_bin(spark):
    i = np.arange(60)
    columns = [((37 * i) % 61) / 10, (11 * i) % 13, (5 * i) % 17 - 8]
    columns = [np.asarray(c, dtype=np.float32) for c in columns]
    r = (np.sin(0.3 * columns[0] - 1) + np.where(columns[2] > 0, 0.4, -0.1)).astype(np.float32)
    rows = corpus(spark, columns, r)
    listed, table = edges_for(spark, rows, 3, 256)
    hist = histogram.histogram(binning.bin_rows(rows, ["f0", "f1", "f2"], listed), 3)
    best = histogram.search_stumps(hist, table, Controls(min_leaf=3, max_correction=1, kinds=("two-leaf",))).first()
    gain, f, t = brute_stumps(columns, r.astype(float), 3, 1)
    assert best.gain == pytest.approx(gain, abs=1e-6) and (best.feature, best.threshold) == (f, pytest.approx(t))


def test_wide_form_equals_the_long_one(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 300)).astype(np.float32)
    x[1, ::7] = NAN
    rows = corpus(spark, x, rng.normal(size=300))
    listed, _ = edges_for(spark, rows, 5, 8)
    names = [f"f{i}" for i in range(5)]
    want = {(r.feature, r.bin): (r.n, r.s, r.q) for r in histogram.histogram(binning.bin_rows(rows, names, listed), 5).collect()}
    wide = rows.select(F.array(*names).alias("x"), "residual")
    got = {(r.feature, r.bin): (r.n, r.s, r.q) for r in histogram.wide_histogram(wide, listed).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for odd in (None, [1.0]):
        with pytest.raises(Exception, match="isn't 5 wide"):
            histogram.wide_histogram(wide.unionByName(spark.createDataFrame([(odd, 1.0)], "x array<float>, residual float")), listed).collect()


def test_planted_right_only_stump_and_controls(spark):
    i = np.arange(200)
    rows = corpus(spark, [i % 7, i / 200], np.where(i / 200 > 0.3, 0.5, 0))
    listed, table = edges_for(spark, rows, 2, 20)
    hist = histogram.histogram(binning.bin_rows(rows, ["f0", "f1"], listed), 2)
    best = histogram.search_stumps(hist, table, Controls(min_leaf=5, max_correction=1)).first()
    assert best.feature == 1 and best.threshold == pytest.approx(0.3, abs=0.06) and best.right_correction == pytest.approx(0.5, abs=0.02)
    assert histogram.search_stumps(hist, table, Controls(min_leaf=500)).count() == 0
    assert histogram.search_stumps(hist, table, Controls(min_leaf=5, top_k=3, max_per_feature=1)).count() <= 2


def test_parent_less_child_is_the_sibling(spark):
    rng = np.random.default_rng(1)
    rows = corpus(spark, [rng.normal(size=400), rng.normal(size=400)], rng.normal(size=400))
    listed, _ = edges_for(spark, rows, 2, 4)
    binned = binning.bin_rows(rows, ["f0", "f1"], listed)
    whole = histogram.histogram(binned, 2)
    left, right = (histogram.histogram(binned.where(c), 2) for c in ("b0 <= 1", "b0 > 1"))
    got = {(r.feature, r.bin): (r.n, r.s, r.q) for r in histogram.subtract(whole, left).collect()}
    want = {(r.feature, r.bin): (r.n, r.s, r.q) for r in right.collect()}
    for k, v in got.items():
        assert v == pytest.approx(want.get(k, (0, 0, 0)), abs=1e-9)


@pytest.fixture(scope="module")
def interaction(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (3, 2000)).astype(np.float32)
    rows = corpus(spark, x, np.where((x[0] > 0) & (x[1] > 0), 0.6, 0)).persist()
    listed, table = edges_for(spark, rows, 3, 64)
    return rows, listed, table, binning.bin_rows(rows, ["f0", "f1", "f2"], listed).persist()


@pytest.mark.parametrize("best_first", [False, True])
def test_trees_find_an_interaction(interaction, best_first):
    rows, listed, table, binned = interaction
    controls = Controls(min_leaf=20, max_correction=1)
    found = trees.grow_tree(binned, table, 3, controls, max_depth=2, best_first=best_first)
    assert [t.depth for t in found] == [1, 2]
    sse = rows.agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert found[1].gain > 0.85 * sse and found[1].gain > 1.5 * found[0].gain
    node = found[1].node(controls.max_correction)
    left = patches.apply(rows, node).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert sse - left == pytest.approx(found[1].gain, rel=1e-3)
    assert patches.depth(node) == 2 and patches.features(node) == [0, 1]


def test_a_line_beats_stumps(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (3, 1500)).astype(np.float32)
    rows = corpus(spark, x, np.where(x[0] + x[1] > 0, 0.5, -0.5)).persist()
    controls = Controls(min_leaf=20, max_correction=1)
    along = oblique.best_threshold(rows, [(0, 1.0), (1, 1.0)], controls).first()
    alone = oblique.best_threshold(rows, [(0, 1.0)], controls).first()
    assert along.gain > 0.99 * 0.25 * 1500 and along.gain > 1.5 * alone.gain and abs(along.threshold) < 0.05


def test_bins_and_values_give_the_same_correction(interaction):
    rows, listed, _, binned = interaction
    node = patches.split(0, listed[0][10], patches.leaf(-1.0), patches.split(1, listed[1][3], patches.leaf(0.25), patches.leaf(2.0)))
    a = rows.select("record_id", patches.value_of(node).alias("a"))
    b = binned.select("record_id", patches.value_on_bins(node, listed).alias("b"))
    assert a.join(b, "record_id").where("a <> b").count() == 0
    assert patches.value_on_bins(patches.oblique([(0, 1.0), (1, 1.0)], 0.0, patches.leaf(0), patches.leaf(1)), listed) is None
    assert patches.value_on_bins(patches.split(0, 123.0, patches.leaf(0), patches.leaf(1)), listed) is None


def test_patch_folds_and_ids():
    node = patches.split(0, 1.0, patches.leaf(0.0), patches.oblique([(2, 0.5), (1, 1.0)], 0.0, patches.leaf(-2.0), patches.leaf(1.0)))
    assert (patches.depth(node), patches.splits(node), patches.zero_leaves(node), patches.largest(node), patches.features(node)) == (2, 2, 1, 2.0, [0, 1, 2])
    assert patches.patch_id(node) == patches.patch_id(json.loads(json.dumps(node))) != patches.patch_id(patches.scaled(node, 0.5))
    assert patches.scaled_gain(8.0, 0.5) == 6.0 and patches.scaled_gain(8.0, -1) == -8.0


def test_samples_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    rows = corpus(spark, [rng.normal(size=3000)], rng.normal(size=3000) ** 3)
    for draw in (sampling.uniform, sampling.stratified, sampling.weighted):
        a = {r.record_id: r.weight for r in draw(rows, 600, 1).collect()}
        b = {r.record_id: r.weight for r in draw(rows.repartition(7), 600, 1).collect()}
        assert a == b and 350 < len(a) < 750
        assert a.keys() != {r.record_id for r in draw(rows, 600, 2).collect()}
    weights = sampling.weighted(rows, 600, 1)
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(3000, rel=0.5)
    assert sampling.random_features(10, 0.25, 3) == sampling.random_features(10, 0.25, 3) and len(sampling.random_features(10, 0.25, 3)) == 3


def test_expansion_order_and_combos(spark):
    edges = spark.createDataFrame([(0, b, float(b)) for b in range(4)] + [(1, 0, 5.0)], "feature int, bin int, threshold float")
    top = spark.createDataFrame([(1, 0, 0, 0.0, 1.0, -1.0, 8.0), (2, 1, 0, 5.0, 0.0, 2.0, 4.0)], "place int, feature int, bin int, threshold float, left_correction float, right_correction float, gain double")
    rows = candidates.expand(top, edges).orderBy("phase", "step", "place").collect()
    assert [r.strategy for r in rows] == ["stump"] * 2 + ["stump/scale"] * 4 + ["stump/one-sided"] * 2 + ["stump/shifted"]
    assert [r.gain for r in rows[2:6]] == [6.0, 3.0, 6.0, 3.0] and rows[-1].threshold == 1.0
    singles = candidates.distinct(rows)
    assert len({c.id for c in singles}) == len(singles) == 9
    assert [c.strategy for c in candidates.combos(singles)] == ["combo/2:stump"]


def test_promotion_accepts_only_strict_gains_and_vetoes_drift(spark):
    i = np.arange(400)
    rows = corpus(spark, [(i % 13) / 13, np.where(7 * i % 5 < 2, 1, -1)], np.where(7 * i % 5 < 2, 0.3, 0)).persist()
    good = patches.split(1, 0.0, patches.leaf(0.0), patches.leaf(0.3))
    cohort = [("good", [good]), ("half", [patches.scaled(good, 0.5)]), ("bad", [patches.scaled(good, -1)]), ("none", [patches.split(0, 0.5, patches.leaf(0.0), patches.leaf(0.0))])]
    found = promotion.promote(rows, cohort, count=10)
    assert found["winner"] == "good" and found["deltas"]["good"] == pytest.approx(0.036, abs=1e-3) and found["screen"] is None
    small = promotion.promote(rows, cohort, count=2, rate=0.25, bypass_count=1)
    assert small["winner"] == "good" and len(small["promoted"]) == 3
    assert promotion.promote(rows, cohort[2:], count=10)["winner"] is None
    drifted = promotion.promote(rows, cohort, count=10, stored_baseline=0.5)
    assert drifted["winner"] is None and drifted["veto"]
    assert promotion.parity(1.0, 1.0 + 1e-7) and not promotion.parity(1.0, 1.1)


def test_loop_finds_planted_stumps_and_stops(spark):
    i = np.arange(600)
    columns = [(i % 17) / 17, np.where(i % 2, 1, -1), (13 * i % 11) / 11]
    rows = corpus(spark, columns, 0.3 * (columns[1] > 0) + 0.2 * (columns[2] > 0.5))
    found = loop.run(rows, ["f0", "f1", "f2"], bins=16, controls=Controls(min_leaf=20, max_correction=1, top_k=4, max_per_feature=2), iterations=4, patience=0, count=6)
    assert [x["record"] for x in found.log][:2] == ["header", "baseline"] and found.log[-1]["record"] == "summary"
    assert found.accepted and found.scores == sorted(found.scores)
    assert found.scores[-1] > 1 - 0.25 * (1 - found.scores[0])
    assert found.stop in ("iterations", "no improvement", "no candidates")


VERDICT = "position long, id string, incumbent string, outcome string, delta double, at_unix long, host string, inputs int"


def verdict_rows(spark, rows):
    return spark.createDataFrame([(i, *r, "h", 3) for i, r in enumerate(rows)], VERDICT)


def test_replay_prefers_wins_then_old_failures(spark):
    log = verdict_rows(spark, [("a", "m1", "accepted", 0.5, 100), ("a", "m2", "rejected", -1.0, 200), ("b", "m1", "accepted", 0.9, 100), ("c", "m1", "rejected", 0.0, 10), ("d", "m1", "rejected", 0.0, 990), ("e", "now", "accepted", 5.0, 1), ("f", "m1", "accepted", 3.0, 1), ("g", "m1", "accepted", 9.0, 5), ("g", "m2", "rejected", 0.0, 990), ("g", "m3", "rejected", 0.0, 991)])
    carried = spark.createDataFrame([("f",)], "id string")
    got = [(r.place, r.id, r.kind) for r in verdicts.choose(log, "now", 3, carried, 1000, 500, 10).orderBy("place").collect()]
    assert got == [(1, "b", "win"), (2, "a", "win"), (3, "c", "retry")]
    assert {r.id for r in verdicts.known_failures(log, 1000, 500).collect()} == {"d"}
    assert verdicts.choose(log, "now", 4, carried, 1000, 500, 10).count() == 0


def test_prune_dedupes_then_ages_then_caps(spark):
    log = verdict_rows(spark, [("a", "m", "accepted", 1.0, 100), ("a", "m", "accepted", 1.0, 100), ("b", "m", "rejected", 0.0, 10), ("c", "m", "accepted", 1.0, 10), ("d", "m", "rejected", 0.0, 90), ("e", "m", "rejected", 0.0, 95)])
    fate = {r.position: r.fate for r in verdicts.prune(log, 100, 90, 50, 2).collect()}
    assert fate == {0: "duplicate", 1: "kept", 2: "stale-rejected", 3: "stale-accepted", 4: "over-cap", 5: "kept"}
    assert verdicts.unfiled(log, log.where("id = 'a'")).count() == 4


def test_fixed_width_files(spark, tmp_path, monkeypatch):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.bin").write_bytes(struct.pack("<6f", 1, 2, 3, 4, NAN, 6))
    rows = files.read_records(spark, f"file://{tmp_path}/c", 2, 1).orderBy("record_id").collect()
    assert [(r.number, r.f0, r.y0) for r in rows] == [(0, 1.0, 3.0), (1, 4.0, 6.0)] and math.isnan(rows[1].f1)
    files.write_records(spark.createDataFrame([(1.5, 2.0, 3.0)], "f0 float, f1 float, y0 float"), str(tmp_path / "c" / "b.bin"), ["f0", "f1", "y0"])
    assert files.read_records(spark, f"file://{tmp_path}/c", 2, 1).count() == 3
    monkeypatch.setattr(files, "SPLIT_BYTES", 24)  # two records a task
    (tmp_path / "c" / "c.bin").write_bytes(struct.pack("<33f", *range(33)))
    (tmp_path / "c" / "empty.bin").write_bytes(b"")
    whole = files.read_records(spark, f"file://{tmp_path}/c", 2, 1)
    found = whole.orderBy("record_id").collect()
    assert [r.record_id for r in found] == list(range(14)) and [r.f0 for r in found[3:]] == [3.0 * i for i in range(11)] and [r.number for r in found[3:]] == list(range(11))
    assert whole.rdd.getNumPartitions() == 8
    (tmp_path / "c" / "odd.bin").write_bytes(b"12345")
    with pytest.raises(ValueError):
        files.read_records(spark, f"file://{tmp_path}/c", 2, 1)


def test_read_verdicts_of_files_and_folders(spark, tmp_path):
    folder = tmp_path / "corpus-x"
    folder.mkdir()
    (folder / "h.jsonl").write_text('{"id":"a","outcome":"accepted","delta":1.0,"at_unix":5}\nnot json\n{"id":"b","outcome":"rejected"}\n')
    assert {r.id for r in files.read_verdicts(spark, f"file://{tmp_path}", "x").collect()} == {"a", "b"}
    assert files.corpora_in(spark, f"file://{tmp_path}") == ["x"]
    assert files.read_verdicts(spark, f"file://{tmp_path}", "none").count() == 0 and files.corpora_in(spark, f"file://{tmp_path}/nowhere") == []
    with pytest.raises(Exception):
        files.read_log(spark, f"file://{folder}", files.VERDICT).collect()


def test_appended_verdicts_are_read_and_pruned(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = [("a", "m", "accepted", 1.0, 100), ("a", "m", "accepted", 1.0, 100), ("b", "m", "rejected", 0.0, 10), ("c", "m", "accepted", 1.0, 10), ("d", "m", "rejected", 0.0, 90)]
    files.append_verdicts(verdict_rows(spark, rows[:3]), root, "x", "one")
    files.append_verdicts(verdict_rows(spark, rows[3:]).drop("position"), root, "x", "one")
    files.append_verdicts(verdict_rows(spark, rows[:1]), root, "x", "two")
    found = files.read_verdicts(spark, root, "x")
    assert sorted((r.id, r.host) for r in found.collect()) == [("a", "one"), ("a", "one"), ("a", "two"), ("b", "one"), ("c", "one"), ("d", "one")]
    plan = lambda v: verdicts.prune(v, 100, 80, 50)
    want = {"duplicate": 1, "kept": 2, "stale-rejected": 1, "stale-accepted": 1}
    assert files.prune_verdicts(spark, root, "x", "one", plan, dry_run=True) == want and files.read_verdicts(spark, root, "x").count() == 6

    def appended_meanwhile(v):
        files.append_verdicts(verdict_rows(spark, [("late", "m", "accepted", 1.0, 99)]), root, "x", "one")
        return plan(v)

    assert files.prune_verdicts(spark, root, "x", "one", appended_meanwhile) == want
    assert sorted(r.id for r in files.read_verdicts(spark, root, "x").where("host = 'one'").collect()) == ["a", "d", "late"]
    assert files.prune_verdicts(spark, root, "x", "nobody", plan) == {}

    def fails(v):
        raise RuntimeError

    with pytest.raises(RuntimeError):
        files.prune_verdicts(spark, root, "x", "one", fails)
    assert files.read_verdicts(spark, root, "x").count() == 4


def test_boosted_trees_move_the_threshold_to_the_float_before(spark):
    dump = json.dumps([{"nodeid": 0, "split": "f1", "split_condition": 0.5, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "leaf": 2.0}]}])
    (node,) = files.boosted_trees(dump)
    rows = corpus(spark, [[0, 0, 0], [0.5, 0.49, 0.51]], [0, 0, 0]).orderBy("record_id")
    assert [r.v for r in rows.select(patches.value_of(node).alias("v")).collect()] == [2.0, -1.0, 2.0]


def test_a_cache_never_gives_the_rows_of_another_key(spark, tmp_path):
    path, built = f"file://{tmp_path}/cache", []

    def build(n=None):
        built.append(1)
        return spark.range(len(built) if n is None else n)

    assert files.cached(spark, path, {"k": 1}, build).count() == 1
    assert files.cached(spark, path, {"k": 1}, build).count() == 1

    def stops():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        files.cached(spark, path, {"k": 2}, stops)
    assert files.cached(spark, path, {"k": 1}, stops).count() == 1  # untouched by the build that stopped
    assert files.cached(spark, path, {"k": 2}, build).count() == 2
    assert files.cached(spark, path, {"k": 1}, stops).count() == 1
    (folder,) = [p for p in (tmp_path / "cache").iterdir() if json.loads((p / "meta.json").read_text()) == {"k": 2}]
    (folder / ".meta.json.crc").unlink()
    for broken in (lambda: (folder / "meta.json").write_text("no json"), lambda: [x.unlink() for x in (folder / "data").iterdir()]):
        broken()
        assert files.cached(spark, path, {"k": 2}, lambda: spark.range(7)).count() == 7


def test_edges_and_residuals_are_kept_by_corpus_and_model(spark, tmp_path, monkeypatch):
    rows = corpus(spark, [np.arange(50)], np.zeros(50)).withColumn("y", F.col("f0") * 2)
    path = f"file://{tmp_path}/c"
    first = files.cached_edges(spark, path, rows, ["f0"], 4).collect()
    model = residuals.Model([{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}], "o")
    other = residuals.Model([{"id": "o", "squash": "IDENTITY", "bias": 1.0, "in": [("f0", 1.0)]}], "o")
    sums = [files.cached_residuals(spark, path, rows, m).agg(F.sum("residual")).first()[0] for m in (model, other)]
    assert sums == [1225.0, 1175.0]
    monkeypatch.setattr(files, "build_edges", None)
    monkeypatch.setattr(files, "compute_residuals", None)
    assert files.cached_edges(spark, path, rows, ["f0"], 4).collect() == first and files.cached_residuals(spark, path, rows, other).count() == 50
    with pytest.raises(TypeError):
        files.cached_edges(spark, path, rows.where("f0 > 3"), ["f0"], 4)


@pytest.mark.parametrize("keys", [lambda i: 2 * i + 1, lambda i: i * 8 + i % 7, lambda i: i**3])
def test_a_stride_counts_records_not_keys(spark, keys):
    rows = spark.createDataFrame([(keys(i), float(i)) for i in range(3000)], "record_id long, f0 float").repartition(5)
    order = sorted(keys(i) for i in range(3000))
    for target in (10, 100, 2999, 3000):
        k = -(-3000 // target)
        want = [x for i, x in enumerate(order) if i % k == 0]
        assert sorted(r.record_id for r in binning.stride_sample(rows, target).collect()) == want and len(want) <= target
        assert sorted(r.record_id for r in sampling.stride(rows, target).collect()) == want
    assert sorted(r.position for r in binning.numbered(rows).collect()) == list(range(3000))
    assert [r.record_id for r in binning.every(rows, 7, 3).orderBy("record_id").collect()] == [x for i, x in enumerate(order) if (i + 3) % 7 == 0]
    assert binning.numbered(rows.limit(0)).count() == 0
    assert binning.build_edges(rows, ["f0"], 8, 100).count() == 7


def test_strata_are_quarters_also_with_ties(spark):
    values = [0.0] * 700 + [1.0] * 200 + [2.0] * 103
    rows = spark.createDataFrame([(7 * i + 3, v) for i, v in enumerate(values)], "record_id long, residual float").repartition(3)
    found = sampling.with_stratum(rows, sampling.strata_bounds(rows)).orderBy("record_id").collect()
    n = len(values)
    assert [r.stratum for r in found] == [next(s for s in range(4) if i < (s + 1) * n // 4) for i in range(n)]
    assert residuals.kth(rows, "record_id", 500) == 3503


def test_false_positives_and_negatives_of_the_screen(spark):
    i = np.arange(400)
    rows = corpus(spark, [np.where(7 * i % 5 < 2, 1, -1)], np.where(7 * i % 5 < 2, 0.3, 0)).persist()
    good = patches.split(0, 0.0, patches.leaf(0.0), patches.leaf(0.3))
    bad = patches.scaled(good, -1)
    one = promotion.promote(rows, [("good", [good]), ("bad", [bad])], count=1, rate=0.5, bypass_count=1)
    assert (one["promoted"], one["bypass"], one["false_positives"], one["false_negatives"]) == (["good", "bad"], ["bad"], 0, 0)

    def turned(rows, candidates):  # a screen that is wrong about everything
        real = promotion.score_all(rows, candidates)
        base = real["baseline"][0]
        return {k: (v[0] if rows.count() == 400 else 2 * base - v[0], v[1], v[2]) for k, v in real.items()}

    two = promotion.promote(rows, [("good", [good]), ("bad", [bad])], count=1, rate=0.5, bypass_count=1, scorer=turned)
    assert (two["promoted"], two["false_positives"], two["false_negatives"], two["winner"]) == (["bad", "good"], 1, 1, "good")
    for odd in ({}, {"baseline": (1.0, 0.0, 1)}, {"baseline": (float("nan"), 0.0, 1), "good": (1.0, 0.0, 1), "bad": (1.0, 0.0, 1)}):
        with pytest.raises(ValueError):
            promotion.promote(rows, [("good", [good]), ("bad", [bad])], scorer=lambda *a: odd)
