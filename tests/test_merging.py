"""Merged models against the model and the correction as columns, and models in numpy against models in columns."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import grafted, merging, patches, residuals
from ridgeline.operators.residuals import Model
from ridgeline.sources import artifacts

IDENTITY = Model([{"id": "o", "squash": "IDENTITY", "bias": 0.25, "in": [("f0", 0.5), ("f1", -1.0)]}], "o")
DEEP = Model(
    [{"id": "one", "type": "constant", "bias": 1.0}, {"id": "h", "squash": "TANH", "bias": -0.5, "in": [("f0", 0.7), ("f2", -0.3), ("one", 0.1)]}, {"id": "o", "squash": "LOGISTIC", "bias": 0.1, "in": [("h", 1.5), ("f1", 0.2)]}], "o"
)
BRANCHED = Model([{"id": "h", "squash": "RELU", "bias": 0.0, "in": [("f0", 1.0)]}, {"id": "o", "squash": "IF", "bias": 0.5, "in": [("f1", 1.0, "condition"), ("h", 1.0, "positive"), ("f2", 2.0)]}], "o")
BRANCHED_BOTH = Model([{"id": "h", "squash": "RELU", "bias": 0.0, "in": [("f0", 1.0)]}, {"id": "o", "squash": "IF", "bias": 0.5, "in": [("f1", 1.0, "condition"), ("h", 1.0, "positive"), ("f2", 2.0, "negative")]}], "o")
CLAMPED = Model(
    [
        {"id": "low", "type": "constant", "bias": -40.0},
        {"id": "high", "type": "constant", "bias": 50.0},
        {"id": "h", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0), ("f1", 1.0)]},
        {"id": "m", "squash": "MAXIMUM", "bias": 0.0, "in": [("h", 0.5), ("low", 1.0)]},
        {"id": "o", "squash": "MINIMUM", "bias": 0.125, "in": [("m", 2.0), ("high", 1.0)]},
    ],
    "o",
)
MODELS = {"identity": IDENTITY, "deep": DEEP, "branched": BRANCHED, "both": BRANCHED_BOTH, "clamped": CLAMPED}


def shapes(depth):
    """Every shape of a tree to a depth: None is a leaf."""
    if depth == 0:
        return [None]
    below = shapes(depth - 1)
    return [None, *itertools.product(below, below)]


def tree(shape, numbers):
    if shape is None:
        return patches.leaf(next(numbers) / 4)
    n = next(numbers)
    if n % 3 == 0:
        return patches.oblique([(0, 0.5), (2, -1.5)], n / 8, tree(shape[0], numbers), tree(shape[1], numbers))
    return patches.split(n % 3, n / 8, tree(shape[0], numbers), tree(shape[1], numbers))


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(float(np.float32(x)) for x in rng.normal(0, 2, 3))) for i in range(300)] + [(1000, 0.0, 0.0, 0.0), (1001, 0.125, 1.0, -0.5)]
    return spark.createDataFrame(rows, "record_id long, f0 float, f1 float, f2 float").coalesce(1).persist()


def arrays(records):
    found = records.orderBy("record_id").toPandas()
    return {f"f{i}": found[f"f{i}"].to_numpy().astype(float) for i in range(3)}


def value_in_numpy(node, x):
    if "correction" in node:
        return np.full(len(x["f0"]), np.float32(node["correction"]), dtype=float)
    total = sum(np.float32(w) * x[f"f{i}"].astype(np.float32) for i, w in node["terms"]) - np.float32(node["threshold"])
    return np.where(total > 0, value_in_numpy(node["right"], x), value_in_numpy(node["left"], x))


@pytest.mark.parametrize("name", sorted(MODELS))
@pytest.mark.parametrize("how", [{}, {"shared": False}, {"relay": True}, {"shared": False, "relay": True}], ids=str)
def test_every_shape_merged_is_the_model_and_its_correction(records, name, how):
    model, x = MODELS[name], arrays(records)
    rng = np.random.default_rng(2)
    every = shapes(3)[1:]
    assert len(every) == 25
    for shape in every:
        node = tree(shape, iter(rng.integers(-12, 13, 100).tolist()))
        merged, added = merging.merge(model, node, inputs=3, **how)
        assert set(added) == {n["id"] for n in merged.neurons} - {n["id"] for n in model.neurons}
        (before, _), (after, out) = model.forward(x, 302)["o"], merged.forward(x, 302)["o"]
        correction = value_in_numpy(node, x)
        if name == "clamped":  # where a clamp binds, the correction is capped
            want = np.minimum(2 * np.maximum(0.5 * (x["f0"] + x["f1"] + correction), -40), 50) + 0.125
            assert out == pytest.approx(want, abs=1e-9)
        else:
            assert after - before == pytest.approx(correction, abs=1e-9)
        assert merging.merged_ids(merged) == {patches.patch_id(node)}


@pytest.mark.parametrize("name", sorted(MODELS))
def test_columns_numpy_and_json_give_the_same(records, name, monkeypatch):
    node = patches.split(1, 0.25, patches.leaf(-0.5), patches.oblique([(0, 1.0), (2, 0.5)], 0.1, patches.leaf(0.25), patches.leaf(1.0)))
    merged, _ = merging.merge_all(MODELS[name], [node, patches.split(0, 0.0, patches.leaf(1.0), patches.leaf(-1.0))])
    merged = Model.from_json(merged.to_json())
    narrow = [(r.record_id, r.prediction, r.hint) for r in merged.columns(records).orderBy("record_id").collect()]
    monkeypatch.setattr(residuals, "COLUMN_WEIGHTS", 0)
    wide = merged.columns(records)
    assert wide.columns == [*records.columns, "prediction", "hint"]
    got = [(r.record_id, r.prediction, r.hint) for r in wide.orderBy("record_id").collect()]
    assert [r[0] for r in got] == [r[0] for r in narrow] and np.allclose([r[1:] for r in got], [r[1:] for r in narrow], atol=1e-5)
    out = merged.forward(arrays(records), 302)["o"][1]
    assert np.allclose([r[1] for r in narrow], out, atol=1e-5)
    assert merged.checksum == Model.from_json(merged.to_json()).checksum != MODELS[name].checksum


def test_a_large_model_is_computed_outside_of_columns(records):
    rng = np.random.default_rng(3)
    hidden = [{"id": f"h{k}", "squash": "TANH", "bias": float(rng.normal()), "in": [(f"f{i}", float(rng.normal())) for i in range(3)]} for k in range(400)]
    model = Model([*hidden, {"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": [(f"h{k}", float(rng.normal())) for k in range(400)]}], "o")
    found = model.columns(records.withColumn("y", F.lit(1.0).cast("float")))
    x = arrays(records)
    want = sum(np.tanh(h["bias"] + sum(x[s] * w for s, w in h["in"])) * model.neurons[-1]["in"][k][1] for k, h in enumerate(hidden))
    assert np.allclose([r.prediction for r in found.orderBy("record_id").collect()], want, atol=1e-4)
    assert residuals.compute_residuals(records.withColumn("y", F.lit(1.0).cast("float")), model).count() == 302


LEAF2 = patches.split(0, 1.0, patches.leaf(0.5), patches.leaf(-0.5))


@pytest.mark.parametrize(
    ("cause", "model", "node", "how"),
    [
        ("leaf", IDENTITY, patches.leaf(1.0), {}),
        ("non-finite", IDENTITY, patches.split(0, float("nan"), patches.leaf(0.0), patches.leaf(1.0)), {}),
        ("output", IDENTITY, LEAF2, {"output": 1}),
        ("feature", IDENTITY, patches.split(3, 0.0, patches.leaf(0.0), patches.leaf(1.0)), {"inputs": 3}),
        ("duplicate", IDENTITY, patches.oblique([(0, 1.0), (0, 2.0)], 0.0, patches.leaf(0.0), patches.leaf(1.0)), {}),
        ("taken", merging.merge(IDENTITY, LEAF2)[0], LEAF2, {}),
        ("no-anchor", Model([{"id": "a", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}, {"id": "b", "squash": "IDENTITY", "bias": 0.0, "in": [("f1", 1.0)]}, {"id": "o", "squash": "MINIMUM", "bias": 0.0, "in": [("a", 1.0), ("b", 1.0)]}], "o"), LEAF2, {}),
        ("no-anchor", Model([{"id": "o", "squash": "MAXIMUM", "bias": 0.0, "in": [("f0", 1.0), ("f1", 1.0)]}], "o"), LEAF2, {}),
        ("no-anchor", Model([{"id": "a", "squash": "TANH", "bias": 0.0, "in": [("f0", 1.0)]}, {"id": "o", "squash": "MINIMUM", "bias": 0.0, "in": [("a", 1.0), ("f1", 1.0)]}], "o"), LEAF2, {}),
        ("no-anchor", Model([{"id": "a", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}, {"id": "o", "squash": "MINIMUM", "bias": 0.0, "in": [("a", 0.0)]}], "o"), LEAF2, {}),
        ("no-anchor", Model([{"id": "m0", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0)]}, *[{"id": f"m{k}", "squash": "MINIMUM", "bias": 0.0, "in": [(f"m{k - 1}", 1.0)]} for k in range(1, 11)]], "m10"), LEAF2, {}),
    ],
)
def test_what_cannot_be_merged_says_why(cause, model, node, how):
    with pytest.raises(merging.MergeError) as error:
        merging.merge(model, node, **how)
    assert error.value.cause == cause


@pytest.mark.parametrize(
    "neurons",
    [
        [{"id": "o", "squash": "IDENTITY", "bias": float("inf"), "in": []}],
        [{"id": "o", "squash": "MEAN", "bias": 0.0, "in": []}],
        [{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0), ("f0", 2.0)]}],
        [{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": [("f0", 1.0, "positive")]}],
        [{"id": "h", "squash": "IDENTITY", "bias": 0.0, "in": []}, {"id": "c", "type": "constant", "bias": 1.0}, {"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": []}],
        [{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": []}, {"id": "h", "squash": "IDENTITY", "bias": 0.0, "in": []}],
        [{"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": []}, {"id": "o", "squash": "IDENTITY", "bias": 0.0, "in": []}],
    ],
)
def test_broken_graphs_are_refused(neurons):
    with pytest.raises(ValueError):
        Model(neurons, "o")


def test_shared_constants_are_reused_and_names_stay_free():
    first, added = merging.merge(DEEP, LEAF2)
    assert added == [f"patch-{patches.patch_id(LEAF2)}-split-0"] and first.neurons[0]["id"] == "one"  # the model's own constant of value 1
    second, added = merging.merge(first, patches.scaled(LEAF2, 2.0))
    assert len(added) == 1 and merging.merged_ids(second) == {patches.patch_id(LEAF2), patches.patch_id(patches.scaled(LEAF2, 2.0))}
    odd = Model([{"id": "patch-one-unit-0", "type": "constant", "bias": 2.0}, *IDENTITY.neurons], "o")
    merged, added = merging.merge(odd, LEAF2)
    assert added[0] == "patch-one-unit-1" and merging.merged_ids(merged) == {patches.patch_id(LEAF2)}
    assert merging.merge(merged, patches.scaled(LEAF2, 2.0))[1] == [f"patch-{patches.patch_id(patches.scaled(LEAF2, 2.0))}-split-0"]


@pytest.mark.parametrize("name", sorted(MODELS))
def test_scores_through_the_graph_are_those_of_merged_models(records, name):
    model = MODELS[name]
    rows = records.withColumn("y", (F.col("f0") * 0.3 + F.when(F.col("f1") > 0, 0.4).otherwise(-0.1)).cast("float")).repartition(3)
    rng = np.random.default_rng(6)
    cohort = [("one", [tree(shapes(2)[-1], iter(rng.integers(-12, 13, 100).tolist()))]), ("two", [tree(shapes(1)[-1], iter(rng.integers(-12, 13, 100).tolist())), patches.split(0, 0.5, patches.leaf(0.25), patches.leaf(-0.5))])]
    found = grafted.scorer(model)(rows, cohort)
    for candidate, parts in [("baseline", []), *cohort]:
        merged = merging.merge_all(model, parts)[0]
        want = merged.columns(rows).agg(residuals.mse(F.col("y"), F.col("prediction")).alias("m")).first().m
        assert found[candidate][1] == pytest.approx(want, abs=1e-6) and found[candidate][2] == 302
        splits = sum(patches.splits(p) for p in parts)
        assert found[candidate][0] == pytest.approx(1 - want - 2e-7 * splits, abs=1e-6)
    assert found["baseline"][3] == 0 and 0 < found["two"][3] <= 302
    assert grafted.scorer(model, carried=3)(rows.limit(0), [])["baseline"][:2] == (1 - 6e-7, 0.0)


def test_bundles_workspaces_and_tags(spark, tmp_path):
    bundle = artifacts.Bundle(3)
    assert not bundle.write(spark, f"file://{tmp_path}/none.json")
    bundle.accept([LEAF2], 0.5)
    assert bundle.write(spark, f"file://{tmp_path}/b.json") and json.loads((tmp_path / "b.json").read_text())["accepted"][0]["patches"][0]["id"] == patches.patch_id(LEAF2)
    bundle.accept([patches.split(7, 0.0, patches.leaf(0.0), patches.leaf(1.0))], 0.6)
    bundle.accept([LEAF2], 0.7)
    with pytest.raises(ValueError, match="beyond 3"):
        bundle.write(spark, f"file://{tmp_path}/c.json")
    path = f"file://{tmp_path}/best.json"
    for score in (0.25, 0.5):
        artifacts.write_best(spark, DEEP, {"score": artifacts.score_text(score)}, path)
    text = (tmp_path / "best.json").read_text()
    assert artifacts.read_tags(text) == ([("score", "0.500000")], {}) and artifacts.read_model(spark, path).checksum == DEEP.checksum
    checksum = artifacts.write_workspace(spark, path, f"file://{tmp_path}/work", {"run": 1})
    meta = json.loads((tmp_path / "work" / "meta.json").read_text())
    assert meta["checksum"] == checksum and meta["run"] == 1 and (tmp_path / "work" / "model.json").read_text() == text
    assert artifacts.read_tags('{"tags": [{"name": "a", "value": null}, 3], "neurons": [{"id": "x", "tags": [{"name": "b"}]}]}') == ([("a", "null")], {"x": [("b", "")]})
    assert artifacts.read_tags("nonsense") == ([], {})
    assert (artifacts.delta_text(0.000123), artifacts.delta_text(-1234.5)) == ("+1.23e-4", "-1.23e3") or artifacts.delta_text(-1234.5) == "-1.24e3"
