"""Lines, logs, identities, verdict stores, external scorers, reports of growing logs, and edges of many features."""

import json
import sys

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ridgeline.operators import binning, external, patches, promotion, runlog, verdicts
from ridgeline.plans import queries
from ridgeline.sources import chunks, files, storage
from ridgeline.streaming import run_report


@pytest.mark.parametrize("split", ["100", "37m"])
def test_lines_have_their_numbers_whatever_the_splits(spark, tmp_path, split):
    want = []
    for name, n in (("b.txt", 40), ("a.txt", 25), ("sub/c.txt", 3)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(f"{name} line {i} {'x' * (i % 9)}\n" for i in range(n)))
    for name, n in (("a.txt", 25), ("b.txt", 40), ("sub/c.txt", 3)):
        want += [(name, i + 1, len(want) + i) for i in range(n)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        found = files.numbered_lines(spark, f"file://{tmp_path}").collect()
        assert sorted((r.path.split(tmp_path.name + "/")[1], r.line, r.number) for r in found) == sorted(want)
        assert all(f" line {r.line - 1} " in r.value + " " for r in found)
        (tmp_path / "a.txt").write_text('{"id": "x"}\n\n{"id": "y"}\nno json\n{"id": "z"}\n')
        with pytest.raises(PySparkException, match=r"a\.txt, line 4 is malformed: no json"):
            files.read_log(spark, f"file://{tmp_path}/a.txt", "id string").collect()
        with pytest.raises(PySparkException, match="line 4"):
            files.read_log(spark, f"file://{tmp_path}/a.txt", "id string").where("id = 'x'").count()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_two_writers_share_a_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one, two = files.LogWriter(spark, path), files.LogWriter(spark, path)
    one.append("header", timestamp=1)
    two.append("header", timestamp=2)
    one.append("baseline", score=0.5)
    files.LogWriter(spark, path).append("summary", stop="x")
    found = files.read_log(spark, path, runlog.LOG).orderBy("line").collect()
    assert [(r.line, r.record) for r in found] == [(0, "header"), (1, "header"), (2, "baseline"), (3, "summary")]


def verdict(name, at, outcome="rejected", **more):
    return json.dumps({"id": name, "outcome": outcome, "delta": 0.1, "incumbent": "m", "at_unix": at, "inputs": 3} | more) + "\n"


def test_verdicts_without_a_position_go_by_path_and_line(spark, tmp_path):
    folder = tmp_path / "corpus-c"
    folder.mkdir()
    (folder / "a.jsonl").write_text(verdict("p", 5) + "broken\n" + verdict("q", 5, "accepted"))
    (folder / "b.jsonl").write_text(verdict("p", 5, "accepted"))
    found = files.read_verdicts(spark, f"file://{tmp_path}", "c")
    assert [(r.id, r.outcome, r.position) for r in found.orderBy("position").collect()] == [("p", "rejected", 0), ("q", "accepted", 2), ("p", "accepted", 3)]
    assert {r.id: r.last_position for r in verdicts.evidence(found).collect()} == {"p": 3, "q": 2}


def test_a_prune_keeps_the_order_and_later_verdicts_come_after(spark, tmp_path):
    root = f"file://{tmp_path}"
    row = lambda name, at, outcome: spark.createDataFrame([(name, outcome, 0.1, "m", at, 3)], "id string, outcome string, delta double, incumbent string, at_unix long, inputs int")
    for name, at, outcome in (("a", 9, "accepted"), ("a", 9, "rejected"), ("b", 9, "accepted"), ("c", 9, "rejected")):
        files.append_verdicts(row(name, at, outcome), root, "c", "h")
    assert files.prune_verdicts(spark, root, "c", "h", lambda own: verdicts.prune(own, 10, 100, 100), dry_run=True) == {"kept": 3, "duplicate": 1}
    assert files.read_verdicts(spark, root, "c").count() == 4
    files.prune_verdicts(spark, root, "c", "h", lambda own: verdicts.prune(own, 10, 100, 100))
    files.append_verdicts(row("d", 9, "accepted"), root, "c", "h")
    found = files.read_verdicts(spark, root, "c").orderBy("position").collect()
    assert [(r.id, r.outcome) for r in found] == [("a", "rejected"), ("b", "accepted"), ("c", "rejected"), ("d", "accepted")]
    assert len({r.position for r in found}) == 4


def test_identities_tell_corpora_apart_and_files_by_their_listing(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "record_id long, f0 int")
    one, two = files.identity(frame([(1, 1), (1, 1), (2, 2)])), files.identity(frame([(7, 9), (7, 9), (2, 2)]))
    assert one != two and files.identity(frame([(2, 2), (1, 1), (1, 1)])) == one and files.identity(frame([(2, 2)])) != one
    plan = frame([(1, 1)]).agg(files.checksum_of(["record_id", "f0"]).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "hashpartitioning" not in plan
    path = f"file://{tmp_path}/corpus"
    spark.range(200).selectExpr("id AS record_id", "CAST(id % 17 AS FLOAT) AS f0").write.parquet(path)
    version = files.file_identity(spark, path)
    assert files.file_identity(spark, path) == version and version["files"] > 0
    rows, cache = spark.read.parquet(path), f"file://{tmp_path}/cache"
    built = sorted(map(tuple, files.cached_edges(spark, cache, rows, ["f0"], 4, version).collect()))
    group = "lookup-of-edges"
    spark.sparkContext.setJobGroup(group, group)
    files.cached_edges(spark, cache, rows, ["f0"], 4, files.file_identity(spark, path))
    ran = [i for j in spark.sparkContext.statusTracker().getJobIdsForGroup(group) for i in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(ran) <= 2  # its note and the table's schema, nothing of the corpus
    spark.range(5).selectExpr("id AS record_id", "CAST(id AS FLOAT) AS f0").write.mode("append").parquet(path)
    assert files.file_identity(spark, path) != version and built


def test_small_files_are_replaced_or_added_whole(spark, tmp_path):
    path = f"file://{tmp_path}/x/best.json"
    storage.write_text(spark, "one", path)
    storage.write_text(spark, "two", path)
    assert storage.read_text(spark, path) == "two" and [p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")] == ["best.json"]
    assert not storage.add_text(spark, "three", path) and storage.read_text(spark, path) == "two"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(i, float(rng.normal()), float(rng.normal())) for i in range(300)]
    return spark.createDataFrame(made, "record_id long, f0 float, residual float").repartition(3).persist()


STUMP = patches.split(0, 0.25, patches.leaf(-0.5), patches.leaf(0.5))
COHORT = [("a", [STUMP]), ("b", [STUMP, patches.scaled(STUMP, 0.5)])]


def test_a_program_as_scorer_promotes_the_same(spark, rows):
    score = external.scorer([sys.executable, "-c", queries.PROGRAM], ["f0", "residual"])
    ours, theirs = promotion.score_all(rows, COHORT), score(rows, COHORT)
    assert set(ours) == set(theirs) and all(theirs[k][:3] == pytest.approx(v[:3], abs=1e-6) for k, v in ours.items())
    how = dict(count=1, rate=0.5, phase=1)
    assert promotion.promote(rows, COHORT, scorer=score, **how)["winner"] == promotion.promote(rows, COHORT, **how)["winner"]


@pytest.mark.parametrize(
    ("program", "fault"),
    [
        ("import sys; sys.stdin.read(); sys.exit('boom')", "ended with 1: boom"),
        ("import time; time.sleep(60)", "took more than"),
        ("import sys; sys.stdin.read(); print('well')", "no JSON"),
        ("import os; os._exit(3)", "ended with 3"),
    ],
)
def test_a_program_that_fails_fails_the_scoring(rows, program, fault):
    with pytest.raises(external.ScorerError, match=fault):
        external.scorer([sys.executable, "-c", program], ["f0", "residual"], seconds=2)(rows, COHORT)
    with pytest.raises(external.ScorerError, match="No such file"):
        external.scorer(["/nowhere/program"], ["f0"])(rows, COHORT)


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ('{"records": 2, "sse": {"baseline": 1.0}}', "lacks 'a'"),
        ('{"records": 2, "sse": {"baseline": 1.0, "a": 0.5, "c": 0.1}}', "has 'c'"),
        ('{"records": 3, "sse": {"baseline": 1.0, "a": 0.5}}', "over 3 records"),
        ('{"records": true, "sse": {"baseline": 1.0, "a": 0.5}}', "over True records"),
        ('{"records": 2, "sse": {"baseline": NaN, "a": 0.5}}', "'baseline' is nan"),
        ('{"records": 2, "sse": {"baseline": 1.0, "a": -0.5}}', "'a' is -0.5"),
        ('{"records": 2, "sse": {"baseline": 1.0, "a": "0.5"}}', "'a' is '0.5'"),
        ('{"records": 2, "sse": {"baseline": 1.0, "a": 0.5, "a": 0.6}}', "twice"),
        ('{"records": 2, "sse": {"baseline": 1.0, "a": 0.5}, "more": 1}', "other fields"),
        ('{"records": 2, "sse": {"baseline": 1.0, "a": 0.5}} trailing', "no JSON"),
        ("", "no JSON"),
    ],
)
def test_answers_are_read_strictly(text, fault):
    with pytest.raises(external.ScorerError, match=fault):
        external.parse_answer(text, ["baseline", "a"], 2)
    assert external.parse_answer('{"records": 2, "sse": {"baseline": 1, "a": 0.5}}', ["baseline", "a"], 2) == {"baseline": 1.0, "a": 0.5}


def test_a_report_grows_with_its_logs_also_across_restarts(spark, tmp_path):
    logs, folder = f"file://{tmp_path}/logs", f"file://{tmp_path}/state"
    assert run_report.reports(spark, folder).count() == 0
    writers = {run: files.LogWriter(spark, f"{logs}/{run}") for run in ("r1", "r2")}
    steps = [
        [("r1", "header", dict(timestamp=100, seed=1)), ("r1", "baseline", dict(score=0.25))],
        [("r1", "experiment", dict(iteration=0, timestamp=110, accepted=True, winner="a", improvement=0.1, generated=5, search_ms=7, full_ms=3)), ("r2", "header", dict(timestamp=50))],
        [("r1", "experiment", dict(iteration=1, timestamp=130, accepted=False, error="the baseline disagrees", veto=True, generated=2, promoted=2, false_positives=1, discarded=[{"id": "x", "reason": "y"}])), ("r2", "baseline", dict(score=0.5))],
        [("r1", "summary", dict(timestamp=140, stop="iterations", opening_score=0.25, final_score=0.35, wall_ms=40_000))],
    ]
    for step in steps:
        for run, record, fields in step:
            writers[run].append(record, **fields)
        run_report.follow(spark, logs, folder, at_once=True, per_batch=2).awaitTermination()
        got = {r.run: r.asDict() for r in run_report.reports(spark, folder).collect()}
        for run in got:
            want = runlog.report(files.read_log(spark, f"{logs}/{run}", runlog.LOG)).first().asDict()
            assert got[run] == want | {"run": run}
    assert set(got) == {"r1", "r2"} and got["r1"]["final_score"] == 0.35 and got["r1"]["vetoes"] == 1 and len(run_report.versions(spark, folder)) <= 2
    # a batch that is done again leaves the same
    last = run_report.versions(spark, folder)[-1]
    before = sorted(map(str, run_report.reports(spark, folder).collect()))
    lines = files.read_log(spark, f"{logs}/r1", runlog.LOG).where("record = 'summary'").withColumn("run", F.lit("r1"))
    run_report.advance(spark, lines, last, folder)
    assert sorted(map(str, run_report.reports(spark, folder).collect())) == before


def test_edges_of_many_features_are_those_of_few(spark):
    rng = np.random.default_rng(5)
    width = 150
    x = np.round(rng.normal(size=(400, width)), 1).astype(np.float32)
    x[:, 3] = 1.0
    x[::7, 5] = np.nan
    x[::9, 6] = np.inf
    x[:, 8] = np.nan
    x[::2, 9] = -0.0
    names = [f"f{i}" for i in range(width)]
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "record_id long, " + ", ".join(f"{n} float" for n in names)).repartition(5)
    plain = binning.edges_of(binning.value_counts(rows, names), 16)
    blocked = binning.build_edges(rows, names, 16)
    key = lambda df: sorted((r.feature, r.bin, r.threshold) for r in df.collect())
    assert key(blocked) == key(plain)
    assert "bin" in blocked.columns and binning.blocked_edges(rows.limit(0).select(F.array(*names).alias("x")), width, 16).count() == 0


def test_chunks_are_read_one_by_one_and_errors_name_them(spark):
    listed = spark.createDataFrame([(k, 100 * k, 3 + k % 4) for k in range(12)], "chunk long, first long, n int").repartition(4)

    def read(chunk):
        ids = np.arange(chunk["first"], chunk["first"] + chunk["n"])
        for some in np.array_split(ids, 2):
            yield {"record_id": some, "f0": (some / 7).astype(np.float32)}

    found = chunks.frame(listed, read, "record_id long, f0 float")
    assert sorted(r.record_id for r in found.collect()) == [100 * k + i for k in range(12) for i in range(3 + k % 4)]
    assert found.schema.simpleString() == "struct<record_id:bigint,f0:float>" and chunks.frame(listed.limit(0), read, "record_id long, f0 float").count() == 0

    def odd(chunk):
        yield {"record_id": [1, 2], "f0": [0.5]} if chunk["chunk"] == 7 else {"record_id": [1], "f0": [0.5]}

    with pytest.raises(Exception, match="chunk.*7"):
        chunks.frame(listed, odd, "record_id long, f0 float").collect()
    with pytest.raises(Exception, match="gave no f0"):
        chunks.frame(listed, lambda chunk: [{"record_id": [1]}], "record_id long, f0 float").collect()
