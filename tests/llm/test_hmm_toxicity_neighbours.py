"""The trained models and the search, against brute force or held-out rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm import hmm, neighbours, toxicity


def brute_forward(model, codes):
    alpha, total = model.start * model.emit[codes[0]], 0.0
    for c in codes[1:]:
        total += math.log10(alpha.sum())
        alpha = (alpha / alpha.sum()) @ model.move * model.emit[c]
    return total + math.log10(alpha.sum())


def random_model(rng, size):
    rows = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[:-1])
    return hmm.Hmm(rows(hmm.STATES), rows(hmm.STATES, hmm.STATES), np.ascontiguousarray(rows(hmm.STATES, size).T))


def test_segments_give_the_whole_sequence_its_exact_likelihood():
    rng = np.random.default_rng(1)
    model = random_model(rng, 50)
    texts = [rng.integers(0, 50, n) for n in (1, 2, 127, 128, 129, 300, 5000, 1, 256)]
    assert hmm.log_likelihoods(model, texts) == pytest.approx([brute_forward(model, t) for t in texts], rel=1e-10)


def test_expected_counts_are_those_of_whole_sequences():
    rng = np.random.default_rng(2)
    model, size = random_model(rng, 20), 20
    texts = [rng.integers(0, size, n) for n in (5, 127, 128, 129, 200, 700, 1)]
    starts, moves, emits = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((size, hmm.STATES))
    for s in texts:
        a = [model.start * model.emit[s[0]]]
        for c in s[1:]:
            a.append(a[-1] @ model.move * model.emit[c])
            a[-1] /= a[-1].sum()
        b = [np.ones(hmm.STATES)]
        for c in s[:0:-1]:
            b.insert(0, model.move @ (model.emit[c] * b[0]))
            b[0] /= b[0].sum()
        for i, c in enumerate(s):
            emits[c] += a[i] * b[i] / (a[i] * b[i]).sum()
            if i:
                pair = a[i - 1][:, None] * model.move * (model.emit[c] * b[i])[None]
                moves += pair / pair.sum()
        starts += a[0] * b[0] / (a[0] * b[0]).sum()
    for got, want in zip(hmm.expected(model, texts, size), (starts, moves, emits)):
        assert got == pytest.approx(want, rel=1e-8, abs=1e-9)


def test_long_tokens_are_tokens_like_any_other(spark):
    link, other = "http://" + "x" * 90 + "/a1b", "http://" + "x" * 90 + "/a2b"
    docs = spark.createDataFrame([(i, f"see {link} {'and ' + other if i % 3 else ''}") for i in range(60)], "doc_id long, text string")
    known = hmm.symbols(hmm.count_tokens(docs))
    a, b = (hmm.key_of(hmm.tokens_of(x.encode())[0]) for x in (link, other.upper()))
    assert a != b and len(a) <= hmm.TOKEN_BYTES and a[:1] == b" " and {a, b} <= set(known.ids) and known.mass[known.ids[a]] > known.mass[known.ids[b]]
    scored = {r.doc_id: r for r in hmm.score(docs).collect()}
    training = [t for i, t in ((r.doc_id, r.text) for r in docs.collect()) if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*t.split(), ""])
    n, v = sum(counts.values()), len(counts)
    want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*f"see {link} ".split(), ""])
    assert scored[0].base_score == pytest.approx(want, rel=1e-9) and scored[0].n_known == 3


def test_the_start_sees_all_of_a_long_text():
    codes = np.arange(100_000, dtype="<u4")
    few = hmm.spread(codes, 16_384)
    assert len(few) == 16_384 and few[0] == 0 and few[-1] == 99_999 and np.diff(few).max() < 1000
    assert hmm.spread(codes[:500], 16_384).tolist() == list(range(500))


def test_scores_counts_and_proper_shares(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 20)  # a small head, so that tokens outside of it matter
    trained, train = [], hmm.train
    monkeypatch.setattr(hmm, "train", lambda rows, known, rounds: trained.append((train(rows, known, rounds), known)) or trained[0][0])
    rng = random.Random(3)
    kinds = [[f"{p}{i}" for i in range(40)] for p in ("a", "b")]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(120)] + [(130 + i, "much" * 50 + " a1") for i in range(30)] + [(200, None), (201, ""), (202, "A0 a0 unseen"), (None, "a1"), (203, "b1 " * 4000), (203, "b1 " * 4000)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, n long, token string")
    got = hmm.score(docs, rounds=2).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in got:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(t in counts for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        model, known = trained[0]
        alpha, total = model.start, 0.0  # the plain forward recursion; a token outside the head has its add-one share of its class
        for k, t in enumerate(tokens):
            symbol = known.ids.get(t, len(known.ids) + zlib.crc32(t[-3:]) % hmm.CLASSES)
            own = 1.0 if t in known.ids else (counts[t] + 1) / (1 + sum(c + 1 for u, c in counts.items() if u not in known.ids and hmm.class_of(u) == hmm.class_of(t)))
            alpha = (alpha if k == 0 else alpha @ model.move) * model.emit[symbol] * own
            total += math.log10(alpha.sum())
            alpha /= alpha.sum()
        assert r.score == pytest.approx(total, rel=1e-9)
    own = [r for r in got if r.held_out and r.n_tokens > 30]
    assert own and sum(r.score for r in own) > sum(r.base_score for r in own)  # two kinds of text: the states must help
    assert hmm.score(docs.limit(0)).count() == 0
    known = hmm.symbols(hmm.count_tokens(docs.where(~hmm.held_out())))
    assert known.ids.keys().isdisjoint({b"much" * 50}) and 10 < len(known.ids) <= 35  # a long token is in no head
    assert known.mass.sum() == pytest.approx(1) and known.total == n and known.distinct == v


INSULTS = ["idiot", "moron", "scum"]


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("wo", "ra", "lim", "the", "and") for b in ("ta", "ne", "do", "shi", "x")]
    out = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(10, 120))]
        bad = i % 4 == 0
        for _ in range(3 * bad):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        out.append((i, " ".join(text), int(bad)))
    return out


def test_toxicity_on_held_out_rows_and_odd_ones(spark):
    rows = toxic_rows(400, 1)
    odd = [(1001, None), (1002, ""), (1003, "the idiot"), (None, "moron wota"), (1004, "wota rane " * 40_000), (1005, "wota rane " * 40_000 + "scum moron idiot"), (1002, "")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in [*((i, t) for i, t, _ in rows), *odd]], "doc_id long, text string, score int, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1003, None), (1002, 7)], "doc_id long, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    assert (by[1001].predicted, by[1002].predicted, by[1004].predicted, by[1005].predicted) == (0, 0, 0, 1)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in by.items() if not r.predicted}
    assert {r.score for r in toxicity.classify(docs.limit(5), labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def brute_score(net, text):
    """The network by plain loops, and the threshold of the text's language."""
    words = [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]
    features = [[zlib.crc32(w) % toxicity.BUCKETS, *(zlib.crc32(w[:n], n) % toxicity.BUCKETS if len(w) > n else toxicity.PAD for n in (4, 6))] for w in words]
    vectors = [sum(net.table[i].astype(float) for i in own) for own in features]
    vectors += [np.zeros(toxicity.DIM)] * (2 if words else 3)
    pooled = []
    for f in net.filters:
        for k in range(toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[at + j] @ f[j][:, k]) for j in range(len(f))) for at in range(max(1, len(words)))))
    z = sum(max(p + s, 0) * o for p, s, o in zip(pooled, net.shift, net.out)) + net.bias
    limit = net.limits.get(net.languages.predict(text)[0], net.limit)
    return 1 / (1 + math.exp(-max(-40, min(40, net.slope * (z - limit) + math.log(0.7 / 0.3)))))


def test_scores_are_those_of_the_network_with_a_threshold_for_each_learned_language(spark, monkeypatch):
    rng = random.Random(7)
    words = {"xx": [f"{a}{b}" for a in ("kra", "mol", "ti") for b in ("ska", "vot", "no")], "yy": [f"{a}{b}" for a in ("ee", "uo", "aja") for b in ("lli", "ssa", "ppe")]}
    rows = []
    for i in range(500):
        lang = ("xx", "yy")[i % 2]
        text = [rng.choice(words[lang]) for _ in range(rng.randint(5, 60))]
        bad = i % 4 < 2
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text), lang, int(bad)))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(9000, None, "xx"), (9001, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    nets, learned = [], toxicity.learned
    monkeypatch.setattr(toxicity, "learned", lambda *a: nets.append(learned(*a)) or nets[0])
    got = {r.doc_id: r.score for r in toxicity.classify(docs, labels).collect()}
    assert set(nets[0].limits) == {"xx", "yy"}
    for i, text in [*((r[0], r[1]) for r in rows[:120]), (9000, ""), (9001, "")]:
        assert got[i] == pytest.approx(brute_score(nets[0], text), abs=1e-4)


def test_a_long_text_teaches_with_runs_from_all_over_it(spark):
    words = [b"%d" % i for i in range(100_000)]
    few = toxicity.spread(words)
    assert len(few) == toxicity.TEACH_WORDS and few[0] == b"0" and few[-1] == b"99999" and toxicity.spread(words[:50]) == words[:50]
    docs = spark.createDataFrame([(1, "wota " * 30)] * 300 + [(i, "idiot wota") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)] + [(i, 1) for i in range(2, 30)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 328  # an id that is repeated teaches once


def test_windows_pool_as_the_whole(monkeypatch):
    net = toxicity.ConvNet()
    ids = np.random.default_rng(1).integers(0, toxicity.BUCKETS, (100, 3))
    ids = np.concatenate([ids, np.full((2, 3), toxicity.PAD)])
    whole = net.logit(ids)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert net.logit(ids) == pytest.approx(whole, rel=1e-5)


def test_windows_find_the_largest_responses_of_the_whole(monkeypatch):
    net, rng = toxicity.ConvNet(), np.random.default_rng(2)
    texts = [np.concatenate([rng.integers(0, toxicity.BUCKETS, (n, 3)), np.full((2 if n else 3, 3), toxicity.PAD)]) for n in (100, 0, 1, 7, 8, 40)]
    pooled, places = net.largest(texts)
    assert [float(np.maximum(p + net.shift, 0) @ net.out + net.bias) for p in pooled] == pytest.approx([net.logit(t) for t in texts], rel=1e-4)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    again = net.largest(texts)
    assert again[0] == pytest.approx(pooled, rel=1e-5, abs=1e-6) and all((a == b).all() for a, b in zip(again[1], places))


def test_every_labelled_row_and_word_teaches_whatever_their_number(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, f"wota rane w{rng.randrange(10**6)}", 0) for i in range(6000)]
    for i in range(6000, 6200):  # long texts whose insult stands anywhere
        text = ["wota"] * 9000
        text[rng.randrange(9000)] = f"idiot{rng.randrange(10**6)}"
        rows.append((i, " ".join(text), 1))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, "a")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(99999, 1)], "doc_id long, toxic int")
    seen, start = [], toxicity.ConvNet.start_from
    monkeypatch.setattr(toxicity.ConvNet, "start_from", lambda net, *counted: seen.append(counted) or start(net, *counted))
    calibrated, calibrate = [], toxicity.ConvNet.calibrate
    monkeypatch.setattr(toxicity.ConvNet, "calibrate", lambda net, *counted: calibrated.append(counted) or calibrate(net, *counted))
    assert toxicity.learned(docs, labels) is not None
    want, n = np.zeros((2, toxicity.BUCKETS + 1)), [0, 0]
    kept = {r.doc_id for r in spark.range(6200).withColumnRenamed("id", "doc_id").where("pmod(xxhash64('calibrate', doc_id), 4) = 0").collect()}
    teach = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    for i, text, y in teach:
        if i not in kept:
            n[y] += 1
            want[y, np.unique(toxicity.buckets(toxicity.words_of(text), toxicity.Features()))] += 1
    (counts, by_class), (counted,) = seen[0], calibrated[0]
    assert list(by_class) == n and n[0] > 2800 and (counts == want).all()
    assert sum(c[2] for c in counted) + n[1] == sum(y for _, _, y in teach) and sum(c[3] for c in counted) / 2 + n[0] == sum(1 - y for _, _, y in teach)


def test_many_shards_learn_what_one_does(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD", 64)
    rows = toxic_rows(1200, 3)
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    right = [r.predicted == rows[r.doc_id][2] for r in toxicity.classify(docs, labels).collect() if r.held_out]
    assert len(right) > 300 and sum(right) >= 0.95 * len(right)


def brute_nearest(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % 100 == 0:
            away = sorted((math.dist(v, u), j) for j, u in good if j != i and len(u) == len(v))
            out[i] = [(j, d) for d, j in away[:k]]
    return {i: found for i, found in out.items() if found}


def test_neighbours_with_copies_and_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1200)]
    rows += [(i, rows[3][1]) for i in range(2000, 2040)] + [(3100, rows[3][1]), rows[7]]
    rows += [(5000, None), (5100, [0.0] * 8), (5200, [1.0] * 7), (5300, [float("nan")] * 8), (5400, [None] * 8), (None, [1.0] * 8), (5500, [float("inf")] + [0.0] * 7), (5600, [])]
    frame = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<float>, label int, score double")
    want = brute_nearest(rows, 10)
    monkeypatch.setattr(neighbours, "LEAF", 32)
    got: dict = {}
    for r in neighbours.nearest_neighbours(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {i: v for i, v in rows if v}
    for i, found in got.items():
        assert len(found) == 10 and found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(d == pytest.approx(math.dist(vectors[i], vectors[j]), abs=1e-12) for j, d in found)
    assert [j for j, _ in got[3100]] == [3, *range(2000, 2009)]  # ties to smaller ids
    few = frame.where("vec_id IN (0, 1, 2)")
    assert [(r.query_id, r["rank"]) for r in neighbours.nearest_neighbours(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert neighbours.nearest_neighbours(frame.limit(0)).count() == 0


def test_leaves_of_a_block_are_dealt_out_when_they_are_large():
    blocks = neighbours.Blocks([[3, 4, 20, 1], [0, 0, 0, 0]], 8)
    held = Counter(blocks.of_vector(0, 2, n << 33) for n in range(3000))
    assert max(held.values()) < 1.2 * min(held.values())
    keys = set(held)
    assert keys == set(blocks.of_query([(0, 2)])) and len(keys) == 3
    assert blocks.of_vector(0, 0, 1) == blocks.of_vector(0, 1, 9)


def test_a_search_over_many_blocks_and_parts_finds_what_one_block_does(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest(rows, 10)

    def search():
        return sorted(map(tuple, neighbours.nearest_neighbours(frame, effort=4.0).collect()))

    one = search()
    monkeypatch.setattr(neighbours, "BLOCK", 100)  # several blocks for each tree
    many = search()
    monkeypatch.setattr(neighbours, "LEAF", 400)  # leaves beyond a block: several parts
    parts = search()
    assert one == many == parts == sorted((q, k + 1, j, pytest.approx(d, abs=1e-12)) for q, found in want.items() for k, (j, d) in enumerate(found))


def clustered(rng, clusters, each, size=8):
    centres = rng.normal(size=(clusters, size)) * 20
    return (centres[:, None] + rng.normal(size=(clusters, each, size)) * 0.1).reshape(-1, size).astype(np.float32).astype(float)


@pytest.mark.parametrize("shape", ["clusters", "isotropic", "line"])
def test_planes_beyond_the_limit_hide_nothing(monkeypatch, shape):
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rng = np.random.default_rng(8)
    held = {"clusters": lambda: clustered(rng, 30, 40), "isotropic": lambda: rng.normal(size=(1200, 8)), "line": lambda: np.outer(np.arange(1200.0), np.ones(8))}[shape]()
    forest = neighbours.Forest(held[rng.permutation(len(held))[:600]], len(held))
    leaves = forest.route(held)
    sizes = [np.bincount(leaves[:, t], minlength=forest.inner + 1).tolist() for t in range(neighbours.TREES)]
    opened = 0
    for i in range(0, len(held), 40):
        away = np.sqrt(((held - held[i]) ** 2).sum(1))
        limit = float(np.sort(away)[10])
        found = set(forest.open(held[i], sizes, float("inf"), limit=limit))
        opened += sum(sizes[t][leaf] for t, leaf in found)
        for j in np.flatnonzero(away <= limit):
            assert all((t, int(leaf)) in found for t, leaf in enumerate(leaves[j]))
    share = opened / (neighbours.TREES * len(held) * 30)
    assert share < 0.1 if shape != "isotropic" else share > 0.5


@pytest.mark.parametrize("first", [1, 150])
def test_a_second_wave_makes_clusters_exact_within_a_small_effort(spark, monkeypatch, first):
    for name, value in (("LEAF", 32), ("BLOCK", 100), ("FIRST", first)):
        monkeypatch.setattr(neighbours, name, value)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(np.random.default_rng(9), 40, 60))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_nearest(rows, 10)
    got = sorted(map(tuple, neighbours.nearest_neighbours(frame, effort=0.5).collect()))
    assert got == sorted((q, k + 1, j, pytest.approx(d, abs=1e-9)) for q, found in want.items() for k, (j, d) in enumerate(found))


def test_vectors_of_other_lengths_are_held_against_their_own(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(10)
    sizes = [8] * 300 + [5] * 180 + [3] * 4 + [2]
    rows = [(50 * i, [float(np.float32(x)) for x in rng.normal(size=n)]) for i, n in enumerate(sizes)]
    rows += [(100_001 + i, rows[310][1]) for i in range(15)]
    want = brute_nearest(rows, 10)
    assert {len(found) for found in want.values()} == {3, 10}
    got: dict = {}
    for r in neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), effort=4.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score, abs=1e-12)))
    assert got == want
