"""Fingerprints, the trie join and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import components, simhash


def brute_fingerprint(text, width=3):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values, budget):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near_values(rng, n):
    values = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(values) < n:
        v = rng.choice(values)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    return values


@pytest.mark.parametrize("budget", [0, 1, 3, 5])
def test_trie_join_keeps_every_connection(budget):
    values = sorted(set(near_values(random.Random(budget), 400)))
    edges = simhash.trie_links(values, budget)
    assert all((values[i] ^ values[j]).bit_count() <= budget for i, j in edges)
    parent = brute_classes(values, budget)
    got = simhash.Forest(len(values))
    for i, j in edges:
        got.join(i, j)
    same = {}
    for i in range(len(values)):
        assert same.setdefault(parent[i], got.find(i)) == got.find(i)
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("hot", [2048, 3])
def test_classes_equal_brute_force_also_when_groups_are_hot(spark, hot):
    values = near_values(random.Random(9), 200)
    rows = [(i, simhash.signed(v)) for i, v in enumerate(values)] + [(None, simhash.signed(values[0])), (None, 77)]
    made = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(made, 3, hot).collect()}
    parent = brute_classes([*values, 77], 3)
    for i, v in enumerate(values):
        assert got[simhash.signed(v)] == min(j for j in range(len(values)) if parent[j] == parent[i])
    assert got[77] is None or got[77] in range(200)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_query_with_nulls_short_texts_repeats_and_clashing_columns(spark):
    long = "one two three four five six seven eight nine ten " * 50
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Word"), (5, "word"), (6, "a b"), (7, long), (8, long + "end"), (8, long + "end"), (None, long), (10, "É x y z"), (11, "é x y z")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp int, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t or "") for _, t in rows]
    parent = brute_classes(prints, 3)
    want = [(i, f"{p:016x}", min(rows[j][0] for j in range(len(rows)) if parent[j] == parent[k] and rows[j][0] is not None)) for k, ((i, _), p) in enumerate(zip(rows, prints))]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    monkey = simhash.fingerprint(("x y z w " * 20_000).encode())
    assert monkey == brute_fingerprint("x y z w " * 20_000)


def jaccard(a, b):
    cut = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("hot", [2048, 16])
def test_near_copies_are_those_of_exact_similarity_and_no_others(spark, hot):
    rng = random.Random(5)
    texts = []
    for family in range(150):  # a text and one that shares a run of it, around the least similarity on both sides
        n = rng.choice([12, 40, 200])
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(n)]
        cut = rng.randint(n * 6 // 10, n - 1)
        texts += [base, base[:cut] + [f"f{family}x{i}" for i in range((n - cut) // 3)]]
    line = "this very line stands in each of them".split()
    texts += [line * 40 + texts[0], line + texts[0]]  # repeated lines: the sets are nearly equal
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                parent = [parent[j] if p == parent[i] else p for p in parent]
    want = sorted({min(j for j, q in enumerate(parent) if q == p) for p in parent})
    assert len(want) > 160 and len(texts) - len(want) > 30  # both kinds are there
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs, hot=hot).collect()) == want


def test_exact_links_join_every_similar_pair_of_large_families():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        for _ in range(30):
            some = base.copy()
            some[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(0, 1 << 60, dtype=np.uint64)
            sets.append(np.unique(some))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if (n := len(np.intersect1d(sets[i], sets[j]))) * 5 >= 4 * (len(sets[i]) + len(sets[j]) - n)]
    want, got = simhash.Forest(len(sets)), simhash.Forest(len(sets))
    for i, j in near:
        want.join(i, j)
    edges = simhash.exact_links(sets)
    for i, j in edges:
        got.join(i, j)
    assert {(max(e), min(e)) for e in edges} <= set(near) and len(edges) == len(want.edges)
    assert [got.find(i) for i in range(len(sets))] == [want.find(i) for i in range(len(sets))]


def test_near_copies_are_found_by_the_trie_of_fingerprints_and_held_to_exact_similarity(spark, monkeypatch):
    rng, signatures, keys = random.Random(8), simhash.signatures, {}
    rows = []
    for family in range(40):  # a text, a copy with another end, and one that shares its first third
        base = [f"f{family}w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(3 * family, " ".join(base)), (3 * family + 1, " ".join([*base[:-1], "end"])), (3 * family + 2, " ".join(base[:100] + [f"f{family}x{i}" for i in range(200)]))]
    prints = {i: simhash.set_fingerprint(simhash.shingle_set(t.encode())) for i, t in rows}
    for i, t in rows[:9]:
        own = {xxhash.xxh64_intdigest(" ".join(t.split()[k : k + 5]).encode(), 42) for k in range(296)}
        assert prints[i] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    close = {i + 1 for i in range(0, 120, 3) if (prints[i] ^ prints[i + 1]).bit_count() <= 3}
    assert len(close) >= 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # no two texts share a band: what goes is what the trie links
    monkeypatch.setattr(simhash, "signatures", lambda *a: signatures(*a).withColumn("bands", F.array(F.xxhash64("shingles"))).withColumns(keys))
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(range(120)) - close
    keys["fp"] = F.lit(0).cast("long")  # and if all fingerprints are linked, exact similarity decides
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == {i for i in range(120) if i % 3 != 1}
