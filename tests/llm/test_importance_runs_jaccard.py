"""Importance resampling, periodic runs and the n-gram join against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import families as within
from ridgeline.llm import importance, jaccard, runs
from ridgeline.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, lang string, score double, rank long, bucket int, block string, key string, part int"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def table_of(spark, texts):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, None, 7, 1, "b", "k", None) for i, t in texts], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two"), (None, "one two"), (5, "ONE Two three"), (6, "é à ü " * 40), (7, "!!! ... ###"), (8, "x " * 3000), (9, "x " * 3000), (-3, "a b c d e f g h " * 9)]


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def plain_resampled(docs, target, share=5, least=20, buckets=10_000):
    def features(text):
        w = plain_words(text)
        return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, x in docs:
        own = features(x)
        weight = sum(gains[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: len(may) * share // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def found_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_resampling_is_the_plain_one(spark):
    rng = random.Random(5)
    vocabulary = [f"Wörd{i}" if i % 7 else f"w{i}'s" for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(300)], k=n))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 300]))) for i in range(400)] + ODD + [(900, "the " * 70_000)]
    target = [text(40) for _ in range(30)] + [None, ""]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    wanted = plain_resampled(docs, target)
    assert found_rows(importance.resample(table_of(spark, docs).repartition(5), bench)) == wanted
    assert any(r[4] for r in wanted)


def test_buckets_that_are_dealt_to_more_tasks_weigh_the_same(spark):
    docs = [(i, "the cat and the dog " * (1 + i % 9)) for i in range(120)]
    bench = spark.createDataFrame([("the cat sat",)], "text string")
    frame = table_of(spark, docs).repartition(6)
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "weight", "score").collect())
    assert key(importance.scored(frame, bench, shard=50)) == key(importance.scored(frame, bench))


def test_resampling_of_empty_tables(spark):
    empty, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert importance.resample(empty, bench).collect() == []
    docs = [(i, "some words stand here " * 8) for i in range(40)]
    assert found_rows(importance.resample(table_of(spark, docs), bench)) == plain_resampled(docs, [])


def test_equal_scores_draw_the_smaller_id(spark):
    rows = spark.createDataFrame([(d, 60, 1, 5) for d in (9, 3, None, 7, 1)], "doc_id long, n_features long, weight long, score long")
    assert {r.doc_id: r.rank for r in importance.ranked(rows, (60, 100)).collect()} == {1: 1, 3: 2, 7: 3, 9: None, None: None}


def test_counts_beyond_a_byte_survive_packing():
    keys = np.array([3 << 16 | 5] * 700 + [3 << 16 | 9] * 255 + [4 << 16], dtype=np.uint32)
    rows = list(importance.block_rows(1, list(range(10)), [0] * 10, [keys]))[1:]
    sums = []
    for _, bucket, _, counts, body in rows:
        own, docs = importance.unpacked(counts, body)
        sums.append((bucket, np.bincount(docs, own, 10).astype(int).tolist()))
    assert sums == [(3, [0, 0, 0, 0, 0, 700, 0, 0, 0, 255]), (4, [1] + [0] * 9)]


def plain_runs(words):
    """By the definition: every period, every stretch, smallest period checked."""
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            start, length = i, j + p - i
            smaller = any(all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p))
            if length >= max(6, 4 * p) and not smaller:
                out.append((start, length, p))
            i = j + 1
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=5), st.integers(0, 30), st.lists(st.sampled_from([b"a", b"b"]), max_size=20))
def test_runs_are_those_of_the_definition(before, period, times, after):
    words = [*before, *period * times, *after]
    assert runs.runs_of(runs.numbered(words)) == plain_runs(words)


def test_runs_within_runs_and_long_ones(monkeypatch):
    words = ([b"x"] * 9 + [b"y"]) * 50 + [b"z"] + [b"q"] * 3000
    wanted = plain_runs(words[:501]) + [(501, 3000, 1)]
    assert runs.runs_of(runs.numbered(words)) == sorted(wanted)
    monkeypatch.setattr(runs, "PROBED", 10)
    assert runs.runs_of(runs.numbered(words[:501])) == plain_runs(words[:501])
    assert runs.runs_of(runs.numbered([b"a"] * 200_000)) == [(0, 200_000, 1)]


def plain_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-(r[1] * math.lcm(*(x[2] for x in found)) // r[2]), r[0], r[2])) if found else (None, None, None)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *best,
        1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{length},{p}\n" for s, length, p in found)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_run_query_is_the_plain_one(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("a b c d é".split(), k=rng.randint(0, 90)))) for i in range(300)] + [d for d in ODD if len(d[1] or "") < 1000]
    assert found_rows(runs.detect(table_of(spark, docs), plant=True)) == sorted((plain_row(*d) for d in docs), key=str)
    assert runs.detect(spark.createDataFrame([], SCHEMA)).collect() == []


def test_collapse_cuts_repetition_only(spark):
    docs = [(1, "keep  these\nlines"), (2, "a b " * 10 + "c"), (3, None), (4, "")]
    assert {r.doc_id: r.text for r in runs.collapse(table_of(spark, docs)).collect()} == {1: "keep  these\nlines", 2: "a b c", 3: None, 4: ""}
    assert runs.collapse(table_of(spark, docs)).columns == table_of(spark, docs).columns


def plain_set(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(docs, similar=85):
    sets = [plain_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (docs[i][0] == docs[j][0] or 100 * len(a & b) >= similar * len(a | b)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))


def families(rng, n, words=120):
    """Texts of families whose members differ a little, around the threshold, and share passages with other families."""
    vocabulary = [f"w{i}" for i in range(500)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(3)]
    seeds = [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] + rng.choice(passages) * rng.randint(0, 1) for _ in range(n // 6)]
    out = []
    for i in range(n):
        text = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            text = text[: -rng.randint(1, 9)] or text
        out.append((i, " ".join(text).upper() if i % 9 == 0 else "  ".join(text)))
    return out


def test_join_is_the_plain_one(spark):
    rng = random.Random(13)
    docs = families(rng, 500) + [d for d in ODD if d[0] is not None]
    docs = [(i if i < 1 or i > 9 else i + 10_000, t) for i, t in docs]
    assert found_rows(jaccard.near_duplicates(table_of(spark, docs).repartition(7))) == sorted(plain_components(docs), key=str)


def test_sliced_components_lose_no_link(spark):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    docs = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(100)] = f"own{i}"
        docs.append((i + 1, " ".join(text)))
    found = jaccard.sets_of(table_of(spark, docs))
    nodes = found.selectExpr("doc_id AS nid", "n", "keys", "prefix").where("keys IS NOT NULL").dropDuplicates(["keys"])
    whole = {frozenset(r) for r in jaccard.components.connected(jaccard.links(nodes)).collect()}
    assert {frozenset(r) for r in jaccard.components.connected(jaccard.links(nodes, hot=7)).collect()} == whole
    assert found_rows(jaccard.near_duplicates(table_of(spark, docs))) == sorted(plain_components(docs), key=str)


def test_lookups_of_busy_cells_are_dealt_to_more_tasks(spark):
    docs = families(random.Random(4), 120)
    key = lambda df: sorted((r.doc_id, r.n, r.keys and bytes(r.keys), r.prefix) for r in df.collect())
    frame = table_of(spark, docs).repartition(5)
    assert key(jaccard.sets_of(frame, shard=100)) == key(jaccard.sets_of(frame))


def test_rows_without_id_take_the_component_of_an_equal_set(spark):
    docs = [(None, "a b c d e"), (5, "a b c d e"), (None, "nothing else like this one"), (None, None), (6, "")]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(table_of(spark, docs)).collect()}
    assert found == {(None, 2, 5), (5, 2, 5), (None, 2, None), (None, 0, None), (6, 0, 6)}
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=12), min_size=2, max_size=25), st.sampled_from([(85, 100), (1, 2), (4, 5)]))
def test_trie_links_are_those_of_all_pairs(lists, similar):
    sets = sorted({tuple(sorted(set(x))) for x in lists})
    random.Random(len(sets)).shuffle(sets)
    up, down = similar
    edges = jaccard.trie_links([np.array(s, dtype=np.uint64) for s in sets], [len(s) for s in sets], similar)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in edges:
        both = len(set(sets[i]) & set(sets[j]))
        assert down * both >= up * len(set(sets[i]) | set(sets[j]))
        assert find(i) != find(j)
        parent[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            if down * len(set(sets[i]) & set(sets[j])) >= up * len(set(sets[i]) | set(sets[j])):
                assert find(i) == find(j)


def test_packed_numbers_come_back():
    for values in ([7], [0, 1, 2], [5, 5 + 2**20, 2**57, 2**58 - 1]):
        assert jaccard.unpacked(jaccard.packed(np.array(values, dtype=np.uint64))).tolist() == values
    assert jaccard.from_planes(jaccard.planes(np.array([0, 300, 2], dtype=np.int64))).tolist() == [0, 300, 2]


@pytest.mark.parametrize("name", ["op11_importance", "op12_runs", "op13_jaccard"])
def test_queries_give_what_their_sql_does(spark, name):
    folder = "/root/testdata/sf0.001"
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    df = QUERIES[name](spark, folder)
    assert df.columns == [c[0] for c in found.description]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("name", ["op11_importance", "op12_runs", "op13_jaccard"])
def test_queries_give_every_document_of_the_small_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    found = found_rows(QUERIES[name](spark, folder))
    if name == "op11_importance":
        assert found == plain_resampled(docs, [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    elif name == "op12_runs":
        assert {r[0] for r in found} == {d for d, _ in docs}
        short = sorted((d for d in docs if len(d[1] or "") < 2500), key=str)
        assert [r for r in found if r[0] in {d for d, _ in short}] == sorted((plain_row(*d) for d in short), key=str)
    else:
        assert found == sorted(plain_components(docs), key=str)


@pytest.mark.parametrize("hot", [3, 10, 1000])
def test_classes_of_large_components_meet_in_slices(spark, hot):
    """Two families that one text connects as candidates, and strays between them: links are those of all pairs, and no slice of a family meets another of it."""
    rng = random.Random(hot)
    sets, near = {}, list(range(0, 1000, 10))
    for k in range(40):
        sets[k] = sorted({*near[:50], 2000 + k})  # a family
        sets[100 + k] = sorted({*near[50:], 3000 + k})  # another
    for k in range(6):
        sets[200 + k] = sorted(rng.sample(near, 50))  # strays
    rows = [("c", k, (k // 100) * 100 if k % 100 and k < 200 else None, k in (0, 100), len(x), np.array(x, dtype="<u8").tobytes()) for k, x in sets.items()]
    table = spark.createDataFrame(rows, "key string, nid long, hub long, is_hub boolean, n long, held binary").repartition(4)
    linker = lambda held, sizes, classes: jaccard.trie_links(held, sizes, (85, 100), classes)
    found = within.links(table, linker, (85, 100), hot)
    classes = {r.node: r.component for r in within.components.connected(found).collect()}
    assert {classes.get(k, k) for k in range(40)} == {0} and {classes.get(100 + k, k) for k in range(40)} == {100}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 100 * len({*x} & {*y}) >= 85 * len({*x} | {*y}):
                assert classes[a] == classes[b]
    classed = spark.createDataFrame([("c", k, classes.get(k, k), 400) for k in sets], "key string, nid long, class long, size long")
    met = within.meetings(classed, hot).collect()
    together = {}
    for r in met:
        together.setdefault(r.pair, []).append(r)
    for a in sets:
        for b in sets:
            if classes.get(a, a) != classes.get(b, b):
                assert any({a, b} <= {r.nid for r in own} for own in together.values())
    if hot < 40:
        assert all(len({r["class"] for r in own if r["class"] in (0, 100)}) < 2 or "#0:" in pair and "#100:" in pair for pair, own in together.items())
    assert max(map(len, together.values())) <= max(4 * hot, len(sets))


def test_hubs_are_what_most_keys_name(spark):
    nodes = spark.createDataFrame([(1, [10, 11]), (2, [10, 12, 13]), (3, [12, 13, 10]), (4, [99])], "nid long, bands array<long>")
    met = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "node long, component long")
    assert {(r.nid, r.hub, r.is_hub) for r in within.members(nodes, met).collect()} == {(1, None, True), (2, 1, True), (3, 2, False)}
