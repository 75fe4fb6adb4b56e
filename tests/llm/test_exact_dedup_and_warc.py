"""Exact duplicates and WARC bundles against plain Python."""

import hashlib
import random

import pytest
import re

from pyspark.sql import functions as F

from ridgeline.llm import exact_dedup, warc
from ridgeline.llm.exact_dedup import PatriciaTrie

DOCS = "doc_id long, text string, sha string, kept string"


def test_trie_holds_every_string_and_spills_whole_subtrees():
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"ab", b"\xff\x00", b"abc"]
    trie = PatriciaTrie()
    for i, key in enumerate(keys):
        trie.insert(key, i, 1)
    found = {k: (o, c) for k, o, c in trie.terminals()}
    assert found == {k: (max(i for i, x in enumerate(keys) if x == k), keys.count(k)) for k in set(keys)}
    spilled = list(trie.spill())
    assert {k for k, _, _ in spilled} | {k for k, _, _ in trie.terminals()} == set(keys)
    assert len(spilled) + len(list(trie.terminals())) == len(set(keys))


def test_owners_with_nulls_ties_repeats_long_texts_and_clashing_columns(spark, monkeypatch):
    rows = [(1, "a b"), (2, "a b"), (2, "a b"), (3, None), (4, ""), (None, "x"), (None, "y"), (7, "y"), (8, "z" * 200_000), (9, "z" * 200_000)]
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], DOCS)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect()), key=repr)
    want = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    stay = exact_dedup.drop_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted((r.doc_id for r in stay.collect()), key=repr) == sorted([2, 2, 4, None, 7, 9], key=repr)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_small_memory_gives_the_same_owners(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 1500)
    texts = [f"{i % 7} text {i % 5}".encode() for i in range(200)]
    part = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    best: dict = {}
    for out in exact_dedup.combine(iter([part])):
        for t, o, c in zip(*(out.column(i).to_pylist() for i in (2, 3, 4))):
            owner, n = best.get(t, (-1, 0))
            best[t] = (max(owner, o), n + c)
    assert best == {t: (max(i for i, x in enumerate(texts) if x == t), texts.count(t)) for t in set(texts)}


def test_reduce_side_spills_whole_subtrees_between_keys(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 1500)
    texts = [b"shared beginning %d" % (i % 60) for i in range(300)] + [b"same hash a", b"same hash b"] * 3
    keys = [(len(t), 5 if t.startswith(b"same") else hash(t)) for t in texts]
    rows = sorted(zip(keys, texts, range(306)), key=lambda x: x[0])
    columns = [pa.array([k[0] for k, _, _ in rows]), pa.array([k[1] for k, _, _ in rows]), pa.array([t for _, t, _ in rows], pa.binary()), pa.array([i for _, _, i in rows]), pa.array([1] * 306)]
    part = pa.RecordBatch.from_arrays(columns, names=["l", "h", "t", "o", "c"])
    found = [x for out in exact_dedup.own(iter([part.slice(0, 100), part.slice(100)])) for x in zip(*(c.to_pylist() for c in out.columns))]
    assert len(found) == len(set(texts))
    assert {(s, o, c) for s, o, c in found} == {(hashlib.sha256(t).digest(), max(i for i, u in enumerate(texts) if u == t), texts.count(t)) for t in set(texts)}


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    from ridgeline.llm import common

    schema = pa.schema([("i", pa.int64()), ("b", pa.binary()), ("l", pa.list_(pa.binary())), ("n", pa.list_(pa.int64()))])
    rows = [(i, None if i % 5 == 0 else bytes(1000 * i), [b"x" * 500] * i, None) for i in range(60)]
    made = list(common.batches(iter(rows), schema, size=8, most_bytes=40_000))
    assert [r for m in made for r in zip(*(c.to_pylist() for c in m.columns))] == rows
    assert all(m.num_rows <= 8 and (m.num_rows == 1 or m.nbytes < 45_000) for m in made) and any(m.num_rows == 1 for m in made)


def test_archives_round_trip_and_seek(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    long, short = "<p>é" + "x" * 150, "tiny"
    rows = [(1, "u", long), (2, "u v", long), (3, None, short), (4, "u", short), (5, "u", None), (None, "u", long), (7, "u", "\r\n\r\nWARC/1.1" * 30), (7, "u", "\r\n\r\nWARC/1.1" * 30)]
    pages = spark.createDataFrame([(*r, "o") for r in rows], "page_id long, url string, html string, owner string")
    date = re.compile(rb"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n")
    catalog = warc.write_archives(pages, f"file://{tmp_path}")
    got = sorted(map(tuple, warc.read_archives(spark, catalog).collect()), key=repr)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        owner = min((j for j, _, u in rows if u == t and j is not None), default=None)
        again = len(data) >= 100 and i != owner
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", owner if again else None))
    assert got == sorted(want, key=repr)
    revisit = warc.lookup(catalog, 2)
    assert b"Refers-To-Page-Id: 1\r\n" in revisit and b"WARC-Refers-To-Target-URI: u\r\n" in revisit and b"WARC-Target-URI: uv\r\n" in revisit
    assert catalog.select("record_id").distinct().count() == len(rows)
    assert all(date.search(warc.lookup(catalog, i)) for i in (1, 2, 3))
    (found, end) = warc.parse(warc.lookup(catalog, 4))
    assert found[:2] == (4, 4) and end == len(warc.lookup(catalog, 4))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_bundles_roll_over_and_are_read_one_to_a_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1 << 20)
    rng = random.Random(1)
    large = rng.randbytes(10 << 20).hex()  # 20 MB
    rows = [(i, rng.randbytes(15_000).hex()) for i in range(300)] + [(1000, large), (1001, large)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(2)
    catalog = warc.write_archives(pages, f"file://{tmp_path}")
    bundles = catalog.select("bundle").distinct().count()
    assert bundles >= 9
    read = warc.read_archives(spark, catalog)
    got = {r.page_id: r for r in read.collect()}
    assert len(got) == 302 and (got[1000].payload_bytes, got[1000].record_type, got[1001].record_type, got[1001].refers_to) == (20 << 20, "response", "revisit", 1000)
    assert all(got[i].payload_digest == hashlib.sha256(t.encode()).hexdigest() for i, t in rows)
    assert len(read.inputFiles()) >= 0.8 * bundles  # a file of records for each task that has read a bundle
    for name in {r.bundle for r in catalog.collect()}:  # frames come in any order, as the seek table has them
        bundle = warc.Reader(name)
        sizes = [plain for _, _, plain in bundle.table]
        assert [len(bundle.frame(i)) for i in reversed(range(len(sizes)))] == sizes[::-1]
        bundle.close()


def test_records_are_read_where_the_catalog_says(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<p>{i % 7}</p>" * 40) for i in range(30)], "page_id long, html string")
    catalog = warc.write_archives(pages, f"file://{tmp_path}")
    some = catalog.where("page_id < 7")
    assert {r.page_id for r in warc.read_archives(spark, some).collect()} == set(range(7))
    with pytest.raises(Exception, match="isn't where the catalog has it"):
        warc.read_archives(spark, catalog.withColumn("page_id", F.col("page_id") + 1)).collect()
    with pytest.raises(Exception, match="page 9 revisits what isn't there"):
        warc.read_archives(spark, catalog.where("page_id = 9")).collect()
