"""The transducer and the packer against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ridgeline.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "😀", "\x85", "\xa0", "\x1c", "²", "Ⅷ", "'s", "'ll", "'", "...", "12", "_", "́", "<|endoftext|>", "<|", "\x00", "x" * 70, "="]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(PATH)


def test_encodes_and_decodes_as_the_library_does(library, merges):
    rng = random.Random(1)
    own, compiled = bpe.Encoder(merges, bpe.Pieces(merges)), bpe.Encoder(merges, packing.PackedPieces(merges, "<u2"))
    for _ in range(400):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        want = library.encode(text, add_special_tokens=False).ids
        got = [i for part in own.ids(text) for i in part]
        assert got == want
        assert np.frombuffer(b"".join(b"".join(p) for p in compiled.parts(text)), dtype="<u2").tolist() == want
        machine = bpe.TextMachine(merges.bytes_of)
        assert "".join(machine.feed([i]) for i in got) + machine.finish() == library.decode(want, skip_special_tokens=False)


def test_decodes_any_ids_as_the_library_does(library, merges):
    rng = random.Random(2)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(20)]
        machine = bpe.TextMachine(merges.bytes_of)
        assert "".join(machine.feed([i]) for i in ids) + machine.finish() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, "the" * 2000, "ÃÂ" * 1500, "=-" * 2000])
def test_memory_stays_within_the_lookahead(library, merges, text):
    machine, got, most = bpe.Transducer(merges), [], 0
    data = text.encode()
    for i in range(0, len(data), 61):
        got += machine.feed(data[i : i + 61])
        most = max(most, len(machine.last))
    assert got + machine.finish() == library.encode(text, add_special_tokens=False).ids
    assert most <= 4 * merges.lookahead


def test_segments_split_as_the_whole(monkeypatch, library, merges):
    monkeypatch.setattr(bpe, "SEGMENT", 7)
    text = "one two  three\n\n four 'll five\x1c six \xa0 seven" * 5
    encoder = bpe.Encoder(merges, bpe.Pieces(merges))
    assert [i for part in encoder.ids(text) for i in part] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["日本語" * 400, "x=1;y" * 300, "a" * 900 + "\n\n" + "b" * 700, "word" * 30 + " é" * 500, "\n" * 999 + "z"])
def test_texts_without_spaces_come_in_slices(monkeypatch, library, merges, text):
    for name, value in (("SEGMENT", 50), ("PIECES", 7), ("LONG_PIECE", 20), ("SLICE", 16)):
        monkeypatch.setattr(bpe, name, value)
    want = library.encode(text, add_special_tokens=False).ids
    parts = list(bpe.Encoder(merges, bpe.Pieces(merges)).ids(text))
    assert [i for part in parts for i in part] == want and max(map(len, parts)) <= 4 * merges.lookahead
    packed = bpe.Encoder(merges, packing.PackedPieces(merges, "<u2"))
    assert np.frombuffer(b"".join(b"".join(p) for p in packed.parts(text)), dtype="<u2").tolist() == want


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        found = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": found["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": found["model"] | {"ignore_merges": True}}, {"added_tokens": [found["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(found | change))
        with pytest.raises(ValueError):
            bpe.MergeList(str(tmp_path / "t.json"))


def test_batches_of_long_documents(spark, library):
    docs = spark.createDataFrame([(i, "lorem ipsum " * 300_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    want = library.encode("lorem ipsum " * 300_000, add_special_tokens=False).ids
    assert {(r.doc_tokens, r.n) for r in packing.pack(docs, PATH).groupBy("doc_id", "doc_tokens").agg({"length": "sum"}).toDF("doc_id", "doc_tokens", "n").collect()} == {(len(want) + 1, len(want) + 1)}
    assert {len(r.ids) for r in bpe.encode(docs, PATH).limit(2).collect()} == {len(want)}


ROWS = [(1, "one two three"), (2, None), (3, ""), (None, "é ß"), (5, "word " * 3000), (5, "word " * 3000), (7, "a<|endoftext|>b")]


def test_round_trip_query(spark, library):
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, ids int")
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    texts = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in texts), key=repr) == sorted(((i, t or "") for i, t in ROWS), key=repr)


@pytest.mark.parametrize("window", [1024, 10])
def test_packs_every_id_once_without_gaps(spark, library, window):
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, part int").repartition(3)
    pieces = packing.pack(docs, PATH, window).collect()
    full = {}
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), dtype="<u4")
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        full.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(full) == list(range(len(full)))
    for k, found in full.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at == window or k == len(full) - 1
    for i, t in {(i, t) for i, t in ROWS}:
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        copies = sum(r == (i, t) for r in ROWS)
        own = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == i and p.doc_tokens == len(want))
        assert sum(len(b) for _, b in own) == copies * 4 * len(want)
        if copies == 1:
            assert np.frombuffer(b"".join(b for _, b in own), dtype="<u4").tolist() == want
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ids_need_not_follow_the_merges(spark, tmp_path, library):
    """A vocabulary whose ids are dealt anew: both operators encode as the library does, from the same file."""
    found = json.loads(open(PATH, encoding="utf-8").read())
    vocab = found["model"]["vocab"]
    ids = list(vocab.values())
    random.Random(9).shuffle(ids)
    found["model"]["vocab"] = dict(zip(vocab, ids))
    for t in found["added_tokens"]:
        t["id"] = found["model"]["vocab"].get(t["content"], t["id"])
    path = f"{tmp_path}/permuted.json"
    open(path, "w", encoding="utf-8").write(json.dumps(found))
    other, rng = Tokenizer.from_file(path), random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["the quick brown fox jumps over " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: [*other.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    got = {}
    for r in packing.pack(docs, path, 64).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == want
    assert {r.doc_id: r.n_tokens for r in bpe.round_trip(docs, path).collect()} == {i: len(x) - 1 for i, x in want.items()}
    merges = bpe.MergeList(path)
    merges.merges[next(iter(merges.merges))] = (10**9, next(iter(merges.merges.values()))[1])
    merges.merges[(-1, -1)] = next(iter(merges.merges.values()))
    with pytest.raises(ValueError, match="more than one pair"):
        merges.ranks()
