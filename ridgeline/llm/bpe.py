"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

Encoding. The tokens of a prefix end in exactly one last token: the one that its merges leave intact beside the last
token of what precedes it. So a byte adds one step (the last token that ends there), and a token is final once the
chains of all positions that a later token can start from share its boundary. Such positions lie within the longest
token's length: that is the merge list's sufficient lookahead, computed from the list. The transducer keeps that
window and what isn't final yet, and emits the rest. Long pieces and texts without spaces come in slices, so memory
beyond the text itself is constant.

Decoding. Tokens give bytes; an incremental UTF-8 machine gives text as soon as a character is complete, and U+FFFD
for each maximal broken part.

Defined results: a null text counts as empty and has no tokens; special tokens in a text are found first, as the
tokenizers library does by default; repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries of the caches of pieces and of pairs, after which they start anew.
CACHED_PIECES, CACHED_PAIRS = 700_000, 300_000
#: Characters of a text that are split at a time, and pieces of one that can't be cut.
SEGMENT, PIECES = 1 << 18, 4096
#: Characters beyond which a piece is encoded in slices of so many bytes.
LONG_PIECE, SLICE = 1 << 12, 1 << 16

#: The split of text before merges (GPT-2's), for any text and for Latin-1 text without odd numerals and separators.
ANY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
CUT = re.compile(r"\S(?= )")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The settings of a tokenizer's file that this module reads as the library does.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check(found: dict) -> None:
    """An error for a tokenizer's file with settings that would need other work than this."""
    wrong = [f"model.{k}" for k, v in MODEL.items() if (found["model"].get(k) or None) != (v or None)]
    wrong += [f"pre_tokenizer.{k}" for k, v in SPLIT.items() if (found.get("pre_tokenizer") or {}).get(k, True if k == "use_regex" else None) != v]
    wrong += ["normalizer"] * bool(found.get("normalizer")) + ["decoder"] * ((found.get("decoder") or {}).get("type") != "ByteLevel")
    wrong += [f"added_tokens.{k}" for t in found["added_tokens"] for k, v in ADDED.items() if t.get(k, False) != v]
    if wrong:
        raise ValueError("not a plain byte-level BPE: " + ", ".join(dict.fromkeys(wrong)))


class MergeList:
    """A byte-level vocabulary and its merges, from a tokenizer's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        check(found)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in found["model"]["vocab"]}
        vocab = found["model"]["vocab"]
        self.ids = {raw[token]: i for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(found["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.lookahead = max(map(len, self.ids))
        #: Every end of a token: its id, or -1 if it is no token itself.
        self.ends = {b[i:]: -1 for b in self.ids for i in range(len(b))} | self.ids
        self.pairs: dict[tuple[int, int], bool] = {}

    def ranks(self) -> dict[bytes, int]:
        """Every token that merging can give, numbered in the order of its merge: single bytes, then what pairs become. An error for a list in which a token is merged from two pairs, as a rank of its own wouldn't tell their order."""
        order = sorted(self.merges.values())
        tokens = [*(b for b in self.ids if len(b) == 1), *(self.bytes_of[made] for _, made in order)]
        if len(set(tokens)) < len(tokens):
            raise ValueError("a token is merged from more than one pair")
        return {token: rank for rank, token in enumerate(tokens)}

    def merged(self, text: bytes) -> list[int]:
        """Plain merging: the first pair of the lowest rank, until none is left. For short strings."""
        now = [self.ids[text[i : i + 1]] for i in range(len(text))]
        while len(now) > 1:
            best, at = min(((self.merges[p][0], i) for i, p in enumerate(zip(now, now[1:])) if p in self.merges), default=(0, -1))
            if at < 0:
                break
            now[at : at + 2] = [self.merges[now[at], now[at + 1]][1]]
        return now

    def intact(self, before: int, token: int) -> bool:
        """Whether token stays a token after before (-1: at the start)."""
        key = before, token
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes_of[token]) == [token] if before < 0 else self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        return known


class Transducer:
    """Bytes of one piece in, final tokens out; holds the lookahead and what isn't final."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.base = 0  # position that self.last starts at
        self.last: list[tuple[int, int]] = [(-1, 0)]  # for each position, the last token there and where it starts
        self.tail = b""  # the bytes before the current position, as many as a token can have
        self.done = 0  # boundary up to which tokens are out
        self.unchecked = 0

    def feed(self, data: bytes) -> list[int]:
        m, out = self.merges, []
        ends, intact, far, last, base = m.ends, m.intact, m.lookahead, self.last, self.base
        work, offset = self.tail + data, len(self.tail)
        shift = self.base + len(self.last) - 1 - offset  # position of work[0]
        for i in range(offset + 1, len(work) + 1):
            options = []
            for j in range(i - 1, max(i - far, 0, self.done - shift) - 1, -1):
                token = ends.get(work[j:i])
                if token is None:
                    break
                if token >= 0:
                    options.append((token, j + shift))
            for token, start in reversed(options):
                before = last[start - base][0]
                if (before != -1 or start == 0) and intact(before, token):
                    last.append((token, start))
                    break
            else:
                last.append((-1, -1))
            self.unchecked += 1
            if self.unchecked >= 2 * far:
                out += self.settle()
                base = self.base
        self.tail = work[-far:]
        return out

    def chain(self, end: int) -> list[int]:
        """Tokens between what is out and a boundary."""
        found = []
        while end > self.done:
            token, start = self.last[end - self.base]
            found.append(token)
            end = start
        return found[::-1]

    def settle(self) -> list[int]:
        """Emit what all positions that a later token can start from agree on, and forget it."""
        self.unchecked = 0
        end = self.base + len(self.last) - 1
        live = {p for p in range(max(self.done, end - self.merges.lookahead + 1), end + 1) if self.last[p - self.base][1] >= 0}
        while len(live) > 1:
            p = max(live)
            live.discard(p)
            live.add(max(self.done, self.last[p - self.base][1]))
        shared = live.pop()
        out = self.chain(shared)
        self.done = shared
        if shared - self.base > 0:
            del self.last[: shared - self.base]
            self.base = shared
        return out

    def finish(self) -> list[int]:
        return self.chain(self.base + len(self.last) - 1)


class Pieces(dict):
    """piece -> its token ids; filled by the transducer as pieces come."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHED_PIECES:
            self.clear()
        machine = Transducer(self.merges)
        found = tuple(machine.feed(piece.encode()) + machine.finish())
        if len(piece) <= 64:
            self[piece] = found
        return found

    def slices(self, piece: str) -> Iterator[tuple[int, ...]]:
        for ids in sliced(self.merges, piece):
            yield tuple(ids)


def sliced(merges: MergeList, piece: str) -> Iterator[list[int]]:
    """The ids of a long piece, slice by slice."""
    machine = Transducer(merges)
    for at in range(0, len(piece), SLICE):
        yield machine.feed(piece[at : at + SLICE].encode())
    yield machine.finish()


def segments(text: str) -> Iterator[str]:
    """Parts of a text that split as the whole does: cut before a space that follows something else."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = CUT.search(text, at + SEGMENT)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def split_pieces(text: str) -> Iterator[list[str]]:
    """The pieces of a segment, in lists of bounded length where the segment is long."""
    latin = NOT_LATIN.search(text) is None
    if len(text) <= 2 * SEGMENT:
        if latin:
            yield LATIN.findall(text)
            return
        import regex

        yield regex.findall(ANY, text)
        return
    import regex

    found = (LATIN if latin else regex.compile(ANY)).finditer(text)
    while some := [m[0] for m in islice(found, PIECES)]:
        yield some


class Encoder:
    """Ids of whole texts, part by part."""

    def __init__(self, merges: MergeList, pieces: dict):
        self.special, self.pieces = merges.special, pieces
        self.found = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

    def parts(self, text: str) -> Iterator[list]:
        """What pieces[] gives for each piece, in lists of bounded length."""
        whole = self.found.split(text) if self.found and any(s in text for s in self.special) else [text]
        for i, ordinary in enumerate(whole):
            if i % 2:
                yield [self.pieces.of_special(ordinary)] if hasattr(self.pieces, "of_special") else [(self.special[ordinary],)]
            elif ordinary:
                for segment in segments(ordinary):
                    for pieces in split_pieces(segment):
                        if len(segment) <= LONG_PIECE or len(max(pieces, key=len)) <= LONG_PIECE:
                            yield list(map(self.pieces.__getitem__, pieces))
                            continue
                        for piece in pieces:
                            if len(piece) <= LONG_PIECE:
                                yield [self.pieces[piece]]
                            else:
                                for part in self.pieces.slices(piece):
                                    yield [part]

    def ids(self, text: str) -> Iterator[list[int]]:
        for part in self.parts(text):
            yield list(chain.from_iterable(part))


class TextMachine:
    """Token ids in, text out, character by character as bytes complete them."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.machine = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


_loaded: dict[str, tuple[MergeList, Pieces]] = {}


def load(path: str) -> tuple[MergeList, Pieces]:
    """Once for each Python worker."""
    if path not in _loaded:
        merges = MergeList(path)
        _loaded[path] = merges, Pieces(merges)
    return _loaded[path]


def digests(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def make(parts):
        merges, pieces = load(path)
        encoder = Encoder(merges, pieces)
        names = {i: str(i) for i in merges.bytes_of}

        def row(doc_id, text):
            n, of_ids, of_text, machine = 0, hashlib.sha256(), hashlib.sha256(), TextMachine(merges.bytes_of)
            for ids in encoder.ids(text):
                if ids:
                    of_ids.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                    of_text.update(machine.feed(ids).encode())
                    n += len(ids)
            of_text.update(machine.finish().encode())
            return doc_id, n, of_ids.hexdigest(), of_text.hexdigest()

        yield from common.batches((row(d, t.as_py()) for part in parts for d, t in zip(part.column(0).to_pylist(), part.column(1))), schema)

    return make


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def make(parts):
        encoder = Encoder(*load(path))
        yield from common.batches(((d, list(chain.from_iterable(encoder.ids(t.as_py())))) for part in parts for d, t in zip(part.column(0).to_pylist(), part.column(1))), schema)

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row; null ids count as none, unknown ids are left out."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def make(parts):
        merges, _ = load(path)

        def text(ids):
            machine = TextMachine(merges.bytes_of)
            return machine.feed([i for i in ids or () if i in merges.bytes_of]) + machine.finish()

        yield from common.batches(((d, text(i.as_py())) for part in parts for d, i in zip(part.column(0).to_pylist(), part.column(1))), schema)

    return common.arrow_map(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), make, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded text) of each row."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return common.arrow_map(found, digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
