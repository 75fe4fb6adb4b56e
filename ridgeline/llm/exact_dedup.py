"""Exact duplicates by Patricia-trie owners.

Each map task inserts the whole byte strings that it reads into a compressed radix trie whose terminal
nodes hold the owner (the largest doc_id) and the number of rows. That is a combiner: of a group of copies
a task sends one row, however large the group is. The distinct strings are then partitioned by (length,
content hash) and inserted again, one trie for a run of a partition, so two strings of one hash stay apart; the
final terminals are the owners. A trie that outgrows its memory spills by subtree: on the map side the heaviest
subtree's terminals go on to the next step, where they meet the rest of their group again; on the reduce side rows
come in order of (length, hash), so what is spilled between two of these is final.

Defined results: a null text counts as empty; a null doc_id never owns a group that has another id (a group
of null ids only has a null owner and keeps its rows); a repeated row is the same document and is kept or
dropped as one; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of labels that one trie holds before it spills a subtree.
TRIE_BYTES = 48 << 20


def shared_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


class Node:
    __slots__ = ("label", "children", "owner", "copies")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.copies = label, {}, None, 0


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal holds (owner, copies)."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, owner: int | None, copies: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label) + 200
                node, at = child, len(key)
                break
            rest = key[at : at + len(child.label)]
            n = shared_length(child.label, rest)
            if n < len(child.label):  # split the edge
                upper = Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[key[at]] = upper
                self.size += 200
                child = upper
            node, at = child, at + n
        node.owner = larger(node.owner, owner) if node.copies else owner
        node.copies += copies

    @staticmethod
    def below(node: Node, prefix: bytes) -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node, prefix)]
        while todo:
            node, prefix = todo.pop()
            whole = prefix + node.label
            if node.copies:
                yield whole, node.owner, node.copies
            todo.extend((child, whole) for child in node.children.values())

    def terminals(self) -> Iterator[tuple[bytes, int | None, int]]:
        yield from self.below(self.root, b"")

    @staticmethod
    def weight(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            node = todo.pop()
            total += len(node.label) + 200
            todo.extend(node.children.values())
        return total

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Cut off the heaviest subtree under the root and give its terminals."""
        if not self.root.children:
            return
        key, child = max(self.root.children.items(), key=lambda kv: self.weight(kv[1]))
        del self.root.children[key]
        self.size -= self.weight(child)
        yield from self.below(child, b"")


DISTINCT = pa.schema([("text_length", pa.int64()), ("content_hash", pa.int64()), ("text", pa.binary()), ("owner", pa.int64()), ("copies", pa.int64())])
OWNERS = pa.schema([("sha", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def combine(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: doc_id, text -> the distinct texts of this task, or of what fits into memory."""
    import xxhash

    def rows():
        trie = PatriciaTrie()
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                trie.insert(text.as_py(), doc_id, 1)
                while trie.size > TRIE_BYTES and trie.root.children:
                    yield from trie.spill()
        yield from trie.terminals()

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    yield from common.batches(((len(t), signed(xxhash.xxh64_intdigest(t)), t, o, c) for t, o, c in rows()), DISTINCT, 256)


def own(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: rows sorted by (length, hash) -> the owner of each distinct text. One trie holds a run of the partition; where the next (length, hash) begins all that it holds is final, so a trie that is full spills subtrees there."""

    def rows():
        trie, key = PatriciaTrie(), None
        for part in parts:
            for length, content, text, owner, copies in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist()):
                if (length, content) != key:
                    key = length, content
                    while trie.size > TRIE_BYTES and trie.root.children:
                        yield from trie.spill()
                trie.insert(text.as_py(), owner, copies)
        yield from trie.terminals()

    yield from common.batches(((hashlib.sha256(t).digest(), o, c) for t, o, c in rows()), OWNERS, 4096)


def owners(docs: DataFrame) -> DataFrame:
    """sha, keep_id, group_size of each distinct text."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    distinct = common.arrow_map(found, combine, "text_length long, content_hash long, text binary, owner long, copies long")
    dealt = distinct.repartition("text_length", "content_hash").sortWithinPartitions("text_length", "content_hash")
    return common.arrow_map(dealt, own, "sha binary, keep_id long, group_size long")


def decide(docs: DataFrame) -> DataFrame:
    """docs with sha, keep_id, group_size and kept; the join may split a hot text, as each row needs its owner only."""
    return (
        docs.withColumn("sha", F.unhex(F.sha2(common.text_bytes(), 256)))
        .join(owners(docs), "sha", "left")
        .withColumn("kept", F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")))
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row."""
    return decide(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    return decide(inner).where("kept").select("row.*")
