"""Exact n-gram Jaccard join over prefix trees of globally ordered sets.

A document's set is that of its word shingles. All shingles of all documents are counted, and every set is ordered by how
common they are: classes of document frequency, rarest first, then by hash. A shingle that no other document has can't be
part of any overlap and stands first in every order, so a set links with nothing if those of its shingles that others have
are fewer than the least overlap. What is left is joined in tries: sets that share the beginning of their order share a
path, a probe adds up its overlap along the path once for all sets below, and a subtree is left as soon as what remains of
the probe and of the longest set below can't reach the overlap that the smallest set below needs.

Which sets have to meet follows from the prefix rule: two sets that link share one of the first n - least overlap + 1
shingles of both. Sets that share one are connected; a component's sets are held against hubs first, and what isn't one
class then is joined in tries, large ones by pairs of slices of different classes (families.py). Sets that hang together
already aren't compared again, so a family of copies costs links in proportion to its size. Equal sets are one set from
the start.

Shingles are counted and looked up in cells of their hashes, in blocks of documents: rows are packed arrays, sorted numbers
as the bytes of their distances. The counts may merge a few shingles (they look at some bits more than there are shingles,
as hashes of 58 bits would be twice the bytes); that can only keep a set in that could have been left out. Hashes of 58
bits stand for shingles in the join itself.

Defined results: a null or wordless text has an empty set and links with nothing; fewer words than a shingle are one
shingle; rows of one doc_id are one document's; a null doc_id takes the component of an equal set that has an id, and none
otherwise; repeated rows are repeated; an empty table gives no rows; a very long text is a block of its own. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, families, simhash

WIDTH, SIMILAR = 4, (85, 100)
#: Bits of a shingle's hash; classes of frequency stand above them.
BITS = 58
#: Documents and shingles of a block, and shingles that a task counts at a time.
BLOCK_DOCS, BLOCK_TOKENS, COUNTED = 1 << 15, 2 << 20, 4 << 20
#: Bytes of text to a cell of hashes, and how many bits more than there are shingles a count looks at.
CELL_BYTES, SPARE_BITS = 1 << 20, 8
#: Lookups of a cell beyond which it is dealt to more tasks, and the most cells that may be.
SHARD, MOST_SHARDED = 4 << 20, 1 << 16
#: Sets of a slice of a component.
SLICE_SETS = 2048
#: Kinds of rows: a cell's counts, a block's documents, lookups.
COUNTS, DOCUMENTS, LOOKUPS = 0, 1, 2

ROWS = "kind int, cell long, block long, tokens binary, body binary"
ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("cell", pa.int64()), ("block", pa.int64()), ("tokens", pa.binary()), ("body", pa.binary())])


def token_set(text: bytes, width: int = WIDTH):
    """The distinct shingles of a text as hashes of 58 bits, sorted."""
    import numpy as np

    found = simhash.shingle_set(text, width) >> np.uint64(64 - BITS)
    return found[np.flatnonzero(np.append(True, found[1:] != found[:-1]))] if len(found) else found


def planes(values) -> bytes:
    """Whole numbers as bytes of one place after another, as many as the largest needs."""
    import numpy as np

    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([wide]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()


def from_planes(held: bytes):
    import numpy as np

    wide = held[0]
    found = np.frombuffer(held, np.uint8, offset=1).reshape(wide, -1)
    out = np.zeros((found.shape[1], 8), dtype=np.uint8)
    out[:, :wide] = found.T
    return out.view("<u8").ravel()


def packed(values) -> bytes:
    """Rising whole numbers: the first, then the distances."""
    return int(values[0]).to_bytes(8, "little") + planes(values[1:] - values[:-1])


def unpacked(held: bytes):
    import numpy as np

    return np.cumsum(np.append(np.frombuffer(held, "<u8", 1), from_planes(held[8:])), dtype=np.uint64)


def cell_bounds(values, cells: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(cell, low, high) of the stretches of sorted values of so many bits that lie in one cell."""
    import numpy as np

    firsts = np.array([(c << bits) // cells for c in range(cells)], dtype=np.uint64)
    at = np.append(np.searchsorted(values, firsts), len(values)).tolist()
    for cell in range(cells):
        if at[cell] < at[cell + 1]:
            yield cell, at[cell], at[cell + 1]


def common_tokens(docs: DataFrame, width: int, cells: int, drop: int) -> DataFrame:
    """cell, total, tokens, classes: the shingles (without their lowest drop bits) that two or more rows have, with their class of frequency, and how many shingles of rows there are in the cell."""
    schema = pa.schema([("cell", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())])
    out = pa.schema([("cell", pa.int64()), ("total", pa.int64()), ("tokens", pa.binary()), ("classes", pa.binary())])

    def count(parts):
        import numpy as np

        def rows():
            held, n = [], 0

            def flush():
                tokens, counts = np.unique(np.concatenate(held), return_counts=True)
                for cell, low, high in cell_bounds(tokens, cells, BITS - drop):
                    yield cell, packed(tokens[low:high]), planes(counts[low:high])

            for part in parts:
                for text in part.column(0):
                    own = token_set(text.as_py(), width)
                    held.append(own >> np.uint64(drop))
                    n += len(own)
                    if n >= COUNTED:
                        yield from flush()
                        held, n = [], 0
            if n:
                yield from flush()

        yield from common.batches(rows(), schema, 256)

    def merge(parts):
        import numpy as np

        def added(held):
            tokens, where = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return tokens, np.bincount(where, np.concatenate([c for _, c in held]).astype(float)).astype(np.uint64)

        def done(cell, held):
            tokens, counts = added(held)
            often = counts > 1
            if often.any():
                classes = np.minimum(np.log2(counts[often]).astype(np.uint8), 31)
                yield cell, int(counts.sum()), packed(tokens[often]), classes.tobytes()

        def rows():
            now, held, n = None, [], 0
            for part in parts:
                for cell, tokens, counts in zip(*(part.column(c).to_pylist() for c in range(3))):
                    if cell != now:
                        if held:
                            yield from done(now, held)
                        now, held, n = cell, [], 0
                    held.append((unpacked(tokens), from_planes(counts)))
                    n += len(held[-1][0])
                    if n > COUNTED and len(held) > 1:  # what rows have in common is one entry
                        held = [added(held)]
                        n = len(held[0][0]) // 2
            if held:
                yield from done(now, held)

        yield from common.batches(rows(), out, 64)

    made = common.arrow_map(docs.select(common.text_bytes().alias("text")), count, "cell long, tokens binary, counts binary")
    dealt = made.repartition("cell").sortWithinPartitions("cell")
    return common.arrow_map(dealt, merge, "cell long, total long, tokens binary, classes binary")


def lookups(docs: DataFrame, width: int, cells: int, drop: int) -> DataFrame:
    """Blocks of documents: a row with ids, set sizes and digests, and a row for each cell with the shingles there and whose they are."""

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        import numpy as np
        import xxhash

        task, made = TaskContext.get().partitionId(), 0

        def block(ids, sets):
            name = task << 32 | made
            about = b"".join(s.tobytes() for s in (np.array([i or 0 for i in ids], "<i8"), np.array([len(s) for s in sets], "<i8"), np.array([i is not None for i in ids], np.uint8)))
            yield DOCUMENTS, -1, name, about, b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets)
            tokens = np.concatenate(sets)
            order = np.argsort(tokens, kind="stable")
            tokens, whose = tokens[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
            for cell, low, high in cell_bounds(tokens >> np.uint64(drop), cells, BITS - drop):
                yield LOOKUPS, cell, name, packed(tokens[low:high]), planes(whose[low:high])

        ids, sets, n = [], [], 0
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                own = token_set(text.as_py(), width)
                if ids and (len(ids) >= BLOCK_DOCS or n + len(own) > BLOCK_TOKENS):
                    yield from block(ids, sets)
                    made += 1
                    ids, sets, n = [], [], 0
                ids.append(doc_id)
                sets.append(own)
                n += len(own)
        if ids:
            yield from block(ids, sets)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text"))
    return common.arrow_map(found, lambda parts: common.batches(rows(parts), ROW_SCHEMA, 256), ROWS)


def answered(drop: int):
    """For mapInArrow over rows sorted by cell and shard, counts first: the lookups that found something, as places in the global order; documents as they are."""

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        import numpy as np

        now, known, classes = None, None, None
        for part in parts:
            for kind, cell, block, tokens, body in zip(*(part.column(c).to_pylist() for c in range(5))):
                if kind == COUNTS:
                    now, known, classes = cell, unpacked(tokens), np.frombuffer(body, np.uint8)
                elif kind == DOCUMENTS:
                    yield kind, cell, block, tokens, body
                elif cell == now:
                    own = unpacked(tokens)
                    short = own >> np.uint64(drop)
                    at = np.minimum(np.searchsorted(known, short), len(known) - 1)
                    hit = known[at] == short
                    if hit.any():
                        keys = classes[at[hit]].astype(np.uint64) << np.uint64(BITS) | own[hit]
                        yield kind, cell, block, keys.astype("<u8").tobytes(), planes(from_planes(body)[hit])

    return lambda parts: common.batches(rows(parts), ROW_SCHEMA, 256)


def least_overlap(n: int, similar: tuple[int, int]) -> int:
    """Of a set of n elements and any that it links with."""
    return -(-similar[0] * n // similar[1])


def ordered(similar: tuple[int, int]):
    """For mapInArrow over rows sorted by block, documents first: doc_id, n, digest of each document; of one that may link also its common shingles in global order and which of them are in its prefix."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def rows(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        import numpy as np

        about, digests, keys, whose = None, b"", [], []

        def flush():
            if about is None:
                return
            n = len(digests) // 16
            ids, sizes, there = np.frombuffer(about, "<i8", n), np.frombuffer(about, "<i8", n, 8 * n), np.frombuffer(about, np.uint8, n, 16 * n)
            every, own = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, whose))
            order = np.lexsort((every, own))
            every, bounds = every[order], np.searchsorted(own[order], np.arange(n + 1))
            for i in range(n):
                size, found = int(sizes[i]), every[bounds[i] : bounds[i + 1]]
                spare = len(found) - least_overlap(size, similar)
                may = size > 0 and spare >= 0
                yield int(ids[i]) if there[i] else None, size, digests[16 * i : 16 * i + 16], found.tobytes() if may else None, found[: spare + 1].tolist() if may else None

        for part in parts:
            for kind, tokens, body in zip(*(part.column(c).to_pylist() for c in (0, 3, 4))):
                if kind == DOCUMENTS:
                    yield from flush()
                    about, digests, keys, whose = tokens, body, [], []
                else:
                    keys.append(np.frombuffer(tokens, "<u8"))
                    whose.append(from_planes(body))
        yield from flush()

    return lambda parts: common.batches(rows(parts), schema, 512)


def sets_of(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, shard: int = SHARD) -> DataFrame:
    """doc_id, n, digest, keys, prefix of each row (see ordered())."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(1, size // CELL_BYTES)
    drop = max(0, BITS - SPARE_BITS - max(1, size // 4).bit_length())
    counts = common.written(common_tokens(docs, width, cells, drop), "shingle-counts")
    total = counts.agg(F.sum("total")).first()[0] or 0
    shards = counts.select("cell", F.ceil(F.col("total") / max(shard, total // MOST_SHARDED)).cast("int").alias("shards"))
    ours = counts.join(shards, "cell").select(
        F.lit(COUNTS).alias("kind"), "cell", F.lit(-1).cast("long").alias("block"), "tokens", F.col("classes").alias("body"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    )
    asked = lookups(docs, width, cells, drop).join(F.broadcast(shards.where("shards > 1")), "cell", "left")  # MOST_SHARDED rows at most
    spread = F.when(F.col("kind") == DOCUMENTS, F.pmod(F.hash("block"), F.lit(1 << 20))).otherwise(F.pmod(F.hash("block"), F.coalesce("shards", F.lit(1))))
    dealt = ours.unionByName(asked.withColumn("shard", spread).drop("shards")).repartition("cell", "shard").sortWithinPartitions("cell", "shard", "kind")
    found = common.arrow_map(dealt.select(*ROW_SCHEMA.names), answered(drop), ROWS)
    by_block = found.repartition("block").sortWithinPartitions("block", "kind")
    return common.arrow_map(by_block.select(*ROW_SCHEMA.names), ordered(similar), "doc_id long, n long, digest binary, keys binary, prefix array<long>")


class Trie:
    """Sets (arrays in one order, sorted as sequences) as a prefix tree: a node is a range of sets, its edge the tokens that they share beyond the node above."""

    def __init__(self, sets: list, sizes):
        self.sets, self.sizes = sets, sizes
        self.low, self.high, self.begin, self.end, self.least, self.longest, self.children = [], [], [], [], [], [], []
        todo = [(self.node(0, len(sets), 0))]
        while todo:
            k = todo.pop()
            self.children[k] = own = [self.node(a, b, self.end[k]) for a, b in self.parts(k)]
            todo += own

    def node(self, low: int, high: int, begin: int) -> int:
        import numpy as np

        first, last = self.sets[low], self.sets[high - 1]
        n = min(len(first), len(last))
        apart = first[begin:n] != last[begin:n]
        self.low.append(low)
        self.high.append(high)
        self.begin.append(begin)
        self.end.append(begin + int(apart.argmax()) if apart.any() else n)
        self.least.append(int(np.min(self.sizes[low:high])))
        self.longest.append(max(len(s) for s in self.sets[low:high]))
        self.children.append([])
        return len(self.low) - 1

    def parts(self, k: int) -> list[tuple[int, int]]:
        """The ranges of a node's children: sets that end here one by one, then those that go on, by their next token."""
        low, high, at = self.low[k], self.high[k], self.end[k]
        if high - low == 1:
            return []
        nexts = [int(s[at]) if len(s) > at else -1 - i for i, s in enumerate(self.sets[low:high])]
        starts = [i for i in range(len(nexts)) if i == 0 or nexts[i] != nexts[i - 1]]
        return [(low + a, low + b) for a, b in zip(starts, [*starts[1:], len(nexts)])]


def trie_links(sets: list, sizes: list[int], similar: tuple[int, int] = SIMILAR, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the pairs of sets (rising arrays of the shingles that others have) whose Jaccard similarity is at least similar; sizes are those of the whole sets. classes: sets of one class hang together already."""
    import numpy as np

    up, down = similar
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    tokens, ranks = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    bounds = np.cumsum([0, *(len(sets[i]) for i in order)])
    ours = [ranks[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    n = np.array([sizes[i] for i in order])
    roots = np.arange(len(ours)) if classes is None else np.unique([classes[i] for i in order], return_inverse=True)[1]
    trie, flags, edges = Trie(ours, n), np.zeros(len(tokens), dtype=bool), []
    for i in range(1, len(ours)):
        mine, size = ours[i], int(n[i])

        def still():
            """How many sets before each place may link with this one and don't hang together with it yet."""
            fits = (roots[:i] != roots[i]) & (down * n[:i] >= up * size) & (up * n[:i] <= down * size)
            return np.concatenate([[0], np.cumsum(fits)])

        before = still()
        if not before[-1]:
            continue
        flags[mine] = True
        todo = [(0, 0)]
        while todo:
            k, both = todo.pop()
            low, high = trie.low[k], min(trie.high[k], i)
            if low >= i or before[high] == before[low]:
                continue
            edge = ours[low][trie.begin[k] : trie.end[k]]
            both += int(np.count_nonzero(flags[edge]))
            left = len(mine) - int(np.searchsorted(mine, edge[-1], "right")) if len(edge) else len(mine)
            need = -(-up * (size + trie.least[k]) // (up + down))
            if both + min(left, trie.longest[k] - trie.end[k]) < need:
                continue
            if trie.high[k] - low > 1:
                todo += [(c, both) for c in reversed(trie.children[k]) if trie.low[c] < i and before[min(trie.high[c], i)] > before[trie.low[c]]]
            elif down * both >= up * (size + int(n[low]) - both):
                edges.append((order[low], order[i]))
                roots[roots == roots[low]] = roots[i]
                before = still()
        flags[mine] = False
    return edges


def links(nodes: DataFrame, similar: tuple[int, int] = SIMILAR, hot: int = SLICE_SETS) -> DataFrame:
    """a, b: edges that connect all sets that link; nodes: nid, n, keys, prefix."""
    banded = nodes.select("nid", F.col("prefix").alias("bands"))
    members = families.members(banded, components.connected(simhash.candidates(banded)))
    sets = common.written(nodes.select("nid", "n", F.col("keys").alias("held")).join(members, "nid"), "sets")
    return families.links(sets, lambda held, sizes, classes: trie_links(held, sizes, similar, classes), similar, hot)


def near_duplicates(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id of each row."""
    found = common.written(sets_of(docs, width, similar), "ordered-sets")
    may = found.where("keys IS NOT NULL AND doc_id IS NOT NULL")
    owners = common.written(may.groupBy("digest").agg(F.min("doc_id").alias("nid")), "set-owners")
    nodes = may.join(owners, "digest").where("doc_id = nid").dropDuplicates(["nid", "digest"]).select("nid", "n", "keys", "prefix")
    rows = common.written(found.select("doc_id", "n", "digest").join(owners, "digest", "left").select("doc_id", "n", "nid"), "owned-rows")
    equal = rows.where("doc_id <> nid").select(F.col("doc_id").alias("a"), F.col("nid").alias("b"))
    joined = components.connected(links(common.written(nodes, "join-nodes"), similar).unionByName(equal))
    out = rows.withColumn("node", F.coalesce("doc_id", "nid")).join(joined, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.col("component")), "node").alias("component_id"))
