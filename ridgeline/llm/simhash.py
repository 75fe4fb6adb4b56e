"""SimHash near-duplicates by a binary trie self-join.

Fingerprints of equal value are one trie entry, however many documents have them. The trie is dealt out by the
pigeonhole rule: two fingerprints that differ in at most b bits agree in one of b + 1 blocks of bits, so each
fingerprint goes once to each block's value, where that block has no error budget left to spend. A group is a trie
over its sorted fingerprints (a node is a range that shares a prefix); pairs of nodes are walked together, add up
the bits in which their prefixes differ and stop as soon as the budget is exceeded. A group gives the edges of a
spanning forest only, never all its pairs, so links of different texts are kept and dense groups stay small.
Groups that are hot (by a count, not a sample) are dealt again by a further block of the bits that remain, and in the
end by pairs of slices: every slice of a hot group meets every other in a task of bounded size.

drop_near_duplicates() is the form for filtering a corpus, by the exact Jaccard similarity of the sets of five-word
shingles: 0.8 or more is a near copy, and anything less is none. The same trie join links the SimHashes of these sets, and
what it links are candidates. Bits of a SimHash can't tell 0.8 from 0.7 (no budget of bits keeps all of the first), so bands
of minima of the shingles' hashes add the pairs that are beyond the trie's budget (a pair of similarity 0.8 shares none of
the 40 bands of five with probability 1.3e-7, closer ones more rarely). A component of the trie is one more key that texts
share. Candidates only say which texts have to meet: in each component of
them texts are held against hubs first, and those of different classes then meet in pairs of slices (families.py),
where an exact set-similarity join (prefix and length filters, then counting) gives the links. The rule is the same at
every size: within a component all classes are compared, also where they share no key. Texts that an exact link has joined
already aren't compared again, so a family of copies costs links in proportion to its size and never all its pairs.

Defined results: a null text counts as empty; a document without words has fingerprint zero and links like any
other; fewer words than a shingle are one shingle; a null doc_id joins its component but never names it (it is
null only if all its ids are); repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, families

BITS, SEED = 64, 42
#: Odd multiplier that mixes hashes for further lanes.
MIX = 0x9E3779B97F4A7C15
#: The corpus form: words of a shingle, bands and the minima of each, and the least similarity of near copies as a fraction.
WIDTH, BANDS, ROWS, SIMILAR = 5, 40, 5, (4, 5)
#: Groups beyond this many fingerprints are dealt again.
HOT_GROUP = 2048
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15
#: Pairs below which two nodes are compared directly, and below which that is done one by one.
LEAF_PAIRS, PLAIN_PAIRS = 64, 2048


def fingerprint(text: bytes, width: int = 3, lanes: int = 1) -> int:
    """SimHash of the word shingles, 64 bits for each lane: a bit is 1 if over half of the shingles' hashes have it. Later lanes mix the hash anew."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros((lanes, BITS), dtype=np.int64)
    for start in range(0, n, COUNTED):
        some = words[start : min(n, start + COUNTED) + width - 1]
        shingles = map(b" ".join, zip(*(some[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        for lane in range(lanes):
            counts[lane] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(MIX)
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def set_fingerprint(hashes) -> int:
    """SimHash of a set of 64-bit hashes: a bit is 1 if over half of them have it."""
    import numpy as np

    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[start : start + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = pa.array([signed(fingerprint(t.as_py(), width)) for t in part.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), found], schema=schema)

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")), make, "doc_id long, fp long")


class Forest:
    """Union of sets over the entries of one group; keeps the edges that joined two sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def lanes_of(values: list[int], bits: int) -> list:
    import numpy as np

    return [np.array([v >> s & (1 << 64) - 1 for v in values], dtype=np.uint64) for s in range(0, bits, 64)]


def compared(found: Forest, values: list[int], arrays: list, bits: int, l1: int, h1: int, l2: int, h2: int, budget: int) -> None:
    """Leaf of the walk: two small ranges, entry by entry."""
    import numpy as np

    if (h1 - l1) * (h2 - l2) <= PLAIN_PAIRS:
        for i in range(l1, h1):
            a = values[i]
            for j in range(max(l2, i + 1) if l1 == l2 else l2, h2):
                if (a ^ values[j]).bit_count() <= budget:
                    found.join(i, j)
        return
    if not arrays:
        arrays += lanes_of(values, bits)
    for i in range(l1, h1):
        start = i + 1 if l1 == l2 else l2
        apart = sum(np.bitwise_count(lane[start:h2] ^ lane[i]).astype(np.int16) for lane in arrays)
        for j in np.flatnonzero(apart <= budget).tolist():
            found.join(i, start + j)


def trie_links(values: list[int], budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the pairs of sorted, distinct values that differ in at most budget bits."""
    found, arrays = Forest(len(values)), []
    few = LEAF_PAIRS if budget * 8 < bits else bits * LEAF_PAIRS  # a generous budget prunes late: end the walk early

    def halves(low: int, high: int, bit: int) -> int:
        """Where the node's child 1 starts; its values share all higher bits."""
        return bisect_left(values, (values[low] >> bit | 1) << bit, low, high)

    todo = [(0, len(values), 0, len(values), bits, 0)]
    while todo:
        l1, h1, l2, h2, bit, errors = todo.pop()
        if l1 == h1 or l2 == h2 or errors > budget:
            continue
        if (h1 - l1) * (h2 - l2) <= few or bit == 0:
            compared(found, values, arrays, bits, l1, h1, l2, h2, budget)
            continue
        bit -= 1
        m1 = halves(l1, h1, bit)
        if l1 == l2:  # a node with itself
            todo += [(l1, m1, l1, m1, bit, errors), (m1, h1, m1, h1, bit, errors), (l1, m1, m1, h1, bit, errors + 1)]
        else:
            m2 = halves(l2, h2, bit)
            todo += [(l1, m1, l2, m2, bit, errors), (m1, h1, m2, h2, bit, errors), (l1, m1, m2, h2, bit, errors + 1), (m1, h1, l2, m2, bit, errors + 1)]
    return found.edges


def edges_of(budget: int):
    """For mapInArrow over rows sorted by (key, fp): the edges within each key's group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(parts):
        key, held = None, []

        def flush():
            values = sorted(v & (1 << 64) - 1 for v in held)
            for i, j in trie_links(values, budget) if len(values) > 1 else ():
                yield signed(values[i]), signed(values[j])

        for part in parts:
            for k, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if k != key:
                    yield from flush()
                    key, held = k, []
                held.append(v)
        yield from flush()

    return lambda parts: common.batches(rows(parts), schema)


def block_sizes(bits: int, blocks: int) -> list[int]:
    return [bits // blocks + (i < bits % blocks) for i in range(blocks)]


def dealt(fps: DataFrame, budget: int, hot: int, levels: int = 3) -> DataFrame:
    """key, fp: each fingerprint once for each block of its bits; hot keys are dealt again by blocks of the bits that remain.

    The key is the text of the blocks taken so far; rest is what remains of the fingerprint, as a string of bits.
    """
    now = fps.select(F.lit("").alias("key"), "fp", F.lpad(F.conv(F.hex("fp"), 16, 2), BITS, "0").alias("rest"))
    out, bits = None, BITS
    for level in range(levels):
        sizes = block_sizes(bits, budget + 1)
        starts = [sum(sizes[:i]) for i in range(len(sizes))]
        options = F.array(
            *[
                F.struct(
                    F.concat("key", F.lit(f"{i}:"), F.substring("rest", s + 1, n), F.lit("/")).alias("key"),
                    F.concat(F.substring("rest", 1, s), F.substring("rest", s + n + 1, BITS)).alias("rest"),
                )
                for i, (s, n) in enumerate(zip(starts, sizes))
            ]
        )
        now = now.select("fp", F.explode(options).alias("o")).select("o.key", "fp", "o.rest")
        bits -= sizes[0]
        if level == levels - 1 or len(set(sizes)) > 1 or bits < 2 * (budget + 1):
            return now.select("key", "fp") if out is None else out.unionByName(now.select("key", "fp"))
        now = common.written(now, "blocks")
        hot_keys = now.groupBy("key").count().where(F.col("count") > hot).select("key")
        if not hot_keys.take(1):
            cool, now = now, None
        else:
            hot_keys = common.written(hot_keys, "hot-keys")
            cool, now = now.join(hot_keys, "key", "left_anti"), now.join(hot_keys, "key", "left_semi")
        out = cool.select("key", "fp") if out is None else out.unionByName(cool.select("key", "fp"))
        if now is None:
            return out
    return out


def links(fps: DataFrame, budget: int = 3, hot: int = HOT_GROUP) -> DataFrame:
    """a, b: edges that connect all distinct fingerprints of at most budget differing bits; fps: distinct fp."""
    keyed = slices(common.written(dealt(fps, budget, hot), "dealt"), hot).repartition("key").sortWithinPartitions("key")
    return common.arrow_map(keyed.select("key", "fp"), edges_of(budget), "a long, b long")


def classes(made: DataFrame, budget: int = 3, hot: int = HOT_GROUP) -> DataFrame:
    """fp, component_id (smallest doc_id reachable) of each distinct fp; made: doc_id, fp."""
    reps = common.written(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-owners")
    joined = components.connected(links(reps.select("fp"), budget, hot)).withColumnRenamed("node", "fp")
    marked = reps.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = marked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return marked.select("fp", "component").join(least, "component").select("fp", "component_id")


def slices(keyed: DataFrame, hot: int) -> DataFrame:
    """The rows of keyed (key string); those of a key with more rows than hot go to a key for each pair of slices that holds theirs."""
    sizes = keyed.groupBy("key").agg((F.count("*") / F.lit(hot)).alias("size")).where("size > 1").select("key", F.ceil("size").cast("int").alias("slices"))
    sizes = common.written(sizes, "hot-slices")
    if not sizes.take(1):
        return keyed
    cool = keyed.join(sizes.select("key"), "key", "left_anti")
    own = F.pmod(F.xxhash64(F.lit("slice"), *[c for c in keyed.columns if c != "key"]), F.col("slices")).cast("int")
    warm = keyed.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    pair = F.concat("key", F.lit("#"), F.least("own", "other").cast("string"), F.lit("-"), F.greatest("own", "other").cast("string"))
    return cool.unionByName(warm.withColumn("key", pair).select(*cool.columns))


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    made = common.written(fingerprints(docs, width), "fingerprints")
    return made.join(classes(made, budget), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, width: int = WIDTH):
    """The distinct hashes of a text's word shingles, sorted; empty without a word."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n))


def mixed(values):
    """Hashes of hashes, whose order has nothing to do with that of the values."""
    import numpy as np

    values = (values ^ (values >> np.uint64(32))) * np.uint64(MIX)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def band_keys(shingles):
    """A key for each band: texts share it if all minima of the band are equal."""
    import numpy as np

    seeds = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(MIX))[:, None]
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for start in range(0, len(shingles), 512):
        np.minimum(least, mixed(shingles[None, start : start + 512] + seeds).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(MIX) + column)
    return keys.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles (digest of the set), fp (its SimHash), bands of each row with a word."""
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def rows(parts):
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                found = shingle_set(text.as_py(), width)
                if len(found):
                    yield doc_id, xxhash.xxh128_digest(found.tobytes()), signed(set_fingerprint(found)), band_keys(found)

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_bytes().alias("text")), lambda parts: common.batches(rows(parts), schema, 512), "doc_id long, shingles binary, fp long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """key, nid, hub, is_hub, n and held (the shingle set as bytes) of each row with a word of key, nid, hub, is_hub, text (bytes)."""
    schema = pa.schema([("key", pa.string()), ("nid", pa.int64()), ("hub", pa.int64()), ("is_hub", pa.bool_()), ("n", pa.int64()), ("held", pa.binary())])

    def make(parts):
        for part in parts:
            held = [shingle_set(t.as_py(), width).tobytes() for t in part.column(4)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array([len(h) // 8 for h in held], pa.int64()), pa.array(held, pa.binary())], schema=schema)

    return common.arrow_map(texts.select("key", "nid", "hub", "is_hub", "text"), make, "key string, nid long, hub long, is_hub boolean, n long, held binary").where("n > 0")


def exact_links(sets: list, similar: tuple[int, int] = SIMILAR, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the pairs of sets (sorted arrays) whose Jaccard similarity is at least similar. classes: sets of one class hang together already.

    Prefix filter: with a set's elements ordered rarest first, a pair that is similar shares one of the first
    n - ceil(similar * n) + 1 elements of both.
    """
    import numpy as np

    up, down = similar
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    held = np.concatenate(sets)  # one copy, sorted in place: groups may be tens of MB
    held.sort()
    firsts = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
    tokens, counts = held[firsts], np.diff(np.append(firsts, len(held)))
    del held, firsts
    places = np.empty(len(tokens), dtype=np.int32)
    places[np.argsort(counts, kind="stable")] = np.arange(len(tokens), dtype=np.int32)
    del counts
    prefixes = [np.sort(places[np.searchsorted(tokens, s)])[: n - -(-up * n // down) + 1] for s, n in zip(sets, sizes.tolist())]
    starts = np.zeros(len(tokens) + 1, dtype=np.int64)
    del tokens, places
    listed = np.concatenate(prefixes)
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), [len(p) for p in prefixes])
    owners = owners[np.argsort(listed, kind="stable")]  # the owners of an element in order of their place
    np.cumsum(np.bincount(listed, minlength=len(starts) - 1), out=starts[1:])
    del listed
    roots, edges = np.arange(len(sets)) if classes is None else np.unique([classes[i] for i in order], return_inverse=True)[1], []
    flags = np.zeros(len(sets), dtype=bool)
    for i in range(1, len(sets)):
        first = int(np.searchsorted(sizes, -(-up * int(sizes[i]) // down)))
        if first >= i:
            continue
        flags[:i] = False
        for p in prefixes[i].tolist():
            if starts[p + 1] - starts[p] > 1:
                flags[owners[starts[p] : starts[p + 1]]] = True
        found = np.flatnonzero(flags[first:i]) + first
        found = found[roots[found] != roots[i]]
        while len(found):
            j = int(found[0])
            at = np.minimum(np.searchsorted(sets[i], sets[j]), len(sets[i]) - 1)
            both = int((sets[i][at] == sets[j]).sum())
            if both * down >= up * (len(sets[i]) + len(sets[j]) - both):
                edges.append((order[i], order[j]))
                roots[roots == roots[j]] = roots[i]
                found = found[roots[found] != roots[i]]
            else:
                found = found[1:]
    return edges


def with_trie(nodes: DataFrame, hot: int) -> DataFrame:
    """nid, bands of nodes (nid, fp, bands): a last key is the component that the trie join gives the node's fingerprint."""
    joined = classes(nodes.select(F.col("nid").alias("doc_id"), "fp"), hot=hot)
    own = F.xxhash64(F.lit("trie"), F.col("component_id"))
    return nodes.join(joined, "fp").select("nid", F.concat("bands", F.array(own)).alias("bands"))


def candidates(nodes: DataFrame) -> DataFrame:
    """a, b: edges that connect all nodes (nid, bands) that share a key."""
    keyed = nodes.select("nid", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("nid").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "a")
    return keyed.join(least, "band").where("nid > a").select("a", F.col("nid").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, width: int = WIDTH, similar: tuple[int, int] = SIMILAR, hot: int = HOT_GROUP) -> DataFrame:
    """The rows of docs, with their own columns, that stay: of each component of near copies the rows of its smallest doc_id (all rows, if none has an id). Rows without a word stay."""
    made = common.written(signatures(docs.where("doc_id IS NOT NULL"), width), "signatures")
    nodes = made.groupBy("shingles").agg(F.min("doc_id").alias("nid"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    nodes = common.written(nodes, "near-nodes")
    banded = common.written(with_trie(nodes, hot), "near-keys")
    members = families.members(banded, components.connected(candidates(banded)))
    texts = docs.select(F.col("doc_id").cast("long").alias("nid"), common.text_bytes().alias("text")).join(members, "nid")
    sets = common.written(shingle_sets(texts, width), "shingle-sets")
    joined = components.connected(families.links(sets, lambda held, sizes, classes: exact_links(held, similar, classes), similar, hot))
    # what goes: rows of a set's other ids, and sets that aren't their component's smallest
    owners = nodes.join(joined.withColumnRenamed("node", "nid"), "nid", "left").select("shingles", F.coalesce("component", "nid").alias("keep_id"))
    gone = made.join(owners, "shingles").where("doc_id <> keep_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col("doc_id").cast("long") == gone.gone_id, "left_anti")
