"""Nearest neighbours by a forest of random-projection trees.

Trees are grown on a bounded sample: a node splits at the median along the line through two of its vectors. Every
vector is then routed to a leaf of each tree. A query walks all trees through one priority queue, ordered by how far
it lies behind the planes that it would have to cross, until the leaves that it has opened hold EFFORT times the
rows of the index; the vectors of those leaves are ranked by exact distance.

There are two waves. The first looks at the nearest leaves of one tree only, about FIRST vectors. What lies behind a
plane is at least as far away as the plane, so the second wave doesn't cross planes that are further away than the
k-th vector found so far: nothing is lost by that, it costs none of the effort, and a query that has nothing left to
cross has its exact answer.

Equal vectors are one entry with the smallest ids it needs (k + 1: no more can be among a query's k nearest), and so
are queries of equal vectors: copies cost nothing. The leaves of a tree make blocks of at most BLOCK vectors (a
larger leaf is dealt over several); a block's vectors are held, queries stream past them, and each gives its k + 1
nearest only, so no task holds all pairs, or more of the index than a block.

Isotropic vectors have no structure that trees can use: no plane is further away than their k-th vector, a recall of
0.9 needs leaves that hold about half of all rows, some of them in several trees, and the default allows for that. Data
with clusters stop long before.

Defined results: vectors that are null, empty, zero, or hold null or non-finite parts take no part, nor do rows without
an id; vectors of different lengths have no distance and are no neighbours (those of another length than most are
compared with all of their own length, in blocks); ties go to the smaller vec_id; a repeated row counts once; with no
other vector of its length a query gives no rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors that the trees are grown on, about: the bound of the sample.
SAMPLE = 16_384
TREES, LEAF, BLOCK, EFFORT, SEED = 4, 64, 8192, 1.0, 7
#: Vectors of one tree that the first wave looks at, about.
FIRST = 2048


class Forest:
    """Complete trees as arrays: node i has children 2i + 1 and 2i + 2; leaves follow the inner nodes."""

    def __init__(self, sample, rows: int):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.depth = 0
        while rows >> self.depth > LEAF and len(sample) >> self.depth > 8:
            self.depth += 1
        self.planes = []
        for _ in range(TREES):
            normals, offsets, level = [], [], [sample]
            for _ in range(self.depth):
                below = []
                for held in level:
                    normal = rng.normal(size=sample.shape[1])
                    if len(held) > 1:
                        a, b = held[rng.choice(len(held), 2, replace=False)]
                        normal = a - b
                    normal = normal / (np.linalg.norm(normal) or 1.0)
                    along = held @ normal
                    offset = float(np.median(along)) if len(held) else 0.0
                    normals.append(normal)
                    offsets.append(offset)
                    below += [held[along <= offset], held[along > offset]]
                level = below
            self.planes.append((np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets)))
        self.inner = (1 << self.depth) - 1

    def route(self, vectors):
        """The leaf of each vector in each tree: vectors x trees, from 0."""
        import numpy as np

        out = np.zeros((len(vectors), TREES), dtype=np.int32)
        for t, (normals, offsets) in enumerate(self.planes):
            at = np.zeros(len(vectors), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("nd,nd->n", vectors, normals[at]) > offsets[at])
            out[:, t] = at - self.inner
        return out

    def open(self, query, sizes, budget: float, trees: int = TREES, limit: float = float("inf")) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves to search, nearest first over some trees, without those behind planes further away than a limit."""
        queue, found = [(0.0, t, 0) for t in range(trees)], []
        limit += 1e-9 * (limit + float(query @ query) ** 0.5)  # what rounding may do to a margin
        margins = [normals @ query - offsets for normals, offsets in self.planes]
        while queue and budget > 0:
            far, t, node = heapq.heappop(queue)
            if node >= self.inner:
                found.append((t, node - self.inner))
                budget -= sizes[t][node - self.inner]
                continue
            margin = float(margins[t][node])
            near = 2 * node + 1 + (margin > 0)
            heapq.heappush(queue, (far, t, near))
            if abs(margin) <= limit:
                heapq.heappush(queue, (far + margin * margin, t, 4 * node + 3 - near))
        return found


class Blocks:
    """Which block each leaf is in, and how many parts a block has."""

    def __init__(self, sizes: list[list[int]], most: int):
        self.block, self.parts = [], []
        for own in sizes:
            at, held, block, parts = -1, most + 1, [], []
            for n in own:
                if held + n > most:
                    at, held = at + 1, 0
                    parts.append(1)
                block.append(at)
                held += n
                parts[at] = max(1, -(-held // most))
            self.block.append(block)
            self.parts.append(parts)

    def of_vector(self, tree: int, leaf: int, number: int) -> str:
        """The part of the leaf's block that a vector is in, dealt by its number in the whole index."""
        block = self.block[tree][leaf]
        return f"{tree}:{block}:{zlib.crc32(struct.pack('<q', number)) % self.parts[tree][block]}"

    def of_query(self, opened: list[tuple[int, int]]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for tree, leaf in opened:
            block = self.block[tree][leaf]
            for part in range(self.parts[tree][block]):
                out.setdefault(f"{tree}:{block}:{part}", []).append(leaf)
        return out


def matrix(column):
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector of the rows that take part."""
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    return found.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)).distinct()


SENT = "key string, query boolean, cid long, vector array<double>, leaves array<int>, ids array<long>"


def sent_schema() -> pa.Schema:
    return pa.schema([("key", pa.string()), ("query", pa.bool_()), ("cid", pa.int64()), ("vector", pa.list_(pa.float64())), ("leaves", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])


def of_own_length(classes: DataFrame, queries: DataFrame) -> DataFrame:
    """What is sent for vectors that no tree holds: each is in one of the blocks of its length, and a query asks all of them."""
    lengths = classes.groupBy(F.size("vector").alias("length")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    sized = classes.withColumn("length", F.size("vector")).join(lengths, "length")

    def sent(rows: DataFrame, query: bool, ids) -> DataFrame:
        key = F.concat_ws(":", F.lit("length"), "length", "part")
        return rows.select(key.alias("key"), F.lit(query).alias("query"), "cid", F.col("vector").cast("array<double>").alias("vector"), F.array(F.lit(0)).alias("leaves"), ids.alias("ids"))

    index = sent(sized.withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int")), False, F.col("ids"))
    asked = sized.join(queries.select("cid").distinct(), "cid", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return index.unionByName(sent(asked, True, F.lit(None).cast("array<bigint>")))


def vectors_of(column) -> list:
    """Arrays of a batch, of whatever lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def search(k: int):
    """For mapInArrow over rows sorted by (key, query): a block's vectors, then the queries that open some of its leaves."""
    schema = pa.schema([("query_cid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])

    def rows(parts):
        import numpy as np

        key, cids, vectors, leaves, ids, held = None, [], [], [], [], None
        for part in parts:
            flat = vectors_of(part.column(3)) if len(part) else []
            for i, (name, is_query, cid, own_leaves, own_ids) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4, 5)))):
                if name != key:
                    key, cids, vectors, leaves, ids, held = name, [], [], [], [], None
                if not is_query:
                    cids.append(cid)
                    vectors.append(flat[i])
                    leaves.append(own_leaves[0])
                    ids.append(own_ids)
                    continue
                if not vectors:
                    continue
                if held is None:
                    held = np.array(vectors), np.array(leaves), np.array([x[0] for x in ids])
                some = np.flatnonzero(np.isin(held[1], own_leaves))
                away = held[0][some] - flat[i]
                distance = np.sqrt(np.einsum("nd,nd->n", away, away))
                for j in np.lexsort((held[2][some], distance))[: k + 1] if len(some) <= 4 * k else nearest(distance, held[2][some], k + 1):
                    yield cid, float(distance[j]), ids[some[j]]

    return lambda parts: common.batches(rows(parts), schema)


def nearest(distance, ids, n: int):
    """Positions of the n smallest by (distance, id)."""
    import numpy as np

    limit = np.partition(distance, n - 1)[n - 1]
    few = np.flatnonzero(distance <= limit)
    return few[np.lexsort((ids[few], distance[few]))][:n]


def nearest_neighbours(rows: DataFrame, k: int = 10, is_query=None, effort: float = EFFORT) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors found for each query; is_query: a condition on vec_id (every hundredth)."""
    import numpy as np

    is_query = (F.col("vec_id") % 100 == 0) if is_query is None else is_query
    found = common.written(usable(rows), "vectors")
    first = W.partitionBy("vector").orderBy("vec_id")
    smallest = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    every = common.written(smallest.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    queries = common.written(found.where(is_query).join(every.select("vector", "cid"), "vector").select(F.col("vec_id").alias("query_id"), "cid"), "queries")

    lengths = every.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").take(2)
    length, n = lengths[0] if lengths else (0, 0)
    classes = every.where(F.size("vector") == length)
    drawn = F.pmod(F.xxhash64(F.lit("trees"), "cid"), F.lit(1 << 30)) < min(1.0, SAMPLE / max(1, n)) * float(1 << 30)
    sample = matrix(classes.where(drawn).orderBy("cid").select("vector").toArrow().column(0).combine_chunks()) if n else np.zeros((0, 1))
    forest = Forest(sample, n)

    def route(parts):
        for part in parts:
            leaves = forest.route(matrix(part.column(1))) if len(part) else np.zeros((0, TREES), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.list_(pa.float64())), part.column(2), pa.array(leaves.tolist(), pa.list_(pa.int32()))], names=["cid", "vector", "ids", "leaves"])

    routed = common.written(common.arrow_map(classes.select("cid", "vector", "ids"), route, "cid long, vector array<double>, ids array<long>, leaves array<int>"), "routed")
    sizes = [[0] * (forest.inner + 1) for _ in range(TREES)]
    for r in routed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():  # as many rows as leaves
        sizes[r.tree][r.leaf] = r["count"]
    blocks = Blocks(sizes, BLOCK)

    def index(trees):
        def rows(parts):
            def out():
                for part in parts:
                    for cid, vector, ids, leaves in zip(*(part.column(i).to_pylist() for i in range(4))):
                        for tree, leaf in enumerate(leaves[:trees]):
                            yield blocks.of_vector(tree, leaf, cid), False, cid, vector, [leaf], ids

            yield from common.batches(out(), sent_schema(), 1024)

        return common.arrow_map(routed, rows, SENT)

    def ask(asked, opened):
        """The queries (cid, vector, limit) as they are sent to the blocks of the leaves that they open."""

        def rows(parts):
            def out():
                for part in parts:
                    flat = matrix(part.column(1)) if len(part) else None
                    for i, (cid, limit) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                        for key, leaves in blocks.of_query(opened(flat[i], limit)).items():
                            yield key, True, cid, flat[i].tolist(), leaves, None

            yield from common.batches(out(), sent_schema(), 1024)

        return common.arrow_map(asked, rows, SENT)

    def first_leaves(query, limit=None) -> list[tuple[int, int]]:
        return forest.open(query, sizes, min(FIRST, effort * n), trees=1)

    def other_leaves(query, limit: float) -> list[tuple[int, int]]:
        seen = set(first_leaves(query))
        if sum(sizes[t][leaf] for t, leaf in seen) == n:
            return []
        return [x for x in forest.open(query, sizes, effort * n, limit=limit) if x not in seen]

    def searched(sent: DataFrame) -> DataFrame:
        return common.arrow_map(sent.repartition("key").sortWithinPartitions("key", "query"), search(k), "query_cid long, score double, ids array<long>")

    asked = routed.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "vector")
    near = common.written(searched(index(1).unionByName(ask(asked.withColumn("limit", F.lit(0.0)), first_leaves))), "near")
    nth = F.row_number().over(W.partitionBy("query_cid").orderBy("score"))  # k + 1 classes: the query's own may be one
    limits = near.withColumn("place", nth).where(F.col("place") == k + 1).select(F.col("query_cid").alias("cid"), F.col("score").alias("limit"))
    bounded = asked.join(limits, "cid", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    sent = index(TREES).unionByName(ask(bounded, other_leaves))
    if len(lengths) > 1:
        sent = sent.unionByName(of_own_length(every.where(F.size("vector") != length), queries))
    near = near.unionByName(searched(sent))
    best = W.partitionBy("query_cid").orderBy("score", "vec_id")
    ranked = near.select("query_cid", "score", F.explode("ids").alias("vec_id")).distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    own = queries.join(ranked, queries.cid == ranked.query_cid).where("vec_id <> query_id")
    return own.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
