"""Families of sets: which sets of a component of candidates hang together, without all its pairs in one task.

Candidates say which sets may link; a component of them may be large, and most of a large one is usually one family. So
each set is first held against one hub, the smallest set that most of its candidate keys name, in a join of one row of
the hub for each set, which Spark may split. Components that are one class by then are done, however large. In the
others only sets of different classes have to meet: a class of many sets has slices of its own, which never meet one
another, small classes share slices whole, and every other two slices of a component meet in a task of bounded size.
Links are what an exact comparison gives, so no link between classes is lost, and the rule is the same at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

#: Bytes of sets that a slice holds, about.
SLICE_BYTES = 16 << 20
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])

#: (sets as sorted arrays, sizes, class of each) -> edges (positions) of links that join classes.
Linker = Callable[[list, list, list], list]


def members(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """key, nid, hub, is_hub of the nodes (nid, bands) of components of candidates (met: node, component): a node's hub is, of the smallest nids of the keys that it shares with smaller ones, the one that most of them name; none of the first of its kind."""
    keyed = nodes.select("nid", F.explode("bands").alias("band"))
    least = keyed.groupBy("band").agg(F.min("nid").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    named = keyed.join(least, "band").where("nid > hub").groupBy("nid", "hub").count()
    best = named.groupBy("nid").agg(F.max(F.struct(F.col("count"), (-F.col("hub")).alias("minus"))).alias("b"))
    best = common.written(best.select("nid", (-F.col("b.minus")).alias("hub")), "hubs")
    hubs = best.select(F.col("hub").alias("nid")).distinct().withColumn("is_hub", F.lit(True))
    found = met.select(F.col("node").alias("nid"), F.col("component").cast("string").alias("key")).join(best, "nid", "left").join(hubs, "nid", "left")
    return found.select("key", "nid", "hub", F.coalesce("is_hub", F.lit(False)).alias("is_hub"))


def links_with(similar: tuple[int, int]):
    """For mapInArrow over nid, n, held, hub, hub_n, hub_held: the edges of those whose Jaccard similarity is at least similar."""
    import numpy as np

    up, down = similar

    def rows(parts) -> Iterator[tuple[int, int]]:
        for part in parts:
            for nid, n, held, hub, hub_n, hub_held in zip(*(part.column(i).to_pylist() for i in range(6))):
                if up * max(n, hub_n) <= down * min(n, hub_n):
                    both = len(np.intersect1d(np.frombuffer(held, "<u8"), np.frombuffer(hub_held, "<u8"), assume_unique=True))
                    if down * both >= up * (n + hub_n - both):
                        yield nid, hub

    return lambda parts: common.batches(rows(parts), EDGES)


def edges_within(linker: Linker):
    """For mapInArrow over rows (pair, nid, n, held, class) sorted by pair: the edges that the linker finds within each pair."""
    import numpy as np

    def rows(parts):
        now, held = None, []

        def flush():
            if len({h[3] for h in held}) > 1:
                nids, sizes, sets, classes = zip(*held)
                for i, j in linker([np.frombuffer(s, "<u8") for s in sets], list(sizes), list(classes)):
                    yield nids[i], nids[j]

        for part in parts:
            for key, *own in zip(*(part.column(i).to_pylist() for i in range(5))):
                if key != now:
                    yield from flush()
                    now, held = key, []
                held.append(own)
        yield from flush()

    return lambda parts: common.batches(rows(parts), EDGES)


def meetings(classed: DataFrame, hot: int) -> DataFrame:
    """pair, nid, class: the pairs of slices in which each set meets sets of other classes; classed: key, nid, class, size (bytes)."""
    size = F.greatest(F.count("*") / F.lit(hot), F.sum("size") / F.lit(SLICE_BYTES)).alias("size")
    sizes = common.written(classed.groupBy("key", "class").agg(size), "class-sizes")
    large = F.col("size") > 1
    own = sizes.where(large).select("key", F.col("class").alias("group"), F.ceil("size").cast("int").alias("slices"))
    shared = sizes.where(~large).groupBy("key").agg(F.ceil(2 * F.sum("size")).cast("int").alias("slices")).select("key", F.lit(None).cast("long").alias("group"), F.greatest("slices", F.lit(1)).alias("slices"))
    listed = own.unionByName(shared).groupBy("key").agg(F.collect_list(F.struct("group", "slices")).alias("groups"))  # a large class has over `hot` sets: few for a component
    marked = classed.join(sizes.select("key", "class", F.when(large, F.col("class")).alias("group")), ["key", "class"]).join(listed, "key")
    mine = F.filter("groups", lambda g: g["group"].eqNullSafe(F.col("group")))[0]["slices"]
    part = F.pmod(F.when(F.col("group").isNull(), F.xxhash64("class")).otherwise(F.xxhash64("nid")), mine).cast("int")
    name = lambda group, at: F.concat(F.coalesce(group.cast("string"), F.lit("small")), F.lit(":"), at.cast("string"))
    met = marked.withColumn("own", name(F.col("group"), part)).withColumn("g", F.explode("groups"))
    met = met.where(F.col("group").isNull() | F.col("g.group").isNull() | (F.col("group") != F.col("g.group"))).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("g.slices") - 1)))
    other = name(F.col("g.group"), F.col("at"))
    return met.select(F.concat("key", F.lit("#"), F.least(F.col("own"), other), F.lit("#"), F.greatest(F.col("own"), other)).alias("pair"), "nid", "class")


def links(sets: DataFrame, linker: Linker, similar: tuple[int, int], hot: int) -> DataFrame:
    """a, b: edges that connect all sets that link, of a table of sets: key, nid, hub, is_hub (members()), n (size), held (sorted 64-bit elements)."""
    theirs = sets.where("is_hub").select(F.col("nid").alias("hub"), F.col("n").alias("hub_n"), F.col("held").alias("hub_held"))
    pairs = sets.where("hub IS NOT NULL").select("nid", "n", "held", "hub").join(theirs, "hub")
    first = common.written(common.arrow_map(pairs.select("nid", "n", "held", "hub", "hub_n", "hub_held"), links_with(similar), "a long, b long"), "hub-links")
    classes = components.connected(first).select(F.col("node").alias("nid"), F.col("component").alias("class"))
    about = sets.select("key", "nid", F.octet_length("held").alias("size")).join(classes, "nid", "left")
    classed = common.written(about.select("key", "nid", F.coalesce("class", "nid").alias("class"), "size"), "classes")
    several = classed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    met = common.written(meetings(classed.join(several, "key", "left_semi"), hot), "meetings")
    dealt = sets.select("nid", "n", "held").join(met, "nid").repartition("pair").sortWithinPartitions("pair")
    return first.unionByName(common.arrow_map(dealt.select("pair", "nid", "n", "held", "class"), edges_within(linker), "a long, b long"))
