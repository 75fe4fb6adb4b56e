"""Trees of depth 1 to 3, any number at once: each round is one histogram pass with the leaf as a key.

The binned records are read once a round for all trees, and of two new leaves only the smaller one's are summed: the
larger one is what is left of their parent. What comes back is one best split a leaf. Level-wise growth splits every leaf
that has a split, best-first the best of all. Trees that start from given roots share the histogram of all records. The leaf
is a CASE over bins, so plans stay as short as the trees are deep; binned records are kept (persisted, so what an executor
loses is computed again), the histograms of the leaves too, both until the trees are grown.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patches
from .histogram import Controls, best_by_leaf, histogram, packed_histogram, splits_at, subtract


@dataclass
class Leaf:
    path: tuple  # of (feature, bin, threshold, right)
    n: float = 0.0
    s: float = 0.0
    best: object = None
    open: bool = True
    id: int = 0  # all trees' roots are leaf 0
    parent: int = -1
    tree: int = 0


@dataclass
class Tree:
    depth: int
    leaves: list[Leaf] = field(default_factory=list)
    gain: float = 0.0
    affected: float = 0.0

    def node(self, most: float, prefix: tuple = ()) -> dict:
        here = [leaf for leaf in self.leaves if leaf.path[: len(prefix)] == prefix]
        if len(here) == 1 and here[0].path == prefix:
            return patches.leaf(mean(here[0], most))
        feature, bin_, threshold, _ = here[0].path[len(prefix)]
        step = lambda right: (*prefix, (feature, bin_, threshold, right))
        return patches.split(feature, threshold, self.node(most, step(False)), self.node(most, step(True)))


def mean(leaf: Leaf, most: float) -> float:
    import numpy as np

    return float(np.float32(max(-most, min(most, leaf.s / leaf.n)))) if leaf.n > 0 else 0.0


def reaches(path: Sequence) -> Column:
    """Whether a binned row reaches the leaf."""
    out = F.lit(True)
    for feature, bin_, _, right in path:
        out = out & ((F.col(f"b{feature}") > bin_) == F.lit(right))
    return out


def snapshot(leaves: list[Leaf], most: float) -> Tree:
    gain = affected = 0.0
    for leaf in leaves:
        c = mean(leaf, most)
        gain += 2 * c * leaf.s - leaf.n * c * c
        affected += leaf.n if c else 0.0
    return Tree(max(len(x.path) for x in leaves), [Leaf(x.path, x.n, x.s) for x in leaves], gain, affected)


def renamed(hist: DataFrame, to: dict[int, list[int]]) -> DataFrame:
    """The histograms of some leaves under the numbers of others, once for each."""
    names = F.create_map(*[x for leaf, ids in to.items() for x in (F.lit(leaf), F.array(*map(F.lit, ids)))])
    return hist.where(F.col("leaf").isin(list(to))).withColumn("leaf", F.explode(F.element_at(names, F.col("leaf"))))


def histograms(binned: DataFrame, fresh: Sequence[Leaf], before: DataFrame | None, width: int, held: list[DataFrame]) -> DataFrame:
    """leaf, feature, bin, n, s, q of the fresh leaves: the smaller of two siblings by a pass over its records, the other by subtraction from their parent. before: the histograms of all leaves so far; what is persisted goes into held."""
    weight = "weight" if "weight" in binned.columns else None
    pairs: dict[tuple[int, int], list[Leaf]] = {}
    for leaf in fresh:
        pairs.setdefault((leaf.tree, leaf.parent), []).append(leaf)
    summed = [min(own, key=lambda x: (x.n, x.id)) for own in pairs.values()]
    if "bins" in binned.columns:
        made = packed_histogram(binned, width, [(x.id, x.path) for x in summed], weight)
    else:
        own: dict[int, Column] = {}  # by tree: which of its leaves a record is in
        for x in summed:
            own[x.tree] = F.when(reaches(x.path), F.lit(x.id)).otherwise(own.get(x.tree, F.lit(None).cast("int")))
        made = histogram(binned.withColumn("leaf", F.explode(F.array_compact(F.array(*own.values())))), width, ["leaf"], weight)
    rest: dict[int, list[tuple[int, int]]] = {}  # by parent: (the sibling that is summed, the other)
    for small, own_pair in zip(summed, pairs.values()):
        if len(own_pair) == 2:
            rest.setdefault(small.parent, []).append((small.id, next(x.id for x in own_pair if x is not small)))
    if before is None or not rest:
        return made
    made = made.persist()
    held.append(made)
    parents = renamed(before, {p: [large for _, large in own_pairs] for p, own_pairs in rest.items()})
    children = renamed(made, {small: [large] for own_pairs in rest.values() for small, large in own_pairs})
    return made.unionByName(subtract(parents, children, ["leaf"]).where("n > 0"))


class Growth:
    """One tree as it grows."""

    def __init__(self, tree: int, root: tuple[int, int] | None):
        self.tree, self.root = tree, root
        self.leaves, self.done, self.splits = [Leaf((), tree=tree)], {}, 0

    def step(self, controls: Controls, max_depth: int, best_first: bool, ids: Iterator[int]) -> list[Leaf]:
        """Split what is to be split next; the leaves that are to be looked at for that after. Leaves that stay keep their best split in best-first growth, as they stay eligible."""
        able = [i for i, leaf in enumerate(self.leaves) if leaf.best is not None and (best_first or leaf.open)]
        if best_first and able:
            able = [min(able, key=lambda i: (-self.leaves[i].best.gain, self.leaves[i].best.feature, self.leaves[i].best.bin))]
        grown, new = [], []
        for i, leaf in enumerate(self.leaves):
            leaf.open = False
            if i not in able or self.splits >= 2**max_depth - 1 or len(leaf.path) >= max_depth:
                grown.append(leaf)
                continue
            b, self.splits = leaf.best, self.splits + 1
            for right, n, c in ((False, b.left_records, b.left_correction), (True, b.right_records, b.right_correction)):
                new.append(Leaf((*leaf.path, (b.feature, b.bin, b.threshold, right)), n, c * n, id=next(ids), parent=leaf.id, tree=self.tree))
                grown.append(new[-1])
        self.leaves = grown
        if not new:
            return []
        tree = snapshot(grown, controls.max_correction)
        self.done[tree.depth] = tree
        return new if tree.depth < max_depth and self.splits < 2**max_depth - 1 else []


def grow_trees(binned: DataFrame, edges: DataFrame, width: int, controls: Controls, max_depth: int = 3, best_first: bool = False, roots: Sequence[tuple[int, int] | None] = (None,)) -> list[list[Tree]]:
    """For each root (feature, bin of the first split; None: the best) the last tree of each depth, in as many passes as the tallest of them takes; binned: a column for each feature's bin, or all packed in one."""
    max_depth = min(3, max(1, max_depth))
    cells = ["bins"] if "bins" in binned.columns else [f"b{i}" for i in range(width)]
    kept = binned.select(*cells, "residual", *(["weight"] if "weight" in binned.columns else [])).persist()
    held: list[DataFrame] = [kept]
    growths, ids, before = [Growth(i, root) for i, root in enumerate(roots)], itertools.count(1), None
    todo = [Leaf(())] if growths else []
    try:
        while todo:
            hist = histograms(kept, todo, before, width, held).persist()
            held.append(hist)
            totals = {r.leaf: r for r in hist.where("feature = 0").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
            found = {r.leaf: r for r in best_by_leaf(hist, edges, controls).collect()}
            given = {(r.feature, r.bin): r for r in splits_at(hist, edges, controls, [r for r in roots if r]).collect()} if before is None and any(roots) else {}
            before = hist if before is None else before.unionByName(hist)
            for g in growths:
                for leaf in g.leaves:
                    if leaf.open:
                        leaf.best = given.get(tuple(g.root)) if g.root and not leaf.path else found.get(leaf.id)
                        if leaf.id in totals:
                            leaf.n, leaf.s = totals[leaf.id].n, totals[leaf.id].s
            todo = [leaf for g in growths for leaf in (g.step(controls, max_depth, best_first, ids) if any(x.open for x in g.leaves) else ())]
    finally:
        for df in held:
            df.unpersist()
    return [list(g.done.values()) for g in growths]


def grow_tree(binned: DataFrame, edges: DataFrame, width: int, controls: Controls, max_depth: int = 3, best_first: bool = False, root: tuple[int, int] | None = None) -> list[Tree]:
    """The last tree of each depth."""
    return grow_trees(binned, edges, width, controls, max_depth, best_first, [root])[0]
