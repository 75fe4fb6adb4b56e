"""Candidates scored through the model that they would be merged into.

A correction goes into one neuron of the graph and only what reads that neuron changes. So a batch of records computes
the model once, and for each candidate the correction and the few neurons behind the anchor, in numpy; all candidates and
their baseline share one pass over the corpus, and what is shuffled is a sum for each of them and task. The scores are
those of the merged models: activations, clamps and branches behind the anchor count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import merging, patches
from .promotion import UNIT_COST, UNITS_OF_SPLIT, Scores
from .residuals import Model, computed, edges_of, is_input


class Behind:
    """What of a model changes with a correction of one output: the neuron that takes it, and those that read what has changed."""

    def __init__(self, model: Model, output: int = 0):
        self.model, self.output = model, model.outputs[output]
        self.anchor = merging.anchor_of(model, self.output)
        touched, self.changed = {self.anchor.neuron}, []
        for neuron in model.neurons:
            if neuron["id"] in touched or any(s in touched for s, _, _ in edges_of(neuron)):
                touched.add(neuron["id"])
                self.changed.append(neuron)

    def corrected(self, values: dict, n: int, correction):
        """The output of n records whose correction is given; values: the uncorrected ones of all neurons."""
        now = dict(values)
        for neuron in self.changed:
            more = correction / self.anchor.gain if neuron["id"] == self.anchor.neuron else 0.0
            _, now[neuron["id"]] = computed(neuron, now, n, more)
        return now[self.output]


def squared_errors(rows: DataFrame, model: Model, candidates: Sequence[Sequence[dict]], output: int = 0, target: str = "y") -> DataFrame:
    """candidate (-1: the model as it is), records, affected (whose correction isn't 0), sse: errors against the target of the model and of the model with each candidate (a list of patches) merged, in one pass."""
    import numpy as np
    import pyarrow as pa

    behind = Behind(model, output)
    inputs = sorted({s for n in model.neurons for s, _, _ in edges_of(n) if is_input(s)} | {f"f{i}" for parts in candidates for p in parts for i in patches.features(p)}, key=lambda s: int(s[1:]))

    def make(parts):
        sums = np.zeros((len(candidates) + 1, 3))
        for part in parts:
            n = part.num_rows
            held = {s: part.column(s).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for s in inputs}
            y = part.column(target).cast(pa.float32()).to_numpy(zero_copy_only=False).astype(np.float32)
            with np.errstate(all="ignore"):
                values, _ = model.values(held, n)
                for k, own in enumerate([None, *candidates]):
                    correction = sum((patches.values(p, held, n) for p in own), np.zeros(n)) if own is not None else None
                    out = values[behind.output] if own is None else behind.corrected(values, n, correction)
                    d = (y - out.astype(np.float32)).astype(np.float64)
                    sums[k] += n, 0 if own is None else np.count_nonzero(correction), float((d * d).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(candidates), dtype=np.int32)), *(pa.array(c) for c in sums.T)], names=["candidate", "records", "affected", "sse"])

    made = rows.select(*inputs, target).mapInArrow(make, "candidate int, records double, affected double, sse double")
    return made.groupBy("candidate").agg(F.sum("records").cast("long").alias("records"), F.sum("affected").cast("long").alias("affected"), F.sum("sse").alias("sse"))


def scorer(model: Model, output: int = 0, target: str = "y", carried: int = 0) -> Callable[[DataFrame, Sequence[tuple[str, list[dict]]]], Scores]:
    """A scorer of rows with the inputs f0, f1, ... and the target. carried: splits that the model has from earlier candidates, which cost as they did when they were accepted."""

    def score(rows: DataFrame, candidates: Sequence[tuple[str, list[dict]]]) -> Scores:
        listed, out = list(candidates), {}
        for r in squared_errors(rows, model, [parts for _, parts in listed], output, target).collect():  # a row for each candidate
            own = 0 if r.candidate < 0 else sum(patches.splits(p) for p in listed[r.candidate][1])
            error = r.sse / r.records if r.records else 0.0
            out["baseline" if r.candidate < 0 else listed[r.candidate][0]] = (1 - error - UNIT_COST * UNITS_OF_SPLIT * (carried + own), error, r.records, r.affected)
        return out or {"baseline": (1.0 - UNIT_COST * UNITS_OF_SPLIT * carried, 0.0, 0, 0)}

    return score
