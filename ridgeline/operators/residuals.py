"""Models as columns, residuals, and what is said about them."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import semantics as sem
from ..functions.semantics import finite_or_zero, is_finite, squash, unsquash


#: Weights beyond which a model is computed by numpy over Arrow batches: generated code for each of them would grow too large.
COLUMN_WEIGHTS = 400
ROLES = (None, "condition", "positive", "negative")


class Model:
    """A feed-forward graph: neurons in order, each {"id", "squash", "bias", "in": [(source, weight[, role]), ...]}; inputs are f0, f1, ...

    A source is an input, named by its number, or a neuron that comes before. A neuron {"id", "type": "constant", "bias"}
    has its bias as its value. MINIMUM and MAXIMUM select among weighted sources and add their bias; IF adds up the
    sources of the role positive if the sum of those of the role condition is above 0, else those of the role negative
    (sources without a role are positive). Outputs come last; `output` is one id or several.
    """

    def __init__(self, neurons: list[dict], output: str | Sequence[str]):
        self.neurons = neurons
        self.outputs = [output] if isinstance(output, str) else list(output)
        self.check()

    def check(self) -> None:
        """An error for a graph that can't be computed or that breaks a rule of order."""
        seen: set[str] = set()
        hidden = False
        for n in self.neurons:
            if n["id"] in seen or is_input(n["id"]):
                raise ValueError(f"{n['id']} is there already")
            if n.get("type") == "constant":
                if hidden:
                    raise ValueError(f"the constant {n['id']} follows what is none")
                if n.get("in"):
                    raise ValueError(f"the constant {n['id']} reads something")
            else:
                hidden = True
                if n["squash"] not in sem.ACTIVATIONS and n["squash"] not in sem.AGGREGATES:
                    raise ValueError(f"no activation {n['squash']}")
            if not math.isfinite(n["bias"]):
                raise ValueError(f"the bias of {n['id']} isn't finite")
            pairs = set()
            for source, weight, role in edges_of(n):
                if not is_input(source) and source not in seen:
                    raise ValueError(f"{n['id']} reads {source} before it is there")
                if (source, role) in pairs:
                    raise ValueError(f"{n['id']} reads {source} twice in one role")
                if role not in ROLES or (role and n["squash"] != "IF"):
                    raise ValueError(f"{n['id']} has no role {role}")
                if not math.isfinite(weight):
                    raise ValueError(f"a weight of {n['id']} isn't finite")
                pairs.add((source, role))
            seen.add(n["id"])
        ends = [n["id"] for n in self.neurons[len(self.neurons) - len(self.outputs) :]]
        if missing := [o for o in self.outputs if o not in seen]:
            raise ValueError(f"no output {missing[0]}")
        if sorted(ends) != sorted(self.outputs):
            raise ValueError("outputs aren't the last neurons")

    @property
    def output(self) -> str:
        return self.outputs[0]

    @property
    def weights(self) -> int:
        return sum(len(n.get("in", ())) for n in self.neurons)

    @property
    def inputs(self) -> list[str]:
        """The inputs that are read, by number."""
        return sorted({s for n in self.neurons for s, _, _ in edges_of(n) if is_input(s)}, key=lambda s: int(s[1:]))

    def neuron(self, name: str) -> dict:
        return next(n for n in self.neurons if n["id"] == name)

    def squash_of(self, output: str) -> str:
        return self.neuron(output)["squash"]

    @property
    def squash(self) -> str:
        return self.squash_of(self.output)

    def columns(self, rows: DataFrame) -> DataFrame:
        """rows with prediction and hint (what goes into the output's activation; of an aggregate, what comes out), and prediction1, hint1, ... of further outputs. A null input reads as 0."""
        return self._wide(rows) if self.weights > COLUMN_WEIGHTS else self._narrow(rows)

    def names(self) -> list[tuple[str, str, str]]:
        return [(o, f"prediction{i or ''}", f"hint{i or ''}") for i, o in enumerate(self.outputs)]

    def _narrow(self, rows: DataFrame) -> DataFrame:
        """As columns: one for each neuron's sum and one for its value."""
        out = rows
        value = lambda s: F.coalesce(F.col(s).cast("double"), F.lit(0.0)) if is_input(s) else F.col(f"_{s}")
        for n in self.neurons:
            bias, parts = F.lit(float(n["bias"])), [(value(s) * F.lit(float(w)), role) for s, w, role in edges_of(n)]
            total = lambda own: reduce(add, own, F.lit(0.0))
            if n.get("type") == "constant":
                before = after = bias
            elif n["squash"] == "IF":
                by = {r: total([p for p, role in parts if (role or "positive") == r]) for r in ROLES[1:]}
                before = after = sem.if_kernel(by["condition"], by["positive"], by["negative"], bias)
            elif n["squash"] in sem.AGGREGATES:
                pick = F.least if n["squash"] == "MINIMUM" else F.greatest
                before = after = (pick(*[p for p, _ in parts]) if len(parts) > 1 else total([p for p, _ in parts])) + bias
            else:
                before = bias + total([p for p, _ in parts])
                after = sem.squash(n["squash"], F.col(f"_h_{n['id']}"))
            out = out.withColumn(f"_h_{n['id']}", before).withColumn(f"_{n['id']}", F.col(f"_h_{n['id']}") if before is after else after)
        inner = [c for n in self.neurons for c in (f"_h_{n['id']}", f"_{n['id']}")]
        said = {x: F.col(c).cast("float") for o, p, h in self.names() for x, c in ((p, f"_{o}"), (h, f"_h_{o}"))}
        return out.withColumns(said).drop(*inner)

    def forward(self, inputs: dict, n: int) -> dict:
        """(sum, value) of each output over n records, inputs given as arrays; plain numpy."""
        values, sums = self.values(inputs, n)
        return {o: (sums[o], values[o]) for o in self.outputs}

    def values(self, inputs: dict, n: int) -> tuple[dict, dict]:
        """(value of every input and neuron, sum of every neuron) over n records."""
        values, sums = dict(inputs), {}
        for neuron in self.neurons:
            sums[neuron["id"]], values[neuron["id"]] = computed(neuron, values, n)
        return values, sums

    def _wide(self, rows: DataFrame) -> DataFrame:
        """As numpy over Arrow batches, for models too large for generated code."""
        import numpy as np
        import pyarrow as pa

        inputs, names = self.inputs, self.names()

        def make(parts):
            for part in parts:
                held = {s: part.column(s).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for s in inputs}
                with np.errstate(all="ignore"):
                    found = self.forward(held, part.num_rows)
                for o, p, h in names:
                    part = part.append_column(p, pa.array(found[o][1].astype(np.float32))).append_column(h, pa.array(found[o][0].astype(np.float32)))
                yield part

        schema = T.StructType([*rows.schema.fields, *[T.StructField(x, T.FloatType()) for _, p, h in names for x in (p, h)]])
        return rows.mapInArrow(make, schema)

    @classmethod
    def from_json(cls, text: str) -> Model:
        """{"output": id or ids, "neurons": [{"id", "squash", "bias", "in": [[source, weight, role], ...]}, ...]}"""
        found = json.loads(text)
        made = [n | {"in": [(str(e[0]), float(e[1]), *e[2:]) for e in n["in"]]} if "in" in n else n for n in found["neurons"]]
        return cls(made, found["output"])

    def to_json(self) -> str:
        return json.dumps({"output": self.outputs if len(self.outputs) > 1 else self.output, "neurons": self.neurons})

    @property
    def checksum(self) -> str:
        """SHA-256 of the canonical JSON."""
        return hashlib.sha256(json.dumps(json.loads(self.to_json()), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def corrected(self, rows: DataFrame, correction: Column) -> DataFrame:
        """rows with the prediction of the model and a correction that goes in before the output's activation."""
        found = self.columns(rows)
        value = F.col("hint") + correction
        return found.withColumn("prediction", (value if self.squash in sem.AGGREGATES else squash(self.squash, value)).cast("float")).drop("hint")


def computed(neuron: dict, values: dict, n: int, more=0.0):
    """(sum, value) of a neuron over n records in numpy, from the values of what it reads; more goes into its sum (into both of an IF's)."""
    import numpy as np

    edges, bias = edges_of(neuron), float(neuron["bias"])
    total = lambda own: sum((values[s] * float(w) for s, w, _ in own), np.zeros(n))
    if neuron.get("type") == "constant":
        return (np.full(n, bias),) * 2
    if neuron["squash"] == "IF":
        by = {r: total([e for e in edges if (e[2] or "positive") == r]) for r in ROLES[1:]}
        return (np.where(by["condition"] > 0, by["positive"], by["negative"]) + more + bias,) * 2
    if neuron["squash"] in sem.AGGREGATES:
        pick = np.minimum if neuron["squash"] == "MINIMUM" else np.maximum
        return ((pick.reduce([values[s] * float(w) for s, w, _ in edges]) if edges else np.zeros(n)) + bias,) * 2
    before = bias + total(edges) + more
    act = {"IDENTITY": lambda v: v, "TANH": np.tanh, "LOGISTIC": lambda v: 1 / (1 + np.exp(-v)), "RELU": lambda v: np.maximum(v, 0.0)}
    return before, act[neuron["squash"]](before)


def is_input(name: str) -> bool:
    return name[:1] == "f" and name[1:].isdigit()


def edges_of(neuron: dict) -> list[tuple[str, float, str | None]]:
    return [(e[0], e[1], e[2] if len(e) > 2 else None) for e in neuron.get("in", ())]


def compute_residuals(corpus: DataFrame, model: Model) -> DataFrame:
    """record_id, residual (target less prediction) and correction (before the activation; 0 where it isn't finite) of the first output; target: y."""
    return residuals_by_output(corpus, model, ["y"]).drop("output")


def graph_edges(models: DataFrame, key: str, graph: str) -> DataFrame:
    """key, neuron, squash, source, source_squash (null for an input), weight: the edges of the models that a column has as JSON, joined with the neurons that they read."""
    parsed = models.select(key, F.from_json(graph, "neurons array<struct<id:string,squash:string,in:array<array<string>>>>").alias("m"))
    neurons = parsed.select(key, F.explode("m.neurons").alias("n")).select(key, F.col("n.id").alias("neuron"), F.col("n.squash").alias("squash"), F.col("n.in").alias("edges"))
    edges = neurons.select(key, "neuron", "squash", F.explode("edges").alias("e")).select(key, "neuron", "squash", F.col("e")[0].alias("source"), F.col("e")[1].cast("double").alias("weight"))
    read = neurons.select(key, F.col("neuron").alias("source"), F.col("squash").alias("source_squash"))
    return edges.join(read, [key, "source"], "left").select(key, "neuron", "squash", "source", "source_squash", "weight")


def wanted(model: Model, output: int, target: str) -> Column:
    """Of rows with the model's columns: what has to go into an output's sum to reach the target, 0 where that isn't finite."""
    o, _, hint = model.names()[output]
    more = unsquash(model.squash_of(o), F.col(target).cast("double")) - F.col(hint)
    return F.coalesce(finite_or_zero(more.cast("float")), F.lit(0.0).cast("float"))


def residuals_by_output(corpus: DataFrame, model: Model, targets: Sequence[str]) -> DataFrame:
    """record_id, output (its number), residual and correction of each target's output: one row for each."""
    found = model.columns(corpus)

    def one(i: int, y: str):
        _, p, _ = model.names()[i]
        return F.struct(F.lit(i).alias("output"), (F.col(y) - F.col(p)).cast("float").alias("residual"), wanted(model, i, y).alias("correction"))

    return found.select("record_id", F.explode(F.array(*[one(i, y) for i, y in enumerate(targets)])).alias("r")).select("record_id", "r.*")


def attach(corpus: DataFrame, residuals: DataFrame) -> DataFrame:
    """Records with their residuals, by record_id; any residual of the corpus's own gives way."""
    return corpus.drop("residual").join(residuals.select("record_id", "residual"), "record_id")


def mean_of_outputs(residuals: DataFrame) -> DataFrame:
    """One row: the mean over records of the mean over outputs of the squared residual."""
    r = F.col("residual").cast("double")
    return residuals.groupBy("record_id").agg(F.avg(r * r).alias("m")).agg(F.avg("m").alias("mse"))


def stats(rows: DataFrame) -> DataFrame:
    """One row over the finite residuals, and how many aren't."""
    r = F.when(is_finite(F.col("residual")), F.col("residual").cast("double"))
    n = F.count(r)
    return rows.agg(
        n.alias("records"),
        F.avg(r).alias("mean"),
        F.greatest(F.avg(r * r) - F.avg(r) * F.avg(r), F.lit(0.0)).alias("variance"),
        F.avg(F.abs(r)).alias("mae"),
        F.sum(r * r).alias("sse"),
        F.avg(r * r).alias("mse"),
        F.min(r).alias("least"),
        F.max(r).alias("most"),
        F.count_if(~is_finite(F.col("residual"))).alias("non_finite"),
    )


#: Parts of a range of magnitudes that is looked at more closely.
PARTS = 4096


def holders(sizes: dict, positions: dict[str, int]) -> dict:
    """Which cell of a falling order holds each position, and the position within it; a null cell comes last."""
    out, passed = {}, 0
    for cell in sorted(sizes, key=lambda c: (c is not None, c), reverse=True):
        for name, at in positions.items():
            if passed <= at < passed + sizes[cell]:
                out.setdefault(cell, {})[name] = at - passed
        passed += sizes[cell]
    return out


def at_positions(rows: DataFrame, positions: dict[str, int]) -> dict[str, float]:
    """Absolute residuals at positions of the falling order, without sorting all: counts by magnitude find each position's range (a sixteenth of an octave), counts by PARTS of it a narrower one, and only that is sorted. Three jobs, however many positions."""
    finite = rows.where(is_finite(F.col("residual"))).select(F.abs("residual").alias("a"))
    cell = F.when(F.col("a") > 0, F.floor(F.log2(F.col("a").cast("double")) * 16))
    sizes = {r.cell: r["count"] for r in finite.groupBy(cell.alias("cell")).count().collect()}  # some thousand cells at most: FLOAT magnitudes
    held = holders(sizes, positions)
    out: dict[str, float] = {name: 0.0 for name in held.pop(None, {})}
    if not held:
        return out
    low = F.pow(F.lit(2.0), F.col("cell") / 16)
    part = F.floor((F.col("a").cast("double") - low) / (F.pow(F.lit(2.0), (F.col("cell") + 1) / 16) - low) * PARTS)
    inside = finite.withColumn("cell", cell).where(F.col("cell").isin(list(held))).withColumn("part", part)
    counts: dict[int, dict[int, int]] = {}
    for r in inside.groupBy("cell", "part").count().collect():  # PARTS for each position at most
        counts.setdefault(r.cell, {})[r.part] = r["count"]
    narrow = {(c, k): few for c, names in held.items() for k, few in holders(counts[c], names).items()}
    order = W.partitionBy("cell", "part").orderBy(F.desc("a")).rowsBetween(W.unboundedPreceding, 0)
    runs = inside.where(reduce(or_, [(F.col("cell") == c) & (F.col("part") == k) for c, k in narrow])).groupBy("cell", "part", "a").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(order))
    wanted = [(F.col("cell") == c) & (F.col("part") == k) & ((F.col("end") - F.col("n")) <= at) & (F.col("end") > at) for (c, k), few in narrow.items() for at in few.values()]
    hits = runs.where(reduce(or_, wanted)).collect()
    for (c, k), few in narrow.items():
        for name, at in few.items():
            out[name] = next(r.a for r in hits if (r.cell, r.part) == (c, k) and r.end - r.n <= at < r.end)
    return out


#: Cells of one look at the range of a whole number.
CELLS = 4096


def kth(rows: DataFrame, name: str, k: int) -> int:
    """The value at position k of a whole-number column in rising order: counts of CELLS cells, then of the cells of one of these, until it is one value."""
    low, high = rows.agg(F.min(name), F.max(name)).first()
    while low < high:
        width = -(-(high - low + 1) // CELLS)
        cell = F.expr(f"(`{name}` - {low}) div {width}")
        counts = {r.cell: r["count"] for r in rows.where(F.col(name).between(low, high)).groupBy(cell.alias("cell")).count().collect()}
        for c in sorted(counts):
            if k < counts[c]:
                low, high = low + c * width, min(high, low + (c + 1) * width - 1)
                break
            k -= counts[c]
    return low


def quantiles(rows: DataFrame, shares=(0.5, 0.9, 0.99, 0.999)) -> dict[str, float]:
    """Absolute residuals at the falling order's position round((1 - p)(n - 1))."""
    n = rows.where(is_finite(F.col("residual"))).count()
    return at_positions(rows, {f"p{p * 100:g}": math.floor((1 - p) * (n - 1) + 0.5) for p in shares}) if n else {}


def tail_counts(rows: DataFrame) -> DataFrame:
    """Records beyond two and three standard deviations."""
    sigma = stats(rows).select(F.sqrt("variance").alias("sigma")).first().sigma or 0.0
    a = F.abs("residual").cast("double")
    return rows.agg(F.count_if(a > 2 * sigma).alias("beyond_2"), F.count_if(a > 3 * sigma).alias("beyond_3"))


def top_residuals(rows: DataFrame, n: int = 32) -> DataFrame:
    return rows.orderBy(F.desc(F.abs("residual")), F.asc("record_id")).limit(n).select("record_id", "residual")


def top_share(rows: DataFrame) -> DataFrame:
    """Share of the squared error that the worst hundredth of the records holds: whole runs above the cut, and the rest of the cut's own run."""
    n = rows.where(is_finite(F.col("residual"))).count()
    k = max(1, n // 100)
    cut = at_positions(rows, {"cut": k - 1})["cut"] if n else 0.0
    a = F.abs("residual").cast("double")
    q = a * a
    above = F.coalesce(F.sum(F.when(a > cut, q)), F.lit(0.0))
    return rows.where(is_finite(F.col("residual"))).agg(((above + (k - F.count_if(a > cut)) * F.lit(cut * cut)) / F.sum(q)).alias("share"))


def mse(y: Column, p: Column) -> Column:
    d = (y - p).cast("double")
    return F.avg(d * d)
