"""What a run leaves behind besides tables: tagged models, workspaces, bundles of accepted patches, and numbers as text."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches
from ..operators.residuals import Model
from . import storage


def tags_of(listed) -> list[tuple[str, str]]:
    """(name, value) of a list of tags; a value that is no text is given as JSON, and what has no name is none."""
    out = []
    for tag in listed if isinstance(listed, list) else ():
        if isinstance(tag, dict) and isinstance(tag.get("name"), str):
            value = tag.get("value", "")
            out.append((tag["name"], value if isinstance(value, str) else json.dumps(value)))
    return out


def read_tags(text: str) -> tuple[list[tuple[str, str]], dict[str, list[tuple[str, str]]]]:
    """(a model's own tags in their order, those of its neurons by id) from its JSON; a text that is no such JSON has none."""
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return [], {}
    if not isinstance(found, dict):
        return [], {}
    neurons = {n["id"]: own for n in found.get("neurons", ()) if isinstance(n, dict) and "id" in n and (own := tags_of(n.get("tags")))}
    return tags_of(found.get("tags")), neurons


def tag_rows(models: DataFrame, key: str, graph: str) -> DataFrame:
    """key, place (from 1), name, value: the same of the models that a column has as JSON."""
    tags = F.from_json(graph, "tags array<struct<name:string,value:string>>").getField("tags")
    named = F.filter(tags, lambda t: t.getField("name").isNotNull())
    return models.select(key, F.posexplode(named).alias("at", "t")).select(key, (F.col("at") + 1).alias("place"), "t.name", "t.value")


def with_tags(text: str, tags: dict[str, str]) -> str:
    """The model's JSON with these tags: in place of one of the same name, or after the others."""
    found = json.loads(text)
    now = dict(tags_of(found.get("tags"))) | tags
    return json.dumps(found | {"tags": [{"name": k, "value": v} for k, v in now.items()]})


def write_best(spark: SparkSession, model: Model, tags: dict[str, str], path: str) -> None:
    """The best model so far with its tags, in place of the one before."""
    storage.write_text(spark, with_tags(model.to_json(), tags), path)


def read_model(spark: SparkSession, path: str) -> Model:
    """A model from its JSON file, checked."""
    return Model.from_json(storage.read_text(spark, path))


def write_workspace(spark: SparkSession, source: str, folder: str, meta: dict) -> str:
    """A copy of a model's file in a folder of its own with a note of what it is; its checksum. The copy is read again: a difference is an error."""
    text = storage.read_text(spark, source)
    checksum = hashlib.sha256(text.encode()).hexdigest()
    storage.write_text(spark, text, f"{folder}/model.json")
    if hashlib.sha256(storage.read_text(spark, f"{folder}/model.json").encode()).hexdigest() != checksum:
        raise OSError(f"the copy of {source} differs")
    storage.write_text(spark, json.dumps(meta | {"source": source, "checksum": checksum}), f"{folder}/meta.json")
    return checksum


class Bundle:
    """Accepted patches in their order, each with the score that it reached. Once one can't be filed no bundle is written: what follows it would claim scores that it can't repeat."""

    def __init__(self, width: int):
        self.width, self.entries, self.failure = width, [], None

    def accept(self, parts: Sequence[dict], score: float) -> None:
        try:
            for node in parts:
                if "terms" not in node:
                    raise ValueError("a patch without a split")
                if any(f >= self.width for f in patches.features(node)):
                    raise ValueError(f"a patch reads an input beyond {self.width}")
            self.entries.append({"patches": [{"id": patches.patch_id(n), "root": n} for n in parts], "score": score})
        except ValueError as error:
            self.failure = self.failure or str(error)

    def write(self, spark: SparkSession, path: str) -> bool:
        """Whether there was anything to write."""
        if self.failure:
            raise ValueError(f"the bundle is incomplete: {self.failure}")
        if self.entries:
            storage.write_text(spark, json.dumps({"inputs": self.width, "accepted": self.entries}), path)
        return bool(self.entries)


def score_text(score: float) -> str:
    """A score with six decimals."""
    return f"{score:.6f}"


def delta_text(delta: float) -> str:
    """A difference with its sign, two decimals and the plain exponent."""
    digits, exponent = f"{delta:+.2e}".split("e")
    return f"{digits}e{int(exponent)}"


def json_text(value: float) -> str:
    """A number of a JSON document: the fewest digits that read back as it, without an exponent from a millionth up to 1e21."""
    if not math.isfinite(value):
        return json.dumps(value)
    if value == 0 or 1e-6 <= abs(value) < 1e21:
        plain = format(Decimal(repr(value)), "f")
        return plain if "." in plain else f"{plain}.0"
    digits, exponent = f"{Decimal(repr(value)).normalize():e}".split("e")
    return f"{digits}e{int(exponent)}"


def as_text(number: Column, form: Callable[[float], str]) -> Column:
    """A form of numbers, by Arrow batches: Java rounds exact halves up in its formats, these forms to even."""

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return values.map(form, na_action="ignore")

    return texts(number)


def score_column(score: Column) -> Column:
    """The same of columns."""
    return as_text(score.cast("double"), score_text)


def delta_column(delta: Column) -> Column:
    return as_text(delta.cast("double"), delta_text)


def json_column(rows: DataFrame) -> Column:
    """A row as a JSON object with all its fields, also those without a value. Java writes a double from ten million on with an exponent, so these are json_text()."""
    fields = []
    for name, kind in rows.dtypes:
        if kind == "double":
            value = F.col(f"`{name}`")
            text = as_text(F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)), json_text)  # pandas has one NaN for these two
            fields.append(F.concat(F.lit(f"{json.dumps(name)}:"), F.when(value.isNull(), "null").when(F.isnan(value), "NaN").otherwise(text)))
        else:
            own = F.to_json(F.struct(F.col(f"`{name}`").alias(name)), {"ignoreNullFields": "false"})
            fields.append(own.substr(F.lit(2), F.length(own) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
