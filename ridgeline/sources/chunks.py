"""Records from anything that can be read in chunks.

A source lists its chunks as a DataFrame, a row for each with whatever it takes to read it (a path and a range, say), and
gives a function that reads one: dicts of columns, a batch at a time. Tasks read the chunks that their partition has, one
after another; how many go to a task is the partitioning of the list. Nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What reads a chunk (a row of the list as a dict): batches of columns, arrays or lists by name.
ChunkReader = Callable[[dict], Iterable[Mapping[str, Sequence]]]


def frame(listed: DataFrame, read: ChunkReader, schema: str) -> DataFrame:
    """The records of all chunks of a list. A batch that lacks a column, or whose columns differ in length or can't be of their type, is an error that names the chunk."""
    import pyarrow as pa

    fields = to_arrow_schema(T.StructType.fromDDL(schema))

    def batch(found: Mapping[str, Sequence]) -> pa.RecordBatch:
        if missing := [f.name for f in fields if f.name not in found]:
            raise ValueError(f"it gave no {missing[0]}")
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in fields], schema=fields)

    def make(parts):
        for part in parts:
            for chunk in part.to_pylist():
                try:
                    yield from map(batch, read(chunk))
                except (ValueError, OSError, pa.ArrowException) as error:
                    raise ValueError(f"chunk {chunk}: {error}") from error

    return listed.mapInArrow(make, schema)
