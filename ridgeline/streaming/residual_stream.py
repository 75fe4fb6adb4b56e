"""A residual histogram over a stream: it is a mergeable aggregate, so a stream only keeps features x bins rows of state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.binning import bin_rows
from ..operators.histogram import histogram


def streaming_histogram(corpus: DataFrame, features: Sequence[str], edges: Sequence[Sequence[float]]) -> DataFrame:
    """The histogram of a streaming corpus; write it with outputMode('complete')."""
    return histogram(bin_rows(corpus, features, edges), len(features))


def appended_log(spark, path: str, schema: str) -> DataFrame:
    """A run log as it grows."""
    return spark.readStream.schema(schema).json(path)
