"""A corpus as a run keeps it: numbered and binned once, screens by folder, residuals in a table of their own.

The base table has a record's features, targets and bins, in buckets of its id; a round writes (record_id, residuals)
only, in the same buckets, so joining them shuffles nothing and what a round writes doesn't depend on how many features
there are. Positions are counted once. A record lies in the folder of its position modulo `slots`, so a screen of every
k-th record reads its folders and no others where k divides slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning, histogram
from . import store

#: Folders of a base table, at most, and features beyond which bins are bytes of one column.
MOST_SLOTS, PACKED_FROM = 64, 64


class Layout:
    """base: record_id, position, slot, the features, the kept columns and their bins (b0, b1, ... or bins). beside: record_id, slot, residual columns."""

    def __init__(self, corpus: DataFrame, features: Sequence[str], listed: Sequence[Sequence[float]], keep: Sequence[str] = (), slots: int = 1, buckets: int | None = None):
        """An error for records that share an id."""
        spark = corpus.sparkSession
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.slots = slots if 1 <= slots <= MOST_SLOTS else 1
        own = [c for c in ("record_id", *features, *keep) if c in corpus.columns]
        numbered = binning.numbered(corpus)
        if numbered.groupBy("record_id").count().where("count > 1").take(1):
            raise ValueError("records share an id")
        rows = corpus.select(*own).repartition(self.buckets, "record_id").join(numbered.withColumn("slot", (F.col("position") % self.slots).cast("int")), "record_id")
        held = [*own, "position", "slot"]
        if len(features) > PACKED_FROM:
            binned = histogram.pack_bins(rows.withColumn("x", F.array(*features)), listed, held)
        else:
            binned = binning.bin_rows(rows, features, listed, held)
        self.base = store.bucketed(binned, "base", "record_id", self.buckets, "slot")
        self.beside: DataFrame | None = None

    def put(self, residuals: DataFrame) -> None:
        """From now on these are the records' residuals; residuals: record_id, slot, residual columns."""
        self.beside = store.bucketed(residuals, "residuals", "record_id", self.buckets, "slot")

    def chosen(self, k: int, phase: int) -> list[int] | None:
        """The slots of every k-th record by position; None if they hold others too."""
        return [s for s in range(self.slots) if (s + phase) % k == 0] if self.slots % k == 0 else None

    def every(self, table: DataFrame, k: int, phase: int = 0) -> DataFrame:
        """The rows of a table of this layout whose position and phase add up to a multiple of k."""
        slots = self.chosen(k, phase)
        if slots is not None:
            return table.where(F.col("slot").isin(slots)) if len(slots) < self.slots else table
        return table.where((F.col("position") + phase) % k == 0)

    def rows(self, column: str, k: int = 1, phase: int = 0) -> DataFrame:
        """Records with one of their residuals; every k-th by position."""
        beside = self.beside.select("record_id", "slot", F.col(column).alias("residual"))
        slots = self.chosen(k, phase)
        if slots is not None and len(slots) < self.slots:
            beside = beside.where(F.col("slot").isin(slots))
        return self.every(self.base.drop("residual"), k, phase).join(beside.drop("slot").hint("shuffle_hash"), "record_id")
