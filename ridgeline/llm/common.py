"""What the corpus operators share: shared storage, bounded Arrow batches and safe inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes of an Arrow batch handed to Python: long documents come few at a time.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it is unset, a local session gets one of its own, and any other is an error: a folder of one machine would lose data there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps start from files, not from lineage."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds. Spark reads the session's settings when a plan starts, so they stay set for its later Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def text_bytes(column: str = "text"):
    """A text as UTF-8; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(divisor: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo divisor; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches that are bounded in rows and in the bytes of their texts, binaries and lists; a row beyond that is a batch of its own."""
    flat = [i for i, f in enumerate(schema) if not pa.types.is_primitive(f.type) and not pa.types.is_list(f.type)]
    lists = [(i, not pa.types.is_primitive(f.type.value_type)) for i, f in enumerate(schema) if pa.types.is_list(f.type)]

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    held: list[tuple] = []
    n = 0
    for row in rows:
        own = sum(len(row[i]) for i in flat if row[i] is not None)
        for i, wide in lists:
            if row[i] is not None:
                own += 16 * len(row[i]) + (sum(map(len, row[i])) if wide else 0)
        if held and (len(held) >= size or n + own > most_bytes):
            yield made()
            held, n = [], 0
        held.append(row)
        n += own
    if held:
        yield made()
