"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """As the session names it. Where it is unset, a local session gets a folder of its own, as in tests, and a cluster an error: a folder of one machine would lose data there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = _own["dir"] = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, slot: str) -> DataFrame:
    """The rows as a table in buckets of a key and folders of a slot: tables of the same buckets join without a shuffle, and a slot is read without the others."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.partitionBy(slot).bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
