"""Corpora over the test tables: record_id, FLOAT features f0.., target y, prediction p, residual y - p.

Each has a unique key as its record_id, a deliberately poor model, and the SQL that defines the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Corpus:
    name: str
    width: int
    load: Callable[[SparkSession, str], DataFrame]
    sql: str  # body of a CTE named corpus
    shape: Callable[[DataFrame], DataFrame] | None = None  # rows of the one table it is made of -> corpus

    @property
    def features(self) -> list[str]:
        return [f"f{i}" for i in range(self.width)]


def shaped(df: DataFrame, record_id, features, y, p) -> DataFrame:
    columns = [F.expr(x).cast("float").alias(f"f{i}") for i, x in enumerate(features)]
    found = df.select(F.expr(record_id).cast("long").alias("record_id"), *columns, F.expr(y).cast("float").alias("y"), F.expr(p).cast("float").alias("p"))
    return found.withColumn("residual", F.col("y") - F.col("p"))


def shaped_sql(source: str, record_id, features, y, p) -> str:
    columns = ", ".join(f"CAST({x} AS FLOAT) AS f{i}" for i, x in enumerate(features))
    return f"SELECT *, y - p AS residual FROM (SELECT CAST({record_id} AS BIGINT) AS record_id, {columns}, CAST({y} AS FLOAT) AS y, CAST({p} AS FLOAT) AS p FROM {source})"


def simple(name: str, table: str, record_id, features, y, p) -> Corpus:
    shape = lambda df: shaped(df, record_id, features, y, p)
    return Corpus(name, len(features), lambda spark, d: shape(read(spark, d, table)), shaped_sql(table, record_id, features, y, p), shape)


def orders_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return shaped(joined, *ORDERS)


ORDERS = ("o_orderkey", ["o_totalprice", "c_acctbal", "month(o_orderdate)"], "o_totalprice / 1000 + CASE WHEN c_acctbal > 5000 THEN 20 ELSE 0 END", "o_totalprice / 1000")

#: Its key names a line, though some lines share it; only operators without row identity use it.
LINES = simple("lines", "lineitem", "l_orderkey * 8 + l_linenumber", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice / 1000", "1.5 * l_quantity")
EVENTS = simple("events", "events", "event_id", ["value", "hour(ts)", "user_id % 10"], "value + CASE WHEN hour(ts) >= 12 AND value > 50 THEN 10 ELSE 0 END", "value")
PARTS = simple("parts", "part", "p_partkey", ["p_size", "p_retailprice"], "p_retailprice + CASE WHEN p_size / 50.0 + (p_retailprice - 900) / 100 > 1 THEN 30 ELSE 0 END", "p_retailprice")
ACCOUNTS = Corpus("accounts", 3, orders_of_customers, shaped_sql("orders JOIN customer ON o_custkey = c_custkey", *ORDERS))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide matrix: record_id, x (array of float), residual of a constant model of label 3."""
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("record_id"),
        F.col("embedding").cast("array<float>").alias("x"),
        (F.when(F.col("label") == 3, 1.0).otherwise(0.0) - 0.1).cast("float").alias("residual"),
    )


VECTORS_SQL = "SELECT vec_id AS record_id, embedding AS x, CAST(CASE WHEN label = 3 THEN 1.0 ELSE 0.0 END - 0.1 AS FLOAT) AS residual FROM embeddings"
