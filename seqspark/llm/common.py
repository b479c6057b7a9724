"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators.stages import discard, shared_dir, sized, spare, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one key that a task of a join should meet at most; see :func:`dealt_join`.
HOT_ROWS = 100_000


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(counts: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """``(key, parts)`` of the keys with more than :data:`HOT_ROWS` of ``rows`` rows and more than a task's share: at most as many keys as there are shuffle partitions."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = max(HOT_ROWS, -(-rows // tasks))
    return counts.where(F.col(n) > least).select(key, F.ceil(F.col(n) / least).cast("long").alias("parts"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: list[str], how: str = "inner", cond: Column | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (and ``cond``), both shuffled; the left rows of ``hot`` keys (:func:`hot_keys`) are dealt by ``spread`` to ``parts`` tasks, their right rows are copied to these.

    Both sides keep their ``key``; ``right``'s is dropped.
    """
    few = F.broadcast(hot.select(F.col(key).alias("__hot"), "parts"))  # a row a shuffle partition at most
    one = F.lit(1).cast("long")
    a = left.join(few, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), F.coalesce("parts", one))).drop("__hot", "parts")
    b = right.withColumnRenamed(key, "__key").join(few, F.col("__key") == F.col("__hot"), "left")
    b = b.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", one) - 1))).drop("__hot", "parts")
    on = (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__part"))
    return a.join(b.hint("merge"), on if cond is None else on & cond, how).drop("__key", "__salt", "__part")
