"""Driver tables as the library's inputs, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token events: ``(event_id, seq, us, t, token, value, k)`` with time in microseconds and seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("seq"), us.alias("us"), (us / 1e6).alias("t"), F.col("event_type").alias("token"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


EV = "ev AS (SELECT event_id, user_id AS seq, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, event_type AS token, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variable-length patterns: ``(row_id, ici, n_clicks, dur)``, one an order."""
    one = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.transform(one, lambda x: F.round(x["l_quantity"] / 100, 2)).alias("ici"), (F.count("*") + 1).cast("int").alias("n_clicks"), F.round(F.sum("l_quantity") / 100, 2).alias("dur"))
    return p


PAT = "pat AS (SELECT l_orderkey AS row_id, list(round(l_quantity / 100, 2) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ici, CAST(count(*) + 1 AS INTEGER) AS n_clicks, round(sum(l_quantity) / 100, 2) AS dur FROM lineitem GROUP BY l_orderkey)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns with ``label`` (order priority), ``actor`` (customer), ``day``, ``status`` of their order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("actor"), F.col("o_orderdate").cast("date").cast("string").alias("day"), F.col("o_orderstatus").alias("status"))
    return patterns(spark, sf_dir).join(o, "row_id")


LAB = PAT + ", lab AS (SELECT pat.*, o_orderpriority AS label, o_custkey AS actor, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_orderstatus AS status FROM pat JOIN orders ON o_orderkey = row_id)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.col("role").alias("actor"), F.coalesce("text", F.lit("")).alias("text"))


TURN = "turn_ AS (SELECT conv_id AS seq, turn AS pos, role AS actor, coalesce(text, '') AS text FROM conversations)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents: ``(doc_id, lang, source, pos, token)``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[ \n]+")).alias("pos", "token"))
    return d.where("token <> ''")


WORD = r"word AS (SELECT doc_id, lang, source, pos - 1 AS pos, token FROM (SELECT doc_id, lang, source, unnest(string_split_regex(coalesce(text, ''), '[ \n]+')) AS token, generate_subscripts(string_split_regex(coalesce(text, ''), '[ \n]+'), 1) AS pos FROM documents) WHERE token <> '')"
