"""Token tables: vocabularies, context windows, channels, bins, compound tokens and caches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from .stages import quantiles, running, sized

PAD = "<PAD>"


def dense_ids(df: DataFrame, by: list[str], out: str = "id", start: int = 0) -> DataFrame:
    """``df`` (distinct rows of a vocabulary) with dense ids in the order of ``by``."""
    return running(df, by, rank="__r").withColumn(out, (F.col("__r") - 1 + start).cast("int")).drop("__r")


def label_index(df: DataFrame, label: str, out: str = "id") -> DataFrame:
    """``(label, id)``: sorted distinct labels to 0..N-1."""
    return dense_ids(df.where(F.col(label).isNotNull()).select(label).distinct(), [label], out)


def actor_index(df: DataFrame, actor: str, unknown: str = "::UNK", out: str = "actor_id") -> DataFrame:
    """``(actor, id)``: unknown actors first, then by name."""
    names = df.where(F.col(actor).isNotNull()).select(actor).distinct().withColumn("__known", (~F.col(actor).endswith(unknown)).cast("int"))
    return dense_ids(names, ["__known", actor], out).drop("__known")


def encode(df: DataFrame, index: DataFrame, key: str, id_col: str, default=None) -> DataFrame:
    """``df`` with the id of ``key``; ``default`` where the index doesn't have it."""
    out = df.join(sized(index), key, "left")
    return out if default is None else out.withColumn(id_col, F.coalesce(id_col, F.lit(default)))


def unknown_codes(df: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose code the index doesn't have."""
    return df.join(sized(index.select(key).distinct()), key, "left_anti")


def in_set(df: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is a member."""
    return df.join(sized(members.select(key).distinct()), key, "left_semi")


def cap_vocabulary(df: DataFrame, token: str, cap: int, unk: str = "<unk>") -> DataFrame:
    """``(token, n, id)``: the ``cap - 1`` most frequent tokens (ties: smaller token) and ``unk`` with the last id."""
    counts = df.groupBy(token).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), token).limit(cap - 1)
    ranked = top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), token)) - 1)  # cap - 1 rows
    rest = counts.agg(F.sum("n").alias("all")).crossJoin(ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.count("*").alias("m")))  # one row each
    return ranked.unionByName(rest.select(F.lit(unk).alias(token), (F.coalesce("all", F.lit(0)) - F.col("kept")).alias("n"), F.col("m").cast("int").alias("id")))


def context_windows(df: DataFrame, seq: str, pos: str, token: str, k: int, extra: list[str] = (), pad: str = PAD) -> DataFrame:
    """``(seq, pos, context, target)`` for positions from 1: the last ``k`` tokens, padded on the left. ``extra`` columns get contexts of their own, padded with null."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(-k, -1)
    full = Window.partitionBy(seq).orderBy(pos)

    def context(c: str, filler: Column) -> Column:
        seen = F.collect_list(F.struct(F.col(c).alias("v"))).over(w)  # a struct keeps nulls
        seen = F.transform(seen, lambda s: s["v"])
        return F.concat(F.array_repeat(filler, F.lit(k) - F.size(seen)), seen)

    out = [context(token, F.lit(pad)).alias("context"), F.col(token).alias("target"), *[context(c, F.lit(None).cast(df.schema[c].dataType)).alias(f"context_{c}") for c in extra]]
    return df.withColumn("__n", F.row_number().over(full)).select(seq, pos, *out, "__n").where("__n > 1").drop("__n")


def strict_windows(df: DataFrame, seq: str, pos: str, token: str, k: int) -> DataFrame:
    """``(seq, pos, window)``: only full windows of ``k + 1`` tokens that end at ``pos``; shorter sequences have none."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(-k, 0)
    return df.select(seq, pos, F.collect_list(token).over(w).alias("window")).where(F.size("window") == k + 1)


def quantile_edges(df: DataFrame, value: str, bins: int = 5, by: list[str] = ()) -> DataFrame:
    """``(by.., edges)``: exact interpolated quantile edges, equal ones once."""
    return quantiles(df, list(by), value, [i / bins for i in range(bins + 1)]).select(*by, F.array_distinct("q").alias("edges"))


def right_closed_bin(value: Column, edges: Column) -> Column:
    """The number of inner edges below the value: bins closed on the right."""
    return F.size(F.filter(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), lambda e: e < value))


def equal_population_bins(df: DataFrame, value: str, bins: int = 5, out: str = "bin") -> DataFrame:
    """``df`` with the bin of ``value``; null for null."""
    edges = quantile_edges(df, value, bins).agg(F.first("edges").alias("__e"))  # null edges if there is no value
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), right_closed_bin(F.col(value), F.col("__e")))).drop("__e")  # one row of edges


def compound_index(df: DataFrame, parts: list[str], out: str = "token") -> DataFrame:
    """``(parts.., token, name)``: dense ids of the attested tuples in sorted order, and a readable name."""
    distinct = df.select(*parts).distinct()
    return dense_ids(distinct, parts, out).withColumn("name", F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))


def recency_counts(df: DataFrame, seq: str, pos: str, token: str, size: int = 320) -> DataFrame:
    """``df`` with ``cached`` (how often the token occurs among the ``size`` events before) and ``cache_len``. ``pos`` is 0-based and dense."""
    w = Window.partitionBy(seq, token).orderBy(pos).rangeBetween(-size, -1)
    return df.withColumn("cached", F.count("*").over(w)).withColumn("cache_len", F.least(F.col(pos), F.lit(size)))


def estimated_gaps(df: DataFrame, seq: str, order: list[str], actor: str, utterance: str, end: str, comma: str) -> DataFrame:
    """``df`` (one row a word) with ``dt``: 0 first, 2.0 at a change of actor, 1.0 at the start of an utterance after a sentence end, 0.5 after a comma, else 0.3.

    ``end`` marks words whose utterance ends a sentence, ``comma`` words that follow a comma.
    """
    w = Window.partitionBy(seq).orderBy(*order)
    first = F.row_number().over(w) == 1
    starts = F.col(utterance) != F.lag(utterance).over(w)
    dt = F.when(first, 0.0).when(F.col(actor) != F.lag(actor).over(w), 2.0).when(starts & F.lag(end).over(w), 1.0).when(F.col(comma), 0.5).otherwise(0.3)
    return df.withColumn("dt", dt)


def soft_chunks(df: DataFrame, seq: str, pos: str, actor: str, size: str, target: int = 80) -> DataFrame:
    """``df`` (one row a turn) with ``chunk``: cut at the first change of actor after ``target`` or more tokens; the count starts again.

    The ordered turns of a conversation stream through one task, which holds only the running count, so a conversation of any length fits. A null size
    counts 0, a null actor is no change, a null ``seq`` is a conversation of its own. Repeated rows stay; a column named ``chunk`` is replaced.
    """
    kept = [c for c in df.columns if c != "chunk"]
    at = [kept.index(c) for c in (seq, actor, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who, seen, chunk, started = None, None, 0, 0, False
        for b in batches:
            marks = []
            for s, a, n in zip(*(b.column(i).to_pylist() for i in at)):
                if not started or s != now:
                    now, who, seen, chunk, started = s, None, 0, 0, True
                if seen >= target and a is not None and who is not None and a != who:
                    chunk, seen = chunk + 1, 0
                seen, who = seen + (n or 0), a
                marks.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.int32())], [*kept, "chunk"])

    turns = df.select(*kept).repartition(seq).sortWithinPartitions(seq, pos, actor, size)
    return turns.mapInArrow(run, StructType([*turns.schema.fields, StructField("chunk", IntegerType())]))


def realign(tokens: DataFrame, rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``tokens`` with ``columns`` of ``rows`` by an exact key that both carry; each key once on the right."""
    right = rows.groupBy(*key).agg(*[F.min(c).alias(c) for c in columns])
    return tokens.join(right, key, "left")


def merge_streams(left: DataFrame, right: DataFrame) -> DataFrame:
    """Long-format streams of both corpora; a conversation in either appears."""
    return left.unionByName(right)


def to_long(df: DataFrame, conv: str, pos: str, dims: list[str]) -> DataFrame:
    """``(conv, pos, dim, token)``: one row for each named channel, as text; null channels are left out."""
    x = df.select(conv, pos, *[F.col(c).cast("string").alias(c) for c in dims])
    return x.unpivot([conv, pos], dims, "dim", "token").where("token is not null")


def dims_of(df: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """``df`` with derived channels, each the named columns joined by ``_``."""
    return df.withColumns({name: F.concat_ws("_", *[F.col(c).cast("string") for c in cols]) for name, cols in parts.items()})
