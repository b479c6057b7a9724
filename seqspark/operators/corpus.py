"""Corpus construction at the level of conversations: filters, budgets, tiers, masking and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import running


def hash_order(key: str, seed: int = 0) -> Column:
    """A random order that is the same every time."""
    return F.xxhash64(key, F.lit(seed))


def restrict(df: DataFrame, conv: str, parts: dict[int, list[str]], ages: DataFrame | None = None, max_age: int = 36) -> DataFrame:
    """Rows whose conversation id, a path, has allowed parts (counted from 0), and whose age is known and at most ``max_age``."""
    p = F.split(conv, "/")
    for i, allowed in parts.items():
        df = df.where(F.get(p, F.lit(i)).isin(allowed))
    return df if ages is None else df.join(ages.where(F.col("months") <= max_age).select(conv), conv, "left_semi")


def long_enough(df: DataFrame, conv: str, least: int = 20) -> DataFrame:
    """Rows of conversations with ``least`` rows or more."""
    return df.join(df.groupBy(conv).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).select(conv).hint("shuffle_hash"), conv, "left_semi")


def sample_per_stratum(df: DataFrame, stratum: str, k: int, order: list) -> DataFrame:
    """At most ``k`` rows a stratum, the first in ``order``; a null stratum is one."""
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def bottom_share(convs: DataFrame, value: str, key: str, size: str, share: float, target: int) -> DataFrame:
    """The ``max(1, floor(n * share))`` conversations with the smallest ``value``; all of them if these hold less than twice ``target`` tokens."""
    x = running(convs, [value, key], rank="__r")
    n = convs.agg(F.count("*").alias("__n"))
    x = x.crossJoin(F.broadcast(n)).withColumn("__in", F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share)))  # one row
    pool = x.agg((F.coalesce(F.sum(F.when(F.col("__in"), F.col(size))), F.lit(0)) >= 2 * target).alias("__ok"))
    return x.crossJoin(F.broadcast(pool)).where("__in or not __ok").select(*convs.columns)  # one row


def budgeted_prefix(convs: DataFrame, size: str, target: int, order: list) -> DataFrame:
    """Conversations in ``order`` until their tokens reach ``target``, the one that crosses it included."""
    return running(convs, order, size, "__r", "__s").where(F.col("__s") - F.col(size) < target).drop("__r", "__s")


def weighted_sample(convs: DataFrame, key: str, weight: str, size: str, target: int, seed: int = 0, uniform: Column | None = None) -> DataFrame:
    """A weighted sample without replacement up to a budget: keys ``ln(u) / w``, the largest first (Efraimidis and Spirakis). ``uniform`` replaces the hashed ``u``."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52) if uniform is None else uniform
    x = convs.where(F.col(weight) > 0).withColumn("__k", F.log(u) / F.col(weight))
    return budgeted_prefix(x, size, target, [F.desc("__k"), key]).drop("__k")


def allocate_tiers(convs: DataFrame, size: str, shares: list[tuple[str, int]], order: list) -> DataFrame:
    """``convs`` with ``tier``: disjoint tiers filled one after the other from one order, each until its tokens reach its target; the rest is null."""
    x = running(convs, order, size, "__r", "__s").withColumn("__b", F.col("__s") - F.col(size))
    start, tier = None, F.lit(None).cast("string")
    cut = F.lit(0)
    bounds = []
    for name, target in shares:  # a few tiers; each starts where the one before ended
        ends = x.where(F.col("__b") - cut >= 0) if start is None else x
        end = ends.where((F.col("__b") >= cut) & (F.col("__b") - cut < target)).agg(F.max("__s").alias("e")).first()["e"]
        bounds.append((name, cut, target))
        if end is None:
            break
        cut, start = F.lit(end), end
    for name, lo, target in bounds:
        tier = F.when((F.col("__b") >= lo) & (F.col("__b") - lo < target), name).otherwise(tier)
    return x.withColumn("tier", tier).drop("__r", "__s", "__b")


def mask_sequences(tokens: DataFrame, seq: str, order: list, share: float, actor: str, gap: str, timed: str, unknown: str = "UNK") -> DataFrame:
    """``tokens`` with whole sequences masked, in ``order``, until ``share`` of the tokens: actor unknown, no time. ``masked`` marks them."""
    convs = tokens.groupBy(seq).agg(F.count("*").alias("__size"))
    total = convs.agg(F.sum("__size")).first()[0] or 0
    chosen = budgeted_prefix(convs, "__size", int(total * share), order).select(seq, F.lit(True).alias("masked"))
    x = tokens.join(chosen.hint("shuffle_hash"), seq, "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    hide = lambda c, v: F.when(F.col("masked"), v).otherwise(F.col(c))
    return x.withColumns({actor: hide(actor, F.lit(unknown)), gap: hide(gap, F.lit(-1.0)), timed: hide(timed, F.lit(0))})
