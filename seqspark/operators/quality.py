"""Quality reports: rates, distributions, crosstabs, agreement and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import quantiles


def rate_by(df: DataFrame, key: str, flag: Column, value: str, first: str, order: str) -> DataFrame:
    """``(key, n, flagged, rate, median, first)``; a null key is a group."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(flag.cast("int")).alias("flagged"), F.avg(flag.cast("double")).alias("rate"), F.min_by(first, order).alias("first"))
    q = quantiles(df, [key], value, [0.5]).select(F.col(key).alias("__k"), F.get("q", F.lit(0)).alias("median"))
    return g.join(q.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__k")), "left").select(key, "n", "flagged", "rate", "median", "first")


QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def distribution(df: DataFrame, by: str, value: str, approx: bool = False) -> DataFrame:
    """``(by, n, mean, p5..p99)``; ``approx`` uses a quantile sketch."""
    own, mean = df.where(F.col(value).isNotNull()).groupBy(by), [F.count("*").alias("n"), F.avg(value).alias("mean")]
    if approx:
        g = own.agg(*mean, F.percentile_approx(value, F.array(*map(F.lit, QUANTILES))).alias("q"))
    else:
        q = quantiles(df, [by], value, list(QUANTILES)).withColumnRenamed(by, "__k")
        g = own.agg(*mean).join(q.hint("shuffle_hash"), F.col(by).eqNullSafe(F.col("__k")))
    return g.select(by, "n", "mean", *[F.get("q", F.lit(i)).alias(f"p{int(x * 100)}") for i, x in enumerate(QUANTILES)])


def flag_rates(df: DataFrame, length: str, flag: Column, low: int, high: int) -> DataFrame:
    """``(length, n, flagged, rate)`` for every length of the range; zeros where there is no row."""
    spark = df.sparkSession
    all_ = spark.range(low, high + 1).select(F.col("id").cast("int").alias(length))
    g = df.groupBy(length).agg(F.count("*").alias("n"), F.sum(flag.cast("int")).alias("flagged"))
    x = all_.join(g.hint("merge"), length, "left")
    return x.select(length, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("flagged", F.lit(0)).alias("flagged"), F.coalesce(F.col("flagged") / F.col("n"), F.lit(0.0)).alias("rate"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """``(row, values.., total, share of each value)`` with fixed columns."""
    p = df.groupBy(row).pivot(col, values).count().na.fill(0, values)
    total = sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`"))
    x = p.withColumn("total", total)
    return x.select("*", *[F.when(F.col("total") > 0, F.col(f"`{v}`") / F.col("total")).alias(f"share_{v}") for v in values])


def acceptance(df: DataFrame, before: str, after: str, collapsed: Column, truth: Column, noise: Column, bounds: tuple = (0.95, 0.08, 0.90)) -> DataFrame:
    """One row: share of labels kept, share of noise, agreement of collapsed labels, and whether each passes."""
    g = df.agg((F.count_if(F.col(before).isNotNull() & F.col(after).eqNullSafe(F.col(before))) / F.count(before)).alias("conserved"), F.avg(F.coalesce(noise, F.lit(False)).cast("double")).alias("noise"), (F.count_if(collapsed == truth) / F.count_if(collapsed.isNotNull() & truth.isNotNull())).alias("agreement"))
    return g.select("*", (F.col("conserved") >= bounds[0]).alias("conserved_ok"), (F.col("noise") <= bounds[1]).alias("noise_ok"), (F.col("agreement") >= bounds[2]).alias("agreement_ok"))


def top_label_coverage(df: DataFrame, group: str, label: str, ks: tuple = (1, 3, 5, 10)) -> DataFrame:
    """``(group, n, labels, cover_k..)``: the share of the ``k`` most frequent labels."""
    c = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("c"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), label)))
    return r.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("labels"), *[(F.sum(F.when(F.col("r") <= k, F.col("c"))) / F.sum("c")).alias(f"cover_{k}") for k in ks])


def majority_labels(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """``(cluster, dominant, support, total, purity)``; ties go to the smaller label, null labels don't count."""
    c = df.where(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count("*").alias("c"))
    g = c.groupBy(cluster).agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("dominant"), F.max("c").alias("support"), F.sum("c").alias("total"))
    return g.withColumn("purity", F.col("support") / F.col("total"))


def vote_accuracy(df: DataFrame, by: list[str], cluster: str, label: str, weight: str | None = None) -> DataFrame:
    """``(by.., n, correct, accuracy)`` of each cluster's dominant label; with ``weight``, a row stands for that many."""
    c = df.where(F.col(label).isNotNull()).groupBy(*by, cluster, label).agg((F.sum(weight) if weight else F.count("*")).alias("c"))
    g = c.groupBy(*by, cluster).agg(F.max("c").alias("correct"), F.sum("c").alias("n"))
    return g.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("correct").alias("correct")).withColumn("accuracy", F.col("correct") / F.col("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``(n, ari, same)``: the adjusted Rand index of two labellings and the share of equal labels."""
    c = df.groupBy(a, b).agg(F.count("*").alias("c"))
    two = lambda x: x * (x - 1) / 2
    ij = c.agg(F.sum("c").alias("n"), F.sum(two(F.col("c"))).alias("ij"), F.sum(F.when(F.col(a).cast("string") == F.col(b).cast("string"), F.col("c")).otherwise(0)).alias("diag"))
    side = lambda k, name: c.groupBy(k).agg(F.sum("c").alias("c")).agg(F.sum(two(F.col("c"))).alias(name))
    x = ij.crossJoin(F.broadcast(side(a, "i"))).crossJoin(F.broadcast(side(b, "j")))  # one row each
    expected, most = F.col("i") * F.col("j") / two(F.col("n")), (F.col("i") + F.col("j")) / 2
    return x.select("n", F.when(most != expected, (F.col("ij") - expected) / (most - expected)).otherwise(1.0).alias("ari"), (F.col("diag") / F.col("n")).alias("same"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("c"))


def outcome_rollup(df: DataFrame, key: str, truth: Column, predicted: Column, accepted: Column) -> DataFrame:
    """``(key, total, correct, mismatch, reject)`` for each key and, with a null key, for all rows."""
    ok = F.coalesce(accepted, F.lit(False))
    g = df.rollup(key).agg(F.count("*").alias("total"), F.count_if(ok & (truth == predicted)).alias("correct"), F.count_if(ok & (truth != predicted)).alias("mismatch"), F.count_if(~ok).alias("reject"), F.grouping(key).alias("__g"))
    return g.where(F.col(key).isNotNull() | (F.col("__g") == 1)).drop("__g")


def sweep_summary(df: DataFrame, parameter: str, length: str) -> DataFrame:
    """Accuracy by parameter and by length over ``(parameter, length, n, correct)``, and per length the best parameter (ties: the smaller)."""
    p, n = F.col(parameter), F.col(length)
    x = df.withColumn("__p", p)  # the parameter itself is null in the rows of a length
    g = x.groupingSets([[p], [n]], p, n).agg((F.sum("correct") / F.sum("n")).alias("accuracy"), F.min_by("__p", F.struct(-F.col("correct") / F.col("n"), F.col("__p"))).alias("best"))
    return g.select(parameter, length, "accuracy", F.when(F.col(parameter).isNull(), F.col("best")).alias("best"))


def cluster_records(df: DataFrame, length: str, cluster: str, dur: str, source: str, sources: list[str]) -> DataFrame:
    """``(length, cluster, n, mean_dur, n_<source>..)``."""
    return df.groupBy(length, cluster).agg(F.count("*").alias("n"), F.avg(dur).alias("mean_dur"), *[F.count_if(F.col(source) == s).alias(f"n_{s}") for s in sources])


def cluster_quality(variance: DataFrame, nearest: DataFrame, reference: DataFrame, length: str = "n_clicks", name: str = "cluster", limit: float = 2.0) -> DataFrame:
    """``(name, length, mean_dist, nearest, ratio, collapsed)``: spread against that of the nearest reference type."""
    r = reference.select(length, F.col("label").alias("nearest"), F.col("mean_dist").alias("ref"))
    x = variance.select(name, length, "mean_dist").join(nearest.select(name, length, "nearest").hint("shuffle_hash"), [name, length]).join(r.hint("shuffle_hash"), [length, "nearest"], "left")
    return x.select(name, length, "mean_dist", "nearest", F.when(F.col("ref") > 0, F.col("mean_dist") / F.col("ref")).alias("ratio")).withColumn("collapsed", F.coalesce(F.col("ratio") > limit, F.lit(False)))
