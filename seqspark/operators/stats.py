"""Sequence and corpus statistics as counts, joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import running, written

#: Rows whose pairs a task counts at once; the largest square of tokens that is counted without sorting.
STRETCH, DENSE = 1 << 18, 1 << 20


def _xlogx(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def counts(df: DataFrame, token: str, by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by, token).agg(F.count("*").alias("c"))


def freq_stats(df: DataFrame, token: str) -> DataFrame:
    """One row: ``n, v, entropy`` (bits), ``modal`` count, ``top1, top10`` (share of the most frequent 1 % and 10 % of types), ``p90`` (types that cover 90 %)."""
    c = running(counts(df, token), [F.desc("c"), token], "c")
    tot = c.agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    x = c.crossJoin(F.broadcast(tot))  # one row
    head = lambda part: F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("v") / part)), F.col("c"))) / F.first("n")
    return x.agg(
        F.sum("c").alias("n"), F.count("*").alias("v"), (-F.sum(_xlogx(F.col("c") / F.col("n")))).alias("entropy"), F.max("c").alias("modal"), head(100).alias("top1"), head(10).alias("top10"),
        F.min(F.when(F.col("running") >= F.col("n") * 0.9, F.col("rank"))).alias("p90"),
    )


def freq_stats_by(df: DataFrame, token: str, by: str) -> DataFrame:
    """``freq_stats`` without shares, for every value of ``by``."""
    c = counts(df, token, [by])
    n = c.groupBy(by).agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.max("c").alias("modal"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    return n.select(by, "n", "v", "modal", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def type_token_ratio(df: DataFrame, conv: str, token: str, approx: bool = False) -> DataFrame:
    d = F.approx_count_distinct(token) if approx else F.count_distinct(token)
    return df.groupBy(conv).agg(F.count("*").alias("n"), d.alias("v")).withColumn("ttr", F.col("v") / F.col("n"))


def zipf_fit(df: DataFrame, token: str) -> DataFrame:
    """``alpha, intercept, r2`` of log10 count against log10 rank."""
    c = running(counts(df, token), [F.desc("c"), token])
    x, y = F.log10("rank"), F.log10("c")
    return c.agg((-F.regr_slope(y, x)).alias("alpha"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def top_k(df: DataFrame, token: str, k: int) -> DataFrame:
    return counts(df, token).orderBy(F.desc("c"), token).limit(k)


def lag_counts(df: DataFrame, seq: str, pos: str, token: str, lags: int, stretch: int = STRETCH, dense: int = DENSE) -> DataFrame:
    """``(lag, a, b, c)``: how often ``b`` stands ``lag`` rows after ``a`` inside a sequence, for 1 to ``lags``; no pair has a null ``b``.

    A task's rows come in the order of the window, and are counted a stretch at a time: the pairs, ``lags`` times as many as the rows, never become rows.
    """

    def count(tokens: pa.Array, n: np.ndarray, old: int) -> pa.RecordBatch:
        """The pairs whose later row isn't one of the ``old`` ones; ``n`` is a row's place in its sequence, from 1."""
        t = tokens.dictionary_encode(null_encoding="encode")
        code, names = t.indices.to_numpy(zero_copy_only=False).astype(np.int64), t.dictionary
        v, some, parts = len(names), tokens.is_valid().to_numpy(zero_copy_only=False), []
        for k in range(1, lags + 1):
            b = np.flatnonzero((n[max(k, old) :] > k) & some[max(k, old) :]) + max(k, old)
            key = code[b - k] * v + code[b]
            if v * v <= dense:
                c = np.bincount(key, minlength=v * v)
                at = np.flatnonzero(c)
                c = c[at]
            else:
                at, c = np.unique(key, return_counts=True)
            parts.append((np.full(len(at), k), at, c))
        lag, at, c = map(np.concatenate, zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(lag, pa.int32()), names.take(pa.array(at // v)), names.take(pa.array(at % v)), pa.array(c, pa.int64())], ["lag", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, old = [], 0, 0
        for x in batches:
            held.append(x)
            size += len(x)
            if size - old >= stretch:
                x = pa.Table.from_batches(held).combine_chunks()
                yield count(x.column(0).combine_chunks(), x.column(1).to_numpy(), old)
                held = x.slice(max(0, size - lags)).to_batches()
                size = old = min(size, lags)
        if size > old:
            x = pa.Table.from_batches(held)
            yield count(x.column(0).combine_chunks(), x.column(1).to_numpy(), old)

    n = F.row_number().over(Window.partitionBy(seq).orderBy(pos))
    x = df.select(F.col(token).alias("token"), n.alias("n"))
    kind = x.schema["token"].dataType.simpleString()
    return x.mapInArrow(run, f"lag int, a {kind}, b {kind}, c long").groupBy("lag", "a", "b").agg(F.sum("c").alias("c"))


def mi_decay(df: DataFrame, seq: str, pos: str, token: str, lags: int = 20) -> DataFrame:
    """``(lag, n, mi)``: mutual information in bits between tokens ``lag`` apart inside sequences; marginals come from the pairs of that lag."""
    joint = lag_counts(df, seq, pos, token, lags)
    # I = log2 n + (sum c log c - sum ca log ca - sum cb log cb) / n, so three sums a lag are enough
    s = lambda d, name: d.groupBy("lag").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias(name))
    ab = s(joint, "ab")
    a = s(joint.groupBy("lag", "a").agg(F.sum("c").alias("c")), "sa").drop("n")
    b = s(joint.groupBy("lag", "b").agg(F.sum("c").alias("c")), "sb").drop("n")
    mi = F.log2("n") + (F.col("ab") - F.col("sa") - F.col("sb")) / F.col("n")
    return ab.join(F.broadcast(a), "lag").join(F.broadcast(b), "lag").select("lag", "n", F.greatest(mi, F.lit(0.0)).alias("mi"))  # a row a lag


def decay_models(mi: DataFrame, least: int = 4) -> DataFrame:
    """``(model, slope, r2, sse, aic)`` for a power law and an exponential through ``(lag, mi)``, in logarithms; none with fewer than ``least`` positive points."""
    x = mi.where("mi > 0").select(F.log("mi").alias("y"), F.log("lag").alias("power"), F.col("lag").cast("double").alias("exponential"))
    long = x.unpivot(["y"], ["power", "exponential"], "model", "x")
    g = long.groupBy("model").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.regr_syy("y", "x").alias("syy"))
    sse = F.greatest(F.col("syy") * (1 - F.col("r2")), F.lit(1e-300))
    return g.where(F.col("n") >= least).select("model", "slope", "r2", sse.alias("sse"), (F.col("n") * F.log(sse / F.col("n")) + 4).alias("aic"))


def divergence(p: Column, q: Column) -> Column:
    """One token's part of the Jensen-Shannon divergence, in bits."""
    m = (p + q) / 2
    return 0.5 * p * F.log2(p / m) + 0.5 * q * F.log2(q / m)


def jsd(left: DataFrame, right: DataFrame, token: str, by: list[str], eps: float = 1e-8) -> DataFrame:
    """``(by.., jsd)`` of two token count tables with ``c``: outer join, additive smoothing, each side normalised again."""
    full = left.select(*by, token, F.col("c").alias("l")).join(right.select(*by, token, F.col("c").alias("r")).hint("merge"), [*by, token], "full")
    sums = full.groupBy(*by).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"), F.count("*").alias("v"))
    x = full.join(sums.hint("shuffle_hash"), by) if by else full.crossJoin(F.broadcast(sums))  # one row
    p = (F.coalesce("l", F.lit(0)) / F.col("nl") + eps) / (1 + F.col("v") * eps)
    q = (F.coalesce("r", F.lit(0)) / F.col("nr") + eps) / (1 + F.col("v") * eps)
    return x.groupBy(*by).agg(F.sum(divergence(p, q)).alias("jsd"))


def pause_context_jsd(df: DataFrame, seq: str, pos: str, token: str, bucket: str, least: int = 20) -> DataFrame:
    """``(bucket, n, jsd)``: tokens before against tokens after a gap of each bucket that occurs ``least`` times or more."""
    w = Window.partitionBy(seq).orderBy(pos)
    x = df.select(F.col(bucket).alias("bucket"), F.lag(token).over(w).alias("left"), F.col(token).alias("right")).where("left is not null")
    x = written(x.groupBy("bucket", "left", "right").agg(F.count("*").alias("c")), "pauses")
    n = x.groupBy("bucket").agg(F.sum("c").alias("n")).where(F.col("n") >= least)
    side = lambda c: x.groupBy("bucket", F.col(c).alias("tok")).agg(F.sum("c").alias("c"))
    return n.join(jsd(side("left"), side("right"), "tok", ["bucket"]).hint("merge"), "bucket")


def ngram_pmi(df: DataFrame, seq: str, pos: str, token: str, orders: tuple = (2, 3, 4), least: int = 5, k: int = 20) -> DataFrame:
    """``(n, gram, c, pmi, saving)``: per order the ``k`` n-grams with the largest count times PMI."""
    w = Window.partitionBy(seq).orderBy(pos)
    grams = [F.struct(F.lit(n).alias("n"), F.array(*[F.lead(token, i).over(w) if i else F.col(token) for i in range(n)]).alias("gram")) for n in orders]
    g = df.select(F.array(*grams).alias("g")).select(F.explode("g").alias("x")).select("x.n", "x.gram").where(F.forall("gram", lambda t: t.isNotNull()))
    c = g.groupBy("n", "gram").agg(F.count("*").alias("c"))
    total = c.groupBy("n").agg(F.sum("c").alias("total"))
    uni = counts(df, token).withColumnRenamed("c", "cu")
    all_ = uni.agg(F.sum("cu").alias("all"))
    often = c.where(F.col("c") >= least)
    parts = often.select("n", "gram", "c", F.explode("gram").alias(token)).join(uni.hint("shuffle_hash"), token).crossJoin(F.broadcast(all_))  # one row
    scored = parts.groupBy("n", "gram", "c").agg(F.sum(F.log2(F.col("cu") / F.col("all"))).alias("indep")).join(F.broadcast(total), "n")  # a row an order
    pmi = F.log2(F.col("c") / F.col("total")) - F.col("indep")
    x = scored.select("n", F.array_join("gram", " ").alias("gram"), "c", pmi.alias("pmi"), (F.col("c") * pmi).alias("saving"))
    r = F.row_number().over(Window.partitionBy("n").orderBy(F.desc(F.round("saving", 6)), "gram"))
    return x.withColumn("r", r).where(F.col("r") <= k).drop("r")


def cluster_metadata(df: DataFrame, cluster: str, dur: str, gap: str, flag: str, actor: str, k: int = 3) -> DataFrame:
    """``(cluster, n, mean_dur, sd_dur, mean_gap, flag_rate, actors, top)``: the gap over timed rows (not negative), ``top`` the ``k`` most frequent actors."""
    a = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(dur).alias("mean_dur"), F.stddev_samp(dur).alias("sd_dur"), F.avg(F.when(F.col(gap) >= 0, F.col(gap))).alias("mean_gap"), F.avg(F.col(flag).cast("double")).alias("flag_rate"), F.count_distinct(actor).alias("actors"))
    c = df.where(F.col(actor).isNotNull()).groupBy(cluster, actor).agg(F.count("*").alias("c"))
    r = c.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("c"), actor))).where(F.col("r") <= k)
    top = r.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.col(actor).cast("string").alias("a")))), lambda s: s["a"]), ",").alias("top"))
    return a.join(top, cluster, "left")


def within_k_pairs(df: DataFrame, seq: str, pos: str, token: str, actor: str, gap: str, timed: str, k: int = 8) -> DataFrame:
    """``(a, b, n, forward, backward, cross_rate, mean_dt)`` for unordered pairs of different tokens less than ``k`` positions apart.

    ``forward`` counts a before b. ``cross_rate`` is over pairs whose actors are known; ``mean_dt`` sums ``gap`` over the rows after the
    first up to the second, over pairs with all of these timed.
    """
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    x = df.select(seq, F.col(pos).alias("p"), F.col(token).alias("t"), F.col(actor).alias("w"), F.sum(F.when(F.col(timed), F.col(gap)).otherwise(0.0)).over(w).alias("s"), F.sum(F.col(timed).cast("int")).over(w).alias("m"))
    lead = Window.partitionBy(seq).orderBy("p")
    ahead = F.array(*[F.lead(F.struct("p", "t", "w", "s", "m"), i).over(lead) for i in range(1, k)])
    pair = x.select("p", "t", "w", "s", "m", ahead.alias("ahead")).select("p", "t", "w", "s", "m", F.explode(F.array_compact("ahead")).alias("q")).where("q.p < p + %d and q.t <> t" % k)
    fwd = F.col("t") < F.col("q.t")
    whole = (F.col("q.m") - F.col("m")) == (F.col("q.p") - F.col("p"))
    return (
        pair.groupBy(F.least("t", F.col("q.t")).alias("a"), F.greatest("t", F.col("q.t")).alias("b"))
        .agg(F.count("*").alias("n"), F.count_if(fwd).alias("forward"), F.count_if(~fwd).alias("backward"), F.avg(F.when(F.col("w").isNotNull() & F.col("q.w").isNotNull(), (F.col("w") != F.col("q.w")).cast("double"))).alias("cross_rate"), F.avg(F.when(whole, F.col("q.s") - F.col("s"))).alias("mean_dt"))
    )


def conditional_kl(left: DataFrame, right: DataFrame, seq: str, pos: str, token: str, least: int = 10, eps: float = 1e-8) -> DataFrame:
    """``(context, n, kl)``: bits from the next-token distribution of ``left`` to that of ``right`` by preceding token, seen ``least`` times or more in both."""
    w = Window.partitionBy(seq).orderBy(pos)

    def nexts(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col(token).alias("context"), F.lead(token).over(w).alias("next")).where("next is not null").groupBy("context", "next").agg(F.count("*").alias(c))

    full = nexts(left, "l").join(nexts(right, "r").hint("merge"), ["context", "next"], "full")
    tot = full.groupBy("context").agg(F.sum("l").alias("nl"), F.sum("r").alias("nr")).where((F.col("nl") >= least) & (F.col("nr") >= least))
    x = full.join(tot.hint("shuffle_hash"), "context")
    p, q = F.coalesce("l", F.lit(0)) / F.col("nl") + eps, F.coalesce("r", F.lit(0)) / F.col("nr") + eps
    return x.groupBy("context").agg(F.max("nl").alias("n"), F.sum(p * F.log2(p / q)).alias("kl"))


def acceptance_bands(values: DataFrame, bands: dict[str, tuple]) -> DataFrame:
    """``(check, value, low, high, ok)`` for one row of ``values`` against ``{column: (low, high)}``."""
    rows = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).cast("double").alias("value"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.col(k).between(lo, hi).alias("ok")) for k, (lo, hi) in bands.items()])
    return values.select(F.explode(rows).alias("x")).select("x.*")


def shuffled_positions(df: DataFrame, seq: str, pos: str, seed: int = 42, out: str = "pos", mixed: Column | None = None) -> DataFrame:
    """Each sequence's rows with new positions in a random, repeatable order: by a hash, or by ``mixed``."""
    w = Window.partitionBy(seq).orderBy(F.xxhash64(pos, seq, F.lit(seed)) if mixed is None else mixed, pos)
    return df.withColumn("__q", F.row_number().over(w) - 1).drop(pos).withColumnRenamed("__q", out)
