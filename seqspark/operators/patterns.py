"""Pattern strings: quantile symbols, segment inventories, string and timing metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import columns as C

from .stages import quantiles, sized, small, written


def position_edges(df: DataFrame, vec: str = "ici", bins: int = 4) -> DataFrame:
    """``(pos, edges)``: exact quantile edges of each position (from 1) with at least ``10 * bins`` values and two distinct edges."""
    e = df.select(F.posexplode(vec).alias("i", "x")).where("x is not null").groupBy((F.col("i") + 1).alias("pos"), "x").agg(F.count("*").alias("c"))
    e = written(e, "positions")
    q = quantiles(e, ["pos"], "x", [i / bins for i in range(bins + 1)], weight="c").select("pos", F.array_sort(F.array_distinct("q")).alias("edges"))
    g = e.groupBy("pos").agg(F.sum("c").alias("n")).join(q.hint("shuffle_hash"), "pos")
    return g.where((F.col("n") >= 10 * bins) & (F.size("edges") > 1)).select("pos", "edges")


def edge_map(edges: DataFrame) -> DataFrame:
    """One row: the edges as a map by position; there are as many as positions in the longest pattern."""
    return edges.agg(F.map_from_entries(F.collect_list(F.struct("pos", "edges"))).alias("edge_map"))


def symbol_strings(df: DataFrame, edges: DataFrame, vec: str = "ici", out: str = "sym", bins: int = 4) -> DataFrame:
    """``df`` with the pattern's symbol string."""
    x = df.crossJoin(F.broadcast(edge_map(edges)))  # one row
    return x.withColumn(out, C.symbolise(F.col(vec), F.col("edge_map"), "ABCDEFGHIJ"[:bins])).drop("edge_map")


def bin_means(df: DataFrame, edges: DataFrame, vec: str = "ici", sym: str = "sym") -> DataFrame:
    """``(pos, symbol, mean)``: the mean of the values with a symbol at a position; the bin's midpoint for a bin without values."""
    v = df.select(F.explode(F.arrays_zip(F.col(vec).alias("x"), F.split(sym, "").alias("s"), F.sequence(F.lit(1), F.size(vec)).alias("pos"))).alias("z")).select("z.*").where("x is not null and s is not null")
    seen = v.groupBy("pos", F.col("s").alias("symbol")).agg(F.avg("x").alias("m"))
    bins_ = edges.select("pos", F.posexplode(F.slice("edges", 1, F.size("edges") - 1)).alias("i", "lo"), F.col("edges").alias("e")).select("pos", F.substring(F.lit("ABCDEFGHIJ"), F.col("i") + 1, F.lit(1)).alias("symbol"), ((F.col("lo") + F.get("e", F.col("i") + 1)) / 2).alias("mid"))
    return seen.join(bins_.hint("merge"), ["pos", "symbol"], "full").select("pos", "symbol", F.coalesce("m", "mid").alias("mean"))


def desymbolise(df: DataFrame, means: DataFrame, key: str, sym: str = "sym", fallback: float = 0.25, out: str = "timing") -> DataFrame:
    """``(key, out)``: a string's symbols as intervals in order, ``fallback`` for an unknown one."""
    x = df.select(key, F.posexplode(F.filter(F.split(sym, ""), lambda s: s != "")).alias("i", "symbol")).withColumn("pos", F.col("i") + 1)
    x = x.join(small(means), ["pos", "symbol"], "left")
    return x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("mean", F.lit(fallback)).alias("m")))), lambda s: s["m"]).alias(out))


def string_corpus(df: DataFrame, sym: str = "sym", tempo: str | None = None, least: int = 2) -> DataFrame:
    """``(string, c)``; with ``tempo`` a suffix P to T, U without a tempo."""
    s = F.col(sym)
    x = df.where(F.length(sym) >= least)
    if tempo is not None:
        s = F.concat(s, F.coalesce(F.when(F.col(tempo).between(1, 5), F.substring(F.lit("PQRST"), F.col(tempo), F.lit(1))), F.lit("U")))
    return x.groupBy(s.alias("string")).agg(F.count("*").alias("c"))


def string_ids(df: DataFrame, sym: str = "sym", out: str = "sid") -> DataFrame:
    """``df`` with dense ids of sorted strings from 1; 0 without a string."""
    from .tokens import dense_ids, encode

    ids = dense_ids(df.where(F.length(sym) > 0).select(sym).distinct(), [sym], out, start=1)
    return encode(df, ids, sym, out, 0)


def segment_inventory(strings: DataFrame, segments: DataFrame) -> DataFrame:
    """``(segment, freq, strings)`` from ``(string, c)`` and ``(string, segs)``."""
    x = strings.join(segments.hint("merge"), "string").select("c", F.explode("segs").alias("segment"))
    return x.groupBy("segment").agg(F.sum("c").alias("freq"), F.count("*").alias("strings"))


def segment_purity(rows: DataFrame, segments: DataFrame, sym: str, label: str) -> DataFrame:
    """``(segment, n, labels, purity)``: how many labels a segment's events have and the share of the most frequent one."""
    x = rows.where(F.col(label).isNotNull()).join(segments.withColumnRenamed("string", sym).hint("shuffle_hash"), sym).select(label, F.explode(F.array_distinct("segs")).alias("segment"))
    c = x.groupBy("segment", label).agg(F.count("*").alias("c"))
    return c.groupBy("segment").agg(F.sum("c").alias("n"), F.count("*").alias("labels"), (F.max("c") / F.sum("c")).alias("purity"))


def segment_features(rows: DataFrame, segments: DataFrame, sym: str, tempo: str, trend: str, ornament: str) -> DataFrame:
    """``(segment, n, tempo_mean, tempo_sd, rising, level, falling, ornament_rate)``; population deviation."""
    x = rows.join(segments.withColumnRenamed("string", sym).hint("shuffle_hash"), sym).select(tempo, trend, ornament, F.explode("segs").alias("segment"))
    return x.groupBy("segment").agg(F.count("*").alias("n"), F.avg(tempo).alias("tempo_mean"), F.stddev_pop(tempo).alias("tempo_sd"), *[F.count_if(F.col(trend) == m).alias(n) for m, n in (("/", "rising"), ("-", "level"), ("\\", "falling"))], F.avg(F.col(ornament).cast("double")).alias("ornament_rate"))


def tension_summary(purity: DataFrame, least: int = 50, top: int = 20) -> DataFrame:
    """One row: segments confined to one label and spanning several, among those of ``least`` events or more, and the mean purity of the ``top`` most frequent."""
    often = purity.where(F.col("n") >= least)
    head = often.orderBy(F.desc("n"), "segment").limit(top).agg(F.avg("purity").alias("top_purity"))
    return often.agg(F.count_if(F.col("labels") == 1).alias("confined"), F.count_if(F.col("labels") > 1).alias("spanning")).crossJoin(head)  # one row each


def label_strings(df: DataFrame, label: str, sym: str = "sym") -> DataFrame:
    """``(label, string, c, r)``: string counts of each label, most frequent first."""
    c = df.groupBy(label, F.col(sym).alias("string")).agg(F.count("*").alias("c"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("c"), "string")))


def bin_sensitivity(df: DataFrame, segment, bins: tuple = (2, 3, 4, 7, 10), vec: str = "ici", label: str = "label", least: int = 2, often: int = 50, head: int = 20) -> DataFrame:
    """``(bins, strings, inventory, segmented, mean_length, top_purity, confined, spanning)`` for several numbers of bins.

    ``segment`` cuts the unique strings of ``(string, c)`` into ``(string, segs)``. ``segmented`` is the share of occurrences whose string is cut into two or more,
    ``mean_length`` that of a segment in symbols. Purity is that of the ``head`` most frequent segments; only segments seen ``often`` count as confined to a label or spanning several.
    """
    out = None
    for b in bins:  # a handful of branches
        x = written(symbol_strings(df, position_edges(df, vec, b), vec, bins=b), "bins")
        segs = written(segment(string_corpus(x, least=least)), "segments")
        cut = x.select(F.col("sym").alias("string"), label).join(small(segs), "string")
        each = cut.agg(F.avg((F.size("segs") > 1).cast("double")).alias("segmented"), (F.sum(F.length("string")) / F.sum(F.size("segs"))).alias("mean_length"))
        names = segs.agg(F.count("*").alias("strings")).crossJoin(F.broadcast(segs.select(F.explode("segs").alias("s")).agg(F.count_distinct("s").alias("inventory"))))  # one row each
        t = tension_summary(segment_purity(x, segs, "sym", label), often, head)
        row = names.crossJoin(F.broadcast(each)).crossJoin(F.broadcast(t))  # one row each
        g = row.select(F.lit(b).alias("bins"), "strings", "inventory", "segmented", "mean_length", "top_purity", "confined", "spanning")
        out = g if out is None else out.unionByName(g)
    return out


# -- metrics of a predicted against a true pattern


def string_metrics(pred: Column, true: Column) -> Column:
    """``struct(exact, symbol_acc, norm_edit)``; both over the longer length."""
    n = F.greatest(F.length(pred), F.length(true))
    same = F.size(F.filter(F.zip_with(F.split(pred, ""), F.split(true, ""), lambda a, b: (a == b) & (a != "")), lambda x: x))
    return F.struct((pred == true).cast("int").alias("exact"), F.when(n > 0, same / n).otherwise(1.0).alias("symbol_acc"), F.when(n > 0, F.levenshtein(pred, true) / n).otherwise(0.0).alias("norm_edit"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping of two arrays over the larger length: a fold over rows of the table, each a fold over its cells."""
    inf = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: inf))

    def row(prev: Column, x: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            best = F.least(F.get(prev, j), F.get(prev, j - 1), F.element_at(out, -1))
            return F.concat(out, F.array(F.abs(x - F.get(b, j - 1)) + best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(inf), cell)

    last = F.element_at(F.aggregate(a, first, row), -1)
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.abs(F.size(a) - F.size(b)).cast("double")).otherwise(last / F.greatest(F.size(a), F.size(b)))


def timing_metrics(pred: Column, true: Column) -> Column:
    """``struct(click_err, nn_dist, rmse, dtw, corr)`` of predicted against true intervals."""
    p, t = C.click_times(pred), C.click_times(true)
    near = F.transform(p, lambda x: F.array_min(F.transform(t, lambda y: F.abs(x - y))))
    dur = F.when(F.size(t) > 1, F.element_at(t, -1)).otherwise(1.0)
    n = F.greatest(F.size(pred), F.size(true))
    unit = lambda a: F.transform(a, lambda x: x / (_sum(a) + 1e-9))
    diff = F.zip_with(unit(pred), unit(true), lambda a, b: F.pow(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 2.0))
    rmse = F.when((F.size(pred) == 0) | (F.size(true) == 0), 1.0).otherwise(F.sqrt(_sum(diff) / n))
    m = F.least(F.size(pred), F.size(true))
    a, b = F.slice(pred, 1, m), F.slice(true, 1, m)
    ma, mb = _sum(a) / m, _sum(b) / m
    cov = _sum(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    var = _sum(F.transform(a, lambda x: F.pow(x - ma, 2.0))) * _sum(F.transform(b, lambda y: F.pow(y - mb, 2.0)))
    corr = F.when((m < 2) | (var <= 1e-18), 0.0).otherwise(cov / F.sqrt(var))
    return F.struct(F.abs(F.size(pred) - F.size(true)).alias("click_err"), (_sum(near) / F.size(p) / F.greatest(dur, F.lit(1e-6))).alias("nn_dist"), rmse.alias("rmse"), dtw(pred, true).alias("dtw"), corr.alias("corr"))


def timing_summary(df: DataFrame, pred: str, true: str, by: list[str] = ()) -> DataFrame:
    """Mean and population deviation of every timing metric."""
    x = df.select(*by, timing_metrics(F.col(pred), F.col(true)).alias("m")).select(*by, "m.*")
    aggs = [f(c).alias(f"{c}_{s}") for c in ("click_err", "nn_dist", "rmse", "dtw", "corr") for f, s in ((F.avg, "mean"), (F.stddev_pop, "sd"))]
    return x.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


# -- count-model predictions of patterns


def label_mixture_bits(label_probs: DataFrame, table: DataFrame, true: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``(key, bits)``: ``-log2`` of the mixture over labels of P(label | context) and the smoothed P(string | label).

    ``label_probs`` (key, label, p), ``table`` (label, string, c) of training, ``true`` (key, string). A label unseen in training gives one over the number of strings.
    """
    strings = table.select("string").distinct().agg(F.count("*").alias("v"))
    tot = table.groupBy("label").agg(F.sum("c").alias("n"))
    x = label_probs.join(true.hint("merge"), "key").join(sized(tot), "label", "left").join(table.select("label", "string", "c").hint("shuffle_hash"), ["label", "string"], "left").crossJoin(F.broadcast(strings))  # one row
    p = F.when(F.col("n").isNull(), 1 / F.col("v")).otherwise((F.coalesce("c", F.lit(0)) + alpha) / (F.col("n") + alpha * F.col("v")))
    return x.groupBy("key").agg((-F.log2(F.greatest(F.sum(F.col("p") * p), F.lit(1e-12)))).alias("bits"))


def predicted_strings(best_label: DataFrame, table: DataFrame) -> DataFrame:
    """``(key, pred)``: the most frequent training string of the predicted label; empty for an unseen label."""
    top = table.where("r = 1").select("label", F.col("string").alias("pred"))
    return best_label.join(sized(top), "label", "left").select("key", F.coalesce("pred", F.lit("")).alias("pred"))


def next_labels(rows: DataFrame, folds: int, label: str = "label") -> DataFrame:
    """``(row_id, fold, pred_label)`` of ``rows`` (row_id, seq, pos, own, label): the likeliest label after the one before, counted in the other folds (ties: the smaller); without one, or after an unseen one, the fold's most frequent."""
    before = F.lag(label).over(Window.partitionBy("seq").orderBy("pos"))
    x = written(rows.select("row_id", "own", F.col(label).alias("__l"), before.alias("__b")), "labels")
    by_own = x.groupBy("own", "__b", "__l").agg(F.count("*").alias("c"))
    tr = written(by_own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> own").groupBy("fold", "__b", "__l").agg(F.sum("c").alias("c")), "transitions")
    top = F.min_by("__l", F.struct(-F.col("c"), F.col("__l")))
    after = tr.where("__b is not null").groupBy("fold", "__b").agg(top.alias("nxt"))
    most = tr.groupBy("fold", "__l").agg(F.sum("c").alias("c")).groupBy("fold").agg(top.alias("most"))  # a row a fold
    y = x.select("row_id", F.col("own").alias("fold"), "__b").join(small(after), ["fold", "__b"], "left").join(F.broadcast(most), "fold", "left")
    return y.select("row_id", "fold", F.coalesce("nxt", "most").alias("pred_label"))


def held_out_strings(rows: DataFrame, folds: int, label: str = "label", sym: str = "sym") -> DataFrame:
    """``(row_id, pred)`` of ``rows`` (row_id, seq, pos, own, label, sym): the string most frequent with the predicted label (:func:`next_labels`) in the other folds; empty if these don't have it."""
    by_own = rows.groupBy("own", F.col(label).alias("pred_label"), F.col(sym).alias("s")).agg(F.count("*").alias("c"))
    tr = by_own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> own").groupBy("fold", "pred_label", "s").agg(F.sum("c").alias("c"))
    best = tr.groupBy("fold", "pred_label").agg(F.min_by("s", F.struct(-F.col("c"), F.col("s"))).alias("pred"))
    return next_labels(rows, folds, label).join(small(best), ["fold", "pred_label"], "left").select("row_id", F.coalesce("pred", F.lit("")).alias("pred"))


def context_mixture_bits(rows: DataFrame, folds: int, label: str = "label", sym: str = "sym", alpha: float = 0.5) -> DataFrame:
    """``(row_id, fold, bits)`` of ``rows`` (row_id, seq, pos, own, label, sym): ``-log2`` of the sum over labels of P(label | the label before) and P(string | label), counted in the other folds.

    Both are additively smoothed over all labels of the table and all strings of the fold's training; a label unseen there gives one over the number of strings, an unseen or missing label before the
    labels' own shares. A smoothed share is one number for every label and more for the seen ones, so only labels seen with the string, and of these the ones seen after the label before,
    are joined: rows aren't multiplied by labels.
    """
    before = F.lag(label).over(Window.partitionBy("seq").orderBy("pos"))
    x = written(rows.select("row_id", "own", F.col(label).cast("string").alias("l"), F.col(sym).alias("s"), before.cast("string").alias("b")), "mixture")
    train = lambda df, *by: written(df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> own").groupBy("fold", *by).agg(F.sum("c").alias("c")), "mixture")
    strings = train(x.groupBy("own", "l", "s").agg(F.count("*").alias("c")), "l", "s")
    after = train(x.where("b is not null").groupBy("own", "b", "l").agg(F.count("*").alias("c")), "b", "l")
    names = x.select("l").distinct()
    labels = names.agg(F.count("*").alias("m"))
    v = strings.groupBy("fold").agg(F.count_distinct("s").alias("v"))  # a row a fold
    size = strings.groupBy("fold", "l").agg(F.sum("c").alias("n"))
    every = names.crossJoin(F.broadcast(v)).join(size.hint("merge"), ["fold", "l"], "left")  # labels times folds
    unit = written(every.select("fold", "l", "n", "v", F.when(F.col("n").isNull(), 1 / F.col("v")).otherwise(alpha / (F.col("n") + alpha * F.col("v"))).alias("unit")), "mixture")
    own = size.select("fold", F.lit(None).cast("string").alias("b"), "l", F.col("n").alias("c"))
    ctx = after.select("fold", "b", "l", "c").unionByName(own).withColumn("known", F.col("b").isNotNull()).withColumn("b", F.coalesce("b", F.lit("")))
    total = ctx.groupBy("fold", "known", "b").agg(F.sum("c").alias("t")).crossJoin(F.broadcast(labels)).withColumn("mass", F.col("t") + alpha * F.col("m"))  # one row
    share = ctx.join(total.hint("merge"), ["fold", "known", "b"]).join(unit.select("fold", "l", "unit").hint("merge"), ["fold", "l"]).select("fold", "known", "b", "l", (F.col("c") / F.col("mass")).alias("extra"), "unit", "mass")
    share = written(share, "mixture")
    context = share.groupBy("fold", "known", "b").agg((alpha / F.max("mass")).alias("base"), F.sum(F.col("extra") * F.col("unit")).alias("some"))
    all_ = unit.groupBy("fold").agg(F.sum("unit").alias("all"))  # a row a fold
    seen = strings.join(unit.where("n is not null").select("fold", "l", "n", "v").hint("merge"), ["fold", "l"]).select("fold", "s", "l", (F.col("c") / (F.col("n") + alpha * F.col("v"))).alias("w"))
    seen = written(seen, "mixture")
    asked = x.select("row_id", F.col("own").alias("fold"), "s", F.coalesce("b", F.lit("")).alias("b"), F.col("b").isNotNull().alias("has"))
    met = after.select("fold", "b").distinct().withColumn("known", F.lit(True))
    asked = asked.join(met.hint("merge"), ["fold", "b"], "left").withColumn("known", F.col("has") & F.coalesce("known", F.lit(False)))
    asked = written(asked.withColumn("b", F.when(F.col("known"), F.col("b")).otherwise("")).drop("has"), "mixture")
    kinds = asked.select("fold", "known", "b", "s").distinct()
    pairs = kinds.join(seen.hint("merge"), ["fold", "s"]).join(share.select("fold", "known", "b", "l", "extra").hint("merge"), ["fold", "known", "b", "l"], "left")
    met = pairs.groupBy("fold", "known", "b", "s").agg(F.sum("w").alias("with_s"), F.sum(F.coalesce(F.col("extra"), F.lit(0.0)) * F.col("w")).alias("both"))
    y = kinds.join(met.hint("merge"), ["fold", "known", "b", "s"], "left").join(context.hint("merge"), ["fold", "known", "b"]).join(F.broadcast(all_), "fold")
    p = F.col("base") * (F.col("all") + F.coalesce("with_s", F.lit(0.0))) + F.col("some") + F.coalesce("both", F.lit(0.0))
    y = y.select("fold", "known", "b", "s", (-F.log2(F.greatest(p, F.lit(1e-12)))).alias("bits"))
    return asked.join(y.hint("merge"), ["fold", "known", "b", "s"]).select("row_id", "fold", "bits")


def greedy_strings(rows: DataFrame, folds: int) -> DataFrame:
    """``(row_id, fold, pred)`` of ``rows`` (row_id, seq, pos, own, segs): as many likeliest successors of the last segment before as the row has segments, joined.

    Successors are counted in the other folds, ties go to the smaller; where none is known the fold's most frequent segment follows. The successor table is doubled, so a row of ``n`` segments
    takes a look-up for each set bit of ``n``. Rows without segments or without a training fold are left out.
    """
    start = "<B>"
    last = F.lag(F.element_at("segs", -1)).over(Window.partitionBy("seq").orderBy("pos"))
    x = written(rows.where(F.size("segs") > 0).select("row_id", "own", "segs", F.coalesce(last, F.lit(start)).alias("b")), "greedy")
    chain = F.arrays_zip(F.concat(F.array("b"), F.slice("segs", 1, F.size("segs") - 1)).alias("b"), F.col("segs").alias("t"))
    step = x.select("own", F.explode(chain).alias("e")).groupBy("own", F.col("e.b").alias("b"), F.col("e.t").alias("t")).agg(F.count("*").alias("c"))
    tr = written(step.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where("fold <> own").groupBy("fold", "b", "t").agg(F.sum("c").alias("c")), "greedy")
    top = lambda c: F.min_by("t", F.struct(-F.col(c), F.col("t")))
    most = tr.groupBy("fold", "t").agg(F.sum("c").alias("c")).groupBy("fold").agg(top("c").alias("most"))  # a row a fold
    names = step.select("b").union(step.select("t")).distinct()
    best = names.crossJoin(F.broadcast(most)).join(tr.groupBy("fold", "b").agg(top("c").alias("nxt")).hint("merge"), ["fold", "b"], "left")  # segments times folds
    path = written(best.select("fold", "b", F.coalesce("nxt", "most").alias("to"), F.coalesce("nxt", "most").alias("path")), "greedy")
    longest = x.agg(F.max(F.size("segs"))).first()[0] or 0
    y, bit = x.select("row_id", F.col("own").alias("fold"), F.size("segs").alias("n"), F.col("b").alias("at"), F.lit("").alias("pred")), 1
    while bit <= longest:
        hop = path.select("fold", F.col("b").alias("at"), "to", "path")
        y = y.join(hop.hint("merge"), ["fold", "at"])
        on = F.col("n").bitwiseAND(bit) != 0
        y = written(y.select("row_id", "fold", "n", F.when(on, F.col("to")).otherwise(F.col("at")).alias("at"), F.when(on, F.concat("pred", "path")).otherwise(F.col("pred")).alias("pred")), "greedy")
        nxt = path.select("fold", F.col("b").alias("to"), F.col("to").alias("to2"), F.col("path").alias("path2"))
        path = written(path.join(nxt.hint("merge"), ["fold", "to"]).select("fold", "b", F.col("to2").alias("to"), F.concat("path", "path2").alias("path")), "greedy")
        bit *= 2
    return y.select("row_id", "fold", "pred")
