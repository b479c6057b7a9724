"""N-gram models on shared suffix counts.

The n-grams of the longest order are counted once by the fold that owns them, added up for each fold that trains on them, and rolled up to every shorter order: an order's
table is a sum over the next longer one. Markov, Kneser-Ney and PPM models of several orders read the same tables. A history is a string of tokens; its suffix is the
history without the first one. Every seen n-gram's suffix is seen too, so a model's probabilities of all seen n-grams are made from the next shorter ones, a join an order,
and with them each history's best token: the best of the seen ones, or what backing off makes of the suffix's best. A test token then needs two look-ups an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import running, written

SEP, BOS = "\u0001", "<BOS>"


def suffix(h: Column, k: int) -> Column:
    """The last ``k - 1`` tokens of a history of ``k``."""
    return F.lit("") if k <= 1 else F.substring(h, F.instr(h, SEP) + 1, F.length(h))


def complete(h: Column) -> Column:
    """Whether a history lies wholly inside its sequence."""
    return ~F.contains(h, F.lit(BOS))


class SuffixCounts:
    """Counts of ``(fold, h, token)`` for histories of 0 to ``order`` tokens, over the sequences that other folds own; every table is written once."""

    def __init__(self, df: DataFrame, folds: int, order: int):
        """``df``: ``(own, seq, pos, token)``, ``pos`` dense from 0. Histories are padded at a sequence's start."""
        w = Window.partitionBy("seq").orderBy("pos")
        back = [F.coalesce(F.lag("token", i).over(w), F.lit(BOS)) for i in range(order, 0, -1)]
        self.order, self.folds = order, folds
        keep = [c for c in df.columns if c not in ("h",)]
        self.rows = written(df.select(*keep, (F.concat_ws(SEP, *back) if order else F.lit("")).alias("h")), "ngram-rows")
        by_own = written(self.rows.groupBy("own", "h", "token").agg(F.count("*").alias("c")), "ngrams")
        fold = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("own"))).alias("fold")
        level = by_own.select(fold, "h", "token", "c")
        self.levels: list[DataFrame] = [None] * (order + 1)
        for k in range(order, -1, -1):
            self.levels[k] = written(level.groupBy("fold", "h", "token").agg(F.sum("c").alias("c")), "suffix-counts")
            level = self.levels[k].select("fold", suffix(F.col("h"), k).alias("h"), "token", "c")

    def tests(self, *more: str) -> DataFrame:
        """``(fold, seq, pos, token, h, ..)``: the rows, each tested by the fold that owns it."""
        return self.rows.select(F.col("own").alias("fold"), "seq", "pos", "token", "h", *more)


def shortened(x: DataFrame, order: int, k: int) -> DataFrame:
    """``x`` with ``h`` of ``order`` tokens cut to the last ``k``."""
    for n in range(order, k, -1):
        x = x.withColumn("h", suffix(F.col("h"), n))
    return x


def discounts(counts: DataFrame) -> DataFrame:
    """``(fold, d1, d2, d3)`` from the counts of counts."""
    g = counts.groupBy("fold").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)])
    n = [None, *[F.col(f"n{i}") for i in range(1, 5)]]
    ok = (n[1] > 0) & (n[2] > 0)
    y = F.try_divide(n[1], n[1] + 2 * n[2])
    d1 = 1 - 2 * y * F.try_divide(n[2], n[1])
    d2 = F.when(n[3] > 0, 2 - 3 * y * F.try_divide(n[3], n[2])).otherwise(d1)
    d3 = F.when(n[4] > 0, 3 - 4 * y * F.try_divide(n[4], n[3])).otherwise(d2)
    within = lambda d, top: F.when(ok, F.greatest(F.least(d, F.lit(float(top))), F.lit(0.0))).otherwise(0.5)
    return g.select("fold", within(d1, 1).alias("d1"), within(d2, 2).alias("d2"), within(d3, 3).alias("d3"))


def _top(item: str, p: str) -> Column:
    return F.min(F.struct((-F.round(p, 12)).alias("q"), F.col(item).alias("item"), F.col(p).alias("p")))


class KneserNey:
    """Modified Kneser-Ney of order ``n``: raw counts at the top, counts of distinct left tokens below, three discounts an order, uniform base.

    With ``groups`` (token, label) the items are labels: a label has the sum over its tokens, and sums back off like tokens. ``probs[k]``: ``(fold, h, item, p)`` of seen items,
    ``contexts[k]``: ``(fold, h, gamma, best, bp)`` of seen histories, for histories of ``k`` tokens.
    """

    def __init__(self, counts: SuffixCounts, n: int, groups: DataFrame | None = None):
        self.n, self.item = n, "token" if groups is None else "label"
        self.probs, self.contexts = [], []
        for k in range(n):
            if k == n - 1:
                c = counts.levels[k]
            else:  # distinct left tokens
                c = counts.levels[k + 1].groupBy("fold", suffix(F.col("h"), k + 1).alias("h"), "token").agg(F.count("*").alias("c"))
            c = written(c, "kneser-ney") if k < n - 1 else c
            take = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
            x = c.join(F.broadcast(discounts(c)), "fold").withColumn("take", take)  # a row a fold
            x = x.select("fold", "h", "token", "c", "take", F.greatest(F.col("c") - F.col("take"), F.lit(0.0)).alias("kept"))
            total = x.groupBy("fold", "h").agg(F.sum("c").alias("ch"), (F.sum("take") / F.sum("c")).alias("gamma"))
            if groups is not None:
                if k == 0:
                    base = c.join(groups.hint("shuffle_hash"), "token").groupBy("fold", "label").agg(F.count("*").alias("m"))
                    self.sizes = written(base.join(F.broadcast(c.groupBy("fold").agg(F.count("*").alias("v"))), "fold").select("fold", "label", (F.col("m") / F.col("v")).alias("base")), "label-sizes")  # a row a fold
                x = x.join(groups.hint("shuffle_hash"), "token").groupBy("fold", "h", "label").agg(F.sum("kept").alias("kept"))
            x = x.join(total.hint("broadcast" if k == 0 else "merge"), ["fold", "h"])  # of the empty history there is a row a fold
            up = suffix(F.col("h"), k)
            if k == 0:
                self.v = written(c.groupBy("fold").agg(F.count("*").alias("v")), "vocabulary")
                x = x.join(F.broadcast(self.v), "fold").withColumn("lower", 1 / F.col("v")) if groups is None else x.join(self.sizes.withColumnRenamed("base", "lower").hint("merge"), ["fold", "label"])
            else:
                low = self.probs[-1].select("fold", F.col("h").alias("up"), self.item, F.col("p").alias("lower"))
                x = x.withColumn("up", up).join(low.hint("merge"), ["fold", "up", self.item])
            p = written(x.select("fold", "h", self.item, (F.col("kept") / F.col("ch") + F.col("gamma") * F.col("lower")).alias("p"), "gamma"), "kneser-ney")
            best = p.groupBy("fold", "h").agg(F.max("gamma").alias("gamma"), _top(self.item, "p").alias("t"))
            if k:
                low = self.contexts[-1].select("fold", F.col("h").alias("up"), F.col("best").alias("lb"), F.col("bp").alias("lp"))
                best = best.withColumn("up", up).join(low.hint("merge" if k > 1 else "broadcast"), ["fold", "up"])
                lower = F.struct((-F.round(F.col("gamma") * F.col("lp"), 12)).alias("q"), F.col("lb").alias("item"), (F.col("gamma") * F.col("lp")).alias("p"))
                best = best.withColumn("t", F.least("t", lower))
            self.contexts.append(written(best.select("fold", "h", "gamma", F.col("t.item").alias("best"), F.col("t.p").alias("bp")), "kneser-ney"))
            self.probs.append(p.select("fold", "h", self.item, "p"))

    def score(self, asked: DataFrame) -> DataFrame:
        """``asked`` (fold, h of ``n - 1`` tokens, item, ..) with ``p`` and, where a history is known, ``best`` and its ``bp``."""
        if self.item == "token":
            x = asked.join(F.broadcast(self.v), "fold").withColumn("p", 1 / F.col("v")).drop("v")  # a row a fold
        else:
            x = asked.join(self.sizes.hint("merge"), ["fold", "label"], "left").withColumn("p", F.coalesce("base", F.lit(0.0))).drop("base")
        x = x.withColumns({"best": F.lit(None).cast("string"), "bp": F.lit(None).cast("double")})
        for k in range(self.n):
            at = F.col("h")
            for n in range(self.n - 1, k, -1):
                at = suffix(at, n)
            x = x.withColumn("__h", at)
            ctx = self.contexts[k].select("fold", F.col("h").alias("__h"), "gamma", F.col("best").alias("__b"), F.col("bp").alias("__bp"))
            seen = self.probs[k].select("fold", F.col("h").alias("__h"), self.item, F.col("p").alias("__p"))
            x = x.join(ctx.hint("merge" if k else "broadcast"), ["fold", "__h"], "left").join(seen.hint("merge"), ["fold", "__h", self.item], "left")
            x = x.withColumns({"p": F.coalesce("__p", F.coalesce("gamma", F.lit(1.0)) * F.col("p")), "best": F.coalesce("__b", "best"), "bp": F.coalesce("__bp", "bp")})
            x = x.drop("__h", "gamma", "__b", "__bp", "__p")
        return x


def kneser_ney(counts: SuffixCounts, n: int, model: KneserNey | None = None) -> DataFrame:
    """Scored test tokens, every position: ``(fold, seq, pos, token, p, hit)``, with ``best``, ``bp`` and the history ``h``."""
    m = model or KneserNey(counts, n)
    te = shortened(counts.tests(), counts.order, n - 1)
    p = m.score(te.select("fold", "h", "token").distinct())
    x = te.join(p.hint("merge"), ["fold", "h", "token"])
    return x.select("fold", "seq", "pos", "token", "p", (F.col("best") == F.col("token")).alias("hit"), "h", "best", "bp")


def kneser_ney_labels(counts: SuffixCounts, n: int) -> DataFrame:
    """As :func:`kneser_ney`, of the true ``label`` (a column of the counted rows, a function of the token): sums over a label's tokens, and the best of these."""
    groups = counts.rows.select("token", "label").distinct()
    m = KneserNey(counts, n, groups)
    te = shortened(counts.tests("label"), counts.order, n - 1)
    p = m.score(te.select("fold", "h", "label").distinct())
    x = te.join(p.hint("merge"), ["fold", "h", "label"])
    return x.select("fold", "seq", "pos", "label", F.when(F.col("p") > 0, F.col("p")).alias("p"), (F.col("best") == F.col("label")).alias("hit"))


def ppm_d(counts: SuffixCounts, order: int) -> DataFrame:
    """Scored test tokens, every position, of PPM with escape method D and full exclusion.

    What is seen after a history is seen after its suffix too, so what a seen history excludes from its suffix is known when fitting: the sum of their counts there, and the best token that
    it leaves there, which is among as many most frequent ones as are excluded, and one more.
    """
    t = [counts.levels[k].where(complete(F.col("h"))) if k else counts.levels[0] for k in range(order + 1)]
    contexts = []
    for k, x in enumerate(t):
        top = F.min(F.struct((-F.col("c")).alias("c"), "token"))
        g = x.groupBy("fold", "h").agg(F.sum("c").alias("ch"), F.count("*").alias("u"), top.alias("top"))
        if k:
            up = suffix(F.col("h"), k).alias("up")
            below = t[k - 1].select("fold", F.col("h").alias("up"), "token", F.col("c").alias("cb"))
            gone = x.select("fold", "h", up, "token").join(below.hint("merge"), ["fold", "up", "token"]).groupBy("fold", "h").agg(F.sum("cb").alias("xc"))
            need = g.select("fold", "h", up, (F.col("u") + 1).alias("need"))
            tries = need.select("fold", "h", "up", F.explode(F.sequence(F.lit(1).cast("long"), "need")).alias("r")).join(_ranked(t[k - 1], k - 1).hint("merge"), ["fold", "up", "r"])
            left = tries.join(x.select("fold", "h", "token").hint("merge"), ["fold", "h", "token"], "left_anti").groupBy("fold", "h").agg(top.alias("rest"))
            g = g.join(gone.hint("merge"), ["fold", "h"]).join(left.hint("merge"), ["fold", "h"], "left")
        contexts.append(written(g, "ppm-contexts"))
    v = contexts[0].select("fold", F.col("u").alias("v"))  # a row a fold
    te = shortened(counts.tests(), counts.order, order)
    x = te.select("fold", "h", "token").distinct().withColumn("full", F.col("h"))
    none = F.lit(None)
    x = x.withColumns({"w": F.lit(1.0), "p": none.cast("double"), "bp": F.lit(-1.0), "bt": none.cast("string"), "xc": F.lit(0).cast("long"), "xu": F.lit(0).cast("long"), "rest": none.cast("struct<c:bigint,token:string>"), "longer": F.lit(False)})
    for k in range(order, -1, -1):
        c = contexts[k].select("fold", "h", "ch", "u", "top", *([F.col("xc").alias("nx"), F.col("rest").alias("nr")] if k else []))
        x = x.join(c.hint("merge" if k else "broadcast"), ["fold", "h"], "left").join(t[k].select("fold", "h", "token", F.col("c").alias("ct")).hint("merge"), ["fold", "h", "token"], "left")
        eff, uniq = F.col("ch") - F.col("xc"), F.col("u") - F.col("xu")
        live = F.col("ch").isNotNull() & (uniq > 0)
        share = lambda n: F.try_divide(F.col("w") * (n - 0.5), eff)  # noqa: E731  nothing is left where all are excluded
        cand = F.when(F.col("longer"), F.col("rest")).otherwise(F.col("top"))
        better = live & (F.round(share(-cand["c"]), 12) > F.round(F.col("bp"), 12))
        here = F.col("ch").isNotNull()
        x = x.withColumns({
            "p": F.when(F.col("p").isNull() & live & F.col("ct").isNotNull(), share(F.col("ct"))).otherwise(F.col("p")),
            "bt": F.when(better, cand["token"]).otherwise(F.col("bt")),
            "bp": F.when(better, share(-cand["c"])).otherwise(F.col("bp")),
            "w": F.when(live, F.try_divide(F.col("w") * 0.5 * uniq, eff)).otherwise(F.col("w")),
            **({"xc": F.when(here, F.col("nx")).otherwise(0).cast("long"), "xu": F.when(here, F.col("u")).otherwise(0).cast("long"), "rest": F.when(here, F.col("nr")), "longer": here, "h": suffix(F.col("h"), k)} if k else {}),
        }).drop("ch", "u", "top", "nx", "nr", "ct")
        x = written(x, "ppm-scored") if k and k % 3 == 0 else x
    x = x.join(F.broadcast(v), "fold").select("fold", F.col("full").alias("h"), "token", (F.col("p") + F.col("w") / F.col("v")).alias("p"), "bt")
    x = te.join(x.hint("merge"), ["fold", "h", "token"])
    return x.select("fold", "seq", "pos", "token", "p", (F.col("bt") == F.col("token")).alias("hit"))


def _ranked(x: DataFrame, k: int) -> DataFrame:
    """``(fold, up, token, c, r)``: the tokens of each history, most frequent first. The empty history has a fold's whole vocabulary, so that is ranked by ranges."""
    if k:
        r = F.row_number().over(Window.partitionBy("fold", "h").orderBy(F.desc("c"), "token"))
        return x.select("fold", F.col("h").alias("up"), "token", "c", r.cast("long").alias("r"))
    every = running(x.withColumn("m", -F.col("c")), ["fold", "m", "token"], rank="__r")
    first = every.groupBy("fold").agg((F.min("__r") - 1).alias("__s"))  # a row a fold
    return every.join(F.broadcast(first), "fold").select("fold", F.col("h").alias("up"), "token", "c", (F.col("__r") - F.col("__s")).alias("r"))


def markov(counts: SuffixCounts, order: int, alpha: float = 0.5) -> DataFrame:
    """Scored test tokens at positions from 1 of a model of the last ``order`` tokens with additive smoothing; an unseen history falls back to the unigram and its majority. Order 0 is the unigram.

    The vocabulary is that of the whole table and the padding token.
    """
    if counts.order < max(order, 1):
        raise ValueError("counts of a longer order are needed")
    v = counts.rows.agg((F.count_distinct("token") + 1).alias("v"))
    # a sequence's first token isn't counted: the first to stand before it is padding
    inner = counts.levels[1].where(complete(F.col("h")))
    best = lambda c: F.min_by("token", F.struct(-F.col(c), F.col("token")))
    uni = inner.groupBy("fold", "token").agg(F.sum("c").alias("cu"))
    un = uni.groupBy("fold").agg(F.sum("cu").alias("nu"), best("cu").alias("bu"))
    te = shortened(counts.tests().where("pos > 0"), counts.order, order)
    x = te.join(uni.hint("shuffle_hash"), ["fold", "token"], "left").join(F.broadcast(un), "fold").crossJoin(F.broadcast(v))  # a row a fold, one row
    p0 = (F.coalesce("cu", F.lit(0)) + alpha) / (F.col("nu") + alpha * F.col("v"))
    if not order:
        return x.select("fold", "seq", "pos", "token", p0.alias("p"), (F.col("bu") == F.col("token")).alias("hit"))
    last = F.element_at(F.split("h", SEP), -1)
    cw = counts.levels[order].where(last != BOS)
    ch = cw.groupBy("fold", "h").agg(F.sum("c").alias("ch"), best("c").alias("bh"))
    x = x.join(cw.hint("merge"), ["fold", "h", "token"], "left").join(ch.hint("merge"), ["fold", "h"], "left")
    p = F.when(F.col("ch").isNull(), p0).otherwise((F.coalesce("c", F.lit(0)) + alpha) / (F.col("ch") + alpha * F.col("v")))
    return x.select("fold", "seq", "pos", "token", p.alias("p"), (F.coalesce("bh", "bu") == F.col("token")).alias("hit"))
