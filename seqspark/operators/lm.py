"""Count-based next-token models as relational jobs.

Input is ``(seq, pos, token)``, ``pos`` dense from 0, with ``own``: the fold that tests the sequence. The fold is a column: one plan fits
and scores every fold. Fitting is counting, evaluating is joining test tokens to count tables by history; a history is a string of
tokens, so suffixes are keys. Scores are bits a token, ``-mean(log2(max(p, 1e-12)))``, and the share of tokens that are the model's best guess.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ngrams as N
from .stages import written

SEP, BOS, FLOOR = "\u0001", "<BOS>", 1e-12


def with_folds(df: DataFrame, seq: str, k: int, fold: Column | None = None) -> DataFrame:
    """``df`` with ``own``: the sequence's fold, by a hash of its id or by ``fold``; a sequence is never split."""
    return df.withColumn("own", (F.pmod(F.xxhash64(seq), F.lit(k)) if fold is None else fold).cast("int"))


def tier_folds(seqs: DataFrame, seq: str, tier: str, k: int, test_tier: str = "clean", held_back: bool = True, validation: int = 10, mixed: Column | None = None) -> DataFrame:
    """``(seq, fold, part)``: 1/k of the test tier is ``test``, one in ``validation`` of its rest ``val``, the rest and all of the other tiers ``train`` (unless not ``held_back``).

    ``mixed`` is a long that deals sequences out; a hash of the id by default.
    """
    h = F.xxhash64(seq) if mixed is None else mixed
    folds = seqs.select(seq, tier, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    part = F.when(F.col(tier) != test_tier, "train").when(F.pmod(h, F.lit(k)) == F.col("fold"), "test").when(F.pmod(F.floor(h / k).cast("long"), F.lit(validation)) == 0, "val").otherwise("train")
    out = folds.select(seq, tier, "fold", part.alias("part"))
    return out if held_back else out.where((F.col(tier) == test_tier) | (F.col("part") != "train"))


def histories(df: DataFrame, n: int, pad: str | None = BOS) -> DataFrame:
    """``(own, seq, pos, token, h0..hn)``: ``hk`` are the last ``k`` tokens. With ``pad`` missing ones are filled; else ``hk`` is null."""
    w = Window.partitionBy("seq").orderBy("pos")
    back = [F.lag("token", i).over(w) for i in range(n, 0, -1)]
    back = [F.coalesce(b, F.lit(pad)) for b in back] if pad is not None else back
    x = df.select("own", "seq", "pos", "token", *[b.alias(f"__b{i}") for i, b in zip(range(n, 0, -1), back)])
    hs = [F.lit("").alias("h0")]
    for k in range(1, n + 1):
        cols = [F.col(f"__b{i}") for i in range(k, 0, -1)]
        known = F.col(f"__b{k}").isNotNull()
        hs.append(F.when(known, F.concat_ws(SEP, *cols)).alias(f"h{k}"))
    return x.select("own", "seq", "pos", "token", *hs)


def training(rows: DataFrame, folds: int) -> DataFrame:
    """Each row once for every fold that trains on it."""
    return rows.withColumn("fold", F.explode(F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("own"))))


def testing(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("own", "fold")


def summary(scored: DataFrame, by: list[str] = ("fold",)) -> DataFrame:
    """``(by.., n, bits, acc)`` from ``p`` and ``hit``."""
    return scored.groupBy(*by).agg(F.count("*").alias("n"), (-F.avg(F.log2(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR))))).alias("bits"), F.avg(F.coalesce("hit", F.lit(False)).cast("double")).alias("acc"))


def fold_summary(per_fold: DataFrame, model: str = "model") -> DataFrame:
    """``(model, bits, bits_sd, perplexity, acc, acc_sd)`` over folds, population deviations."""
    g = per_fold.groupBy(model).agg(F.avg("bits").alias("bits"), F.stddev_pop("bits").alias("bits_sd"), F.avg("acc").alias("acc"), F.stddev_pop("acc").alias("acc_sd"))
    return g.select(model, "bits", "bits_sd", F.pow(F.lit(2.0), "bits").alias("perplexity"), "acc", "acc_sd")


def _best(c: str = "c") -> Column:
    return F.min_by("token", F.struct(-F.col(c), F.col("token")))


def markov(df: DataFrame, order: int, folds: int, alpha: float = 0.5, pad: str = "<PAD>") -> DataFrame:
    """Scored test tokens at positions from 1 of an order-``order`` model with additive smoothing; an unseen history falls back to the unigram and its majority.

    Order 0 is the smoothed unigram. The vocabulary is that of the whole table and the padding token.
    """
    rows = histories(df, max(order, 1), pad).where("pos > 0")
    v = df.agg((F.count_distinct("token") + 1).alias("v"))
    tr = training(rows, folds)
    uni = tr.groupBy("fold", "token").agg(F.count("*").alias("cu"))
    un = uni.groupBy("fold").agg(F.sum("cu").alias("nu"), _best("cu").alias("bu"))  # a row a fold
    x = testing(rows).join(uni.hint("shuffle_hash"), ["fold", "token"], "left").join(F.broadcast(un), "fold").crossJoin(F.broadcast(v))  # one row
    p0 = (F.coalesce("cu", F.lit(0)) + alpha) / (F.col("nu") + alpha * F.col("v"))
    if not order:
        return x.select("fold", "seq", "pos", "token", p0.alias("p"), (F.col("bu") == F.col("token")).alias("hit"))
    h = f"h{order}"
    cw = tr.groupBy("fold", h, "token").agg(F.count("*").alias("c"))
    ch = cw.groupBy("fold", h).agg(F.sum("c").alias("ch"), _best().alias("bh"))
    x = x.join(cw.hint("merge"), ["fold", h, "token"], "left").join(ch.hint("merge"), ["fold", h], "left")
    p = F.when(F.col("ch").isNull(), p0).otherwise((F.coalesce("c", F.lit(0)) + alpha) / (F.col("ch") + alpha * F.col("v")))
    return x.select("fold", "seq", "pos", "token", p.alias("p"), (F.coalesce("bh", "bu") == F.col("token")).alias("hit"))


def markov_labels(df: DataFrame, folds: int, alpha: float = 0.5, pad: str = "<PAD>") -> DataFrame:
    """Scored test rows of the order-1 model on ``token``, summed over the tokens of the true ``label`` (a column of ``df``, a function of the token)."""
    lab = df.select("token", "label").distinct()
    size = lab.groupBy("label").agg(F.count("*").alias("m"))
    rows = histories(df, 1, pad).where("pos > 0").join(lab.hint("shuffle_hash"), "token")
    v = df.agg((F.count_distinct("token") + 1).alias("v"))
    tr = training(rows, folds)
    uni = tr.groupBy("fold", "label").agg(F.count("*").alias("cu"))
    un = uni.groupBy("fold").agg(F.sum("cu").alias("nu"), F.min_by("label", F.struct(-F.col("cu"), F.col("label"))).alias("bu"))
    cw = tr.groupBy("fold", "h1", "label").agg(F.count("*").alias("c"))
    best = F.min_by("label", F.struct(F.round(-(F.col("c") + alpha * F.col("m")), 9), F.col("label"))).alias("bh")
    ch = cw.join(size.hint("shuffle_hash"), "label").groupBy("fold", "h1").agg(F.sum("c").alias("ch"), best)
    x = testing(rows).join(size.hint("shuffle_hash"), "label").join(uni.hint("shuffle_hash"), ["fold", "label"], "left").join(F.broadcast(un), "fold").crossJoin(F.broadcast(v))  # a row a fold, one row
    x = x.join(cw.hint("merge"), ["fold", "h1", "label"], "left").join(ch.hint("merge"), ["fold", "h1"], "left")
    c, n = F.when(F.col("ch").isNull(), F.coalesce("cu", F.lit(0))).otherwise(F.coalesce("c", F.lit(0))), F.coalesce("ch", "nu")
    return x.select("fold", "seq", "pos", "label", ((c + alpha * F.col("m")) / (n + alpha * F.col("v"))).alias("p"), (F.coalesce("bh", "bu") == F.col("label")).alias("hit"))


def kneser_ney(df: DataFrame, folds: int, n: int = 5) -> DataFrame:
    """Scored test tokens, every position, of the modified Kneser-Ney model; see :mod:`ngrams` for several models over one set of counts."""
    return N.kneser_ney(N.SuffixCounts(df, folds, n - 1), n).select("fold", "seq", "pos", "token", "p", "hit")


def kneser_ney_labels(df: DataFrame, folds: int, n: int = 3) -> DataFrame:
    """Scored test rows of the model on ``token``, summed over the tokens of the true ``label`` (a column of ``df``, a function of the token)."""
    return N.kneser_ney_labels(N.SuffixCounts(df, folds, n - 1), n)


def with_cache(scored: DataFrame, df: DataFrame, folds: int, size: int = 320, share: float = 0.25) -> DataFrame:
    """``scored`` mixed with the smoothed distribution of the sequence's last ``size`` tokens. ``hit`` is not carried: the best guess depends on the position's cache."""
    w = Window.partitionBy("seq", "token").orderBy("pos").rangeBetween(-size, -1)
    c = df.select("seq", "pos", F.count("*").over(w).alias("cc"), F.least(F.col("pos"), F.lit(size)).alias("cl"))
    v = training(df, folds).groupBy("fold").agg(F.count_distinct("token").alias("v"))
    x = scored.join(c.hint("merge"), ["seq", "pos"]).join(F.broadcast(v), "fold")  # a row a fold
    return x.withColumn("p", (1 - share) * F.col("p") + share * (F.col("cc") + 0.5) / (F.col("cl") + 0.5 * F.col("v"))).drop("cc", "cl", "v").withColumn("hit", F.lit(None).cast("boolean"))


def kneser_ney_cached(df: DataFrame, folds: int, n: int = 5, size: int = 320, share: float = 0.25, counts: N.SuffixCounts | None = None) -> DataFrame:
    """As :func:`kneser_ney`, mixed with the smoothed distribution of the sequence's last ``size`` tokens, with the mixture's best token.

    Without the cache the model's own best wins, so only tokens more frequent in the window than that one can beat it: a stream over each sequence, in stretches that overlap by a
    window, returns these, and they alone are scored.
    """
    counts = counts or N.SuffixCounts(df, folds, n - 1)
    model = N.KneserNey(counts, n)
    scored = written(N.kneser_ney(counts, n, model), "cached")
    seen = written(_windows(scored, size), "cached")
    x = scored.join(seen.hint("merge"), ["seq", "pos"]).join(F.broadcast(model.v), "fold")  # a row a fold
    mix = lambda p, c: (1 - share) * p + share * (c + 0.5) / (F.col("cl") + 0.5 * F.col("v"))
    rivals = x.select("seq", "pos", "fold", "h", "cl", "v", F.explode("rivals").alias("e")).select("seq", "pos", "fold", "h", "cl", "v", "e.token", "e.n")
    p = model.score(rivals.select("fold", "h", "token").distinct()).select("fold", "h", "token", F.col("p").alias("rp"))
    order = lambda p, token: F.struct((-F.round(p, 12)).alias("q"), token.alias("token"))
    most = rivals.join(p.hint("merge"), ["fold", "h", "token"]).groupBy("seq", "pos").agg(F.min(order(mix(F.col("rp"), F.col("n")), F.col("token"))).alias("rival"))
    x = x.join(most.hint("merge"), ["seq", "pos"], "left")
    own = order(mix(F.col("bp"), F.col("cb")), F.col("best"))
    return x.select("fold", "seq", "pos", "token", mix(F.col("p"), F.col("cc")).alias("p"), (F.least(own, "rival")["token"] == F.col("token")).alias("hit"))


#: Positions of a sequence that one task's stream takes together.
STRETCH = 1 << 16


def _windows(scored: DataFrame, size: int, stretch: int = STRETCH) -> DataFrame:
    """``(seq, pos, cc, cb, cl, rivals)``: how often the token and the best one stand in the last ``size`` tokens, how many these are, and the tokens that stand there more often than the best one."""
    at = F.floor(F.col("pos") / stretch)
    next_ = F.floor((F.col("pos") + size) / stretch)
    x = scored.select("seq", "pos", "token", "best", F.explode(F.sequence(at, next_)).alias("stretch"), at.alias("home"))
    x = x.repartition("seq", "stretch").sortWithinPartitions("seq", "stretch", "pos")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = None, deque(), Counter()
        for b in batches:
            keep, out = [], []
            for i, (seq, pos, token, best, part, home) in enumerate(zip(*[c.to_pylist() for c in b.columns])):
                if (seq, part) != now:
                    now = (seq, part)
                    held.clear()
                    count.clear()
                if part == home:
                    cb = count[best]
                    keep.append(i)
                    out.append((count[token], cb, min(pos, size), [{"token": t, "n": n} for t, n in count.items() if n > cb]))
                held.append(token)
                count[token] += 1
                if len(held) > size:
                    old = held.popleft()
                    count[old] -= 1
                    if not count[old]:
                        del count[old]
            take = pa.array(keep, pa.int64())
            cols = zip(zip(*out) if out else [[]] * 4, kinds)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, k) for c, k in cols]], ["seq", "pos", "cc", "cb", "cl", "rivals"])

    t = scored.schema
    return x.mapInArrow(run, f"seq {t['seq'].dataType.simpleString()}, pos {t['pos'].dataType.simpleString()}, cc long, cb long, cl long, rivals array<struct<token: string, n: bigint>>")


def ppm_d(df: DataFrame, folds: int, order: int = 7) -> DataFrame:
    """Scored test tokens, every position, of PPM with escape method D and full exclusion."""
    return N.ppm_d(N.SuffixCounts(df, folds, order), order)


def event_bits(scored: DataFrame, event: str) -> DataFrame:
    """``(fold, n, bits)`` an event: the bits of its sub-tokens summed, then averaged over events."""
    e = scored.groupBy("fold", "seq", event).agg((-F.sum(F.log2(F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(FLOOR))))).alias("b"))
    return e.groupBy("fold").agg(F.count("*").alias("n"), F.avg("b").alias("bits"))


def softmax_gradient(w: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed negative log-likelihoods and gradients of every fold that trains on the rows: ``w`` (fold, feature, class), ``x`` the features that are 1, ``n`` the rows' counts."""
    loss, grad = np.zeros(folds), np.zeros_like(w)
    for f in range(folds):
        at = own != f
        if not at.any():
            continue
        z = w[f][x[at]].sum(axis=1)
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(axis=1, keepdims=True)
        rows = np.arange(at.sum())
        loss[f] = -(n[at] * np.log(np.maximum(p[rows, y[at]], 1e-300))).sum()
        p[rows, y[at]] -= 1
        p *= n[at][:, None]
        for j in range(x.shape[1]):
            np.add.at(grad[f], x[at][:, j], p)
    return loss, grad


def _descend(evaluate, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving."""
    value, g = evaluate(w)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s_, y in reversed(held):
            a = (s_ * q).sum() / (y * s_).sum()
            alphas.append(a)
            q -= a * y
        if held:
            s_, y = held[-1]
            q *= (s_ * y).sum() / (y * y).sum()
        for (s_, y), a in zip(held, reversed(alphas)):
            q += s_ * (a - (y * q).sum() / (y * s_).sum())
        step, slope = 1.0, -(g * q).sum()
        if slope > -1e-12:
            break
        while True:
            new = w - step * q
            v, h = evaluate(new)
            if v <= value + 1e-4 * step * slope or step < 1e-4:
                break
            step /= 2
        if ((new - w) * (h - g)).sum() > 1e-12:
            held = [*held[1 - memory :], (new - w, h - g)]
        w, value, g = new, v, h
    return w


def learned_baseline(df: DataFrame, folds: int, k: int = 4, max_iter: int = 20, penalty: float = 1e-4) -> DataFrame:
    """``(fold, n, bits, acc)`` of a multinomial logistic regression on the one-hot last ``k`` tokens, for every fold fitted on the sequences of the others.

    All folds are one problem: tasks add up the gradients of every fold over their distinct contexts, a task a fold adds up the tasks', and the driver takes the steps. It holds the model, ``folds`` times
    ``k`` times the vocabulary's square.
    """
    w_ = Window.partitionBy("seq").orderBy("pos")
    names = [f"c{i}" for i in range(1, k + 1)]
    x = df.select("own", "seq", "pos", "token", *[F.coalesce(F.lag("token", i).over(w_), F.lit("<PAD>")).alias(c) for i, c in enumerate(names, 1)]).where("pos > 0")
    rows = written(x.groupBy("own", *names, "token").agg(F.count("*").alias("n")), "contexts")
    vocab = ["<PAD>", *sorted(r.token for r in df.select("token").distinct().collect())]  # the model's classes
    at, size = {t: i for i, t in enumerate(vocab)}, len(vocab)
    spark = df.sparkSession

    def arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        cols = [np.array([at[t] for t in b.column(i).to_pylist()], np.int64) + (i - 1) * size for i in range(1, k + 1)]
        features = np.column_stack([*cols, np.full(b.num_rows, k * size)])
        return b.column(0).to_numpy(), features, np.array([at[t] for t in b.column(k + 1).to_pylist()], np.int64), b.column(k + 2).to_numpy().astype(float)

    total = {r.fold: r.n for r in training(rows, folds).groupBy("fold").agg(F.sum("n").alias("n")).collect()}
    count = np.array([max(1, total.get(f, 0)) for f in range(folds)], float)

    def batch(held: dict) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(f, v, g.tobytes()) for f, (v, g) in held.items()]) if held else [[]] * 3, kinds)], ["fold", "loss", "grad"])

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad = np.zeros(folds), np.zeros_like(shared.value)
            for b in batches:
                if b.num_rows:
                    v, g = softmax_gradient(shared.value, *arrays(b), folds)
                    loss, grad = loss + v, grad + g
            yield batch({f: (loss[f], grad[f]) for f in range(folds)})

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for b in batches:
                for f, v, g in zip(*[c.to_pylist() for c in b.columns]):
                    old = held.get(f, (0.0, 0.0))
                    held[f] = (old[0] + v, old[1] + np.frombuffer(g))
            yield batch(held)

        schema = "fold int, loss double, grad binary"
        value, out = 0.0, np.zeros_like(w)
        for r in rows.mapInArrow(tasks, schema).repartition(folds, "fold").mapInArrow(added, schema).collect():
            value += r.loss / count[r.fold]
            out[r.fold] = np.frombuffer(r.grad).reshape(w.shape[1:]) / count[r.fold]
        shared.unpersist()
        free = w.copy()
        free[:, -1] = 0  # the bias isn't penalised
        return value + penalty / 2 * (free**2).sum(), out + penalty * free

    model = spark.sparkContext.broadcast(_descend(evaluate, np.zeros((folds, k * size + 1, size)), max_iter))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, features, y, n = arrays(b)
            z = model.value[own[:, None], features].sum(axis=1)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            mine = p[np.arange(len(y)), y]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(mine), pa.array(p.argmax(axis=1) == y)], ["fold", "n", "p", "hit"])

    s = rows.mapInArrow(tested, "fold int, n long, p double, hit boolean")
    bits = -F.sum(F.col("n") * F.log2(F.greatest("p", F.lit(FLOOR)))) / F.sum("n")
    return s.groupBy("fold").agg(F.sum("n").alias("n"), bits.alias("bits"), (F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("acc"))
