"""Digram merges over token sequences, by an index of digram counts.

A row holds a part of at most ``CUT`` tokens as small integers with its own list of names: of a longer sequence a part, of shorter ones as many as go in, with a ``GAP`` between two, as arrays of numpy are worth while
only when long. What the merges do is told by a table of digram counts that is never counted anew: a part that a merge touches returns the differences, other parts nothing. Rounds whose
digrams share no token, and that nothing between could have come before, are merged in one pass. The integers are kept as bytes, as a pass would take an array apart and make it anew several times on its way to Python and back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stages import discard, together, written

#: Tokens of a part; digrams looked at for further winners of a pass; passes after which the count differences are added up.
CUT, AHEAD, COMPACT = 1 << 16, 64, 8
#: What stands between two sequences of a row; the largest square of names that is counted without sorting.
GAP, DENSE = -1, 1 << 20
FIELDS = "weight array<bigint>, tokens binary, names array<string>, first string, last string, lead int, trail int, size int, total long, a array<string>, b array<string>, c array<bigint>"


def merged(t: np.ndarray, a: int, b: int, x: int, before: int = 0, after: bool = False) -> np.ndarray:
    """``t`` with each digram ``a b`` replaced by ``x``, left to right without overlap.

    ``before``: for ``a != b`` whether a part before ends with ``a``, else how many ``a`` stand right before ``t``. ``after``: whether ``b`` follows ``t``.
    """
    n = len(t)
    if not n:
        return t
    is_a, is_b = t == a, t == b
    follows = np.append(is_b[1:], after)
    if a != b:
        head, tail = is_a & follows, np.append(bool(before), is_a[:-1]) & is_b
    else:
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(is_a & ~np.append(False, is_a[:-1]), at, 0))
        odd = (at - start + np.where(start == 0, before, 0)) % 2 == 1 if is_a[0] else (at - start) % 2 == 1
        head, tail = is_a & ~odd & follows, is_a & odd
    out = np.where(head, x, t)
    return out[~tail]


def _each(t: np.ndarray, weight: np.ndarray) -> np.ndarray | int:
    """The weight of each token, or of all where they are equal."""
    return int(weight[0]) if (weight == weight[0]).all() else weight[np.cumsum(t == GAP)]


def _narrow(k: int) -> type:
    """The integers that hold ``GAP`` and ``k`` names."""
    return np.int8 if k <= 1 << 7 else np.int16 if k <= 1 << 15 else np.int32


def _pairs(t: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The digrams inside sequences, as ``first * k + second``, and how often they occur."""
    w, wide, u = _each(t, weight), k + 1, t.astype(np.int64) + 1  # GAP is 0 here
    key = u[:-1] * wide + u[1:]
    if wide * wide <= DENSE:  # sums of integers below 2 ** 53 are exact
        n = np.bincount(key, None if np.isscalar(w) else w[:-1], wide * wide)
        n = n * w if np.isscalar(w) else np.rint(n).astype(np.int64)
        n = n.reshape(wide, wide)[1:, 1:].ravel()
        at = np.flatnonzero(n)
        return at, n[at]
    at, to = np.unique(key, return_inverse=True)
    n = np.bincount(to, None if np.isscalar(w) else w[:-1], len(at))
    n = n * w if np.isscalar(w) else np.rint(n).astype(np.int64)
    inside = (at >= wide) & (at % wide > 0)
    return (at[inside] // wide - 1) * k + at[inside] % wide - 1, n[inside]


def _change(new: tuple, old: tuple, names: list[str]) -> tuple[list, list, np.ndarray]:
    """Digrams by name and how far their counts differ, where they do."""
    k = len(names)
    at, to = np.unique(np.concatenate((new[0], old[0])), return_inverse=True)
    n = np.zeros(len(at), np.int64)
    np.add.at(n, to, np.concatenate((new[1], -old[1])))
    at, n = at[n != 0], n[n != 0]
    return [names[i] for i in (at // k).tolist()], [names[i] for i in (at % k).tolist()], n


NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _row(weight: np.ndarray, t: np.ndarray, names: list[str], change: tuple) -> tuple:
    """A part's fields: its tokens, its ends with the lengths of their runs, its tokens with and without weights, and the changes to the counts. Ends count only where it holds one sequence."""
    n, ends = len(t), (None, None, 0, 0)
    if n and len(weight) == 1:
        lead, trail = np.flatnonzero(t != t[0]), np.flatnonzero(t[::-1] != t[-1])
        ends = (names[t[0]], names[t[-1]], int(lead[0]) if len(lead) else n, int(trail[0]) if len(trail) else n)
    w, real = _each(t, weight), t != GAP
    size = int(real.sum())
    return weight, t.astype(_narrow(len(names))).tobytes(), names, *ends, size, size * w if np.isscalar(w) else int(w[real].sum()), *change


def _used(t: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[str]]:
    """``t`` with only those names that it has."""
    has = np.bincount(t.astype(np.int64) + 1, minlength=len(names) + 1)[1:] > 0
    return t if has.all() else np.append(np.cumsum(has) - 1, GAP)[t], [names[i] for i in np.flatnonzero(has).tolist()]


def _batch(keys: list[pa.Array], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    kinds = (longs, pa.binary(), texts, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), texts, texts, longs)
    return pa.RecordBatch.from_arrays([*keys, *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], ["seq", "one", "part", *names])


NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def _lists(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list of a column begins, and its last one ends, in their values."""
    return np.concatenate(([0], np.cumsum(np.asarray(col.value_lengths())))).astype(np.int64), col.flatten()


def _tokens(field: pa.Scalar, k: int) -> np.ndarray:
    """A row's tokens, which have ``k`` names."""
    return np.frombuffer(field.as_buffer(), _narrow(k))


def _first(parts: DataFrame, cut: int) -> DataFrame:
    """The parts (seq, part, weight, words) as integers, short sequences several a row, with all their digrams as changes: ``seq`` lists the sequences, ``one`` is the sequence of a row that may be one of several parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            starts, words = _lists(b.column(3))
            words = words.dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
            seq, part, weight, n = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), np.diff(starts)
            lone = (part > 0) | (n >= cut)
            some = np.flatnonzero(~lone)
            full = np.cumsum(n[some] + 1) // max(1, cut)
            groups = [np.array([i]) for i in np.flatnonzero(lone)] + [g for g in np.split(some, np.flatnonzero(np.diff(full)) + 1) if len(g)]
            rows = []
            for g in groups:
                to = np.cumsum(n[g] + 1)
                t = np.full(to[-1] - 1, GAP, np.int64)
                at = np.arange(n[g].sum()) + np.repeat(np.arange(len(g)), n[g])
                t[at] = code[np.arange(n[g].sum()) + np.repeat(starts[g] - np.concatenate(([0], np.cumsum(n[g])[:-1])), n[g])]
                t, own = _used(t, names)
                rows.append(_row(weight[g], t, own, _change(_pairs(t, weight[g], len(own)), NONE, own)))
            ends = np.concatenate(([0], np.cumsum([len(g) for g in groups]))).astype(np.int32)
            head = pa.array([g[0] for g in groups])
            one = pa.array([g[0] if lone[g[0]] else None for g in groups], pa.int64())
            yield _batch([pa.ListArray.from_arrays(pa.array(ends), seq.take(pa.array(np.concatenate(groups)))), seq.take(one), b.column(1).take(head)], rows, NAMES)

    kind = parts.schema["seq"].dataType.simpleString()
    return parts.mapInArrow(run, f"seq array<{kind}>, one {kind}, part long, {FIELDS}")


def _merge(parts: DataFrame, winners: list[tuple[str, str, str]]) -> DataFrame:
    """``parts`` (with ``before``, ``after``) after merging ``winners`` (a, b, name), which share no token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ws, weights = _lists(b.column(3))
            weights = weights.to_numpy(zero_copy_only=False)
            for r, (names, before, after) in enumerate(zip(*[b.column(i).to_pylist() for i in range(5, 8)])):
                weight, had = weights[ws[r] : ws[r + 1]], {w: i for i, w in enumerate(names)}
                t = _tokens(b.column(4)[r], len(names)).astype(_narrow(len(names) + len(winners)))
                new = t
                for x, y, name in winners:
                    i, j = had.get(x, -2), had.get(y, -2)
                    edge = bool(before) and j >= 0 or after == y and i >= 0
                    if (i >= 0 and j >= 0) or edge:
                        x_id = had.get(name, len(names))  # two ways of merging may give one name
                        got = merged(new, i, j, x_id, before or 0, after == y)
                        if len(got) < len(new) or edge and (got != new).any():
                            new, names = got, names if name in had else [*names, name]
                if new is t:
                    rows.append(_row(weight, t, names, ([], [], [])))
                    continue
                k = len(names)
                change = _change(_pairs(new, weight, k), _pairs(t, weight, k), names)
                rows.append(_row(weight, *_used(new, names), change))
            if rows:
                yield _batch([b.column(0), b.column(1), b.column(2)], rows, NAMES)

    x = parts.select("seq", "one", "part", "weight", "tokens", "names", "before", "after")
    kind = parts.schema["one"].dataType.simpleString()
    return x.mapInArrow(run, f"seq array<{kind}>, one {kind}, part long, {FIELDS}")


def _apart(parts: DataFrame) -> DataFrame:
    """``(seq, part, at, token, weight)``: the parts as a row a token, ``at`` in order inside a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (ss, seqs), (ws, weights), (ns, names) = [_lists(b.column(i)) for i in (0, 2, 4)]
            weights = weights.to_numpy(zero_copy_only=False)
            for r in range(len(b)):
                t = _tokens(b.column(3)[r], ns[r + 1] - ns[r])
                at = np.flatnonzero(t != GAP)
                who = np.cumsum(t == GAP)[at]
                part = pa.array(np.full(len(at), b.column(1)[r].as_py()))
                yield pa.RecordBatch.from_arrays([seqs.take(pa.array(ss[r] + who)), part, pa.array(at), names.take(pa.array(ns[r] + t[at])), pa.array(weights[ws[r] + who])], ["seq", "part", "at", "token", "weight"])

    x = parts.select("seq", "part", "weight", "tokens", "names")
    return x.mapInArrow(run, f"seq {parts.schema['one'].dataType.simpleString()}, part long, at long, token string, weight long")


def _edges(parts: DataFrame) -> DataFrame:
    """The ends of the parts that aren't empty, of sequences with several, and what follows each: a row a part."""
    w = Window.partitionBy("one").orderBy("part")
    return parts.where("one is not null and size > 0").select("one", "part", F.get("weight", F.lit(0)).alias("weight"), "first", "last", "lead", "trail", "size").withColumn("after", F.lead("first").over(w))


def _with_edges(parts: DataFrame, edges: DataFrame | None, a: str, b: str) -> DataFrame:
    """``parts`` with ``before`` and ``after`` for the digram ``a b``; see :func:`merged`."""
    if edges is None:
        return parts.withColumns({"before": F.lit(0), "after": F.lit(None).cast("string")})
    w = Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    if a != b:
        before = F.coalesce((F.last("last").over(w) == a).cast("int"), F.lit(0))
    else:
        whole = (F.col("first") == a) & (F.col("lead") == F.col("size"))
        broken = F.last(F.when(~whole, F.struct("upto", F.when(F.col("last") == a, F.col("trail")).otherwise(0).alias("trail"))), ignorenulls=True).over(w)
        edges = edges.withColumn("upto", F.sum("size").over(Window.partitionBy("one").orderBy("part")))
        before = F.coalesce(F.max("upto").over(w), F.lit(0)) - F.coalesce(broken["upto"] - broken["trail"], F.lit(0))
    e = edges.select("one", "part", before.cast("int").alias("before"), "after")
    return parts.join(e.hint("merge"), ["one", "part"], "left")


def _winners(top: list, joiner: str, made: set[str], many: bool, rounds: int) -> list:
    """The digrams that the next rounds take, in order: the first of ``top``, and those behind it that share no token with it or each other and that no digram of a taken token, nor what merging makes of it, comes before.

    Merging only lessens the counts of digrams with a merged token, and a new digram has no more than the one that it came from. So a digram whose count is above that of every other
    digram with a taken token keeps its place; the list is cut where that isn't known.
    """
    took = [top[0]]
    if not many or top[0]["a"] == top[0]["b"] or f"{top[0]['a']}{joiner}{top[0]['b']}" in made:
        return took
    used, floor = {top[0]["a"], top[0]["b"]}, top[-1]["score"] if len(top) > AHEAD else 0
    for r in top[1:]:
        if r["a"] in used or r["b"] in used or r["a"] == r["b"] or f"{r['a']}{joiner}{r['b']}" in made:
            floor = max(floor, r["score"])
            break
        took.append(r)
        used |= {r["a"], r["b"]}
    return [r for i, r in enumerate(took) if i == 0 or r["score"] > floor][:rounds]


def _counts(deltas: list[DataFrame]) -> DataFrame:
    """``(a, b, c)``: the written changes summed, which are read as one table."""
    x = together("a array<string>, b array<string>, c array<bigint>", *deltas)
    return x.select(F.explode(F.arrays_zip("a", "b", "c")).alias("e")).groupBy("e.a", "e.b").agg(F.sum("e.c").alias("c"))


def merge_rounds(df: DataFrame, rounds: int, least: int = 2, by_pmi: bool = False, joiner: str = "+", weight: str | None = None, cut: int = CUT) -> tuple[DataFrame, list[dict]]:
    """Repeatedly replace the most frequent (or most frequent times PMI) digram of ``(seq, pos, token)``, inside sequences, left to right without overlap; ties to the smaller digram.

    Returns the last table and, per round, the digram, its count, the number of tokens and the ratio to the first. A pass is one job over the parts, which returns the new parts and
    the changed counts, and one that picks from the summed counts at most ``AHEAD`` rows. With PMI each round is a pass, as a merge changes every score.
    """
    order = Window.partitionBy("seq").orderBy("pos")
    rows = df.select("seq", "pos", "token", (F.col(weight) if weight else F.lit(1)).cast("long").alias("weight")).withColumn("__n", F.row_number().over(order) - 1)
    part = F.floor(F.col("__n") / cut).cast("long").alias("part")
    lists = rows.groupBy("seq", part).agg(F.max("weight").alias("weight"), F.transform(F.array_sort(F.collect_list(F.struct("__n", "token"))), lambda s: s["token"]).alias("words"))
    parts = written(_first(lists, cut), "merge-parts")
    size = parts.agg(F.sum("total"), F.max("part")).first()
    first = tokens = size[0] or 0
    several = bool(size[1])
    many = not by_pmi and not several and not parts.where(F.exists("names", lambda x: x.contains(joiner))).limit(1).count()  # so that no name is both given and made
    made: set[str] = set()
    log, deltas = [], [parts]
    moved: list[tuple[str, int]] = []  # three a round
    if by_pmi:
        given = written(_apart(parts).groupBy("token").agg(F.sum("weight").alias("u")), "merge-units")
    while len(log) < rounds and tokens:
        edges = None
        if len(deltas) > COMPACT:
            sums = written(_counts(deltas).where("c <> 0").select(F.array("a").alias("a"), F.array("b").alias("b"), F.array("c").alias("c")), "merge-counts")
            discard(*[d for d in deltas if d is not parts])
            deltas = [sums]
        pair = _counts(deltas)
        if several:  # a digram may lie across parts
            edges = written(_edges(parts), "merge-edges")
            across = edges.where("after is not null").select(F.col("last").alias("a"), F.col("after").alias("b"), F.col("weight").alias("c"))
            pair = pair.unionByName(across).groupBy("a", "b").agg(F.sum("c").alias("c"))
        pair = pair.where(F.col("c") >= least)
        if by_pmi:
            units = given.unionByName(df.sparkSession.createDataFrame(moved, "token string, u long")).groupBy("token").agg(F.sum("u").alias("u")).where("u > 0")
            ua, ub = units.select(F.col("token").alias("a"), F.col("u").alias("ua")), units.select(F.col("token").alias("b"), F.col("u").alias("ub"))
            pair = pair.join(ua.hint("shuffle_hash"), "a").join(ub.hint("shuffle_hash"), "b")
            pair = pair.withColumn("score", F.round(F.col("c") * F.log2(F.col("c") * F.lit(tokens) / (F.col("ua") * F.col("ub"))), 6)).where("score > 0")
        else:
            pair = pair.withColumn("score", F.col("c").cast("double"))
        top = pair.orderBy(F.desc("score"), "a", "b").limit(AHEAD + 1 if many else 1).collect()
        if not top:
            break
        took = _winners(top, joiner, made, many, rounds - len(log))
        names = [(r["a"], r["b"], f"{r['a']}{joiner}{r['b']}") for r in took]
        made |= {n for _, _, n in names}
        parts = written(_merge(_with_edges(parts, edges, *names[0][:2]), names), "merge-parts")
        deltas.append(parts)
        if took[0]["a"] == took[0]["b"]:  # a run of n holds n - 1 of them and gives n // 2
            counts = [tokens - parts.agg(F.sum("total")).first()[0]]
        else:  # a digram of two tokens is merged wherever it stands
            counts = [r["c"] for r in took]
        for r, gone in zip(took, counts):
            tokens -= gone
            log.append({"round": len(log) + 1, "a": r["a"], "b": r["b"], "count": int(r["c"]), "tokens": int(tokens), "ratio": tokens / first})
        if by_pmi:
            moved += [(t, int(n)) for t, n in zip(names[0], (-counts[0], -counts[0], counts[0]))]
    pos = F.row_number().over(Window.partitionBy("seq").orderBy("part", "at")) - 1
    out = _apart(parts).select("seq", pos.alias("pos"), "token", *([F.col("weight").alias(weight)] if weight else []))
    return out, log
