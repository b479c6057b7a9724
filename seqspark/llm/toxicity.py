"""Toxicity by non-negative positive-unlabelled learning with numpy classifiers.

Confirmed toxic documents are the positives, all documents of the training fold are the unlabelled set. With the class prior p the risk of a
scorer g is ``p E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p E_pos[loss(-g)])``: the unlabelled set stands for both classes,
and what the positives contribute to it is taken off, but never below zero; where it would be, the step goes the other way.
(Kiryo et al., Positive-Unlabeled Learning with Non-Negative Risk Estimator, 2017.)

A document is the set of its words and their first letters, hashed; whole texts are read, in tasks, and written as numbers once. The share of
documents that have a feature is counted over all positives and all unlabelled documents, and only features whose shares differ beyond chance are
kept. What is left of a document is a short set, and equal ones are one row with a count, so the unlabelled side is small but still
stands for every document. These rows are dealt to shards of bounded size, each of which meets all positives and trains one linear scorer in a
task of its own; the scorers are averaged. A corpus whose sets fit one shard is trained on as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, spare, table, written

BITS, PREFIX = 18, 5
#: Bound of the labelled sample: documents with a positive label. Distinct unlabelled sets in a shard, about, and texts hashed at a time: these bound a task's memory.
POSITIVES, SHARD = 6000, 8_000
SLICE = 500
STEPS, RATE, DECAY = 200, 0.1, 1e-5
#: Standard errors by which a feature's shares among positive and unlabelled documents must differ to be used, and features used at most: those that differ most.
APART, FEATURES = 4.0, 1 << 14
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    """Word to its hashed features; emptied by the user when it grows too large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        m = (1 << BITS) - 1
        out = self[word] = (zlib.crc32(word.encode()) & m, zlib.crc32(b"^" + word[:PREFIX].encode()) & m)
        return out


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """The sorted distinct hashed features of a whole text; none for a null or wordless one."""
    words = set(_WORD.findall((text or "").lower()))
    if len(hashes) > 150_000:
        hashes.clear()
    flat = [h for w in words for h in hashes[w]]
    return np.unique(np.array(flat, np.int32))


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for i in range(0, b.num_rows, SLICE))


def _sums(weights: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of the weights of each document's features; ``at`` holds its bounds in ``flat``."""
    total = np.concatenate(([0.0], np.cumsum(weights[flat])))
    return total[at[1:]] - total[at[:-1]]


def risk(weights: np.ndarray, flat: np.ndarray, at: np.ndarray, pos: np.ndarray, unl: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """``(first term, second term before its bound, gradient)`` of the non-negative risk with logistic loss, at weights of which the last is the bias.

    Sets of features are ``flat`` cut at ``at``; ``pos`` and ``unl`` are their shares among the positives and the unlabelled documents. Where the second term is
    negative, the gradient is that of minus this term.
    """
    g = _sums(weights[:-1], flat, at) + weights[-1]
    s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    as_negative, as_positive = np.logaddexp(0, g), np.logaddexp(0, -g)
    first, rest = prior * (pos @ as_positive), unl @ as_negative - prior * (pos @ as_negative)
    each_rest = (unl - prior * pos) * s
    each = prior * pos * (s - 1) + each_rest if rest >= 0 else -each_rest
    who = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return first, rest, np.append(np.bincount(flat, weights=each[who], minlength=len(weights) - 1), each.sum())


def train(sets: list[np.ndarray], pos: np.ndarray, unl: np.ndarray, prior: float, size: int, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights of a linear scorer over ``size`` features, the bias last, by full-batch Adam. ``pos`` and ``unl`` count the documents of each set."""
    flat = np.concatenate(sets).astype(np.int64) if len(sets) else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum([len(d) for d in sets]))).astype(np.int64)
    pos, unl = pos / max(pos.sum(), 1), unl / max(unl.sum(), 1)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = -1.0
    for t in range(1, steps + 1):
        grad = risk(w, flat, at, pos, unl, prior)[2]
        grad[:-1] += decay * w[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def in_training(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "utf-8")), F.lit(3)) != 1, F.lit(True))


def feature_sets(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, positives: int) -> DataFrame:
    """``(pos, unl, f)``, written: each document of the training fold with its hashed features; ``pos`` marks the confirmed ones taken, ``unl`` all of the fold."""
    bounded = labels.where("y = 1").select("id").orderBy(F.xxhash64("id", F.lit(7)), "id").limit(positives)  # the smallest by hash: the same choice every time
    chosen = written(bounded.withColumn("pos", F.lit(True)), "op3-positives")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(in_training(F.col("id")))
    rows = rows.join(F.broadcast(chosen), "id", "left").select(F.coalesce("pos", F.lit(False)).alias("pos"), "text")  # at most ``positives`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()
        for b in (part for whole in batches for part in _slices(whole)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py(), cache) for t in b.column(1)], pa.list_(pa.int32()))], ["pos", "f"])

    return written(rows.mapInArrow(run, "pos boolean, f array<int>"), "op3-features")


def shares(sets: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """The numbers of positive and of all documents, and of those with each feature: counted in the tasks, then added up by feature."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size + 1), np.int64)
        for b in batches:
            if b.num_rows:
                mark = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
                f = b.column(1)
                flat, who = f.flatten().to_numpy(), np.repeat(mark, f.value_lengths().to_numpy())
                n[0, :size] += np.bincount(flat[who], minlength=size)
                n[1, :size] += np.bincount(flat, minlength=size)
                n[0, size] += mark.sum()
                n[1, size] += len(mark)
        at = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], ["f", "p", "u"])

    n = np.zeros((2, size + 1), np.int64)
    for r in sets.mapInArrow(run, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p > 0 or u >= 3").collect():  # a row a feature
        n[:, r.f] = r.p, r.u
    return int(n[0, size]), int(n[1, size]), n[0, :size], n[1, :size]


def telling(n_pos: int, n_unl: int, in_pos: np.ndarray, in_unl: np.ndarray, apart: float = APART, most: int = FEATURES) -> np.ndarray:
    """The features whose shares differ by ``apart`` standard errors, in ascending order; the others only fit noise."""
    both = (in_pos + in_unl) / max(n_pos + n_unl, 1)
    z = (in_pos / max(n_pos, 1) - in_unl / max(n_unl, 1)) / np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / max(n_pos, 1) + 1 / max(n_unl, 1)))
    z[in_pos + in_unl < 3] = 0
    best = np.argsort(-np.abs(z), kind="stable")[:most]
    return np.sort(best[np.abs(z[best]) >= apart])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, shard: int = SHARD) -> np.ndarray:
    """Weights of all hashed features, the bias last. ``labels`` (id_col, label_col) holds training rows only; the prior is the share of label 1 among them.

    At most ``positives`` confirmed documents, chosen by hash, are used as such; every document of the training fold is unlabelled, repeated rows as often as they
    are there, null ids and texts too. An id's label is its largest one. Without any positive document the scorer is constant.
    """
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    n, ones = lab.agg(F.count("*"), F.sum("y")).first()
    none = np.append(np.zeros(1 << BITS), -5.0)
    if not ones:
        return none
    prior = min(max(ones / n, 1e-3), 0.9)
    sets = feature_sets(docs, lab, id_col, text_col, positives)
    n_pos, n_unl, in_pos, in_unl = shares(sets)
    if not n_pos:
        return none
    used = telling(n_pos, n_unl, in_pos, in_unl)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(1)
            to = place[f.flatten().to_numpy()]
            ends = np.concatenate(([0], np.cumsum(to >= 0)))[np.concatenate(([0], np.cumsum(f.value_lengths().to_numpy())))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(to[to >= 0]))], ["pos", "f"])

    equal = sets.mapInArrow(reduced, "pos boolean, f array<int>").groupBy("f").agg(F.count("*").alias("u"), F.count_if("pos").alias("p"))
    rows = written(equal, "op3-sets")
    discard(sets)
    confirmed = np.array([(tuple(r.f), r.p) for r in rows.where("p > 0").collect()], dtype=object)  # at most ``positives`` rows
    known = rows.sparkSession.sparkContext.broadcast(([np.array(f, np.int32) for f, _ in confirmed], np.array([p for _, p in confirmed], float)))
    shards, size = max(1, -(-rows.count() // shard)), len(used)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable")  # the same order, whenever it is run
        sets, p = known.value
        unl = pdf["u"].to_numpy(float)
        w = train([*sets, *pdf["f"]], np.append(p, np.zeros(len(unl))), np.append(np.zeros(len(p)), unl), prior, size)
        return pd.DataFrame({"w": [w.astype("<f8").tobytes()]})

    dealt = rows.select("f", "u", F.xxhash64("f").alias("h")).withColumn("shard", F.pmod("h", F.lit(shards)))
    each = dealt.groupBy("shard").applyInPandas(learn, "w binary")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, m = np.zeros(size + 1), 0
        for b in batches:
            for x in b.column(0):
                total, m = total + np.frombuffer(x.as_py(), "<f8"), m + 1
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([m])], ["w", "n"])

    parts = each.mapInArrow(summed, "w binary, n long").collect()  # a scorer a task, of ``FEATURES`` weights at most
    mean = np.sum([np.frombuffer(r.w, "<f8") for r in parts], axis=0) / sum(r.n for r in parts)
    out = np.zeros((1 << BITS) + 1)
    out[used], out[-1] = mean[:-1], mean[-1]
    return out


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``. A null text scores as an empty one; rows and columns stay, but those two names are replaced."""
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cache = shared.value, _Hashes()
        for b in batches:
            g = np.array([w[features(t.as_py(), cache)].sum() + w[-1] for t in b.column(kept.index(text_col))])
            s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(s >= threshold, pa.bool_()).cast(pa.int32())], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*kept).mapInArrow(run, f"{schema}, score double, predicted int")


def reject_toxic(docs: DataFrame, all_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, by a scorer trained on ``all_docs`` and the training fold of ``labels``.

    Columns stay, those named ``score`` or ``predicted`` too. Null and empty texts score alike; repeated rows stay or go together; an empty table stays empty.
    """
    w = fit(all_docs, labels.where(in_training(F.col("doc_id"))))
    theirs = {c: spare(f"own_{c}", docs) for c in docs.columns if c.lower() in ("score", "predicted")}
    scored = score(docs.withColumnsRenamed(theirs), w).where("predicted = 0").drop("score", "predicted")
    return scored.withColumnsRenamed({new: c for c, new in theirs.items()}).select(*docs.columns)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    w = fit(docs, table(spark, sf_dir, "labels").where(in_training(F.col("doc_id"))))
    return score(docs, w).select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")
