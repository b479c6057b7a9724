"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that makes them unit vectors; a query is scaled to norm one with a zero
there. Then the largest inner product is the smallest distance, and Gaussian (2-stable) projections cut into slots of some
width hash near vectors alike. A table's bucket is a tuple of slots. A query visits, besides its own bucket, those whose slots
differ by one, in the order of the squared distances to the slot borders that they cross (Lv et al., Multi-Probe LSH, 2007).

``fit`` chooses width and number of probes on a bounded sample so that the wanted share of the sample's neighbours is met;
every vector is indexed. The buckets that share a table and their first slots form a cell: the buckets a query visits lie in a few cells, so
its vector is sent once a cell, with the list of its buckets there. Vectors and probes are dealt by (cell, parts) and sorted; a task holds
one part of a cell at a time, compares a query with the vectors of the buckets that it visits, and merges what its parts found before it is
shuffled. A cell with more than ``BLOCK`` components or probes is split, and each part of the one meets each part of the other. What a query has
in the sample sets the score that answers must reach.

Products are found by blocks; those near the k-th best are then added up component by component, so that equal vectors have equal scores.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, sized, table, written

TABLES, HASHES, WIDTHS = 2, 4, (0.8, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0)
#: Vectors at most in the sample that the index is fitted on, one in so many of the table's, queries of it tried, and the share of their neighbours to be met.
SAMPLE, SHARE, TRIED, TARGET = 4096, 10, 512, 0.97
#: Components at most in a part of a cell, and answers that a task holds before it passes them on.
BLOCK, HELD = 1 << 20, 400_000
_DELTAS = np.array(list(itertools.product((0, -1, 1), repeat=HASHES)))
_CROSS = np.concatenate([_DELTAS == -1, _DELTAS == 1], axis=1).T.astype(float)


@dataclass
class Index:
    norm: float
    planes: np.ndarray  # tables x (dimension + 1) x hashes
    shifts: np.ndarray  # tables x hashes, in slots
    width: float
    probes: int
    ids: np.ndarray | None = None  # the sample
    vectors: np.ndarray | None = None

    def slots(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and places in the slots from 0 to 1."""
        f = x @ self.planes[t] / self.width + self.shifts[t]
        h = np.floor(f)
        return h.astype(np.int64), f - h

    def items(self, v: np.ndarray) -> np.ndarray:
        s = v / self.norm
        return np.column_stack((s, np.sqrt(np.maximum(0.0, 1 - (s * s).sum(axis=1)))))

    @staticmethod
    def queries(v: np.ndarray) -> np.ndarray:
        return np.column_stack((v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros(len(v))))


def _bucket(slots: np.ndarray) -> np.ndarray:
    out = np.zeros(slots.shape[:-1], np.uint64)
    for i in range(slots.shape[-1]):
        out = (out ^ slots[..., i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _costs(place: np.ndarray) -> np.ndarray:
    """The score of every perturbation: the sum of squared distances to the borders crossed."""
    return np.concatenate([place**2, (1 - place) ** 2], axis=1) @ _CROSS


def fit(sample: np.ndarray, norm: float, count: int, k: int, seed: int = 0, target: float = TARGET) -> Index:
    """The cheapest width, with the number of probes, that meets ``target`` of the sample's nearest pairs.

    Among ``n`` of ``count`` vectors the ``k * n / count`` nearest ones are as near as the ``k`` nearest of all.
    """
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    planes, shifts = rng.standard_normal((TABLES, d + 1, HASHES)), rng.uniform(0, 1, (TABLES, HASHES))
    n = len(sample)
    tried = rng.permutation(n)[:TRIED]
    s = sample[tried] @ sample.T
    s[np.arange(len(tried)), tried] = -np.inf
    near = max(1, min(n - 1, -(-k * n // max(count, 1))))
    pairs_near = (np.repeat(np.arange(len(tried)), near), np.argsort(-s, axis=1)[:, :near].ravel())
    pairs_any = (np.repeat(np.arange(len(tried)), 8), rng.integers(0, n, 8 * len(tried)))
    best = None
    for width in WIDTHS:
        index = Index(norm, planes, shifts, width, 1)
        x, q = index.items(sample), index.queries(sample[tried])
        ranks = {}
        for name, (a, b) in (("near", pairs_near), ("any", pairs_any)):
            r = np.full((TABLES, len(a)), len(_DELTAS))
            for t in range(TABLES):
                hx, _ = index.slots(x, t)
                hq, place = index.slots(q, t)
                cost = _costs(place)
                delta = hx[b] - hq[a]
                ok = np.abs(delta).max(axis=1) <= 1
                own = (np.where(delta < 0, place[a] ** 2, 0) + np.where(delta > 0, (1 - place[a]) ** 2, 0)).sum(axis=1)
                r[t, ok] = (cost[a[ok]] < own[ok, None] - 1e-12).sum(axis=1)
            ranks[name] = r
        need = np.sort(ranks["near"].min(axis=0))
        probes = int(min(len(_DELTAS), need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)] + 1))
        met = (need < probes).mean()
        scanned = (ranks["any"] < probes).mean(axis=1).sum() + 1e-4 * probes
        key = (met < target, scanned if met >= target else -met)
        if best is None or key < best[0]:
            best = (key, Index(norm, planes, shifts, width, probes))
    return best[1]


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)``: rows with an id and a vector of finite components, not all zero, and of the most frequent length among these (ties: the shorter)."""
    kept = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kept).alias("v"))
    v = v.where("id is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))).where(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.where(F.size("v") == (sizes[0]["n"] if sizes else -1))


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``, component by component: the same for equal vectors, wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def best_of(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's ``k`` best answers, each id once with its best score, ties to the smaller id."""
    order = np.lexsort((-scores, ids, who))
    first = np.ones(len(order), bool)
    first[1:] = (who[order][1:] != who[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    order = order[first]
    order = order[np.lexsort((ids[order], -scores[order], who[order]))]
    w = who[order]
    starts = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
    rank = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
    return order[rank < k]


def top(q: np.ndarray, own: np.ndarray, floor: np.ndarray, mat: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, id, score)`` of the ``k`` best rows of ``mat`` for each row of ``q``, at its ``floor`` or above, rows of its own id left out."""
    out = []
    twice = len(np.unique(names)) < len(names)
    if twice:
        order = np.argsort(names, kind="stable")
        mat, names = mat[order], names[order]
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    length = np.sqrt((mat * mat).sum(axis=1).max()) * np.sqrt((q * q).sum(axis=1)) * 1e-12  # more than rounding can differ
    step = max(1, 4_000_000 // len(mat))
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        s = q[part] @ mat.T
        s[own[part, None] == names[None, :]] = -np.inf
        each = np.maximum.reduceat(s, starts, axis=1) if twice else s
        least = floor[part]
        if each.shape[1] > k:
            least = np.maximum(least, np.partition(each, each.shape[1] - k, axis=1)[:, -k])
        r, c = np.nonzero((s >= (least - length[part])[:, None]) & (s > -np.inf))
        for j in range(0, len(r), 1_000_000):  # in pieces, should many rows tie
            rr, cc = r[j : j + 1_000_000], c[j : j + 1_000_000]
            score = exact(q[part][rr], mat[cc])
            keep = best_of(rr, names[cc], score, k)
            out.append((own[part][rr[keep]], names[cc[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _rows(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0, report: dict | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query`` (a condition on ``id``) holds, the ``k`` rows of other ids with the largest inner products among those met.

    A query that meets fewer than ``k`` rows in its buckets visits every perturbed bucket of every table; one that is short even then is compared with all rows, in blocks. ``report``
    gets the numbers of queries, ``asked``, and of both kinds, ``widened`` and ``compared``.
    Null, zero, ragged and non-finite vectors and null ids take no part. Rows that repeat an id answer together, each pair of
    ids once with its best score; equal scores go to the smaller id, and equal vectors have equal scores. Fewer than ``k`` others give fewer rows, an empty
    table none. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vec_col)
    kind = rows.schema["v"].dataType.simpleString()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    count, ids, norm, size = rows.agg(F.count("*"), F.count_distinct("id"), F.max(F.sqrt(square)), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not count:
        return spark.createDataFrame([], schema)
    got = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max(2, min(SAMPLE, count // SHARE))).collect()
    index = fit(np.array([r.v for r in got]), norm, count, k, seed)
    index.ids, index.vectors = np.array([r.id for r in got]), np.array([r.v for r in got])
    shared = spark.sparkContext.broadcast(index)  # SAMPLE vectors
    block, asked = max(256, BLOCK // size), max(256, BLOCK // size)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector under its cell and bucket of every table."""
        ix = shared.value
        for b in batches:
            if b.num_rows:
                x = ix.items(_rows(b.column(1), b.num_rows))
                for t in range(TABLES):
                    h = ix.slots(x, t)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(_bucket(h[:, :2])), pa.array(_bucket(h)), b.column(0), b.column(1)], ["t", "cell", "bucket", "id", "v"])

    def probing(batches: Iterator[pa.RecordBatch], probes: int | None = None) -> Iterator[pa.RecordBatch]:
        """Each query once a cell that it visits, with the buckets it visits there, the likeliest first, and its k-th best score in the sample. ``probes``: more than the index's, without that score."""
        ix = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                v = _rows(part.column(1), part.num_rows)
                own, q = part.column(0).to_numpy(), ix.queries(v)
                floor = np.full(len(v), -np.inf)
                s = v @ ix.vectors.T
                s[own[:, None] == ix.ids[None, :]] = -np.inf
                if probes is None and len(np.unique(ix.ids)) == s.shape[1] > k:  # k other ids are that near
                    floor = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
                    floor = np.where(np.isfinite(floor), floor - np.abs(floor) * 1e-9, -np.inf)
                for t in range(TABLES):
                    h, place = ix.slots(q, t)
                    order = np.argsort(_costs(place), axis=1, kind="stable")[:, : probes or ix.probes]
                    seen = h[:, None, :] + _DELTAS[order]
                    cell, bucket = _bucket(seen[..., :2]), _bucket(seen)
                    by = np.argsort(cell, axis=1, kind="stable")
                    cell, bucket = np.take_along_axis(cell, by, axis=1), np.take_along_axis(bucket, by, axis=1)
                    new = np.ones(cell.shape, bool)
                    new[:, 1:] = cell[:, 1:] != cell[:, :-1]
                    who, starts = np.nonzero(new)[0], np.flatnonzero(new.ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, cell.size).astype(np.int32)), pa.array(bucket.ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(who), t, np.int32)), pa.array(cell.ravel()[starts]), lists, part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(floor[who])],
                        ["t", "cell", "buckets", "id", "v", "floor"],
                    )

    one = F.lit(1).cast("long")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.coalesce(n, one))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, one) - 1))

    def sides(have: DataFrame, ask: DataFrame) -> DataFrame:
        """Vectors and probes in one table, each under the parts of its cell where it meets the others."""
        left = have.select("t", "cell", part(F.col("vparts"), 1).alias("vp"), every(F.col("qparts")).alias("qp"), F.lit(0).alias("kind"), F.array("bucket").alias("buckets"), "id", "v", F.lit(None).cast("double").alias("floor"))
        right = ask.select("t", "cell", every(F.col("vparts")).alias("vp"), part(F.col("qparts"), 2).alias("qp"), F.lit(1).alias("kind"), "buckets", "id", "v", "floor")
        return left.unionByName(right)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores of each probe against the vectors of its buckets in the cell's part; the ``k`` best of a query in this task's parts, merged ``HELD`` at a time."""
        key, held, found, n = None, [], [], 0

        def merged() -> tuple[np.ndarray, ...]:
            who, ids, scores = (np.concatenate(x) for x in zip(*found))
            keep = best_of(who, ids, scores, k)
            return who[keep], ids[keep], scores[keep]

        batch = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["query_id", "vec_id", "score"])
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            vec, own, floor = _rows(b.column(7), b.num_rows), b.column(6).to_numpy(), b.column(8).to_numpy(zero_copy_only=False)
            flat = b.column(5).flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(b.column(5).value_lengths().to_numpy())))
            cut = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
                now = tuple(cols[i, :4])
                if now != key:
                    key, held, ready = now, [], None
                if cols[i, 4] == 0:
                    held.append((flat[ends[i] : ends[j]], vec[i:j], own[i:j]))
                    continue
                if not held:
                    continue
                if ready is None:
                    where, mat, names = (np.concatenate(x) for x in zip(*held))
                    order = np.argsort(where, kind="stable")
                    where, mat, names = where[order], mat[order], names[order]
                    starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                    ready = dict(zip(where[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(where)])))
                asked_ = flat[ends[i] : ends[j]]
                who = np.repeat(np.arange(i, j), np.diff(ends[i : j + 1]))
                order = np.argsort(asked_, kind="stable")
                asked_, who = asked_[order], who[order]
                firsts = np.flatnonzero(np.concatenate(([True], asked_[1:] != asked_[:-1])))
                for a, z in zip(firsts.tolist(), [*firsts[1:].tolist(), len(who)]):
                    lo, hi = ready.get(int(asked_[a]), (0, 0))
                    if lo < hi:
                        w = who[a:z]
                        x = top(vec[w], own[w], floor[w], mat[lo:hi], names[lo:hi], k)
                        found.append(x)
                        n += len(x[0])
                        if n > HELD:
                            x = merged()
                            found, n = [x], len(x[0])
                            if n > HELD // 2:
                                yield batch(x)
                                found, n = [], 0
        if n:
            yield batch(merged())

    def best(dealt: DataFrame) -> DataFrame:
        """The ``k`` best of what each query meets."""
        keys = ["t", "cell", "vp", "qp"]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "kind")
        found = met.mapInArrow(rerank, "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best_ = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank)
        return written(best_.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "op2-found")

    def hashed(asking: DataFrame, probes: int | None = None) -> DataFrame:
        """What ``asking`` meet in the buckets that they visit."""
        ask = asking.mapInArrow(lambda batches: probing(batches, probes), f"t int, cell long, buckets array<long>, id long, v {kind}, floor double")
        crowd = have.groupBy("t", "cell").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m")).union(ask.groupBy("t", "cell").agg(F.lit(0).cast("long"), F.count("*")))
        crowd = crowd.groupBy("t", "cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where(f"n > {block} or m > {asked}")
        crowd = written(crowd.select("t", "cell", F.ceil(F.greatest("n", F.lit(1)) / block).alias("vparts"), F.ceil(F.greatest("m", F.lit(1)) / asked).alias("qparts")), "op2-crowd")
        met = best(sides(have.join(sized(crowd), ["t", "cell"], "left"), ask.join(sized(crowd), ["t", "cell"], "left")))
        discard(crowd)
        return met

    def short_of(asking: DataFrame, met: DataFrame) -> tuple[DataFrame, int]:
        full = met.where(F.col("rank") == min(k, ids - 1)).select(F.col("query_id").alias("id"))
        short = written(asking.join(full.hint("merge"), "id", "left_anti"), "op2-short")
        return short, short.count()

    asking = rows.where(is_query)
    have = rows.mapInArrow(listed, f"t int, cell long, bucket long, id long, v {kind}")
    met = hashed(asking)
    short, n = short_of(asking, met)
    if report is not None:
        report.update(asked=asking.count(), widened=n, compared=0)
    if not n:
        return met
    without = lambda met, short: met.join(short.select(F.col("id").alias("query_id")).hint("merge"), "query_id", "left_anti")
    wide = hashed(short, len(_DELTAS))
    met = without(met, short).unionByName(wide).select("query_id", "rank", "vec_id", "score")
    short, n = short_of(short, wide)
    if report is not None:
        report["compared"] = n
    if not n:
        return met
    # queries that still met fewer than k: against all vectors, in blocks
    blocks = lambda rows, size: F.lit(-(-rows // size)).cast("long")
    zero = F.lit(0).cast("long")
    place = lambda df: df.withColumns({"t": F.lit(-1), "cell": zero, "vparts": blocks(count, block), "qparts": blocks(n, asked)})
    rest = best(sides(place(rows).withColumn("bucket", zero), place(short).withColumns({"buckets": F.array(zero), "floor": F.lit(float("-inf"))})))
    return without(met, short).unionByName(rest).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
