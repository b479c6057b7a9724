"""Exact Euclidean neighbours by a search over cells of the anchors.

Equal vectors are one point: of its ids only the smallest few can be among a query's nearest. The anchors of a block (vectors of one length) lie in :mod:`cells` of bounded size. A query first
meets its own cell, and then, at once, every other cell whose box its k-th distance reaches. Inside a task, leaves with boxes narrow the rows that are compared. Distances are rounded to ``DIGITS``
places, so ties are exact and go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cells
from .stages import small, written

DIGITS, BAND, STEP, MIX, SLACK, FINE, FIRST = 9, 1 << 13, 64, 16, 1e-8, 1e-9, 1 << 11
HASH = "__h"


def _hashed(df: DataFrame, block: list[str], vec: str, *more: Column) -> DataFrame:
    """``(block.., __h, v, more..)``. Rows are sorted and joined by the hash ``__h`` before block and vector, as comparing arrays takes most of a sort; equal hashes are told apart by the vectors."""
    x = df.select(*block, F.col(vec).cast("array<double>").alias("v"), *more)
    return x.withColumn(HASH, F.xxhash64(*block, "v"))


def _points(queries: DataFrame, anchors: DataFrame, block: list[str], vec: str, aid: str, keep: int, same: bool, carry: str | None) -> DataFrame:
    """``(block.., __h, v, ids, asked)``: each distinct vector with its ``keep`` smallest anchor ids, in order, and whether a query has it; ``(id, tag)`` for an id where anchors ``carry`` a column."""
    keys = [HASH, *block, "v"]
    w = Window.partitionBy(*keys).orderBy("id")
    a = _hashed(anchors, block, vec, F.col(aid).alias("id"), *([F.col(carry).alias("tag")] if carry else [])).where("id is not null")
    few = a.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    item = F.struct("id", "tag") if carry else F.col("id")
    have = few.withColumn("ids", F.array_compact(F.array(item, *[F.lead(item, i).over(w) for i in range(1, keep)]))).where("__r = 1").select(*keys, "ids")
    if same:
        return have.withColumn("asked", F.lit(True))
    ask = _hashed(queries, block, vec).select(*keys).distinct().withColumn("asked", F.lit(True))
    both = have.join(ask.hint("merge"), keys, "full_outer")
    return both.withColumns({"ids": F.coalesce("ids", F.array().cast(have.schema["ids"].dataType)), "asked": F.coalesce("asked", F.lit(False))})


def _bound(d: np.ndarray, keep: int) -> np.ndarray:
    """For each row a bound of its ``keep``-th smallest value: the ``keep``-th smallest of the least values of ``MIX`` sets of columns a kept one, as selecting among all columns takes most of the time."""
    sets = MIX * keep
    if d.shape[1] >= 2 * sets:
        whole = d.shape[1] // sets * sets
        d = d[:, :whole].reshape(len(d), -1, sets).min(axis=1)
    return np.partition(d, keep - 1, axis=1)[:, keep - 1] if d.shape[1] > keep else np.full(len(d), np.inf)


def _search(q: np.ndarray, radius: np.ndarray, a: np.ndarray, starts: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query, in order, up to ``keep`` nearest ids of the points ``a`` within ``radius``: positions of queries, distances, ids; and the pairs compared.

    Point ``j`` has the ids from ``starts[j]`` to ``starts[j + 1]``. Queries and points lie in leaves; the ``FIRST`` points in the leaves nearest to a leaf of queries bound its ``keep``-th distances, and of the others only leaves
    within that bound are compared. Squares by products find the candidates; their distances are added up component by component.
    """
    out, pairs = [], 0
    have, asked = cells.Leaves(a), cells.Leaves(q, STEP)
    size, least = np.diff(have.starts), max(4 * keep, min(FIRST, len(a) // 4))
    for h in range(len(asked)):
        who = asked.order[asked.starts[h] : asked.starts[h + 1]]
        x, r = q[who], radius[who]
        gap = have.gaps(asked.lo[h], asked.hi[h])
        near = np.argsort(gap, kind="stable")
        near = near[gap[near] <= (r.max() + SLACK) ** 2]
        if not len(near):
            continue
        some = int(np.searchsorted(np.cumsum(size[near]), least)) + 1
        at = have.members(near[:some])
        d = cells.squares(x, have.x[at], FINE)
        bound = np.minimum(_bound(d, keep) * (1 + 1e-9) + SLACK, (r + SLACK) ** 2 + 2 * FINE)
        row, col = cells.marked(d <= bound[:, None])
        col, n = at[col], d.size
        rest = near[some:]
        rest = rest[gap[rest] <= bound.max() + SLACK]
        if len(rest):
            at = have.members(rest)
            d = cells.squares(x, have.x[at], FINE)
            also, more = cells.marked(d <= bound[:, None])
            row, col, n = np.concatenate((row, also)), np.concatenate((col, at[more])), n + d.size
        pairs += n
        col = have.order[col]
        dist = np.round(np.sqrt(((x[row] - a[col]) ** 2).sum(axis=1)), DIGITS)
        n = starts[col + 1] - starts[col]
        take = np.arange(n.sum()) + np.repeat(starts[col] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
        row, dist, name = np.repeat(row, n), np.repeat(dist, n), ids[take]
        order = np.lexsort((name, dist, row))
        row, dist, name = row[order], dist[order], name[order]
        first = np.searchsorted(row, np.arange(len(x)))
        some = np.arange(len(row)) - first[row] < keep
        out.append((who[row[some]], dist[some], name[some]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), ids[:0], pairs
    row, dist, name = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(row, kind="stable")
    return row[order], dist[order], name[order], pairs


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _found(points: DataFrame, block: list[str], keep: int, band: int, kind: str, tag: str | None) -> tuple[DataFrame, DataFrame | None]:
    """What the asked of ``points`` (block.., __h, v, ids, asked; written) find in their own cell and, if there are several, in others: ``(block.., __h, v, best, pairs)``."""
    trees = cells.cuts(points.where(F.size("ids") > 0), block, band)
    placed = cells.dealt(points, trees, block).drop("guest")
    placed = written(placed, "near-cells") if trees else placed
    held = placed.where(F.size("ids") > 0).select(*block, "cell", "v", "ids")
    carry = tag is not None
    top = f"array<struct<d: double, id: {kind}{f', tag: {tag}' if carry else ''}>>"
    through = [*block, HASH, "v"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*through).schema], f"best {top}", "pairs long"])

    def found(ask: pa.Table, have: pa.Table) -> pa.Table:
        """``ask`` (block.., __h, v, reach) with their nearest of ``have`` (v, ids), and the pairs compared, told by the first."""
        lists = have.column("ids").combine_chunks()
        held_ids = lists.flatten()
        names, tags = (held_ids.field("id"), held_ids.field("tag")) if carry else (held_ids, None)
        starts, ids = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths())))).astype(np.int64), names.to_numpy(zero_copy_only=False)
        who, d, name, pairs = np.zeros(0, np.int64), np.zeros(0), ids[:0], 0
        if len(have) and len(ask):
            who, d, name, pairs = _search(cells.vectors(ask.column("v")), _column(ask, "reach"), cells.vectors(have.column("v")), starts, ids, keep)
        ends = np.searchsorted(who, np.arange(len(ask) + 1))
        each = [pa.array(d), pa.array(name, names.type)]
        if carry:
            order = np.argsort(ids, kind="stable")
            each.append(tags.take(pa.array(order[np.searchsorted(ids, name, sorter=order)])))
        best = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(each, ["d", "id", "tag"][: len(each)]))
        count = np.zeros(len(ask), np.int64)
        count[:1] = pairs
        return pa.table([*[ask.column(c) for c in through], best, pa.array(count)], names=[*through, "best", "pairs"])

    def meet(asks: DataFrame) -> DataFrame:
        """``asks`` (block.., __h, v, reach, cell) with what they find in their cells; those of a cell are dealt to parts, which all have its points."""
        parts = small(asks.groupBy(*block, "cell").agg(F.ceil(F.count("*") / (4 * band)).alias("parts")))
        asking = asks.join(parts, [*block, "cell"]).withColumn("part", F.pmod(F.col(HASH), F.col("parts"))).drop("parts")
        met = held.join(parts, [*block, "cell"]).select(*block, "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "v", "ids")
        met = met.select(*[F.col(c).alias(c) for c in met.columns])  # own columns, though both sides are of one table
        return asking.groupBy(*block, "cell", "part").cogroup(met.groupBy(*block, "cell", "part")).applyInArrow(found, schema)

    asked = placed.where("asked").select(*through, "cell", F.lit(float("inf")).alias("reach"))
    own = written(meet(asked), "near-found")
    if not trees:
        return own, None
    reach = F.coalesce(F.get("best", F.lit(keep - 1))["d"], F.lit(float("inf")))
    far = cells.dealt(own.select(*through, reach.alias("reach")), trees, block, "reach").where("guest").drop("guest")
    return own, written(meet(written(far, "near-asks")), "near-found")


def _some(df: DataFrame, block: list[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null" for c in block)) if block else df


def nearest(queries: DataFrame, anchors: DataFrame, block: list[str], k: int, vec: str = "ici", qid: str = "row_id", aid: str = "row_id", exclude_self: bool = False, band: int = BAND, counted: bool = False, carry: str | None = None, also: list[str] = ()) -> DataFrame:
    """``(block.., qid, anchor_id, d, r)``: each query's ``k`` nearest anchors of its block, ``r`` from 1; with ``counted``, ``(block.., points, pairs)`` instead: distinct vectors and pairs compared.

    With ``carry``, a column of the anchors, ``(block.., qid, also.., best)`` instead: a row a query that has any, ``best`` its nearest as ``(d, id, tag)``, in order, ``also`` columns of the queries; so what is told of neighbours
    and queries needs no join. Queries and anchors are read several times: write costly ones first.

    Vectors of one block have one length and no nulls. Null blocks meet nothing.
    """
    keep = k + 1 if exclude_self else k
    same = queries is anchors or queries.sameSemantics(anchors) and qid == aid
    kind, tag = anchors.schema[aid].dataType.simpleString(), anchors.schema[carry].dataType.simpleString() if carry else None
    keys = [HASH, *block, "v"]
    points = written(_points(_some(queries, block), _some(anchors, block), block, vec, aid, keep, same, carry), "near-points")
    own, far = _found(points, block, keep, band, kind, tag)
    if counted:
        every = own.select(*block, "pairs")
        every = every if far is None else every.unionByName(far.select(*block, "pairs"))
        n = points.groupBy(*block).agg(F.count("*").alias("points"))
        return n.join(every.groupBy(*block).agg(F.sum("pairs").alias("pairs")).hint("merge"), block)
    known = own.select(*keys, "best")
    if far is not None:
        more = far.where(F.size("best") > 0).groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, keep).alias("more"))  # keep of each cell met
        known = known.join(more.hint("merge"), keys, "left").select(*keys, F.slice(F.array_sort(F.concat("best", F.coalesce("more", F.array().cast(own.schema["best"].dataType)))), 1, keep).alias("best"))
    also = [c for c in also if c not in block]
    known = known.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "best")
    rows = _hashed(_some(queries, block), block, vec, F.col(qid).alias("qid"), *also)
    on = F.col(HASH) == F.col("__k0")
    for i, c in enumerate(keys[1:]):
        on &= F.col(c) == F.col(f"__k{i + 1}")
    rows = rows.join(known.hint("merge"), on)
    mine = F.filter("best", lambda x: x["id"] != F.col("qid")) if exclude_self else F.col("best")
    if carry:
        return rows.select(*block, "qid", *also, F.slice(mine, 1, k).alias("best")).where(F.size("best") > 0)
    out = rows.select(*block, "qid", F.posexplode(F.slice(mine, 1, k)).alias("r", "x"))
    return out.select(*block, "qid", F.col("x.id").alias("anchor_id"), F.col("x.d").alias("d"), (F.col("r") + 1).alias("r"))


def nearest_others(rows: DataFrame, block: list[str], vec: str = "ici", band: int = BAND) -> DataFrame:
    """``(block.., d, rows)``: the distance of each distinct vector's rows to the nearest other row of their block, and how many rows these are; a row alone in its block is left out.

    Rows aren't told apart, so nothing is joined back to them: equal ones are 0 apart, and only vectors of a single row are searched for.
    """
    keys = [HASH, *block, "v"]
    points = _hashed(_some(rows, block), block, vec).groupBy(*keys).agg(F.count("*").alias("__n"))
    points = written(points.select(*block, HASH, "v", "__n", F.array(HASH).alias("ids"), (F.col("__n") == 1).alias("asked")), "near-points")
    equal = points.where("__n > 1").select(*block, F.lit(0.0).alias("d"), F.col("__n").alias("rows"))
    own, far = _found(points.drop("__n"), block, 2, band, "bigint", None)
    d = own.select(*keys, F.get("best", F.lit(1))["d"].alias("d"))  # of the own cell's two nearest, one is the point itself, 0 apart
    if far is not None:
        d = d.unionByName(far.select(*keys, F.get("best", F.lit(0))["d"].alias("d"))).groupBy(*keys).agg(F.min("d").alias("d"))
    return equal.unionByName(d.where("d is not null").groupBy(*block, "d").agg(F.count("*").alias("rows")))
