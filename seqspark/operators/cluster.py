"""Density discovery, graph components and iterative merges. Every round of a loop is written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import cells
from . import match as M
from .merges import merge_rounds
from .stages import discard, small, written

#: Points of a cell: fewer where there are few, so that tasks are many; more where there are many, so that guests are few.
PART, MOST = cells.CELL, 1 << 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` for the nodes of the edges: the smallest node of each component, by alternating large and small stars.

    Minima are written before they are joined back, so both sides of each join are plain shuffles and a node with very many links can be split.
    """
    edges = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "components")
        large = both.join(low.hint("merge"), both["u"] == low["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "components")
        met = large.join(least.hint("merge"), large["u"] == least["n"])
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        done, edges = edges, written(small, "components")
        discard(done, low, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: pairs that list each other."""
    e = neighbours.select(F.col("qid").alias("a"), F.col("anchor_id").alias("b"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return e.intersect(back).where("a < b")


def mutual_knn_components(vectors: DataFrame, block: list[str], k: int = 6, least: float = 0.45, vec: str = "embedding", vid: str = "vec_id") -> DataFrame:
    """``(node, comp)``: components of the mutual top-``k`` cosine graph with similarity ``least`` or more; singletons are left out."""
    near = M.knn(vectors, vectors, block, k, vec, vid, vid, cosine=True, exclude_self=True).where(F.col("d") >= least)
    return components(mutual_edges(near))


def mutual_pair_score(rates: DataFrame, a: str = "a", b: str = "b", rate: str = "rate", n: int = 50) -> DataFrame:
    """``(a, b, score)``: the geometric mean of both directed rates, the ``n`` largest."""
    back = rates.select(F.col(a).alias("__b"), F.col(b).alias("__a"), F.col(rate).alias("__r"))
    x = rates.join(back.hint("merge"), (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b"))).where(F.col(a) < F.col(b))
    return x.select(a, b, F.sqrt(F.col(rate) * F.col("__r")).alias("score")).orderBy(F.desc(F.round("score", 9)), a, b).limit(n)


#: Links of a group up to which one task joins them; more are joined in rounds.
FEW_LINKS = 1 << 20


class _Sets:
    """Disjoint sets of the numbers below ``n``; the smallest number stands for its set."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def root(self, i: np.ndarray) -> np.ndarray:
        up = self.top[i]
        while ((higher := self.top[up]) != up).any():
            up = higher
        self.top[i] = up
        return up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root(a), self.root(b)
            apart = a != b
            a, b = a[apart], b[apart]
            self.top[np.maximum(a, b)] = np.minimum(a, b)  # of several links of one set, one holds; the others come again


def components_by(edges: DataFrame, by: list[str], a: str = "a", b: str = "b", few: int | None = None) -> DataFrame:
    """``(by.., node, comp)``: :func:`components` of each group of edges, a graph of its own.

    A group of at most ``few`` distinct links is joined by one task; larger groups go through the rounds of :func:`components` together.
    """
    few = FEW_LINKS if few is None else few
    edges = written(edges.where(F.col(a) != F.col(b)).select(*by, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    size = small(edges.groupBy(*by).agg((F.count("*") > few).alias("__large")))
    kinds = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by)
    kind = edges.schema["u"].dataType.simpleString()

    def joined(t: pa.Table) -> pa.Table:
        ends = pa.chunked_array([*t.column("u").chunks, *t.column("v").chunks]).combine_chunks().dictionary_encode()
        code, nodes = ends.indices.to_numpy(), ends.dictionary
        sets = _Sets(len(nodes))
        sets.join(code[: len(t)], code[len(t) :])
        comp = _least(nodes.to_numpy(zero_copy_only=False), sets.root(np.arange(len(nodes))))
        return pa.table([*[pa.array([t.column(c)[0].as_py()] * len(nodes), t.schema.field(c).type) for c in by], nodes, pa.array(comp, nodes.type)], names=[*by, "node", "comp"])

    sided = edges.join(size, by)
    out = sided.where("not __large").groupBy(*by).applyInArrow(joined, f"{kinds}, node {kind}, comp {kind}")
    if size.where("__large").isEmpty():
        return out
    node = lambda c: F.struct(*by, F.col(c).alias("id")).alias(c)
    rounds = components(sided.where("__large").select(node("u"), node("v")), "u", "v")
    return out.unionByName(rounds.select("node.*", F.col("comp.id").alias("comp")).withColumnRenamed("id", "node"))


def _least(ids: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each number the smallest of ``ids`` in its set."""
    order = np.argsort(ids, kind="stable")
    rank, low = np.empty(len(ids), int), np.full(len(ids), len(ids))
    rank[order] = np.arange(len(ids))
    np.minimum.at(low, root, rank)
    return ids[order[low[root]]]


class _Field:
    """The points of a cell in leaves, those at home first: ``home`` leaves, ``inside`` points; ``rows`` are the table's rows in that order."""

    def __init__(self, t: pa.Table, radii: list[float]):
        x, guest = cells.vectors(t.column("v")), t.column("guest").to_numpy()
        own, other = np.flatnonzero(~guest), np.flatnonzero(guest)
        a, b = cells.Leaves(x[own], LEAF), cells.Leaves(x[other], LEAF)
        self.home, self.inside = len(a), len(own)
        a.order, a.x = np.concatenate((own[a.order], other[b.order])), np.concatenate((a.x, b.x))
        a.starts, a.lo, a.hi = np.concatenate((a.starts, b.starts[1:] + len(own))), np.concatenate((a.lo, b.lo)), np.concatenate((a.hi, b.hi))
        self.leaves, self.rows = a, t.take(pa.array(a.order))
        self.id, self.w = self.rows.column("id").to_numpy(), self.rows.column("w").to_numpy().astype(float)
        self.radii, self.limits, self.fine = radii, np.array([_limit(e) for e in radii]), radii[0] * 10.0 ** -(M.DIGITS + 1)

    def members(self, h: int) -> np.ndarray:
        return np.arange(self.leaves.starts[h], self.leaves.starts[h + 1])

    def around(self, h: int, leaves: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(far, points, level)``: some of the points of ``leaves``, of those ``wanted``, that the box of home leaf ``h`` reaches; near leaves first, a few at once, then more.

        ``level`` is the first radius that reaches a point, ``far`` the first that reaches any of these.
        """
        f = self.leaves
        lo, hi, reach = f.lo[h], f.hi[h], np.square(np.array(self.radii) + cells.SLACK)
        gap = f.gaps(lo, hi)[leaves]
        near = np.flatnonzero(gap <= reach[-1])
        near = near[np.argsort(gap[near], kind="stable")]
        near, ends = leaves[near], np.searchsorted(gap[near], reach, side="right")
        i, step = 0, FEW
        for far, end in enumerate(ends.tolist()):
            while i < end:
                at = f.members(near[i : min(i + step, end)])
                i, step = min(i + step, end), min(4 * step, MANY)
                if wanted is not None:
                    at = at[wanted[at]]
                off = np.maximum(np.maximum(f.x[at] - hi, lo - f.x[at]), 0)
                level = np.searchsorted(reach, np.einsum("ij,ij->i", off, off))
                met = np.flatnonzero(level < len(reach))
                if len(met):
                    yield far, at[met], level[met]

    def squares(self, who: np.ndarray, at: np.ndarray) -> np.ndarray:
        return cells.squares(self.leaves.x[who], self.leaves.x[at], self.fine)


#: Points of a leaf; leaves compared at once with a leaf, first and at most; leaves after which the sets of all are looked up again.
LEAF, FEW, MANY, AGAIN = 256, 2, 32, 16


def _limit(e: float) -> float:
    """The square up to which a distance, rounded to ``DIGITS`` places, is within ``e``."""
    return (e + 0.5 * 10.0**-M.DIGITS) ** 2


def _weights(f: _Field, enough: int) -> np.ndarray:
    """For each point at home the weight within each radius; ``enough`` or more stands for any larger one, so a point is compared until it has that many."""
    leaves, radii, out = f.leaves, f.radii, np.zeros((f.inside, len(f.radii)))
    mass, every = np.add.reduceat(f.w, leaves.starts[:-1]), np.arange(len(leaves))
    for h in range(f.home):
        who = f.members(h)
        within = mass[leaves.spans(leaves.lo[h], leaves.hi[h]) <= radii[0] ** 2].sum()
        if within >= enough:
            out[who] = within
            continue
        for far, at, _ in f.around(h, every):
            who = who[out[who, far] < enough]
            if not len(who):
                break
            d = f.squares(who, at).ravel()
            hit = np.flatnonzero(d <= f.limits[-1])
            row, w, d = hit // len(at), f.w[at[hit % len(at)]], d[hit]
            for j in range(far, len(radii)):
                out[who, j] += np.bincount(row, w * (d <= f.limits[j]), len(who))
    return out


def _grow(f: _Field, core: np.ndarray, level: np.ndarray, sets: _Sets, across: bool) -> None:
    """Joins the cores within reach at each setting: those at home with each other, or, ``across``, with guests. ``core`` has a row a setting; point ``i`` is number ``s * n + i`` at setting ``s``.

    Points whose cores are in the set of a leaf already aren't compared with it again, so a dense cell costs few comparisons.
    """
    n, starts, wanted = core.shape[1], f.leaves.starts[: len(f.leaves) if across else f.home], core.any(axis=0)
    some = np.flatnonzero(np.add.reduceat(wanted, starts, dtype=int))
    own, other = some[some < f.home], some[some >= f.home] if across else some
    live = np.arange(len(core))
    for i, h in enumerate(own.tolist()):
        if i % max(AGAIN, f.home // AGAIN) == 0:  # the sets of each leaf: the same one, or from low to high
            have = core[live]
            now = sets.root(live[:, None] * n + np.arange(n))
            low, high = np.where(have, now, core.size), np.where(have, now, -1)
            apart = low.min(axis=1) < high.max(axis=1)
            low, high, live = (np.minimum.reduceat(low[apart], starts, axis=1), np.maximum.reduceat(high[apart], starts, axis=1), live[apart])
            if not len(live):
                break  # one set at every setting
            base, level_, have = live[:, None] * n, level[live], have[apart]
        met = other if across else other[other >= h]
        one = (low[:, h] == high[:, h])[:, None] & (low[:, met] == high[:, met]) & (low[:, met] == low[:, [h]])
        met = met[~(one | (high[:, met] < 0) | (high[:, [h]] < 0)).all(axis=0)]
        if not len(met):
            continue
        who = f.members(h)
        who = who[wanted[who]]
        mine_core = have[:, who]
        for far, at, reach in f.around(h, met, wanted):
            mine, theirs = sets.root(base + who), sets.root(base + at)
            least, most = np.where(mine_core, mine, core.size).min(axis=1), np.where(mine_core, mine, -1).max(axis=1)
            alive = (level_ >= far) & (most >= 0)
            apart = have[:, at] & alive[:, None] & (level_[:, None] >= reach) & ((least != most)[:, None] | (theirs != least[:, None]))
            keep = np.flatnonzero(apart.any(axis=0))
            if not len(keep):
                continue
            at, theirs, apart = at[keep], theirs[:, keep], apart[:, keep]
            d = f.squares(who, at).ravel()
            hit = np.flatnonzero(d <= f.limits[-1])
            row, col = hit // len(at), hit % len(at)
            first = np.searchsorted(f.limits, d[hit])
            for s in np.flatnonzero(alive).tolist():
                pair = np.flatnonzero((first <= level_[s]) & mine_core[s, row] & apart[s, col])
                a, b = mine[s, row[pair]], theirs[s, col[pair]]
                pair = a != b
                sets.join(a[pair], b[pair])


def _nearest_cores(f: _Field, have: np.ndarray, core: np.ndarray, least: list[int], level: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each setting the points at home that are no cores but have one within the radius, and their nearest core (ties: the smallest id).

    A point is compared up to the largest radius at which it is no core, where it has fewer than the largest least number of neighbours: so what is found is few.
    """
    short = have[: f.inside] < least[-1]
    top = np.where(short.any(axis=1), len(f.radii) - 1 - short[:, ::-1].argmax(axis=1), -1)
    often, every, rows, cols = core.any(axis=0), np.arange(len(f.leaves)), [], []
    for h in range(f.home):
        who = f.members(h)
        who = who[top[who] >= 0]
        if not len(who):
            continue
        most = top[who].max()
        for far, at, reach in f.around(h, every, often):
            if far > most:
                break
            at = at[reach <= most]
            if len(at):
                row, col = cells.marked(f.squares(who, at) <= f.limits[top[who]][:, None])
                rows.append(who[row])
                cols.append(at[col])
    row, col = (np.concatenate(c) if c else np.zeros(0, int) for c in (rows, cols))
    dist = np.round(np.sqrt(np.square(f.leaves.x[row] - f.leaves.x[col]).sum(axis=1)), M.DIGITS)
    order = np.lexsort((f.id[col], dist, row))
    row, col, dist = row[order], col[order], dist[order]
    out = []
    for s, j in enumerate(level.tolist()):
        ok = np.flatnonzero(~core[s, row] & core[s, col] & (dist <= f.radii[j]))
        first = ok[np.unique(row[ok], return_index=True)[1]]
        out.append((row[first], col[first]))
    return out


def _lists(values: pa.Array, size: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), values)


def _density(points: DataFrame, radii: list[float], least: list[int], length: str, part: int | None) -> tuple[DataFrame, DataFrame, list[tuple[float, int]]]:
    """The clusters of distinct ``points`` (length, v, id, w; written) at every setting: ``(length, v, of)``, ``of`` a name a setting or null, ``(s, node, comp)``, the names of setting ``s`` that belong together, and the settings.

    Points lie in :mod:`cells`. A task has the points of a cell and the guests within the largest radius, in leaves with boxes. The first pass counts neighbours and joins the cores of a cell, which are named by their smallest
    id. The second joins these names across cells, at most a link a name, and finds the nearest core of the other points. So what is joined in rounds, or by a task if it is little, are names and not points.
    """
    radii, least = sorted(set(radii)), sorted(set(least))
    settings = [(i, m) for m in least for i in range(len(radii))]
    level, lows = np.array([i for i, _ in settings]), np.array([m for _, m in settings])
    kind, n = points.schema["id"].dataType.simpleString(), points.schema[length].dataType.simpleString()
    trees = cells.cuts(points, [length], part or max(PART, min(MOST, points.count() // 64)))
    tasks = max(16, min(4096, 2 * sum(len(t.lo) for t in trees.values())))  # a cell is much work on little data

    def cores(have: np.ndarray) -> np.ndarray:
        return have.T[level] >= lows[:, None]

    def counts(t: pa.Table) -> pa.Table:
        f = _Field(t, radii)
        have = np.minimum(_weights(f, least[-1]), least[-1])
        core, ids = cores(have), f.id[: f.inside]
        sets = _Sets(core.size)
        _grow(f, core, level, sets, False)
        root = sets.root(np.arange(core.size)).reshape(core.shape) - np.arange(len(settings))[:, None] * f.inside
        names = np.column_stack([_least(ids, r) for r in root])
        own = f.rows.slice(0, f.inside)
        lists = [_lists(pa.array(have.astype(np.int32).ravel()), len(radii)), _lists(pa.array(names.ravel(), t.schema.field("id").type), len(settings))]
        return pa.table([*[own.column(c) for c in (length, "v", "id", "w")], *lists], names=[length, "v", "id", "w", "core", "root"])

    around = cells.dealt(points, trees, [length], radii[-1]).repartition(tasks, length, "cell")
    marked = written(around.groupBy(length, "cell").applyInArrow(counts, f"`{length}` {n}, v array<double>, id {kind}, w long, core array<int>, root array<{kind}>"), "grid")

    def spans(t: pa.Table) -> pa.Table:
        f, id_type = _Field(t, radii), t.schema.field("id").type
        have = cells.vectors(f.rows.column("core"))
        core, total = cores(have), len(f.id)
        names = f.rows.column("root").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(total, -1)
        sets, firsts = _Sets(core.size), []
        for s in range(len(settings)):  # cores of one name are one set
            at = np.flatnonzero(core[s])
            code = pa.array(names[at, s]).dictionary_encode().indices.to_numpy()
            first = at[np.unique(code, return_index=True)[1]]
            sets.top[s * total + at] = s * total + first[code]
            firsts.append(first)
        _grow(f, core, level, sets, True)
        of, noise = names[: f.inside].copy(), ~core[:, : f.inside].T
        for s, (who, to) in enumerate(_nearest_cores(f, have, core, least, level)):
            of[who, s], noise[who, s] = names[to, s], False
        links = []
        for s, first in enumerate(firsts):
            to = sets.root(s * total + first) - s * total
            other = to != first
            links.append((np.full(int(other.sum()), s), names[first[other], s], names[to[other], s]))
        at, a, b = (np.concatenate(c) for c in zip(*links))
        own, k = f.rows.slice(0, f.inside), len(at)
        full = [*[own.column(c).combine_chunks() for c in (length, "v")], _lists(pa.array(of.ravel(), id_type, mask=noise.ravel()), len(settings))]
        full = [pa.concat_arrays([c, pa.nulls(k, c.type)]) for c in full]
        ends = [pa.concat_arrays([pa.nulls(f.inside, kind_), pa.array(c, kind_)]) for c, kind_ in ((at, pa.int32()), (a, id_type), (b, id_type))]
        return pa.table([*full, *ends], names=[length, "v", "of", "s", "a", "b"])

    often = F.get("core", F.lit(len(radii) - 1)) >= least[0]  # a core at some setting; the others are nobody's guests
    met = cells.dealt(marked.where(often), trees, [length], radii[-1]).unionByName(cells.dealt(marked.where(~often), trees, [length]))
    met = met.repartition(tasks, length, "cell")
    found = written(met.groupBy(length, "cell").applyInArrow(spans, f"`{length}` {n}, v array<double>, of array<{kind}>, s int, a {kind}, b {kind}"), "grid")
    discard(marked)
    comp = small(components_by(found.where("s is not null").select("s", "a", "b"), ["s"]), "merge")
    return found.where("s is null").select(length, "v", "of"), comp, [(radii[i], m) for i, m in settings]


def _points(rows: DataFrame, length: str, vec: str, rid: str, tag: str | None = None) -> DataFrame:
    """Distinct ``(length, v, tag, id, w)``: the smallest id and the number of rows."""
    more = [] if tag is None else [F.col(tag).alias("tag")]
    return written(rows.groupBy(length, F.col(vec).cast("array<double>").alias("v"), *more).agg(F.min(rid).alias("id"), F.count("*").alias("w")), "grid")


def _clustered(rows: DataFrame, of: DataFrame, length: str, vec: str, how: str = "inner") -> DataFrame:
    """``rows`` with the names ``of`` their vectors; sorted by a hash, as comparing arrays takes most of a sort."""
    left = rows.withColumn("__h", F.xxhash64(length, F.col(vec).cast("array<double>")))
    right = of.select(F.xxhash64(length, "v").alias("__h"), F.col(length), F.col("v").alias(vec), "of")
    return left.join(right.hint("merge"), ["__h", length, vec], how).drop("__h")


def _whole(named: DataFrame, comp: DataFrame) -> DataFrame:
    """``named`` (.., s, name) with ``cluster``: the smallest of the names that belong together."""
    x = named.join(comp.select(F.col("s").alias("__s"), "node", "comp"), (F.col("s") == F.col("__s")) & (F.col("name") == F.col("node")), "left")
    return x.withColumn("cluster", F.coalesce("comp", "name")).drop("__s", "node", "comp", "name")


def density_clusters(rows: DataFrame, length: str = "n_clicks", vec: str = "ici", rid: str = "row_id", eps: float = 0.10, min_points: int = 10, part: int | None = None) -> DataFrame:
    """``(rid, length, cluster)``: density clusters of equal-length patterns; null is noise. ``cluster`` is the smallest core id.

    Equal patterns are one weighted point. A point with ``min_points`` or more rows within ``eps`` (itself included) is a core; cores within ``eps``
    are one cluster; another point joins that of its nearest core within ``eps``. Lengths with fewer than ``min_points`` rows are noise.
    """
    enough = rows.groupBy(length).count().where(F.col("count") >= min_points).select(length)
    of, comp, _ = _density(_points(rows.join(enough.hint("shuffle_hash"), length, "left_semi"), length, vec, rid), [eps], [min_points], length, part)
    named = _clustered(rows.select(rid, length, vec), of, length, vec, "left").select(rid, length, F.lit(0).alias("s"), F.get("of", F.lit(0)).alias("name"))
    return _whole(named, comp).select(rid, length, "cluster")


def density_grid(rows: DataFrame, eps: list[float], min_points: list[int], length: str = "n_clicks", vec: str = "ici", rid: str = "row_id", part: int | None = None, tag: str | None = None) -> DataFrame:
    """``(rid, length, eps, min_points, cluster)``: :func:`density_clusters` for every pair of a radius and a least number of points, as one search.

    With ``tag``, a column, ``(length, tag, eps, min_points, cluster, n)`` instead: the rows counted, before a row a setting is made of each. One pass over the cells counts the neighbours at all radii and
    joins the cores of each cell at every setting, a second joins them across cells. So a grid costs little more than one setting.
    """
    kinds = _points(rows, length, vec, rid, tag)
    points = kinds if tag is None else written(kinds.groupBy(length, "v").agg(F.min("id").alias("id"), F.sum("w").alias("w")), "grid")
    of, comp, settings = _density(points, eps, min_points, length, part)
    if tag is None:
        named = _clustered(rows.select(rid, length, vec), of, length, vec).select(rid, length, F.posexplode("of").alias("s", "name"))
    else:
        named = _clustered(kinds.select(length, "v", "tag", "w"), of, length, "v").select(length, "tag", "w", F.posexplode("of").alias("s", "name"))
        named = named.groupBy(length, "tag", "s", "name").agg(F.sum("w").alias("w"))
    of_setting = lambda i, name: F.get(F.array(*[F.lit(x[i]) for x in settings]), F.col("s")).alias(name)
    x = _whole(named, comp)
    if tag is None:
        return x.select(rid, length, of_setting(0, "eps"), of_setting(1, "min_points"), "cluster")
    return x.groupBy(length, "tag", "s", "cluster").agg(F.sum("w").alias("n")).select(length, F.col("tag").alias(tag), of_setting(0, "eps"), of_setting(1, "min_points"), "cluster", "n")


def keep_large(clusters: DataFrame, least: int = 10, cluster: str = "cluster", length: str = "n_clicks") -> DataFrame:
    """``clusters`` with clusters of fewer than ``least`` rows made noise, and ``name``: ``{n}-NOISE`` for noise."""
    size = clusters.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("__n"))
    x = clusters.join(size.hint("shuffle_hash"), cluster, "left").withColumn(cluster, F.when(F.col("__n") >= least, F.col(cluster))).drop("__n")
    return x.withColumn("name", F.when(F.col(cluster).isNull(), F.concat(F.col(length).cast("string"), F.lit("-NOISE"))))


def tempo_rank_names(clusters: DataFrame, length: str, shape: str, mean: str, discovery: bool = False, anchors: DataFrame | None = None) -> DataFrame:
    """``clusters`` with ``rank`` and ``name``: gapped shapes verbatim; else length, shape and the rank by mean duration.

    Among anchors a single cluster of a shape has no rank. Discovered clusters always have one, with a ``P``; the shape is left out if no anchor (``length``, ``shape``) has it.
    """
    w = Window.partitionBy(length, shape)
    r, m = F.row_number().over(w.orderBy(mean, *([c for c in ("cluster",) if c in clusters.columns]))), F.count("*").over(w)
    plus = F.col(shape).contains("+")
    n = F.col(length).cast("string")
    if not discovery:
        x = clusters.withColumn("rank", F.when(~plus & (m > 1), r))
        return x.withColumn("name", F.when(plus, F.col(shape)).otherwise(F.concat(n, F.col(shape), F.coalesce(F.col("rank").cast("string"), F.lit("")))))
    known = anchors.select(length, shape).distinct().withColumn("__k", F.lit(True))
    x = clusters.withColumn("rank", F.when(~plus, r)).join(known, [length, shape], "left")
    return x.withColumn("name", F.when(plus, F.col(shape)).otherwise(F.concat(n, F.when(F.col("__k"), F.col(shape)).otherwise(""), F.lit("P"), F.col("rank").cast("string")))).drop("__k")


def log_table(spark, log: list[dict]) -> DataFrame:
    """A merge log as a table, a row a round."""
    return spark.createDataFrame([(r["round"], r["a"], r["b"], r["count"], r["tokens"], float(r["ratio"])) for r in log], "round int, a string, b string, count long, tokens long, ratio double")


def coverage(ratio: float, k: int = 8) -> dict:
    """What merges save: the reduction in per cent and how many more events a context of ``k`` covers."""
    return {"reduction": 100 * (1 - ratio), "extra": k / ratio - k}


def segment_strings(strings: DataFrame, rounds: int = 20, least: int = 3) -> DataFrame:
    """``(string, segs)``: each unique string of ``(string, c)`` cut by digram merges over characters, weighted by the counts."""
    chars = strings.select(F.col("string").alias("seq"), F.col("c").alias("weight"), F.posexplode(F.filter(F.split("string", ""), lambda x: x != "")).alias("pos", "token"))
    cur, _ = merge_rounds(chars, rounds, least, by_pmi=True, joiner="", weight="weight")
    return cur.groupBy(F.col("seq").alias("string")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("segs"))


def expand_segments(rows: DataFrame, segments: DataFrame, seq: str, pos: str, sym: str, gap: str) -> DataFrame:
    """``(seq, event, sub, token, gap, starts)``: events as their segments; the event's gap stands at each, ``starts`` marks the first."""
    x = rows.join(segments.withColumnRenamed("string", sym).hint("shuffle_hash"), sym)
    return x.select(seq, F.col(pos).alias("event"), gap, F.posexplode("segs").alias("sub", "token")).withColumn("starts", F.col("sub") == 0)


def global_cluster_ids(df: DataFrame, length: str, cluster: str, label: str) -> tuple[DataFrame, DataFrame]:
    """``(length, cluster, gid)`` of local clusters, and one row: clusters with and without labelled rows."""
    from .tokens import dense_ids

    ids = dense_ids(df.where(F.col(cluster).isNotNull()).select(length, cluster).distinct(), [length, cluster], "gid")
    g = df.where(F.col(cluster).isNotNull()).groupBy(length, cluster).agg(F.count(label).alias("n"))
    return ids, g.agg(F.count_if(F.col("n") > 0).alias("with_labels"), F.count_if(F.col("n") == 0).alias("without"))


def noise_majority(df: DataFrame, length: str, cluster: str, label: str, noise: Column) -> DataFrame:
    """One row: clusters, those whose most frequent label (ties: the smaller) is ``noise`` (a condition on the label), and the labelled rows that aren't noise inside these."""
    c = df.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(length, cluster, label).agg(F.count("*").alias("c"), F.max(noise).alias("noise"))
    g = c.groupBy(length, cluster).agg(F.min_by("noise", F.struct(-F.col("c"), F.col(label))).alias("lost"), F.sum(F.when(F.col("noise"), 0).otherwise(F.col("c"))).alias("rows"))
    return g.agg(F.count("*").alias("clusters"), F.count_if("lost").alias("noise_clusters"), F.coalesce(F.sum(F.when(F.col("lost"), F.col("rows"))), F.lit(0).cast("long")).alias("rows_inside"))


def principal_components(rows: DataFrame, length: str = "n_clicks", vec: str = "ici", least: int = 5) -> DataFrame:
    """``(length, n, mean, sd, v1, v2, ratio1, ratio2)``: the two first components of the scaled patterns of each length of 3 or more with ``least`` rows, and their shares of the variance; signs make the largest loading positive.

    Tasks return counts, sums and products a length; what is solved is a small matrix a length.
    """
    kind = rows.schema[length].dataType.simpleString()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            n = b.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(n):
                part = b.column(1).filter(pa.array(n == k))
                x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), float).reshape(len(part), -1)
                both = np.column_stack((np.ones(len(x)), x))
                held[k] = held.get(k, 0) + both.T @ both  # counts, sums and products in one
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))], ["n", "m"])

    x = rows.where((F.col(length) >= 3) & F.col(vec).isNotNull()).select(F.col(length).cast("long").alias("n"), F.col(vec).cast("array<double>").alias("v"))
    each = x.mapInArrow(moments, "n long, m array<double>").select("n", F.posexplode("m").alias("i", "x")).groupBy("n", "i").agg(F.sum("x").alias("x"))
    whole = each.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, m in zip(*[c.to_pylist() for c in b.columns]):
                k = int(round(len(m) ** 0.5))
                m = np.array(m).reshape(k, k)
                count, mean = m[0, 0], m[0, 1:] / m[0, 0]
                if count < least:
                    continue
                cov = (m[1:, 1:] - count * np.outer(mean, mean)) / (count - 1)
                sd = np.sqrt(np.maximum(np.diag(cov), 0))
                unit = np.where(sd > 1e-12, 1 / np.maximum(sd, 1e-12), 0.0)
                values, vectors = np.linalg.eigh(cov * np.outer(unit, unit))
                top = [vectors[:, -1 - i] * (1 if vectors[np.abs(vectors[:, -1 - i]).argmax(), -1 - i] > 0 else -1) for i in (0, 1)]
                total = values.sum() or 1.0
                out.append((n, int(count), mean.tolist(), sd.tolist(), top[0].tolist(), top[1].tolist(), values[-1] / total, values[-2] / total))
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 4, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], ["k", "n", "mean", "sd", "v1", "v2", "ratio1", "ratio2"])

    got = whole.mapInArrow(solved, "k long, n long, mean array<double>, sd array<double>, v1 array<double>, v2 array<double>, ratio1 double, ratio2 double")
    return got.withColumn(length, F.col("k").cast(kind)).drop("k")


def pca_2(rows: DataFrame, length: str = "n_clicks", vec: str = "ici", rid: str = "row_id", least: int = 5) -> DataFrame:
    """``(rid, length, pc1, pc2)``: each pattern on the :func:`principal_components` of its length."""
    model = small(principal_components(rows, length, vec, least).select(length, "mean", "sd", "v1", "v2"))
    unit = F.zip_with(F.zip_with(vec, "mean", lambda x, m: x - m), "sd", lambda x, s: F.when(s > 1e-12, x / s).otherwise(0.0))
    on = lambda v: F.aggregate(F.zip_with(unit, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select(rid, length, vec).join(model, length).select(rid, length, on("v1").alias("pc1"), on("v2").alias("pc2"))
