"""Cells of points: boxes of a bounded number of vectors, cut at medians of a sample, and leaves inside a cell.

A block (vectors of one length) with more points than a cell may hold is cut in two at the median of its widest dimension, and so on. The cuts come from a sample of at most ``SAMPLE`` vectors; every vector
then goes to the cell whose box it lies in, and to the other cells that its reach meets. So a vector meets few cells, however many there are, and no pair within reach is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL, LEAF, SAMPLE, SLACK = 1 << 14, 64, 1 << 17, 1e-8


def key(block: list[str]) -> Column:
    """A block as one string."""
    return F.concat_ws("\x1f", F.lit(""), *[F.col(c).cast("string") for c in block])


def vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), float).reshape(len(col), -1)


class Cuts:
    """The cuts of a block, as a tree: ``dim`` and ``at`` of a cut, its two children, and ``~cell`` for an end; the boxes of the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        n = sample.shape[1]
        self.dim, self.at, self.kids, lows, highs = [], [], [], [], []
        most = max(1, len(sample) // max(1, cells))

        def grow(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
            spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(n)
            if len(x) <= most or not spread.any():
                lows.append(lo)
                highs.append(hi)
                return ~(len(lows) - 1)
            j = int(spread.argmax())
            at = np.partition(x[:, j], (len(x) - 1) // 2)[(len(x) - 1) // 2]
            if at == x[:, j].max():
                at = x[x[:, j] < at, j].max()
            me = len(self.dim)
            self.dim.append(j)
            self.at.append(at)
            self.kids.append([0, 0])
            left, right = x[:, j] <= at, x[:, j] > at
            below, above = hi.copy(), lo.copy()
            below[j] = above[j] = at
            self.kids[me] = [grow(x[left], lo, below), grow(x[right], above, hi)]
            return me

        self.root = grow(sample, np.full(n, -np.inf), np.full(n, np.inf))
        self.dim, self.at, self.kids = np.array(self.dim, int), np.array(self.at, float), np.array(self.kids, int).reshape(-1, 2)
        self.lo, self.hi = np.array(lows), np.array(highs)

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while (open_ := np.flatnonzero(node >= 0)).size:
            at = node[open_]
            node[open_] = self.kids[at, (x[open_, self.dim[at]] > self.at[at]).astype(int)]
        return ~node

    def reached(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells whose boxes are within the rows' reach."""
        row, node, out = np.arange(len(x)), np.full(len(x), self.root), []
        reach = reach + SLACK
        while len(row):
            end = node < 0
            out.append((row[end], ~node[end]))
            row, node = row[~end], node[~end]
            off = x[row, self.dim[node]] - self.at[node]
            left, right = off <= reach[row], off > -reach[row]
            row, node = np.concatenate((row[left], row[right])), np.concatenate((self.kids[node[left], 0], self.kids[node[right], 1]))
        row, cell = (np.concatenate(c) for c in zip(*out))
        near = np.zeros(len(row), bool)
        for i in range(0, len(row), 1 << 16):
            r, c = row[i : i + (1 << 16)], cell[i : i + (1 << 16)]
            gap = np.maximum(np.maximum(self.lo[c] - x[r], x[r] - self.hi[c]), 0)
            near[i : i + (1 << 16)] = (gap * gap).sum(axis=1) <= reach[r] ** 2
        return row[near], cell[near]


def cuts(points: DataFrame, block: list[str], size: int = CELL) -> dict[str, Cuts]:
    """The cuts of each block with more than ``size`` of the ``points`` (block.., v): a sample of ``SAMPLE`` vectors at most comes to the driver."""
    large = {r["k"]: r["n"] for r in points.groupBy(key(block).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > size).collect()}
    if not large:
        return {}
    total = sum(large.values())
    share = min(1.0, max(128 / size, 1024 / total), SAMPLE / total)
    mixed = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))
    held: dict[str, list] = {}
    for r in points.where(mixed).select(key(block).alias("k"), "v").collect():
        if r["k"] in large:
            held.setdefault(r["k"], []).append(r["v"])
    return {k: Cuts(np.array(v, float), -(-large[k] // size)) for k, v in held.items()}


def dealt(rows: DataFrame, trees: dict[str, Cuts], block: list[str], reach: float | str | None = None) -> DataFrame:
    """``rows`` (block.., v, ..) with ``cell`` and ``guest``: once in the own cell and, as a guest, in every other one within ``reach`` (a number, a column, or none)."""
    if not trees:
        return rows.withColumns({"cell": F.lit(0), "guest": F.lit(False)})
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(b.schema.get_field_index("__k")).dictionary_encode()
            code, words = k.indices.to_numpy(zero_copy_only=False), k.dictionary.to_pylist()
            rows_, cells_, guests = [], [], []
            for i, word in enumerate(words):
                at = np.flatnonzero(code == i)
                if word not in trees:
                    rows_.append(at)
                    cells_.append(np.zeros(len(at), int))
                    guests.append(np.zeros(len(at), bool))
                    continue
                x = vectors(b.column(b.schema.get_field_index("v")).take(pa.array(at)))
                own = trees[word].home(x)
                rows_.append(at)
                cells_.append(own)
                guests.append(np.zeros(len(at), bool))
                if reach is not None:
                    far = np.full(len(at), reach) if not isinstance(reach, str) else b.column(b.schema.get_field_index(reach)).to_numpy(zero_copy_only=False)[at]
                    row, cell = trees[word].reached(x, far)
                    other = cell != own[row]
                    rows_.append(at[row[other]])
                    cells_.append(cell[other])
                    guests.append(np.ones(int(other.sum()), bool))
            row, cell, guest = np.concatenate(rows_), np.concatenate(cells_), np.concatenate(guests)
            for i in range(0, len(row), 1 << 14):
                s = slice(i, i + (1 << 14))
                t = b.take(pa.array(row[s]))
                yield pa.RecordBatch.from_arrays([*[t.column(t.schema.get_field_index(c)) for c in names], pa.array(cell[s], pa.int32()), pa.array(guest[s])], [*names, "cell", "guest"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn("__k", key(block)).mapInArrow(run, f"{fields}, cell int, guest boolean")


class Leaves:
    """Points in leaves of at most ``size``: ``order`` lists them leaf by leaf, leaf ``i`` from ``starts[i]`` to ``starts[i + 1]``; the leaves' boxes."""

    def __init__(self, x: np.ndarray, size: int = LEAF):
        stack, parts = [np.arange(len(x))] if len(x) else [], []
        while stack:
            i = stack.pop()
            if len(i) <= size:
                parts.append(i)
                continue
            y = x[i]
            j = int((y.max(axis=0) - y.min(axis=0)).argmax())
            half = len(i) // 2
            p = np.argpartition(y[:, j], half)
            stack += [i[p[half:]], i[p[:half]]]
        self.order = np.concatenate(parts) if parts else np.zeros(0, int)
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(int)
        self.x = x[self.order]
        if parts:
            self.lo, self.hi = np.minimum.reduceat(self.x, self.starts[:-1]), np.maximum.reduceat(self.x, self.starts[:-1])
        else:
            self.lo = self.hi = x[:0]

    def __len__(self) -> int:
        return len(self.starts) - 1

    def gaps(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least squared distances of the leaves from a box."""
        gap = np.maximum(np.maximum(self.lo - hi, lo - self.hi), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Largest squared distances of the leaves from a box."""
        far = np.maximum(self.hi - lo, hi - self.lo)
        return np.einsum("ij,ij->i", far, far)

    def members(self, leaves: np.ndarray) -> np.ndarray:
        """Positions in ``order`` of the points of these leaves."""
        n = self.starts[leaves + 1] - self.starts[leaves]
        return np.arange(n.sum()) + np.repeat(self.starts[leaves] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(leaves) else np.zeros(0, int)


def squares(x: np.ndarray, y: np.ndarray, fine: float) -> np.ndarray:
    """Squared distances, with an error below ``fine`` (so some may be below 0): by products around the middle of ``x``, or by differences where these would be too coarse."""
    mid = (x.min(axis=0) + x.max(axis=0)) / 2
    p, q = x - mid, y - mid
    pp, qq = np.einsum("ij,ij->i", p, p), np.einsum("ij,ij->i", q, q)
    if not (pp.max(initial=0) + qq.max(initial=0)) * 4e-15 <= fine:
        out = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            out += (x[:, j, None] - y[None, :, j]) ** 2
        return out
    return np.column_stack((p, pp, np.ones(len(p)))) @ np.column_stack((q * -2, np.ones(len(q)), qq)).T


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true places, as ``np.nonzero``, which takes far longer on two dimensions."""
    at = np.flatnonzero(mask)
    return at // mask.shape[1], at % mask.shape[1]
