"""Cells of points: what meets in them, and the searches over them against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from seqspark.operators import cells
from seqspark.operators import cluster as K


def test_dealt_meets_all_near_pairs_with_few_copies(spark):
    rng = random.Random(3)
    rows = [(i, 2, [round(rng.random(), 2), round(rng.random(), 4)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, n int, v array<double>")
    trees = cells.cuts(df, ["n"], 200)
    got = cells.dealt(df, trees, ["n"], 0.02).collect()
    home = {r.id: r.cell for r in got if not r.guest}
    at = {(r.id, r.cell) for r in got}
    assert len(home) == 3000 and len(got) < 2 * 3000 and max(np.bincount(list(home.values()))) < 600
    for i, _, v in rows[:300]:
        for j, _, w in rows:
            if math.dist(v, w) <= 0.02:
                assert (j, home[i]) in at


@pytest.mark.parametrize("part", [30, 5000])
def test_weights_and_links_of_a_grid_by_hand(spark, part):
    """Repeated vectors, distances that equal a radius, and several settings."""
    rng = random.Random(4)
    rows = [(i, 3, [round(rng.choice([0.1, 0.5]) + rng.gauss(0, 0.03), 2) for _ in range(2)]) for i in range(220)]
    rows += [(500 + i, 3, [0.9 + 0.04 * i, 0.9]) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>")
    got = {(r.eps, r.min_points, r.row_id): r.cluster for r in K.density_grid(df, [0.02, 0.04], [3, 9], part=part).collect()}
    near = {e: {i: [j for j, _, w in rows if round(math.dist(v, w), 9) <= e] for i, _, v in rows} for e in (0.02, 0.04)}
    at = {i: v for i, _, v in rows}
    for e in (0.02, 0.04):
        for m in (3, 9):
            core = {i for i in at if len(near[e][i]) >= m}
            want: dict = {}
            for i in sorted(core):
                stack = [i] if i not in want else []
                while stack:
                    j = stack.pop()
                    if j not in want:
                        want[j] = i
                        stack += [k for k in near[e][j] if k in core]
            for i in at:
                if i not in core:
                    to = [(round(math.dist(at[i], at[j]), 9), min(k for k in at if at[k] == at[j])) for j in near[e][i] if j in core]
                    want[i] = want[min(to)[1]] if to else None
            assert {i: got[e, m, i] for i in at} == want


def test_squares_of_far_vectors():
    x = np.array([[1e6, 0.5], [1e6, 0.54]])
    assert np.allclose(cells.squares(x, np.array([[1e6, 0.5], [-1e6, 3.0]]), 1e-12)[:, 0], [0, 0.0016], atol=1e-15)


def test_leaves_hold_every_point_in_its_box():
    x = np.random.default_rng(0).integers(0, 5, (1000, 3)).astype(float)
    f = cells.Leaves(x, 10)
    assert sorted(f.order) == list(range(1000)) and max(np.diff(f.starts)) <= 10
    for i in range(len(f)):
        inside = f.x[f.members(np.array([i]))]
        assert (inside >= f.lo[i]).all() and (inside <= f.hi[i]).all()


def test_nearest_in_four_dimensions_compares_few_pairs(spark):
    from seqspark.operators.nearest import nearest

    rng = random.Random(6)
    df = spark.createDataFrame([(i, 4, [rng.random() for _ in range(4)]) for i in range(8000)], "row_id long, n int, ici array<double>")
    r = nearest(df, df, ["n"], 3, exclude_self=True, band=1024, counted=True).first()
    assert r.points == 8000 and r.pairs < 8000 * 8000 / 4, r


def test_votes_carry_labels_and_bounds_keep_the_nearest(spark):
    """Predictions by hand over repeated vectors, and without a join of neighbours to labels; the bound of a row lies at or above its k-th smallest value."""
    from seqspark.operators import match as M
    from seqspark.operators.nearest import _bound

    rng = random.Random(8)
    rows = [(i, 3, [rng.randrange(8) / 8, rng.randrange(8) / 8], rng.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>, label string")
    voted = M.loo_match(df, ["n_clicks"])
    assert "anchor_id" not in voted._jdf.queryExecution().optimizedPlan().toString()
    got = {r.qid: (r.predicted, r.nearest) for r in voted.collect()}
    for i, _, v, _ in rows:
        near = sorted((round(math.dist(v, w), 9), j) for j, _, w, _ in rows if j != i)[:5]
        tags = [rows[j][3] for _, j in near]
        want = min(set(tags), key=lambda t: (-tags.count(t), t is not None, t or ""))
        assert got[i] == (want, near[0][0])
    d = np.random.default_rng(1).random((7, 1003))
    for keep in (1, 5, 6):
        kth = np.partition(d, keep - 1, axis=1)[:, keep - 1]
        assert (_bound(d, keep) >= kth).all() and (np.count_nonzero(d <= _bound(d, keep)[:, None], axis=1) <= 3 * keep).all()


def test_others_are_measured_once_a_vector(spark, monkeypatch):
    """Distances to the nearest other row by hand, in cells and without; only vectors of a single row are searched for, and thresholds and outcomes read them without a join back to rows."""
    from seqspark.operators import match as M
    from seqspark.operators import nearest as N

    rng = random.Random(9)
    rows = [(i, 3, rng.choice("ab"), [rng.randrange(30) / 20, -0.0 if i % 9 == 0 else rng.randrange(30) / 20]) for i in range(700)] + [(900, 3, "c", [0.1, 0.2]), (901, 4, "a", [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, label string, ici array<double>")
    asked = []
    search = N._found
    monkeypatch.setattr(N, "_found", lambda points, *a: asked.append(points.where("asked").count()) or search(points, *a))
    for band in (40, 5000):
        got = {(r.label, r.n_clicks, r.d): r.rows for r in N.nearest_others(df, ["n_clicks", "label"], band=band).groupBy("n_clicks", "label", "d").sum("rows").withColumnRenamed("sum(rows)", "rows").collect()}
        want: dict = {}
        for i, n, c, v in rows:
            near = [round(math.dist(v, w), 9) for j, m, o, w in rows if j != i and (m, o) == (n, c)]
            if near:
                want[c, n, min(near)] = want.get((c, n, min(near)), 0) + 1
        assert got == want
    alone = [v for v in {(c, n, *map(abs, v)) for _, n, c, v in rows} if sum((c, n, *map(abs, w)) == v for _, n, c, w in rows) == 1]
    assert asked == [len(alone)] * 2 and len(alone) < 500
    voted = M.loo_match(df, ["n_clicks"], also=["label"])
    assert {r.qid: r.label for r in voted.collect()} == {i: c for i, n, c, _ in rows if n == 3}


@pytest.mark.parametrize("part", [400, None])
def test_clusters_over_many_leaves_link_names(spark, monkeypatch, part):
    """Cells of several leaves against plain numpy, dense and sparse regions, repeated vectors; what is joined across cells are names of a cell's clusters and not its points."""
    rng = np.random.default_rng(11)
    x = np.round(np.concatenate([rng.normal(c, 0.05, (700, 2)) for c in (0.2, 0.6)] + [rng.uniform(0, 3, (900, 2))]), 2)
    rows = [(i, 3, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>")
    links = []
    join = K.components_by
    monkeypatch.setattr(K, "components_by", lambda edges, by: links.append(edges.count()) or join(edges, by))
    got = {(r.eps, r.min_points, r.row_id): r.cluster for r in K.density_grid(df, [0.02, 0.05, 0.08], [4, 12], part=part).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    first = np.array([min(np.flatnonzero(d[i] == 0)) for i in range(len(x))])
    cores = 0
    for e in (0.02, 0.05, 0.08):
        for m in (4, 12):
            near = d <= e
            core = near.sum(axis=1) >= m
            cores += len(set(first[core]))
            low = np.arange(len(x))
            while True:
                now = np.where(core, np.where(near & core[None, :], low[None, :], len(x)).min(axis=1), low)
                if (now == low).all():
                    break
                low = now
            want = {}
            for i in range(len(x)):
                to = np.flatnonzero(near[i] & core)
                want[i] = int(low[i]) if core[i] else int(low[min(zip(d[i, to], first[to]))[1]]) if len(to) else None
            assert {i: got[e, m, i] for i in range(len(x))} == want
    assert cores > 3500 and links[0] < cores / 10 and (part or links == [0]), (cores, links)


def test_weights_stop_at_enough():
    """A point is compared until it has enough neighbours; below that its weights are exact."""
    rng = np.random.default_rng(12)
    x = np.concatenate((rng.normal(0.5, 0.02, (3000, 3)), rng.uniform(0, 1, (100, 3)))).round(3)
    n = len(x)
    t = pa.table([pa.array(x.tolist()), pa.array(range(n)), pa.array([1] * n), pa.array([False] * n)], names=["v", "id", "w", "guest"])
    f = K._Field(t, [0.03, 0.06])
    compared, squares = [0], f.squares
    f.squares = lambda who, at: compared.append(len(who) * len(at)) or squares(who, at)
    got = K._weights(f, 20)
    y = f.leaves.x
    d = np.round(np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2)), 9)
    want = np.column_stack([(d <= e).sum(axis=1) for e in (0.03, 0.06)])
    assert (np.minimum(got, 20) == np.minimum(want, 20)).all() and (want >= 20).any() and (want < 20).any()
    assert sum(compared) < n * n / 3, sum(compared)


@pytest.mark.parametrize("few", [0, 3, 1000])
def test_components_by_group(spark, few):
    """By rounds, by a task or some groups by each; groups are graphs of their own."""
    edges = [(g, i, i + 1) for g in (1, 2) for i in range(0, 20 * g, g)] + [(3, 5, 9), (3, 9, 5), (3, 7, 7)]
    got = {(r.g, r.node): r.comp for r in K.components_by(spark.createDataFrame(edges, "g int, a long, b long"), ["g"], few=few).collect()}
    want = {(1, i): 0 for i in range(21)} | {(2, i): i // 2 * 2 for i in range(40)} | {(3, 5): 5, (3, 9): 5}
    assert got == want


def test_grid_counted_by_tag(spark):
    """Rows counted by a tag equal the rows of the grid, null tags too."""
    rng = random.Random(13)
    rows = [(i, 3, [round(rng.choice([0.2, 0.6]) + rng.gauss(0, 0.03), 2) for _ in range(2)], rng.choice(["a", "b", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>, label string")
    want: dict = {}
    for r in K.density_grid(df, [0.02, 0.04], [3, 9], part=50).collect():
        key = (rows[r.row_id][3], r.eps, r.min_points, r.cluster)
        want[key] = want.get(key, 0) + 1
    got = K.density_grid(df, [0.02, 0.04], [3, 9], part=50, tag="label").collect()
    assert {(r.label, r.eps, r.min_points, r.cluster): r.n for r in got} == want and len(got) == len(want)
