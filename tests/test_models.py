"""Neighbours, merges, n-gram models, density grids and components against plain Python."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import cluster as K
from seqspark.operators import lm as L
from seqspark.operators import ngrams as N
from seqspark.operators.merges import merge_rounds, merged
from seqspark.operators.nearest import nearest

DATA = "/root/testdata/sf0.01"


# neighbours


def all_pairs(queries, anchors, k, same):
    out = {}
    for i, n, v in queries:
        near = sorted((round(math.dist(v, w), 9), j) for j, m, w in anchors if m == n and not (same and i == j))[:k]
        out |= {(i, r + 1): (j, d) for r, (d, j) in enumerate(near)}
    return out


@pytest.mark.parametrize("band", [40, 4096])
def test_nearest_equals_all_pairs(spark, band):
    """Small bands: several rounds; many equal vectors, ties, and a length with few rows."""
    rng = random.Random(1)
    rows = [(i, n, [round(rng.random(), 1 if n == 2 else 3) for _ in range(n)]) for i in range(500) for n in [rng.choice([2, 3, 5])]]
    rows += [(1000 + i, 2, [0.5, 0.5]) for i in range(60)] + [(2000, 9, [0.1] * 9)]
    df = spark.createDataFrame([*rows, (3000, None, [0.5, 0.5])], "row_id long, n int, ici array<double>")
    got = {(r.qid, r.r): (r.anchor_id, r.d) for r in nearest(df, df, ["n"], 3, exclude_self=True, band=band).collect()}
    assert got == all_pairs(rows, rows, 3, True)
    q, a = df.where("row_id % 3 <> 0"), df.where("row_id % 3 = 0")
    got = {(r.qid, r.r): (r.anchor_id, r.d) for r in nearest(q, a, ["n"], 4, band=band).collect()}
    assert got == all_pairs([r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0], 4, False)


def test_nearest_compares_few_pairs(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, 2, [rng.random(), rng.random()]) for i in range(6000)], "row_id long, n int, ici array<double>")
    r = nearest(df, df, ["n"], 3, exclude_self=True, band=1024, counted=True).first()
    assert r.points == 6000 and r.pairs < 6000 * 6000 / 4
    assert nearest(df.limit(0), df, ["n"], 3).count() == 0


# merges


def plain_merges(seqs, rounds, least, by_pmi=False):
    seqs = [list(s) for s in seqs]
    first = sum(map(len, seqs))
    log = []
    for _ in range(rounds):
        pairs, units = Counter(p for s in seqs for p in zip(s, s[1:])), Counter(t for s in seqs for t in s)
        total = sum(units.values())
        score = lambda p: round(pairs[p] * math.log2(pairs[p] * total / (units[p[0]] * units[p[1]])), 6) if by_pmi else pairs[p]
        open_ = [p for p in pairs if pairs[p] >= least and score(p) > 0]
        if not open_:
            break
        a, b = min(open_, key=lambda p: (-score(p), p))
        for i, s in enumerate(seqs):
            out, j = [], 0
            while j < len(s):
                if s[j : j + 2] == [a, b]:
                    out.append(f"{a}+{b}")
                    j += 2
                else:
                    out.append(s[j])
                    j += 1
            seqs[i] = out
        size = sum(map(len, seqs))
        log.append((a, b, pairs[a, b], size, round(size / first, 9)))
    return log, seqs


def logged(log):
    return [(r["a"], r["b"], r["count"], r["tokens"], round(r["ratio"], 9)) for r in log]


def test_merged_runs():
    t = np.array([1, 1, 1, 2, 1, 1], np.int32)
    assert merged(t, 1, 1, 9).tolist() == [9, 1, 2, 9] and merged(t, 1, 1, 9, before=1).tolist() == [9, 2, 9] and merged(t, 1, 1, 9, after=True).tolist() == [9, 1, 2, 9]
    assert merged(t, 1, 2, 9).tolist() == [1, 1, 9, 1, 1] and merged(t, 2, 1, 9, before=1).tolist() == [1, 1, 9, 1]
    assert merged(np.array([1], np.int32), 1, 1, 9, after=True).tolist() == [9] and merged(np.array([1], np.int32), 1, 1, 9, before=1).tolist() == []


@pytest.mark.parametrize("cut", [3, 1 << 16])
@pytest.mark.parametrize("by_pmi", [False, True])
def test_merges_equal_plain_ones(spark, cut, by_pmi):
    """Parts of three tokens: digrams and runs lie across parts."""
    rng = random.Random(3)
    seqs = ["".join(rng.choice("aaabbcd") for _ in range(rng.randint(1, 40))) for _ in range(12)] + ["a" * 23, "abab" * 5]
    df = spark.createDataFrame([(i, j, t) for i, s in enumerate(seqs) for j, t in enumerate(s)], "seq long, pos long, token string")
    out, log = merge_rounds(df, 14, 2, by_pmi, cut=cut)
    want, left = plain_merges(seqs, 14, 2, by_pmi)
    assert logged(log) == want
    got = defaultdict(list)
    for r in out.orderBy("seq", "pos").collect():
        got[r.seq].append(r.token)
    assert [got[i] for i in range(len(seqs))] == left


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_eighty_merges_of_events(spark):
    from seqspark.plans.q_context import placed

    df = placed(spark, DATA).select("seq", "pos", "token")
    seqs = defaultdict(list)
    for r in df.orderBy("seq", "pos").collect():
        seqs[r.seq].append(r.token)
    assert logged(merge_rounds(df, 80)[1]) == plain_merges(seqs.values(), 80, 2)[0]


def test_merges_without_rows(spark):
    df = spark.createDataFrame([], "seq long, pos long, token string")
    assert merge_rounds(df, 3)[1] == []


# n-gram models


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(4)
    return {i: [rng.choice("aabbcde"[: 3 + i % 5]) for _ in range(rng.randint(1, 30))] for i in range(24)}


@pytest.fixture(scope="module")
def tokens(spark, sequences):
    rows = [(i % 3, i, j, t) for i, s in sequences.items() for j, t in enumerate(s)]
    return spark.createDataFrame(rows, "own int, seq long, pos int, token string")


class PlainKneserNey:
    def __init__(self, seqs, n):
        self.n, self.tables = n, {}
        raw = Counter()
        for s in seqs:
            pad = [N.BOS] * (n - 1) + s
            raw.update(tuple(pad[i : i + n]) for i in range(len(s)))
        grams = {n: raw}
        for k in range(n - 1, 0, -1):
            full = {g[-(k + 1) :] for g in raw}
            grams[k] = Counter(g[1:] for g in full)
        self.vocab = sorted({g[-1] for g in raw})
        for k, c in grams.items():
            of = Counter(c.values())
            d = [0.5] * 3
            if of[1] and of[2]:
                y = of[1] / (of[1] + 2 * of[2])
                d[0] = 1 - 2 * y * of[2] / of[1]
                d[1] = 2 - 3 * y * of[3] / of[2] if of[3] else d[0]
                d[2] = 3 - 4 * y * of[4] / of[3] if of[4] else d[1]
                d = [max(0.0, min(x, top)) for x, top in zip(d, (1, 2, 3))]
            by = defaultdict(dict)
            for g, m in c.items():
                by[g[:-1]][g[-1]] = (m, d[min(m, 3) - 1])
            self.tables[k] = by

    def dist(self, h):
        p = {w: 1 / len(self.vocab) for w in self.vocab}
        for k in range(1, self.n + 1):
            seen = self.tables[k].get(tuple(h[len(h) - k + 1 :]))
            if seen:
                total, off = sum(m for m, _ in seen.values()), sum(x for _, x in seen.values())
                p = {w: max(seen[w][0] - seen[w][1], 0) / total + off / total * p[w] if w in seen else off / total * p[w] for w in self.vocab}
        return p


def scored_rows(df):
    return {(r.seq, r.pos): (r.p, r.hit) for r in df.collect()}


def test_kneser_ney_5_by_hand(spark, sequences, tokens):
    counts = N.SuffixCounts(tokens, 3, 7)
    got = scored_rows(N.kneser_ney(counts, 5))
    cached = scored_rows(L.kneser_ney_cached(tokens, 3, 5, size=6, counts=counts))
    for fold in range(3):
        m = PlainKneserNey([s for i, s in sequences.items() if i % 3 != fold], 5)
        for i, s in sequences.items():
            if i % 3 != fold:
                continue
            for j, t in enumerate(s):
                p = m.dist(([N.BOS] * 4 + s)[j : j + 4])
                assert got[i, j][0] == pytest.approx(p.get(t, got[i, j][0]), abs=1e-9)
                assert got[i, j][1] == (min(p, key=lambda w: (-round(p[w], 12), w)) == t)
                last = Counter(s[max(0, j - 6) : j])
                q = {w: 0.75 * p[w] + 0.25 * (last[w] + 0.5) / (min(j, 6) + 0.5 * len(p)) for w in p}
                if t in q:
                    assert cached[i, j][0] == pytest.approx(q[t], abs=1e-9)
                assert cached[i, j][1] == (min(q, key=lambda w: (-round(q[w], 12), w)) == t)


def test_windows_do_not_depend_on_stretches(spark, tokens):
    x = tokens.withColumn("best", F.lit("a"))
    rows = lambda n: sorted((r.seq, r.pos, r.cc, r.cb, r.cl, sorted(map(tuple, r.rivals))) for r in L._windows(x, 5, n).collect())
    assert rows(7) == rows(1 << 16) and len(rows(7)) == x.count()


@pytest.mark.parametrize("order", [0, 2, 7])
def test_ppm_by_hand(spark, sequences, tokens, order):
    got = scored_rows(N.ppm_d(N.SuffixCounts(tokens, 3, 7), order))
    for fold in range(3):
        seen = defaultdict(Counter)
        for i, s in sequences.items():
            if i % 3 != fold:
                for j, t in enumerate(s):
                    for k in range(min(j, order) + 1):
                        seen[tuple(s[j - k : j])][t] += 1
        vocab = set(seen[()])
        for i, s in sequences.items():
            if i % 3 != fold:
                continue
            for j, t in enumerate(s):
                p, weight, out = {}, 1.0, set()
                for k in range(min(j, order), -1, -1):
                    here = {w: c for w, c in seen.get(tuple(s[j - k : j]), {}).items() if w not in out}
                    if here:
                        total = sum(here.values())
                        p |= {w: weight * (c - 0.5) / total for w, c in here.items()}
                        weight *= 0.5 * len(here) / total
                        out |= set(here)
                if t in vocab:
                    assert got[i, j][0] == pytest.approx(p[t] + weight / len(vocab), abs=1e-9)
                best = max(round(x, 12) for x in p.values())
                assert not got[i, j][1] or round(p[t], 12) == best


# density grid, components


def test_density_grid_equals_single_runs(spark):
    rng = random.Random(5)
    rows = [(i, n, [round(rng.choice([0.2, 0.6]) + rng.gauss(0, 0.04), 2) for _ in range(n)]) for i in range(260) for n in [rng.choice([1, 2, 3])]]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>")
    grid = {(r.eps, r.min_points, r.row_id): r.cluster for r in K.density_grid(df, [0.02, 0.04, 0.08], [3, 6, 12], part=50).collect()}
    assert len(grid) == 9 * len(rows)
    for e, m in ((0.02, 3), (0.04, 6), (0.08, 3), (0.08, 12)):
        one = {r.row_id: r.cluster for r in K.density_clusters(df, eps=e, min_points=m, part=50).collect()}
        assert one == {i: c for (x, y, i), c in grid.items() if (x, y) == (e, m)}


def test_principal_components_by_hand(spark):
    rng = np.random.default_rng(6)
    rows = [(i, n, (rng.normal(size=n) * [1, 2, 3, 4, 5][:n] + rng.normal()).tolist()) for i in range(120) for n in [int(rng.choice([2, 3, 5]))]] + [(500, 4, [1.0] * 4)]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>")
    got = {r.n_clicks: r for r in K.principal_components(df).collect()}
    assert set(got) == {3, 5}
    pc = {r.row_id: (r.pc1, r.pc2) for r in K.pca_2(df).collect()}
    for n, r in got.items():
        ids, x = zip(*[(i, v) for i, m, v in rows if m == n])
        z = (np.array(x) - np.mean(x, axis=0)) / np.std(x, axis=0, ddof=1)
        values, vectors = np.linalg.eigh(np.cov(z.T))
        assert (r.ratio1, r.ratio2) == pytest.approx((values[-1] / values.sum(), values[-2] / values.sum()))
        for c in (0, 1):
            v = vectors[:, -1 - c]
            v = v * (1 if v[np.abs(v).argmax()] > 0 else -1)
            assert [pc[i][c] for i in ids] == pytest.approx((z @ v).tolist(), abs=1e-8)


# sinks


def test_a_large_group_is_read_back_in_order(spark, tmp_path):
    from seqspark.sources import files as SRC

    rows = [("one" if i % 10 else "two", i, f"line {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, line_no int, line string").repartition(7, "line")
    SRC.write_transcripts(df, str(tmp_path / "t"), "g", parts=6)
    got = SRC.read_transcripts(spark, str(tmp_path / "t"), "g").orderBy("g", "part", "at").collect()
    assert len({r.part for r in got if r.g == "one"}) > 3
    for g in ("one", "two"):
        assert [r.line for r in got if r.g == g] == [x for h, _, x in rows if h == g]
    SRC.write_inventory(spark.createDataFrame([("a", 3), ("b", 1)], "segment string, count int"), str(tmp_path / "j"))
    assert sorted(map(tuple, SRC.read_inventory(spark, str(tmp_path / "j"), lines=True).collect())) == [("a", 3), ("b", 1)]


# the learned baseline


def test_softmax_gradient_by_differences():
    rng = np.random.default_rng(7)
    folds, features, classes = 3, 9, 4
    w = rng.normal(size=(folds, features, classes))
    own, x, y, n = rng.integers(0, folds, 20), rng.integers(0, features, (20, 3)), rng.integers(0, classes, 20), rng.integers(1, 5, 20).astype(float)
    _, g = L.softmax_gradient(w, own, x, y, n, folds)
    for at in [(0, 1, 2), (1, 8, 0), (2, 3, 3), (2, 0, 1)]:
        up, down = w.copy(), w.copy()
        up[at] += 1e-6
        down[at] -= 1e-6
        slope = (L.softmax_gradient(up, own, x, y, n, folds)[0][at[0]] - L.softmax_gradient(down, own, x, y, n, folds)[0][at[0]]) / 2e-6
        assert g[at] == pytest.approx(slope, abs=1e-4)


def test_learned_baseline_equals_a_plain_fit(spark, sequences, tokens):
    """Against plain gradient descent in numpy, every fold by itself."""
    got = {r.fold: r for r in L.learned_baseline(tokens, 3, k=2, max_iter=60, penalty=1e-2).collect()}
    vocab = ["<PAD>", *sorted({t for s in sequences.values() for t in s})]
    at, v = {t: i for i, t in enumerate(vocab)}, len(vocab)
    data = [(i % 3, [at[s[j - 1]], v + at[s[j - 2] if j > 1 else "<PAD>"], 2 * v], at[s[j]]) for i, s in sequences.items() for j in range(1, len(s))]
    own, x, y = (np.array(c) for c in zip(*data))
    for fold in range(3):
        train, w = own != fold, np.zeros((1, 2 * v + 1, v))
        for _ in range(3000):
            _, g = L.softmax_gradient(w, np.full(train.sum(), -1), x[train], y[train], np.ones(train.sum()), 1)
            free = w.copy()
            free[:, -1] = 0
            w -= 0.5 * (g / train.sum() + 1e-2 * free)
        z = w[0][x[~train]].sum(axis=1)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        assert got[fold].n == (~train).sum() and got[fold].bits == pytest.approx(-np.log2(p[np.arange(len(p)), y[~train]]).mean(), abs=2e-3)


# the corpus of transcripts


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_dialogue_corpus_keeps_its_bounds(spark):
    """Words of whole conversations up to the budget, chunks of one conversation, ids below the cap, tiers and masks of whole chunks."""
    from seqspark.functions import columns as C
    from seqspark.plans import flows as FL
    from seqspark.plans.q_corpus import transcript_lines
    from seqspark.sources import files as SRC

    lines = transcript_lines(spark, DATA)
    rows = FL.dialogue_corpus(lines, budget=1500, cap=60, target=40).collect()
    words = defaultdict(list)
    for r in SRC.utterances(lines).where("mor is not null").select("path", "utt", C.lemmas(F.col("mor")).alias("w")).collect():
        words[r.path] += r.w
    got = defaultdict(list)
    for r in rows:
        got[r.seq].append(r)
    sizes = {s: len(x) for s, x in got.items()}
    assert all(len(words[s]) == n for s, n in sizes.items()) and sum(sizes.values()) >= 1500 > sum(sizes.values()) - max(sizes.values())
    assert {r.word_id for r in rows} <= set(range(60)) and max(r.word_id for r in rows) == 59
    chunks = defaultdict(list)
    for r in rows:
        chunks[r.cid].append(r)
    assert all(len({(r.seq, r.tier, r.masked) for r in x}) == 1 for x in chunks.values())
    assert all((r.actor, r.dt, r.timed) == ("UNK", -1.0, 0) if r.masked else r.timed == 1 and r.dt >= 0 for r in rows)
    hidden = sum(r.masked for r in rows)
    assert 0.3 * len(rows) - 1 <= hidden < 0.3 * len(rows) + max(map(len, chunks.values()))


def test_short_sequences_share_rows(spark, monkeypatch):
    """Weighted short sequences are merged several a row, beside one in parts; the log and the tokens are those of the plain way over copies."""
    from seqspark.operators import merges

    rows_of = []
    write = merges.written
    monkeypatch.setattr(merges, "written", lambda df, name: (out := write(df, name), name == "merge-parts" and rows_of.append(out.count()))[0])
    rng = random.Random(5)
    seqs = [("".join(rng.choice("aabc") for _ in range(rng.randint(1, 6))), rng.randint(1, 3)) for _ in range(400)] + [("ab" * 30 + "aaa" * 15, 2)]
    df = spark.createDataFrame([(i, j, t, w) for i, (s, w) in enumerate(seqs) for j, t in enumerate(s)], "seq long, pos long, token string, w long")
    out, log = merge_rounds(df, 3, weight="w", cut=50)
    want, left = plain_merges([s for s, w in seqs for _ in range(w)], 3, 2)
    assert logged(log) == want
    got = defaultdict(list)
    for r in out.orderBy("seq", "pos").collect():
        got[r.seq].append(r.token)
        assert r.w == seqs[r.seq][1]
    assert [got[i] for i, (_, w) in enumerate(seqs) for _ in range(w)] == left
    assert max(rows_of) < 80, rows_of


def test_tokens_of_merges_are_bytes(spark, monkeypatch):
    """Tokens are kept as bytes, one a token up to 128 names of a row and two beyond, which merges pass; the changes of all passes are read as one table."""
    from seqspark.operators import merges

    kinds, scans = set(), []
    write, read = merges.written, merges.together
    monkeypatch.setattr(merges, "written", lambda df, name: (out := write(df, name), name == "merge-parts" and kinds.update((out.schema["tokens"].dataType.simpleString(), r.n, len(r.names) > 128) for r in out.select(F.expr("length(tokens) / (size + size(weight) - 1)").alias("n"), "names").collect()))[0])
    monkeypatch.setattr(merges, "together", lambda schema, *t: (scans.append(len(t)), read(schema, *t))[1])
    rng = random.Random(11)
    words = [f"t{i:03}" for i in range(122)]
    seqs = [words[:], *[[rng.choice(words[:5]) for _ in range(rng.randint(1, 30))] for _ in range(60)]]
    df = spark.createDataFrame([(i, j, t) for i, s in enumerate(seqs) for j, t in enumerate(s)], "seq long, pos long, token string").coalesce(1)
    out, log = merge_rounds(df, 14)
    want, left = plain_merges(seqs, 14, 2)
    assert logged(log) == want
    got = defaultdict(list)
    for r in out.orderBy("seq", "pos").collect():
        got[r.seq].append(r.token)
    assert [got[i] for i in range(len(seqs))] == left
    assert {k[0] for k in kinds} == {"binary"} and all(n == 1 + wide for _, n, wide in kinds) and {k[2] for k in kinds} == {False, True}
    assert 1 < max(scans) <= merges.COMPACT + 1


@pytest.mark.parametrize("stretch, dense", [(1, 1 << 20), (7, 0), (1 << 18, 1 << 20)])
def test_lag_counts_make_no_row_a_pair(spark, stretch, dense):
    """Counts by stretches equal plain ones, with null tokens and a null sequence; no pair becomes a row before it is counted."""
    from seqspark.operators import stats as S

    rng = random.Random(7)
    seqs = {i or None: [rng.choice(["a", "b", "c", None]) for _ in range(rng.choice([1, 3, 9, 40]))] for i in range(30)}
    df = spark.createDataFrame([(i, j, t) for i, s in seqs.items() for j, t in enumerate(s)], "seq long, pos long, token string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = {(r.lag, r.a, r.b): r.c for r in S.lag_counts(df, "seq", "pos", "token", 6, stretch, dense).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter((k, a, b) for s in seqs.values() for k in range(1, 7) for a, b in zip(s, s[k:]) if b is not None)
    plan = S.mi_decay(df, "seq", "pos", "token")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    assert S.mi_decay(df.limit(0), "seq", "pos", "token").collect() == []
