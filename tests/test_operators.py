"""Operators on small rows: edge cases, brute force and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqspark.operators import cluster as K
from seqspark.operators import context as X
from seqspark.operators import corpus as CO
from seqspark.operators import lm as L
from seqspark.operators import match as M
from seqspark.operators import patterns as P
from seqspark.operators import stages as ST
from seqspark.operators import stats as S
from seqspark.operators import tokens as T
from seqspark.sources import files as SRC


def test_running(spark):
    rows = [(i * 37 % 101, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, c int").repartition(7)
    got = sorted((r.k, r["rank"], r.running) for r in ST.running(df, ["k"], "c").collect())
    total = 0
    for n, (k, c) in enumerate(sorted(rows), 1):
        total += c
        assert got[n - 1] == (k, n, total)
    assert ST.running(df.limit(0), ["k"], "c").count() == 0


def test_quantiles_between_equal_values_are_that_value(spark):
    from seqspark.operators.stages import quantiles

    df = spark.createDataFrame([(x, x / 100) for x in range(1, 51) for _ in range(23)], "g int, x double")
    got = quantiles(df, ["g"], "x", [i / 7 for i in range(8)] + [i / 10 for i in range(11)], few=10).collect()
    assert len(got) == 50 and all(set(r.q) == {r.g / 100} for r in got)


def test_reuse(spark, tmp_path):
    calls = []

    def compute(df):
        calls.append(1)
        return df.groupBy("k").count()

    a = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    for df in (a, a.repartition(3), a.union(a.limit(1))):
        ST.reuse(df, str(tmp_path), compute).collect()
    assert len(calls) == 2


EV = "seq string, actor string, t double, us long, row_id long, label string, tempo int, dur double, clicks int"


def test_context_edges(spark):
    rows = [
        ("r", "a", 0.0, 0, 1, "x", 1, 0.50, 4), ("r", "b", 0.3, 300_000, 2, "x", 1, 0.50, 5), ("r", "a", 10.0, 10_000_000, 3, "x", 1, 0.60, 5), ("r", "a", 20.1, 20_100_000, 4, "x", 1, 0.60, 6),
        ("r", None, 20.2, 20_200_000, 5, "x", 1, 0.6, 5), ("r", "a", None, None, 6, "x", 1, 0.6, 5), (None, "a", 1.0, 1_000_000, 7, "x", 1, 0.6, 5), ("r", "a", 20.1, 20_100_000, 8, None, 1, 0.6, 5),
    ]
    df = spark.createDataFrame(rows, EV)
    pos = {r.row_id: r.pos for r in X.item_position(df, "seq", "t", "row_id").collect()}
    assert pos == {1: 0, 2: 1, 3: 2, 4: 3, 8: 4, 5: 5, 6: 6, 7: 0}
    tr = {r.row_id: r.trend for r in X.duration_trend(df, ["seq", "actor"], "t", "row_id", "label", "tempo", "dur").collect()}
    assert tr == {1: None, 2: None, 3: "/", 4: None, 5: None, 6: None, 7: None, 8: None}  # 10 s apart counts, 10.1 s doesn't
    orn = {r.row_id: r.ornament for r in X.ornament(df, ["seq", "actor"], "t", "row_id", "clicks").collect()}
    assert orn[3] == 1 and orn[1] == 0 and orn[5] is None and orn[6] is None and orn[7] is None and orn[4] == 1
    sync = {r.row_id: r.sync for r in X.synchrony(df, "seq", "actor", "us").collect()}
    assert sync == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0, 8: 1}  # exactly 0.3 s counts; an unknown actor is another one, but has no flag
    gaps = {r.row_id: r.gap for r in X.time_since_timed(X.item_position(df, "seq", "t", "row_id"), "seq", "t", ["pos"]).collect()}
    assert gaps[1] == 0 and gaps[6] == -1 and gaps[8] == 0 and gaps[7] == 0 and abs(gaps[3] - 9.7) < 1e-9


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(0)
    rows = [("s%d" % (i % 3), "a%d" % rng.randrange(3), float(rng.randrange(40)), i, "t%d" % rng.randrange(4)) for i in range(200)]
    out = []
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "seq string, actor string, t double, row_id long, tok string").repartition(rng.randrange(1, 6))
        x = X.item_position(df, "seq", "t", "row_id")
        lines = X.speaker_runs(x, "seq", ["pos"], "t", "actor", "tok", 5.0)
        out.append((sorted(map(tuple, lines.collect())), sorted(map(tuple, S.mi_decay(x.withColumn("token", F.col("tok")), "seq", "pos", "token", 3).select("lag", "n", F.round("mi", 9)).collect()))))
    assert out[0] == out[1]


def brute_density(rows, eps, m):
    """Weighted points of one length: core components, borders to the nearest core."""
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows])
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 9)
    core = (d <= eps).sum(1) >= m
    lab = {}
    for i in np.flatnonzero(core):
        if i in lab:
            continue
        stack, seen = [i], {i}
        while stack:
            a = stack.pop()
            for b in np.flatnonzero(core & (d[a] <= eps)):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        for a in seen:
            lab[a] = frozenset(ids[x] for x in seen)
    near = {i: d[i][core].min() if core.any() else np.inf for i in range(len(rows))}
    return ids, core, lab, near


def test_density_clusters(spark):
    rng = np.random.default_rng(3)
    pts = np.round(np.concatenate([c + 0.03 * rng.standard_normal((60, 3)) for c in ([0.2, 0.2, 0.2], [0.5, 0.2, 0.2], [0.9, 0.9, 0.9])] + [rng.uniform(0, 2, (40, 3))]), 2)
    rows = [(i, 4, p.tolist()) for i, p in enumerate(pts)] + [(1000 + i, 5, [0.1] * 4) for i in range(12)] + [(2000, 6, [0.1] * 5)]
    got = {r.row_id: r.cluster for r in K.density_clusters(spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>"), eps=0.08, min_points=8, part=16).collect()}
    ids, core, lab, near = brute_density([(r[0], r[2]) for r in rows if r[1] == 4], 0.08, 8)
    for i, rid in enumerate(ids):
        if core[i]:
            mates = {ids[j] for j in range(len(ids)) if core[j] and got[ids[j]] == got[rid]}
            assert mates == set(lab[i])
        else:
            assert (got[rid] is not None) == (near[i] <= 0.08)
    assert len({got[1000 + i] for i in range(12)}) == 1 and got[1000] == 1000 and got[2000] is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(K.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == dict.fromkeys(range(51), 0) | {100: 100, 150: 100, 200: 100}


def test_merges(spark):
    seqs = {"p": "aaabaaab", "q": "abababa", "r": "c"}
    df = spark.createDataFrame([(s, i, c) for s, t in seqs.items() for i, c in enumerate(t)], "seq string, pos int, token string")
    out, log = K.merge_rounds(df, 2, joiner="")
    assert (log[0]["a"], log[0]["b"], log[0]["count"]) == ("a", "b", 5)
    got = {}
    for r in out.orderBy("seq", "pos").collect():
        got.setdefault(r.seq, []).append(r.token)
    assert {s: "".join(t) for s, t in got.items()} == seqs
    same, log = K.merge_rounds(spark.createDataFrame([("p", i, "a") for i in range(7)], "seq string, pos int, token string"), 1, joiner="")
    assert [r.token for r in same.orderBy("pos").collect()] == ["aa", "aa", "aa", "a"] and log[0]["tokens"] == 4
    assert K.merge_rounds(df.limit(0), 3)[1] == []


def test_knn_ties_and_parts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 3, np.round(rng.uniform(0, 0.3, 2), 1).tolist(), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, n_clicks int, ici array<double>, label string")
    for part in (7, 1000):
        got = {}
        for r in M.knn(df, df, ["n_clicks"], 3, exclude_self=True, part=part).collect():
            got.setdefault(r.qid, {})[r.r] = r.anchor_id
        for i, _, v, _ in rows:
            want = sorted((round(math.dist(v, w), 9), j) for j, _, w, _ in rows if j != i)[:3]
            assert [got[i][k] for k in (1, 2, 3)] == [j for _, j in want]
    few = df.limit(4)
    assert M.knn_match(df, few, ["n_clicks"]).count() == 0
    t = {r.label: r.tau for r in M.tau_table(df.where("row_id < 2")).collect()}
    assert t == {"a": 0.10, "b": 0.10}  # single members and no populated class: the floor


def seqs(spark, n=12, k=4, length=30):
    rng = random.Random(1)
    rows = [(s, i, "t%d" % min(rng.randrange(k), rng.randrange(k)), s % 3) for s in range(n) for i in range(length)]
    return spark.createDataFrame(rows, "seq int, pos int, token string, own int"), rows


def brute_kn(rows, fold, n):
    """Probability of every token after every padded history that a test sequence has."""
    by = {}
    for s, _, t, own in rows:
        by.setdefault((s, own), []).append(t)
    grams, vocab = [{} for _ in range(n + 1)], set()
    left = [{} for _ in range(n + 1)]
    for (_, own), toks in by.items():
        if own == fold:
            continue
        full = [L.BOS] * (n - 1) + toks
        vocab |= set(toks)
        for i in range(n - 1, len(full)):
            g = tuple(full[i - n + 1 : i + 1])
            grams[n].setdefault(g[:-1], {}).setdefault(g[-1], 0)
            grams[n][g[:-1]][g[-1]] += 1
            for k in range(1, n):
                left[k].setdefault(tuple(full[i - k + 1 : i]), {}).setdefault(full[i], set()).add(full[i - k])
    for k in range(1, n):
        grams[k] = {h: {w: len(x) for w, x in c.items()} for h, c in left[k].items()}
    disc = []
    for k in range(n + 1):
        c = [sum(v == j for h in grams[k].values() for v in h.values()) for j in range(5)] if k else [0] * 5
        if not c[1] or not c[2]:
            disc.append((0.5,) * 3)
            continue
        y = c[1] / (c[1] + 2 * c[2])
        d1 = 1 - 2 * y * c[2] / c[1]
        d2 = 2 - 3 * y * c[3] / c[2] if c[3] else d1
        d3 = 3 - 4 * y * c[4] / c[3] if c[4] else d2
        disc.append((max(0, min(d1, 1)), max(0, min(d2, 2)), max(0, min(d3, 3))))

    def p(h, w):
        k = len(h) + 1
        lower = p(h[1:], w) if h else 1 / len(vocab)
        c = grams[k].get(h)
        if not c:
            return lower
        d = lambda v: disc[k][min(v, 3) - 1] if v else 0
        tot = sum(c.values())
        return max(c.get(w, 0) - d(c.get(w, 0)), 0) / tot + sum(map(d, c.values())) / tot * lower

    return p, vocab, by


def test_kneser_ney(spark):
    df, rows = seqs(spark)
    got = {(r.seq, r.pos): r for r in L.kneser_ney(df, 3, 3).collect()}
    for fold in range(3):
        p, vocab, by = brute_kn(rows, fold, 3)
        for (s, own), toks in by.items():
            if own != fold:
                continue
            full = [L.BOS] * 2 + toks
            for i, t in enumerate(toks):
                h = tuple(full[i : i + 2])
                dist = {w: p(h, w) for w in vocab}
                assert abs(sum(dist.values()) - 1) < 1e-9
                assert abs(got[s, i].p - dist.get(t, 0)) < 1e-9
                top = min(dist, key=lambda w: (-round(dist[w], 12), w))
                assert got[s, i].hit == (top == t)


def test_ppm_d(spark):
    df, rows = seqs(spark, 9, 5, 20)
    got = {(r.seq, r.pos): r for r in L.ppm_d(df, 3, 2).collect()}
    for fold in range(3):
        by = {}
        for s, _, t, own in rows:
            by.setdefault((s, own), []).append(t)
        cnt, vocab = [{} for _ in range(3)], set()
        for (_, own), toks in by.items():
            if own != fold:
                vocab |= set(toks)
                for i, t in enumerate(toks):
                    for k in range(min(i, 2) + 1):
                        c = cnt[k].setdefault(tuple(toks[i - k : i]), {})
                        c[t] = c.get(t, 0) + 1
        for (s, own), toks in by.items():
            if own != fold:
                continue
            for i, t in enumerate(toks):
                seen, p, w = set(), dict.fromkeys(vocab, 0.0), 1.0
                for k in range(min(i, 2), -1, -1):
                    c = cnt[k].get(tuple(toks[i - k : i]))
                    new = {x: v for x, v in (c or {}).items() if x not in seen}
                    if not new:
                        continue
                    tot = sum(new.values())
                    for x, v in new.items():
                        p[x] += w * (v - 0.5) / tot
                    w *= 0.5 * len(new) / tot
                    seen |= set(new)
                p = {x: v + w / len(vocab) for x, v in p.items()}
                assert abs(sum(p.values()) - 1) < 1e-9
                assert abs((got[s, i].p or 0) - p.get(t, 0)) < 1e-9
                assert got[s, i].hit == (min(p, key=lambda x: (-round(p[x], 9), x)) == t)


def test_timing(spark):
    def brute(a, b):
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
        x, y = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
        n = max(len(a), len(b))
        u = lambda z: np.pad(np.array(z) / (sum(z) + 1e-9), (0, n - len(z)))
        m = min(len(a), len(b))
        corr = float(np.corrcoef(a[:m], b[:m])[0, 1]) if m > 1 and np.std(a[:m]) and np.std(b[:m]) else 0.0
        return abs(len(a) - len(b)), np.mean([min(abs(p - q) for q in y) for p in x]) / max(y[-1], 1e-6), math.sqrt(np.mean((u(a) - u(b)) ** 2)), d[-1, -1] / n, corr

    rng = np.random.default_rng(1)
    rows = [(rng.uniform(0.05, 0.5, rng.integers(1, 7)).tolist(), rng.uniform(0.05, 0.5, rng.integers(1, 7)).tolist()) for _ in range(30)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select("a", "b", P.timing_metrics(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        assert np.allclose(list(r.m), brute(r.a, r.b), atol=1e-7)
    empty = spark.createDataFrame([([], [0.1, 0.2])], "a array<double>, b array<double>").select(P.timing_metrics(F.col("a"), F.col("b")).alias("m")).first().m
    assert empty.dtw == 2.0 and empty.rmse == 1.0 and empty.corr == 0.0 and empty.click_err == 2


TRANSCRIPT = """@UTF8
@ID:\tzho|Tong|MOT||female|||Mother|||
@ID:\tzho|Tong|CHI|1;07.18|male|||Target_Child|||
*MOT:\there's the balloon .
%mor:\tpro:exist|here~cop|be&3S det|the
\tn|balloon .
%com:\tlooks
\tn|nothing
*CHI:\tballoons !
%mor:\tn|balloon-PL !
*MOT:\tmm
@End"""


def test_transcripts(spark, tmp_path):
    (tmp_path / "a.cha").write_text(TRANSCRIPT)
    lines = SRC.read_lines(spark, str(tmp_path))
    got = [(r.speaker, r.mor) for r in SRC.utterances(lines).orderBy("utt").collect()]
    assert got == [("MOT", "pro:exist|here~cop|be&3S det|the n|balloon ."), ("CHI", "n|balloon-PL !"), ("MOT", None)]
    assert [r.months for r in SRC.child_age(lines).collect()] == [19]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.txt").write_text("a1 loose\nFile: one\n  Speaker 1: a1 /b2\n  In chorus -c3\nFile: two\n d4")
    m = SRC.marked_dialogue(SRC.read_lines(spark, str(tmp_path / "d"))).orderBy("line_no", "pos").collect()
    assert [(r.section, r.token, r.marked) for r in m] == [("unknown", "a1", "a1"), ("one", "a1", "a1"), ("one", "/b2", "/b2"), ("one", "-c3", "-c3*"), ("two", "d4", "d4")]


def test_csv_events(spark, tmp_path):
    schema = SRC.event_schema(3)
    head = [f.name for f in schema]
    row = {"source": "s", "n_clicks": "3", "ICI1": "0.1", "ICI2": "0.2", "coda_duration_s": "0.3"}
    (tmp_path / "e.csv").write_text(",".join(head) + "\n" + ",".join(row.get(h, "") for h in head) + "\n")
    r = SRC.read_events(spark, str(tmp_path / "e.csv"), 3).first()
    assert r.ici == [0.1, 0.2] and r.clan is None and r.n_clicks == 3


def test_names(spark):
    rows = [("c1", 5, "R", 1.0), ("c2", 5, "R", 1.2), ("c3", 5, "R", 1.5), ("c4", 4, "D", 1.0), ("c5", 4, "2+2", 1.0)]
    df = spark.createDataFrame(rows, "cluster string, n int, shape string, mean double")
    assert {r.cluster: r.name for r in K.tempo_rank_names(df, "n", "shape", "mean").collect()} == {"c1": "5R1", "c2": "5R2", "c3": "5R3", "c4": "4D", "c5": "2+2"}
    one = spark.createDataFrame([("c1", 5, "R", 1.0), ("c2", 5, "i", 1.0)], df.schema)
    got = {r.cluster: r.name for r in K.tempo_rank_names(one, "n", "shape", "mean", True, df).collect()}
    assert got == {"c1": "5RP1", "c2": "5P1"}


def test_budgets(spark):
    df = spark.createDataFrame([(i, 10) for i in range(20)], "id int, size int")
    assert [r.id for r in CO.budgeted_prefix(df, "size", 35, ["id"]).orderBy("id").collect()] == [0, 1, 2, 3]
    t = {r.id: r.tier for r in CO.allocate_tiers(df, "size", [("a", 25), ("b", 30), ("c", 1000)], ["id"]).collect()}
    assert [t[i] for i in range(8)] == ["a", "a", "a", "b", "b", "b", "c", "c"] and None not in t.values()
    w = CO.weighted_sample(df.withColumn("w", F.col("id") + 1), "id", "w", "size", 50)
    assert w.count() == 5 and CO.weighted_sample(df.limit(0).withColumn("w", F.lit(1)), "id", "w", "size", 5).count() == 0
    f = L.tier_folds(df.select(F.col("id").alias("seq"), F.when(F.col("id") < 15, "clean").otherwise("held").alias("tier")), "seq", "tier", 5)
    assert f.where("part = 'test'").groupBy("seq").count().where("count <> 1").count() == 0 and f.where("tier = 'held' and part <> 'train'").count() == 0


def test_windows_of_short_sequences(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("t", 0, "c")], "seq string, pos int, token string")
    got = {(r.seq, r.pos): (r.context, r.target) for r in T.context_windows(df, "seq", "pos", "token", 3).collect()}
    assert got == {("s", 1): (["<PAD>", "<PAD>", "a"], "b")}
    assert T.strict_windows(df, "seq", "pos", "token", 3).count() == 0
    assert S.freq_stats(df.limit(0), "token").first().n is None


def test_learned_baseline_scores_every_fold(spark):
    rows = [(s % 3, s, i, "abc"[(s + i) % 3]) for s in range(6) for i in range(8 + s)]
    got = {r.fold: r for r in L.learned_baseline(spark.createDataFrame(rows, "own int, seq long, pos int, token string"), 3, k=2, max_iter=10).collect()}
    assert {f: r.n for f, r in got.items()} == {f: sum(8 + s - 1 for s in range(6) if s % 3 == f) for f in range(3)}
    assert all(r.acc == 1 for r in got.values())


def test_soft_chunks_of_long_conversations(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["a", "b", None]), rng.choice([0, 5, 30, None]), 9) for c, n in ((1, 30_000), (2, 40), (None, 50), (3, 1)) for i in range(n)]
    want = []
    for c in (1, 2, None, 3):
        who, seen, chunk = None, 0, 0
        for r in (r for r in rows if r[0] == c):
            if seen >= 80 and r[2] and who and r[2] != who:
                chunk, seen = chunk + 1, 0
            seen, who = seen + (r[3] or 0), r[2]
            want.append((c, r[1], chunk))
    df = spark.createDataFrame(rows, "c int, i int, a string, n int, chunk int")
    out = T.soft_chunks(df, "c", "i", "a", "n")
    assert out.columns == ["c", "i", "a", "n", "chunk"]
    assert sorted(map(repr, ((r.c, r.i, r.chunk) for r in out.collect()))) == sorted(map(repr, want))
    assert T.soft_chunks(df.limit(0), "c", "i", "a", "n").count() == 0


def test_quantiles_count_equal_values_once(spark, monkeypatch):
    """Weighted values, in one aggregate and ranked, against all rows of a group in order; equal values are one written row."""
    import random

    from seqspark.operators import stages

    rng = random.Random(12)
    rows = [(g, float(rng.randrange(6)), rng.randrange(1, 4)) for g in ("a", "b", None) for _ in range(40)] + [("c", 2.5, 1), ("a", None, 3)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    probs, made = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0], []
    kept = stages.written
    monkeypatch.setattr(stages, "written", lambda x, name="stage": made.append((name, kept(x, name))) or made[-1][1])
    for few in (1000, 2):
        for weight in (None, "w"):
            got = {r.g: r.q for r in stages.quantiles(df, ["g"], "x", probs, few=few, weight=weight).collect()}
            for g in ("a", "b", "c", None):
                v = sorted(x for h, x, w in rows if h == g and x is not None for _ in range(w if weight else 1))
                want = [v[int(p * (len(v) - 1))] + (p * (len(v) - 1) - int(p * (len(v) - 1))) * (v[min(int(p * (len(v) - 1)) + 1, len(v) - 1)] - v[int(p * (len(v) - 1))]) for p in probs]
                assert got[g] == pytest.approx(want, abs=1e-9), (g, few, weight)
    assert {x.count() for name, x in made if name == "values"} == {19}


def test_long_dialogues_are_read_in_stretches(spark):
    """Sections go on over stretches without a header; no window holds more of a path than a stretch, so a path isn't one task."""
    from seqspark.sources import files as SRC

    lines = [("p", i, f"File: s{i}" if i in (7, 8, 55) else f"a{i % 5} - /b1{' In chorus' if i % 3 == 0 else ''}") for i in range(90) if i not in (20, 21, 22)] + [("q", i, "a1") for i in (0, 70)]
    df = spark.createDataFrame(lines, "path string, line_no long, line string")
    kinds = [set(map(tuple, SRC.marked_dialogue(df, stretch=n).collect())) for n in (10, 1 << 16)]
    want = set()
    for path in ("p", "q"):
        section = "unknown"
        for _, i, line in sorted(x for x in lines if x[0] == path):
            if line.startswith("File:"):
                section = line[5:].strip()
                continue
            for pos, t in enumerate(line.replace(" In chorus", "").split(" - ")):
                want.add((path, section, i, pos, t, t + "*" * ("In chorus" in line)))
    assert kinds == [want, want]
    plan = SRC.marked_dialogue(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "[path#" in plan and all("stretch#" in line.split("], [")[1] for line in plan.splitlines() if "Window [" in line)
