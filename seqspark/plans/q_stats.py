"""Queries of the sequence statistics over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import stats as S

from .q_context import GAPPED, HOUR, POS, placed
from .registry import query
from .views import EV, WORD, events, words


def rounded(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


FREQ = """c AS (SELECT {tok} AS tok, count(*) AS c FROM {src} GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c DESC, tok) AS k, sum(c) OVER () AS n, count(*) OVER () AS v, sum(c) OVER (ORDER BY c DESC, tok ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT CAST(max(n) AS BIGINT) AS n, count(*) AS v, round(-sum(c / n * log2(c / n)), 6) AS entropy, max(c) AS modal, round(sum(CASE WHEN k <= greatest(1, v // 100) THEN c END) / max(n), 6) AS top1,
  round(sum(CASE WHEN k <= greatest(1, v // 10) THEN c END) / max(n), 6) AS top10, min(CASE WHEN run >= n * 0.9 THEN k END) AS p90 FROM r"""


@query("a17_freq_stats", f"WITH {WORD}, " + FREQ.format(tok="token", src="word"))
def a17(spark, d):
    return rounded(S.freq_stats(words(spark, d), "token"), "entropy", "top1", "top10")


@query("a18_type_token_ratio", f"WITH {WORD} SELECT doc_id, count(*) AS n, count(DISTINCT token) AS v, round(count(DISTINCT token) / count(*), 6) AS ttr FROM word GROUP BY doc_id")
def a18(spark, d):
    return rounded(S.type_token_ratio(words(spark, d), "doc_id", "token"), "ttr")


@query("a24_zipf_fit", f"WITH {WORD}, c AS (SELECT token, count(*) AS c FROM word GROUP BY 1), r AS (SELECT log10(c) AS y, log10(row_number() OVER (ORDER BY c DESC, token)) AS x FROM c) SELECT round(-regr_slope(y, x), 6) AS alpha, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM r")
def a24(spark, d):
    return rounded(S.zipf_fit(words(spark, d), "token"), "alpha", "intercept", "r2")


@query("t01_top_k", f"WITH {WORD} SELECT token, count(*) AS c FROM word GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25")
def t01(spark, d):
    return S.top_k(words(spark, d), "token", 25)


MI = f"""WITH {EV}, {POS}, pr AS (SELECT l.lag, a.token AS a, b.token AS b FROM pos a JOIN (SELECT unnest(range(1, 21)) AS lag) l ON true JOIN pos b ON b.seq = a.seq AND b.pos = a.pos + l.lag),
j AS (SELECT lag, a, b, count(*) AS c FROM pr GROUP BY ALL), t AS (SELECT *, sum(c) OVER (PARTITION BY lag) AS n, sum(c) OVER (PARTITION BY lag, a) AS ca, sum(c) OVER (PARTITION BY lag, b) AS cb FROM j),
mi AS (SELECT CAST(lag AS INTEGER) AS lag, CAST(max(n) AS BIGINT) AS n, greatest(sum(c / n * log2(c * n / (ca * cb))), 0) AS mi FROM t GROUP BY lag)"""


@query("a25_mi_decay", MI + " SELECT lag, n, round(mi, 6) AS mi FROM mi")
def a25(spark, d):
    return rounded(S.mi_decay(placed(spark, d), "seq", "pos", "token"), "mi")


@query(
    "a26_decay_models",
    MI + """, x AS (SELECT 'power' AS model, ln(mi) AS y, ln(lag) AS x FROM mi WHERE mi > 0 UNION ALL SELECT 'exponential', ln(mi), CAST(lag AS DOUBLE) FROM mi WHERE mi > 0),
g AS (SELECT model, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_syy(y, x) AS syy FROM x GROUP BY model)
SELECT model, round(slope, 4) AS slope, round(r2, 4) AS r2, round(syy * (1 - r2), 4) AS sse, round(n * ln(syy * (1 - r2) / n) + 4, 4) AS aic FROM g WHERE n >= 4""",
)
def a26(spark, d):
    return rounded(S.decay_models(S.mi_decay(placed(spark, d), "seq", "pos", "token")), "slope", "r2", "sse", "aic", digits=4)


def gapped(spark, d):
    from seqspark.functions import columns as C
    from seqspark.operators import context as X

    p = X.time_since_timed(placed(spark, d), "seq", "t", ["pos"])
    p = X.actor_switch(p, "seq", "token", ["pos"])
    return p.withColumn("b", C.gap_bucket(F.col("gap") / HOUR, F.col("pos") > 0, F.col("switched")))


@query(
    "a27_j17_pause_jsd",
    GAPPED + """, x AS (SELECT b, pk AS l, token AS r FROM bk WHERE pk IS NOT NULL), n AS (SELECT b, count(*) AS n FROM x GROUP BY b HAVING count(*) >= 20),
lc AS (SELECT b, l AS tok, count(*) AS c FROM x GROUP BY ALL), rc AS (SELECT b, r AS tok, count(*) AS c FROM x GROUP BY ALL),
f AS (SELECT coalesce(lc.b, rc.b) AS b, coalesce(lc.c, 0) AS l, coalesce(rc.c, 0) AS r FROM lc FULL JOIN rc ON lc.b = rc.b AND lc.tok = rc.tok),
g AS (SELECT b, (l / sum(l) OVER w + 1e-8) / (1 + count(*) OVER w * 1e-8) AS p, (r / sum(r) OVER w + 1e-8) / (1 + count(*) OVER w * 1e-8) AS q FROM f WINDOW w AS (PARTITION BY b))
SELECT b AS bucket, n, round(sum(0.5 * p * log2(2 * p / (p + q)) + 0.5 * q * log2(2 * q / (p + q))), 6) AS jsd FROM g JOIN n USING (b) GROUP BY b, n""",
)
def a27(spark, d):
    return rounded(S.pause_context_jsd(gapped(spark, d), "seq", "pos", "token", "b"), "jsd")


NG = f"""WITH {EV}, {POS}, s AS (SELECT *, [token, lead(token) OVER w, lead(token, 2) OVER w, lead(token, 3) OVER w] AS g FROM pos WINDOW w AS (PARTITION BY seq ORDER BY pos)),
x AS (SELECT n, g[1:n] AS gram FROM s, (SELECT unnest([2, 3, 4]) AS n) WHERE g[n] IS NOT NULL), c AS (SELECT n, gram, count(*) AS c FROM x GROUP BY ALL),
t AS (SELECT n, sum(c) AS total FROM c GROUP BY n), u AS (SELECT token, count(*) / (SELECT count(*) FROM pos) AS p FROM pos GROUP BY 1),
q AS (SELECT n, gram, c, sum(log2(p)) AS indep FROM (SELECT n, gram, c, unnest(gram) AS token FROM c WHERE c >= 5) JOIN u USING (token) GROUP BY ALL),
z AS (SELECT q.n, array_to_string(gram, ' ') AS gram, c, log2(c / total) - indep AS pmi FROM q JOIN t ON q.n = t.n)
SELECT CAST(n AS INTEGER) AS n, gram, c, round(pmi, 6) AS pmi, round(c * pmi, 6) AS saving FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY round(c * pmi, 6) DESC, gram) AS r FROM z) WHERE r <= 20"""


@query("a28_ngram_pmi", NG)
def a28(spark, d):
    return rounded(S.ngram_pmi(placed(spark, d), "seq", "pos", "token"), "pmi", "saving")


@query(
    "a29_cluster_metadata",
    f"""WITH {EV}, x AS (SELECT token, value, CASE WHEN k % 4 = 0 THEN -1.0 ELSE k / 10 END AS gap, k % 2 AS flag, seq % 7 AS actor FROM ev),
t AS (SELECT token, string_agg(CAST(actor AS VARCHAR), ',' ORDER BY r) AS top FROM (SELECT token, actor, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, actor) AS r FROM x GROUP BY token, actor) WHERE r <= 3 GROUP BY token)
SELECT token, count(*) AS n, round(avg(value), 6) AS mean_dur, round(stddev_samp(value), 6) AS sd_dur, round(avg(CASE WHEN gap >= 0 THEN gap END), 6) AS mean_gap, round(avg(flag), 6) AS flag_rate, count(DISTINCT actor) AS actors, any_value(top) AS top FROM x JOIN t USING (token) GROUP BY token""",
)
def a29(spark, d):
    k = F.col("k")
    x = events(spark, d).select("token", "value", F.when(k % 4 == 0, -1.0).otherwise(k / 10).alias("gap"), (k % 2).alias("flag"), (F.col("seq") % 7).alias("actor"))
    return rounded(S.cluster_metadata(x, "token", "value", "gap", "flag", "actor"), "mean_dur", "sd_dur", "mean_gap", "flag_rate")


@query(
    "j15_within_k_pairs",
    f"""WITH {EV}, {POS}, x AS (SELECT seq, pos, token, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 4 END AS actor, value AS gap, k % 9 <> 0 AS timed FROM pos),
p AS (SELECT a.token AS t, b.token AS u, a.actor AS w, b.actor AS v, (SELECT CASE WHEN bool_and(timed) THEN sum(gap) END FROM x m WHERE m.seq = a.seq AND m.pos > a.pos AND m.pos <= b.pos) AS dt FROM x a JOIN x b ON b.seq = a.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 4 AND b.token <> a.token)
SELECT least(t, u) AS a, greatest(t, u) AS b, count(*) AS n, count(*) FILTER (t < u) AS forward, count(*) FILTER (t > u) AS backward, round(avg(CASE WHEN w IS NOT NULL AND v IS NOT NULL THEN CAST(w <> v AS INTEGER) END), 6) AS cross_rate, round(avg(dt), 4) AS mean_dt FROM p GROUP BY 1, 2""",
)
def j15(spark, d):
    k = F.col("k")
    x = placed(spark, d).select("seq", "pos", "token", F.when(k % 6 != 0, k % 4).alias("actor"), F.col("value").alias("gap"), (k % 9 != 0).alias("timed"))
    return rounded(rounded(S.within_k_pairs(x, "seq", "pos", "token", "actor", "gap", "timed", 5), "cross_rate"), "mean_dt", digits=4)


@query(
    "a33_conditional_kl",
    f"""WITH {EV}, {POS}, x AS (SELECT seq, token AS ctx, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS nx FROM pos),
c AS (SELECT ctx, nx, count(*) FILTER (seq % 2 = 0) AS l, count(*) FILTER (seq % 2 = 1) AS r FROM x WHERE nx IS NOT NULL GROUP BY ALL),
s AS (SELECT ctx, nx, sum(l) OVER w AS nl, l / sum(l) OVER w + 1e-8 AS p, r / sum(r) OVER w + 1e-8 AS q FROM c WINDOW w AS (PARTITION BY ctx))
SELECT ctx AS context, CAST(max(nl) AS BIGINT) AS n, round(sum(p * log2(p / q)), 6) AS kl FROM s GROUP BY ctx""",
)
def a33(spark, d):
    p = placed(spark, d)
    return rounded(S.conditional_kl(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), "seq", "pos", "token"), "kl")


@query(
    "a34_acceptance_bands",
    f"""WITH {EV}, v AS (SELECT count(DISTINCT token) AS v, round(avg(CAST(k % 6 = 0 AS INTEGER)), 6) AS missing, round(max(c) / sum(c), 6) AS modal FROM ev, (SELECT token AS t2, count(*) AS c FROM ev GROUP BY 1) q WHERE q.t2 = ev.token)
SELECT 'v' AS "check", CAST(v AS DOUBLE) AS value, 2.0::DOUBLE AS low, 10.0::DOUBLE AS high, v BETWEEN 2 AND 10 AS ok FROM v UNION ALL SELECT 'missing', missing, 0.0, 0.1, missing BETWEEN 0 AND 0.1 FROM v""",
)
def a34(spark, d):
    e = events(spark, d)
    v = e.agg(F.count_distinct("token").alias("v"), F.round(F.avg((F.col("k") % 6 == 0).cast("int")), 6).alias("missing"))
    return S.acceptance_bands(v, {"v": (2, 10), "missing": (0, 0.1)})


@query("f05_corpus_profile", f"WITH {WORD}, x AS (SELECT lang AS dim, token, count(*) AS c FROM word GROUP BY ALL), y AS (SELECT dim, sum(c) AS n, count(*) AS v, max(c) AS modal, sum(c * log2(c)) AS s FROM x GROUP BY dim) SELECT dim, CAST(n AS BIGINT) AS n, v, modal, round(log2(n) - s / n, 6) AS entropy FROM y")
def f05(spark, d):
    return rounded(S.freq_stats_by(words(spark, d).select(F.col("lang").alias("dim"), "token"), "token", "dim"), "entropy")


@query("t11_shuffled_sequences", f"WITH {EV}, {POS} SELECT seq, token, CAST(row_number() OVER (PARTITION BY seq ORDER BY (pos * 7919 + seq) % 10007, pos) - 1 AS INTEGER) AS pos FROM pos")
def t11(spark, d):
    return S.shuffled_positions(placed(spark, d).select("seq", "pos", "token"), "seq", "pos", mixed=(F.col("pos") * 7919 + F.col("seq")) % 10007)

