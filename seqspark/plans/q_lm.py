"""Queries of the count models over event sequences; folds are the sequence id modulo the number of folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import lm as L

from .q_context import POS, placed
from .q_patterns import SYM
from .q_stats import rounded
from .registry import query
from .views import EV

FOLDS = 3
SEG = SYM


def rows(spark, d):
    p = placed(spark, d).select("seq", "pos", "token", "k")
    return L.with_folds(p, "seq", FOLDS, F.col("seq") % FOLDS)


def done(scored):
    return rounded(L.summary(scored), "bits", "acc")


BASE = f"WITH {EV}, {POS}, rw AS (SELECT CAST(seq % {FOLDS} AS INTEGER) AS own, seq, pos, token, coalesce(lag(token) OVER w, '<B>') AS a, coalesce(lag(token, 2) OVER w, '<B>') AS b FROM pos WINDOW w AS (PARTITION BY seq ORDER BY pos)), fo AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold), tr AS (SELECT fold, rw.* FROM rw JOIN fo ON fold <> own)"
UNI = "vv AS (SELECT count(DISTINCT token) + 1 AS v FROM rw), u AS (SELECT fold, token, count(*) AS cu FROM tr WHERE pos > 0 GROUP BY ALL), un AS (SELECT fold, sum(cu) AS nu, arg_min(token, (-cu, token)) AS bu FROM u GROUP BY fold)"
OUT = "SELECT own AS fold, count(*) AS n, round(-avg(log2(p)), 6) AS bits, round(avg(CAST(hit AS INTEGER)), 6) AS acc FROM sc GROUP BY own"


@query("l01_unigram", f"{BASE}, {UNI}, sc AS (SELECT own, (coalesce(cu, 0) + 0.5) / (nu + 0.5 * v) AS p, bu = rw.token AS hit FROM rw JOIN vv ON true JOIN un ON un.fold = own LEFT JOIN u ON u.fold = own AND u.token = rw.token WHERE pos > 0) {OUT}")
def l01(spark, d):
    return done(L.markov(rows(spark, d), 0, FOLDS))


def _markov(key):
    return f"""{BASE}, {UNI}, k AS (SELECT *, {key} AS h FROM rw), kt AS (SELECT *, {key} AS h FROM tr), cw AS (SELECT fold, h, token, count(*) AS c FROM kt WHERE pos > 0 GROUP BY ALL), ch AS (SELECT fold, h, sum(c) AS ch, arg_min(token, (-c, token)) AS bh FROM cw GROUP BY ALL),
sc AS (SELECT own, CASE WHEN ch.ch IS NULL THEN (coalesce(cu, 0) + 0.5) / (nu + 0.5 * v) ELSE (coalesce(c, 0) + 0.5) / (ch.ch + 0.5 * v) END AS p, coalesce(bh, bu) = k.token AS hit FROM k JOIN vv ON true JOIN un ON un.fold = own LEFT JOIN u ON u.fold = own AND u.token = k.token LEFT JOIN cw ON cw.fold = own AND cw.h = k.h AND cw.token = k.token LEFT JOIN ch ON ch.fold = own AND ch.h = k.h WHERE pos > 0) {OUT}"""


@query("l02_markov1", _markov("a"))
def l02a(spark, d):
    return done(L.markov(rows(spark, d), 1, FOLDS))


@query("l02_markov2", _markov("b || '|' || a"))
def l02b(spark, d):
    return done(L.markov(rows(spark, d), 2, FOLDS))


def compound(spark, d):
    r = rows(spark, d)
    return r.withColumns({"label": F.col("token"), "token": F.concat_ws("/", "token", (F.col("k") % 3).cast("string"))})


CBASE = f"WITH {EV}, {POS}, cp AS (SELECT seq, pos, token AS label, token || '/' || (k % 3) AS token FROM pos WHERE k IS NOT NULL), rw AS (SELECT CAST(seq % {FOLDS} AS INTEGER) AS own, seq, pos, token, label, coalesce(lag(token) OVER w, '<B>') AS a FROM cp WINDOW w AS (PARTITION BY seq ORDER BY pos)), fo AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold), tr AS (SELECT fold, rw.* FROM rw JOIN fo ON fold <> own WHERE pos > 0)"


@query(
    "l03_joint_markov_labels",
    f"""{CBASE}, vv AS (SELECT count(DISTINCT token) + 1 AS v FROM rw), sz AS (SELECT label, count(DISTINCT token) AS m FROM rw GROUP BY 1), u AS (SELECT fold, label, count(*) AS cu FROM tr GROUP BY ALL), un AS (SELECT fold, sum(cu) AS nu, arg_min(label, (-cu, label)) AS bu FROM u GROUP BY fold),
cw AS (SELECT fold, a, label, count(*) AS c FROM tr GROUP BY ALL), ch AS (SELECT fold, a, sum(c) AS ch, arg_min(label, (-(c + 0.5 * m), label)) AS bh FROM cw JOIN sz USING (label) GROUP BY ALL),
sc AS (SELECT own, CASE WHEN ch.ch IS NULL THEN (coalesce(cu, 0) + 0.5 * m) / (nu + 0.5 * v) ELSE (coalesce(c, 0) + 0.5 * m) / (ch.ch + 0.5 * v) END AS p, coalesce(bh, bu) = rw.label AS hit FROM rw JOIN vv ON true JOIN sz ON sz.label = rw.label JOIN un ON un.fold = own LEFT JOIN u ON u.fold = own AND u.label = rw.label LEFT JOIN cw ON cw.fold = own AND cw.a = rw.a AND cw.label = rw.label LEFT JOIN ch ON ch.fold = own AND ch.a = rw.a WHERE pos > 0) {OUT}""",
)
def l03(spark, d):
    return done(L.markov_labels(compound(spark, d), FOLDS))


def _disc(k):
    return f"""n{k} AS (SELECT fold, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c = 3) AS n3, count(*) FILTER (c = 4) AS n4 FROM c{k} GROUP BY fold),
y{k} AS (SELECT *, n1 / (n1 + 2 * n2) AS y FROM n{k}), e{k} AS (SELECT *, 1 - 2 * y * n2 / n1 AS x1 FROM y{k}), f{k} AS (SELECT *, CASE WHEN n3 > 0 THEN 2 - 3 * y * n3 / n2 ELSE x1 END AS x2 FROM e{k}), g{k} AS (SELECT *, CASE WHEN n4 > 0 THEN 3 - 4 * y * n4 / n3 ELSE x2 END AS x3 FROM f{k}),
d{k} AS (SELECT fold, CASE WHEN n1 > 0 AND n2 > 0 THEN greatest(least(x1, 1), 0) ELSE 0.5 END AS d1, CASE WHEN n1 > 0 AND n2 > 0 THEN greatest(least(x2, 2), 0) ELSE 0.5 END AS d2, CASE WHEN n1 > 0 AND n2 > 0 THEN greatest(least(x3, 3), 0) ELSE 0.5 END AS d3 FROM g{k}),
k{k} AS (SELECT c{k}.*, CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS dd FROM c{k} JOIN d{k} USING (fold)), t{k} AS (SELECT fold, h, sum(c) AS ch, sum(dd) / sum(c) AS g FROM k{k} GROUP BY ALL)"""


KN = f"""{BASE}, c3 AS (SELECT fold, b || '|' || a AS h, token, count(*) AS c FROM tr GROUP BY ALL), c2 AS (SELECT fold, a AS h, token, count(DISTINCT b) AS c FROM tr GROUP BY ALL), c1 AS (SELECT fold, '' AS h, token, count(DISTINCT a) AS c FROM tr GROUP BY ALL),
{_disc(1)}, {_disc(2)}, {_disc(3)}, vc AS (SELECT fold, token FROM tr GROUP BY ALL), vn AS (SELECT fold, count(*) AS v FROM vc GROUP BY 1), hs AS (SELECT DISTINCT own AS fold, a, b FROM rw),
p1 AS (SELECT vc.fold, vc.token, greatest(coalesce(c - dd, 0), 0) / ch + g / v AS p FROM vc JOIN vn USING (fold) JOIN t1 ON t1.fold = vc.fold LEFT JOIN k1 ON k1.fold = vc.fold AND k1.token = vc.token),
p2 AS (SELECT hs.fold, a, b, p1.token, CASE WHEN t2.ch IS NULL THEN p ELSE greatest(coalesce(c - dd, 0), 0) / ch + g * p END AS p FROM hs JOIN p1 ON p1.fold = hs.fold LEFT JOIN t2 ON t2.fold = hs.fold AND t2.h = a LEFT JOIN k2 ON k2.fold = hs.fold AND k2.h = a AND k2.token = p1.token),
p3 AS (SELECT p2.fold, a, b, p2.token, CASE WHEN t3.ch IS NULL THEN p ELSE greatest(coalesce(c - dd, 0), 0) / ch + g * p END AS p FROM p2 LEFT JOIN t3 ON t3.fold = p2.fold AND t3.h = b || '|' || a LEFT JOIN k3 ON k3.fold = p2.fold AND k3.h = b || '|' || a AND k3.token = p2.token),
bs AS (SELECT fold, a, b, arg_min(token, (-round(p, 12), token)) AS best FROM p3 GROUP BY ALL), sk AS (SELECT own, rw.seq, rw.pos, rw.token, p, best = rw.token AS hit FROM rw JOIN p3 ON p3.fold = own AND p3.a = rw.a AND p3.b = rw.b AND p3.token = rw.token JOIN bs ON bs.fold = own AND bs.a = rw.a AND bs.b = rw.b)"""


@query("l04_kneser_ney_3", KN + ", sc AS (SELECT * FROM sk) " + OUT)
def l04(spark, d):
    return done(L.kneser_ney(rows(spark, d), FOLDS, 3))


@query("l04_kneser_ney_5")
def l04b(spark, d):
    return done(L.kneser_ney(rows(spark, d), FOLDS, 5))


@query("l05_kneser_ney_cache", KN + ", ca AS (SELECT seq, pos, count(*) OVER (PARTITION BY seq, token ORDER BY pos RANGE BETWEEN 320 PRECEDING AND 1 PRECEDING) AS cc FROM rw), sc AS (SELECT own, 0.75 * p + 0.25 * (cc + 0.5) / (least(sk.pos, 320) + 0.5 * v) AS p FROM sk JOIN ca ON ca.seq = sk.seq AND ca.pos = sk.pos JOIN vn ON vn.fold = own) SELECT own AS fold, count(*) AS n, round(-avg(log2(p)), 6) AS bits FROM sc GROUP BY own")
def l05(spark, d):
    r = rows(spark, d)
    return done(L.with_cache(L.kneser_ney(r, FOLDS, 3), r, FOLDS)).drop("acc")


CACHE = """, al AS (SELECT own, rw.seq, rw.pos, rw.token AS tok, p3.token, p, CAST(rw.token = p3.token AS INTEGER) AS here FROM rw JOIN p3 ON p3.fold = own AND p3.a = rw.a AND p3.b = rw.b),
cn AS (SELECT *, coalesce(sum(here) OVER (PARTITION BY seq, token ORDER BY pos ROWS BETWEEN 320 PRECEDING AND 1 PRECEDING), 0) AS c FROM al), mx AS (SELECT cn.*, 0.75 * p + 0.25 * (c + 0.5) / (least(pos, 320) + 0.5 * v) AS q FROM cn JOIN vn ON vn.fold = own),
sc AS (SELECT own, seq, pos, max(q) FILTER (token = tok) AS p, arg_min(token, (-round(q, 12), token)) = any_value(tok) AS hit FROM mx GROUP BY ALL) """


@query("l05_cache_accuracy", KN + CACHE + OUT)
def l05b(spark, d):
    return done(L.kneser_ney_cached(rows(spark, d), FOLDS, 3))


@query(
    "l06_ppm_d_1",
    f"""{BASE}, h1 AS (SELECT fold, a AS h, token, count(*) AS c FROM tr WHERE pos > 0 GROUP BY ALL), h0 AS (SELECT fold, token, count(*) AS c FROM tr GROUP BY ALL), vn AS (SELECT fold, count(*) AS v FROM h0 GROUP BY 1), hs AS (SELECT DISTINCT own AS fold, a FROM rw),
f AS (SELECT hs.fold, hs.a, h0.token, h0.c AS c0, h1.c AS c1 FROM hs JOIN h0 ON h0.fold = hs.fold LEFT JOIN h1 ON h1.fold = hs.fold AND h1.h = hs.a AND h1.token = h0.token),
s AS (SELECT *, sum(c1) OVER w AS n1, count(c1) OVER w AS u1, coalesce(sum(CASE WHEN c1 IS NULL THEN c0 END) OVER w, 0) AS n0, count(*) FILTER (c1 IS NULL) OVER w AS u0 FROM f WINDOW w AS (PARTITION BY fold, a)),
w AS (SELECT *, CASE WHEN u1 > 0 THEN 0.5 * u1 / n1 ELSE 1.0 END AS w0 FROM s), q AS (SELECT fold, a, token, CASE WHEN c1 IS NOT NULL THEN (c1 - 0.5) / n1 ELSE w0 * (c0 - 0.5) / n0 END AS p, CASE WHEN u0 > 0 THEN w0 * 0.5 * u0 / n0 ELSE w0 END AS wf FROM w),
b AS (SELECT fold, a, arg_min(token, (-round(p, 12), token)) AS best FROM q GROUP BY ALL), sc AS (SELECT own, p + wf / v AS p, best = rw.token AS hit FROM rw JOIN q ON q.fold = own AND q.a = rw.a AND q.token = rw.token JOIN b ON b.fold = own AND b.a = rw.a JOIN vn ON vn.fold = own) {OUT}""",
)
def l06(spark, d):
    return done(L.ppm_d(rows(spark, d), FOLDS, 1))


@query("l06_ppm_d_3")
def l06b(spark, d):
    return done(L.ppm_d(rows(spark, d), FOLDS, 3))


@query("l06_ppm_d_7")
def l06c(spark, d):
    return done(L.ppm_d(rows(spark, d), FOLDS, 7))


@query("l08_learned_baseline")
def l08(spark, d):
    return rounded(L.learned_baseline(rows(spark, d), FOLDS), "bits", "acc")


@query("l09_event_bits", _markov("a").replace(OUT, "SELECT fold, count(*) AS n, round(avg(b), 6) AS bits FROM (SELECT fold, seq, ev, -sum(log2(p)) AS b FROM sc GROUP BY ALL) GROUP BY fold").replace("sc AS (SELECT own,", "sc AS (SELECT own AS fold, k.seq, k.pos // 4 AS ev,"))
def l09(spark, d):
    s = L.markov(rows(spark, d), 1, FOLDS).withColumn("event", F.floor(F.col("pos") / 4))
    return rounded(L.event_bits(s, "event"), "bits")


@query("a30_fold_summary", _markov("a").replace(OUT, "") + ", pf AS (" + OUT.replace("round(-avg(log2(p)), 6)", "-avg(log2(p))").replace("round(avg(CAST(hit AS INTEGER)), 6)", "avg(CAST(hit AS INTEGER))") + ") SELECT 'markov1' AS model, round(avg(bits), 6) AS bits, round(stddev_pop(bits), 6) AS bits_sd, round(pow(2, avg(bits)), 5) AS perplexity, round(avg(acc), 6) AS acc, round(stddev_pop(acc), 6) AS acc_sd FROM pf")
def a30(spark, d):
    s = L.summary(L.markov(rows(spark, d), 1, FOLDS)).withColumn("model", F.lit("markov1"))
    return rounded(rounded(L.fold_summary(s), "bits", "bits_sd", "acc", "acc_sd"), "perplexity", digits=5)


@query("t09_folds", f"WITH {EV} SELECT DISTINCT seq, CAST(seq % 5 AS INTEGER) AS own FROM ev")
def t09(spark, d):
    return L.with_folds(placed(spark, d).select("seq").distinct(), "seq", 5, F.col("seq") % 5)


@query(
    "t10_tier_folds",
    f"WITH {EV}, s AS (SELECT DISTINCT seq, CASE WHEN seq % 4 = 0 THEN 'held' ELSE 'clean' END AS tier, (seq * 7919) % 10007 AS h FROM ev) SELECT seq, tier, CAST(f AS INTEGER) AS fold, CASE WHEN tier <> 'clean' THEN 'train' WHEN h % 5 = f THEN 'test' WHEN (h // 5) % 10 = 0 THEN 'val' ELSE 'train' END AS part FROM s, (SELECT unnest(range(5)) AS f)",
)
def t10(spark, d):
    s = placed(spark, d).select("seq", F.when(F.col("seq") % 4 == 0, "held").otherwise("clean").alias("tier")).distinct()
    return L.tier_folds(s, "seq", "tier", 5, mixed=(F.col("seq") * 7919) % 10007)


def _joint(sql):
    """The model's SQL over compound tokens of a label and a class of ``k``."""
    sql = sql.replace(f"{POS}, rw AS", f"{POS}, cp AS (SELECT seq, pos, token || '/' || (k % 3) AS token FROM pos), rw AS").replace("FROM pos WINDOW w AS (PARTITION BY seq ORDER BY pos)), fo", "FROM cp WINDOW w AS (PARTITION BY seq ORDER BY pos)), fo")
    return sql[: sql.index("bs AS (SELECT fold")]


@query(
    "l07_joint_kneser_ney",
    _joint(KN) + "sl AS (SELECT own, rw.seq, rw.pos, sum(p) AS p FROM rw JOIN p3 ON p3.fold = own AND p3.a = rw.a AND p3.b = rw.b AND split_part(p3.token, '/', 1) = split_part(rw.token, '/', 1) GROUP BY ALL) SELECT own AS fold, count(*) AS n, round(-avg(log2(p)), 6) AS bits FROM sl GROUP BY own",
)
def l07(spark, d):
    return done(L.kneser_ney_labels(compound(spark, d), FOLDS, 3)).drop("acc")


@query(
    "l07_label_accuracy",
    _joint(KN) + f"lb AS (SELECT fold, a, b, split_part(token, '/', 1) AS label, sum(p) AS p FROM p3 GROUP BY ALL), bl AS (SELECT fold, a, b, arg_min(label, (-round(p, 12), label)) AS best FROM lb GROUP BY ALL), sc AS (SELECT own, lb.p, best = lb.label AS hit FROM rw JOIN lb ON lb.fold = own AND lb.a = rw.a AND lb.b = rw.b AND lb.label = split_part(rw.token, '/', 1) JOIN bl ON bl.fold = own AND bl.a = rw.a AND bl.b = rw.b) {OUT}",
)
def l07b(spark, d):
    return done(L.kneser_ney_labels(compound(spark, d), FOLDS, 3))


@query(
    "l11_segment_chain_bits",
    "WITH " + SEG + f", sq AS (SELECT actor AS seq, row_id AS event, CAST(row_number() OVER (PARTITION BY actor ORDER BY row_id, i) - 1 AS INTEGER) AS pos, substr(sym, CAST(2 * i + 1 AS INTEGER), 2) AS token FROM (SELECT actor, row_id, sym, unnest(range(0, CAST((length(sym) + 1) // 2 AS BIGINT))) AS i FROM st)), rw AS (SELECT CAST(seq % {FOLDS} AS INTEGER) AS own, seq, event, pos, token, coalesce(lag(token) OVER w, '<B>') AS a FROM sq WINDOW w AS (PARTITION BY seq ORDER BY pos)), fo AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold), tr AS (SELECT fold, rw.* FROM rw JOIN fo ON fold <> own)"
    + _markov("a").replace(BASE, "").replace(OUT, "SELECT fold, count(*) AS n, round(avg(b), 6) AS bits FROM (SELECT fold, seq, event, -sum(log2(p)) AS b FROM sc GROUP BY ALL) GROUP BY fold").replace("sc AS (SELECT own,", "sc AS (SELECT own AS fold, k.seq, k.event,"),
)
def l11(spark, d):
    from seqspark.operators import cluster as K
    from seqspark.operators import context as X

    from .q_patterns import strings, two

    s, _ = strings(spark, d)
    x = K.expand_segments(s, two(s), "actor", "row_id", "sym", "dur").select(F.col("actor").alias("seq"), "event", "sub", "token")
    w = X.Window.partitionBy("seq").orderBy("event", "sub")
    x = x.withColumn("pos", F.row_number().over(w) - 1)
    scored = L.markov(L.with_folds(x.select("seq", "pos", "token"), "seq", FOLDS, F.col("seq") % FOLDS), 1, FOLDS)
    return rounded(L.event_bits(scored.join(x.select("seq", "pos", "event").hint("merge"), ["seq", "pos"]), "event"), "bits")
