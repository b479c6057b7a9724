"""Queries of matching and quality reports over order patterns and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import match as M
from seqspark.operators import quality as Q
from seqspark.operators.stages import written

from .q_stats import rounded
from .registry import query
from .views import EV, LAB, events, labelled, table


def anchors(spark, d):
    return labelled(spark, d).where("n_clicks between 3 and 10 and row_id % 4 = 0")


def others(spark, d):
    return labelled(spark, d).where("n_clicks between 3 and 10 and row_id % 4 <> 0")


def kept(spark, d, *more):
    """Anchors and others as one table, written once: matching reads them several times."""
    return written(labelled(spark, d).where("n_clicks between 3 and 10").select("row_id", "n_clicks", "ici", "label", *more), "patterns")


def kept_anchors(spark, d):
    return written(anchors(spark, d).select("row_id", "n_clicks", "ici", "label"), "patterns")


AQ = f"{LAB}, an AS (SELECT * FROM lab WHERE n_clicks BETWEEN 3 AND 10 AND row_id % 4 = 0), qu AS (SELECT * FROM lab WHERE n_clicks BETWEEN 3 AND 10 AND row_id % 4 <> 0)"
DIST = "round(sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))), 9)"


def KNN(q, a, cond="true"):
    return f"nb AS (SELECT n_clicks, qid, label, d FROM (SELECT q.n_clicks, q.row_id AS qid, a.label, {DIST.format(a='q.ici', b='a.ici')} AS d, row_number() OVER (PARTITION BY q.row_id ORDER BY {DIST.format(a='q.ici', b='a.ici')}, a.row_id) AS r FROM {q} q JOIN {a} a ON a.n_clicks = q.n_clicks AND {cond}) WHERE r <= 5), vt AS (SELECT n_clicks, qid, label, count(*) AS c FROM nb GROUP BY ALL), nn AS (SELECT qid, min(d) AS nearest FROM nb GROUP BY qid), km AS (SELECT n_clicks, qid, predicted, nearest FROM (SELECT *, label AS predicted, row_number() OVER (PARTITION BY qid ORDER BY c DESC, label) AS r FROM vt) JOIN nn USING (qid) WHERE r = 1)"


BIG = "big AS (SELECT n_clicks FROM an GROUP BY n_clicks HAVING count(*) >= 6), ax AS (SELECT * FROM an WHERE n_clicks IN (SELECT n_clicks FROM big))"
TAU = f"""ns AS (SELECT a.n_clicks, a.label, a.row_id, min({DIST.format(a='a.ici', b='b.ici')}) AS d FROM an a JOIN an b ON a.n_clicks = b.n_clicks AND a.label = b.label AND a.row_id <> b.row_id GROUP BY ALL),
p9 AS (SELECT n_clicks, label, quantile_cont(d, 0.99) AS p FROM ns GROUP BY ALL), md AS (SELECT n_clicks, quantile_cont(p, 0.5) AS m FROM p9 GROUP BY 1),
tau AS (SELECT e.n_clicks, e.label, greatest(coalesce(p, m, 0.1), 0.1) AS tau FROM (SELECT DISTINCT n_clicks, label FROM an) e LEFT JOIN p9 USING (n_clicks, label) LEFT JOIN md USING (n_clicks))"""


@query("j01_truth_join", "SELECT d.doc_id, source, CASE WHEN source IN ('src0', 'src1', 'src2') THEN q END AS quality FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def j01(spark, d):
    return M.truth_join(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").withColumnRenamed("doc_id", "truth_id"), "doc_id", "truth_id", "quality", F.col("source").isin("src0", "src1", "src2"))


@query("j02_knn_match", f"WITH {AQ}, {BIG}, {KNN('qu', 'ax')} SELECT n_clicks, qid, predicted, round(nearest, 6) AS nearest FROM km")
def j02(spark, d):
    x = kept(spark, d)
    return rounded(M.knn_match(x.where("row_id % 4 <> 0"), x.where("row_id % 4 = 0"), ["n_clicks"]), "nearest")


@query("a01_tau_table", f"WITH {AQ}, {TAU} SELECT n_clicks, label, round(tau, 6) AS tau FROM tau")
def a01(spark, d):
    return rounded(M.tau_table(kept_anchors(spark, d)), "tau")


@query("j03_threshold_accept", f"WITH {AQ}, {BIG}, {TAU}, {KNN('qu', 'ax')} SELECT km.n_clicks, qid, predicted, round(nearest, 6) AS nearest, nearest <= coalesce(tau, 'Infinity'::DOUBLE) AS accepted FROM km LEFT JOIN tau ON tau.n_clicks = km.n_clicks AND tau.label = predicted")
def j03(spark, d):
    x = kept(spark, d)
    a = x.where("row_id % 4 = 0")
    return rounded(M.accept(M.knn_match(x.where("row_id % 4 <> 0"), a, ["n_clicks"]), M.tau_table(a)).select("n_clicks", "qid", "predicted", "nearest", "accepted"), "nearest")


LOO = f"{AQ}, {TAU}, {KNN('an', 'an', 'a.row_id <> q.row_id')}"


@query("j04_knn_loo", f"WITH {LOO} SELECT n_clicks, qid, predicted, round(nearest, 6) AS nearest FROM km")
def j04(spark, d):
    return rounded(M.loo_match(kept_anchors(spark, d), ["n_clicks"]), "nearest")


@query(
    "a13_loo_outcomes",
    f"""WITH {LOO}, o AS (SELECT km.n_clicks, an.label, predicted, nearest <= coalesce(tau, 'Infinity'::DOUBLE) AS ok FROM km JOIN an ON an.row_id = qid LEFT JOIN tau ON tau.n_clicks = km.n_clicks AND tau.label = predicted)
SELECT n_clicks, count(*) AS total, count(*) FILTER (ok AND label = predicted) AS correct, count(*) FILTER (ok AND label <> predicted) AS mismatch, count(*) FILTER (NOT ok) AS reject FROM o GROUP BY ROLLUP (n_clicks)""",
)
def a13(spark, d):
    a = kept_anchors(spark, d)
    x = M.accept(M.loo_match(a, ["n_clicks"], also=["label"]), M.tau_table(a))
    return Q.outcome_rollup(x, "n_clicks", F.col("label"), F.col("predicted"), F.col("accepted"))


CENT = "cs AS (SELECT n_clicks, label, i, sum(ici[i]) AS s, count(*) AS n FROM (SELECT n_clicks, label, ici, unnest(range(1, len(ici) + 1)) AS i FROM an) GROUP BY ALL), ce AS (SELECT n_clicks, label, max(n) AS n, list(s ORDER BY i) AS sums, list(s / n ORDER BY i) AS centroid FROM cs GROUP BY n_clicks, label), cd AS (SELECT an.n_clicks, an.label, avg({d}) AS mean_dist, quantile_cont({d}, 0.95) AS r95 FROM an JOIN ce USING (n_clicks, label) GROUP BY ALL)".replace("{d}", "sqrt(list_sum(list_transform(range(1, len(ici) + 1), lambda i: (ici[i] - centroid[i]) * (ici[i] - centroid[i]))))")


@query(
    "a02_class_variance",
    f"""WITH {AQ}, {TAU}, {CENT}, q AS (SELECT n_clicks, label, quantile_cont(d, [0.5, 0.9, 0.95, 0.99]) AS q FROM ns GROUP BY ALL)
SELECT n_clicks, label, n, list_transform(centroid, lambda x: round(x, 6)) AS centroid, round(mean_dist, 6) AS mean_dist, round(r95, 6) AS r95, round(q[1], 6) AS p50, round(q[2], 6) AS p90, round(q[3], 6) AS p95, round(q[4], 6) AS p99 FROM ce JOIN cd USING (n_clicks, label) LEFT JOIN q USING (n_clicks, label)""",
)
def a02(spark, d):
    v = M.class_variance(anchors(spark, d)).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))
    return rounded(v, "mean_dist", "r95", "p50", "p90", "p95", "p99")


ED = "sqrt(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))))"
ED_AB = ED.format(a="a.ici", b="b.ici")


@query(
    "a03_group_summary",
    f"""WITH {AQ}, c AS (SELECT status, label, count(*) AS c FROM an GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY c DESC, label) AS r FROM c), t AS (SELECT status, CAST(sum(c) AS BIGINT) AS n, string_agg(label, ',' ORDER BY r) FILTER (r <= 5) AS top, sum(c) FILTER (r <= 5) / sum(c) AS coverage FROM r GROUP BY status),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY status, n_clicks ORDER BY (row_id * 2654435761) % 4294967296, row_id) AS k FROM an) WHERE k <= 1500), pm AS (SELECT a.status, a.n_clicks, avg({ED_AB}) AS m FROM s a JOIN s b ON a.status = b.status AND a.n_clicks = b.n_clicks AND a.row_id < b.row_id GROUP BY ALL),
w AS (SELECT status, n_clicks, count(*) AS w FROM an GROUP BY ALL), sp AS (SELECT status, sum(m * w) / sum(w) AS spread FROM pm JOIN w USING (status, n_clicks) GROUP BY status),
nn AS (SELECT a.status, a.row_id, min({DIST.format(a='a.ici', b='b.ici')}) AS d FROM an a JOIN an b ON a.status = b.status AND a.n_clicks = b.n_clicks AND a.row_id <> b.row_id GROUP BY ALL), q AS (SELECT status, quantile_cont(d, 0.5) AS a, quantile_cont(d, 0.9) AS b FROM nn GROUP BY status)
SELECT status, n, top, round(coverage, 6) AS coverage, round(spread, 6) AS spread, round(a, 6) AS nn_p50, round(b, 6) AS nn_p90 FROM t LEFT JOIN sp USING (status) LEFT JOIN q USING (status)""",
)
def a03(spark, d):
    return rounded(M.group_summary(anchors(spark, d), "status", "label"), "coverage", "spread", "nn_p50", "nn_p90")



@query(
    "j06_runner_up_margin",
    f"""WITH {AQ}, {CENT}, x AS (SELECT row_id, ce.label AS l, an.label AS p, {ED.format(a='ici', b='centroid')} AS d FROM an JOIN ce ON ce.n_clicks = an.n_clicks)
SELECT row_id, round(max(CASE WHEN l = p THEN d END), 6) AS own, round(min(CASE WHEN l <> p THEN d END), 6) AS other, round(min(CASE WHEN l <> p THEN d END) - max(CASE WHEN l = p THEN d END), 6) AS margin FROM x GROUP BY row_id""",
)
def j06(spark, d):
    a = anchors(spark, d).withColumn("predicted", F.col("label"))
    return rounded(M.predicted_vs_runner_up(a, M.centroids(a, ["n_clicks", "label"])), "own", "other", "margin")


@query(
    "j05_loo_nearest_centroid",
    f"""WITH {AQ}, {CENT}, x AS (SELECT row_id, ici, an.label AS own, ce.label AS l, r95, CASE WHEN an.label = ce.label THEN list_transform(range(1, len(ici) + 1), lambda i: (sums[i] - ici[i]) / (n - 1)) ELSE centroid END AS c FROM an JOIN ce ON ce.n_clicks = an.n_clicks JOIN cd ON cd.n_clicks = ce.n_clicks AND cd.label = ce.label WHERE an.label <> ce.label OR n > 1),
y AS (SELECT row_id, l, r95, round({ED.format(a='ici', b='c')}, 9) AS d FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, l) AS r FROM y)
SELECT row_id, l AS nearest, round(d, 6) AS d, d > greatest(r95, 0.1) AS outlier FROM z WHERE r = 1""",
)
def j05(spark, d):
    return rounded(M.loo_nearest_centroid(anchors(spark, d)), "d")


CLU = "cl AS (SELECT n_clicks, cluster, list(m ORDER BY i) AS centroid FROM (SELECT n_clicks, cluster, i, avg(ici[i]) AS m FROM (SELECT n_clicks, actor % 6 AS cluster, ici, unnest(range(1, len(ici) + 1)) AS i FROM qu) GROUP BY ALL) GROUP BY ALL)"


def clusters(spark, d):
    return M.centroids(others(spark, d).withColumn("cluster", F.col("actor") % 6), ["n_clicks", "cluster"])


@query("j07_nearest_reference", f"WITH {AQ}, {CENT}, {CLU}, x AS (SELECT cluster, cl.n_clicks, label, {DIST.format(a='cl.centroid', b='ce.centroid')} AS d FROM cl JOIN ce ON ce.n_clicks = cl.n_clicks), y AS (SELECT *, row_number() OVER (PARTITION BY cluster, n_clicks ORDER BY d, label) AS r FROM x) SELECT cluster, n_clicks, label AS nearest, round(d, 6) AS d FROM y WHERE r = 1")
def j07(spark, d):
    return rounded(M.nearest_reference(clusters(spark, d), M.centroids(anchors(spark, d), ["n_clicks", "label"])), "d")


@query("j08_nearest_other_cluster", f"WITH {AQ}, {CLU}, x AS (SELECT a.cluster, a.n_clicks, b.cluster AS o, {DIST.format(a='a.centroid', b='b.centroid')} AS d FROM cl a JOIN cl b ON a.n_clicks = b.n_clicks AND a.cluster <> b.cluster), y AS (SELECT *, row_number() OVER (PARTITION BY cluster, n_clicks ORDER BY d, o) AS r FROM x) SELECT cluster, n_clicks, o AS nearest, round(d, 6) AS d FROM y WHERE r = 1")
def j08(spark, d):
    return rounded(M.nearest_other_cluster(clusters(spark, d)), "d")


@query(
    "c04_cosine_neighbours",
    """WITH x AS (SELECT a.vec_id AS qid, b.vec_id AS anchor_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d DESC, anchor_id) AS r FROM x) SELECT qid, anchor_id, round(d, 6) AS d, CAST(r AS INTEGER) AS r FROM y WHERE r <= 6""",
)
def c04(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(M.knn(e, e, ["label"], 6, "embedding", "vec_id", "vec_id", cosine=True, exclude_self=True).select("qid", "anchor_id", "d", "r"), "d")


@query("a04_rate_by_key", f"WITH {LAB} SELECT day, count(*) AS n, CAST(sum(CAST(label LIKE '5%' AS INTEGER)) AS BIGINT) AS flagged, round(avg(CAST(label LIKE '5%' AS INTEGER)), 6) AS rate, quantile_cont(n_clicks, 0.5) AS median, arg_min(actor, row_id) AS first FROM lab GROUP BY day")
def a04(spark, d):
    return rounded(Q.rate_by(labelled(spark, d), "day", F.col("label").startswith("5"), "n_clicks", "actor", "row_id"), "rate")


@query("a05_distribution", f"WITH {EV} SELECT token, count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in Q.QUANTILES) + " FROM ev GROUP BY token")
def a05(spark, d):
    x = Q.distribution(events(spark, d), "token", "value")
    return rounded(x, *[c for c in x.columns if c not in ("token", "n")])


@query("a06_flag_rates", f"WITH {LAB}, g AS (SELECT n_clicks, count(*) AS n, sum(CAST(actor % 3 = 0 AS INTEGER)) AS f FROM lab GROUP BY 1) SELECT CAST(l AS INTEGER) AS n_clicks, coalesce(n, 0) AS n, CAST(coalesce(f, 0) AS BIGINT) AS flagged, round(coalesce(f / n, 0), 6) AS rate FROM (SELECT unnest(range(1, 31)) AS l) LEFT JOIN g ON n_clicks = l")
def a06(spark, d):
    return rounded(Q.flag_rates(labelled(spark, d), "n_clicks", F.col("actor") % 3 == 0, 1, 30), "rate")


@query("a07_conditional_counts", "SELECT count(*) FILTER (quality = 1 AND source = 'src0') AS anchors, count(*) FILTER (quality = 1 AND source <> 'src0') AS matched, count(*) FILTER (quality = 0) AS noise, count(*) FILTER (quality IS NULL) AS unknown FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def a07(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    q, s = F.col("quality"), F.col("source")
    return Q.conditional_counts(x, {"anchors": (q == 1) & (s == "src0"), "matched": (q == 1) & (s != "src0"), "noise": q == 0, "unknown": q.isNull()})


@query("a08_crosstab", "WITH g AS (SELECT source, " + ", ".join(f"count(*) FILTER (lang = '{v}') AS {v}" for v in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source), t AS (SELECT *, de + en + es + fr AS total FROM g) SELECT *, " + ", ".join(f"round({v} / total, 6) AS share_{v}" for v in ("de", "en", "es", "fr")) + " FROM t")
def a08(spark, d):
    v = ["de", "en", "es", "fr"]
    return rounded(Q.crosstab(table(spark, d, "documents"), "source", "lang", v), *[f"share_{x}" for x in v])


@query("a09_acceptance", f"WITH {LAB}, x AS (SELECT label AS before, CASE WHEN row_id % 50 = 0 THEN '1-URGENT' ELSE label END AS after, label LIKE '5%' AS noise FROM lab), g AS (SELECT count(*) FILTER (after = before) / count(before) AS c, avg(CAST(noise AS INTEGER)) AS n, count(*) FILTER (left(after, 1) = left(before, 1)) / count(*) AS a FROM x) SELECT round(c, 6) AS conserved, round(n, 6) AS noise, round(a, 6) AS agreement, c >= 0.95 AS conserved_ok, n <= 0.08 AS noise_ok, a >= 0.9 AS agreement_ok FROM g")
def a09(spark, d):
    x = labelled(spark, d).withColumn("after", F.when(F.col("row_id") % 50 == 0, "1-URGENT").otherwise(F.col("label")))
    return rounded(Q.acceptance(x, "label", "after", F.substring("after", 1, 1), F.substring("label", 1, 1), F.col("label").startswith("5")), "conserved", "noise", "agreement")


@query("a10_top_label_coverage", "WITH c AS (SELECT c_nationkey AS nation, CAST(o_custkey AS VARCHAR) AS lab, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY c DESC, lab) AS r FROM c) SELECT nation, CAST(sum(c) AS BIGINT) AS n, count(*) AS labels, " + ", ".join(f"round(sum(CASE WHEN r <= {k} THEN c END) / sum(c), 6) AS cover_{k}" for k in (1, 3, 5, 10)) + " FROM r GROUP BY nation")
def a10(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_custkey").cast("string").alias("lab"))
    return rounded(Q.top_label_coverage(x, "nation", "lab"), "cover_1", "cover_3", "cover_5", "cover_10")


@query("a11_majority_labels", f"WITH {LAB}, c AS (SELECT actor, label, count(*) AS c FROM lab GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY c DESC, label) AS r, sum(c) OVER (PARTITION BY actor) AS t FROM c) SELECT actor, label AS dominant, c AS support, CAST(t AS BIGINT) AS total, round(c / t, 6) AS purity FROM r WHERE r = 1")
def a11(spark, d):
    return rounded(Q.majority_labels(labelled(spark, d), "actor", "label"), "purity")


@query(
    "a12_adjusted_rand",
    f"""WITH {LAB}, c AS (SELECT CAST(left(label, 1) AS INTEGER) AS a, CAST(actor % 5 + 1 AS INTEGER) AS b, count(*) AS c FROM lab GROUP BY ALL), n AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS ij, sum(CASE WHEN a = b THEN c ELSE 0 END) AS dg FROM c),
i AS (SELECT sum(s * (s - 1) / 2) AS i FROM (SELECT sum(c) AS s FROM c GROUP BY a)), j AS (SELECT sum(s * (s - 1) / 2) AS j FROM (SELECT sum(c) AS s FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari, round(dg / n, 6) AS same FROM n, i, j""",
)
def a12(spark, d):
    x = labelled(spark, d).select(F.substring("label", 1, 1).cast("int").alias("a"), (F.col("actor") % 5 + 1).cast("int").alias("b"))
    return rounded(Q.adjusted_rand(x, "a", "b"), "ari", "same")


SWEEP = f"{LAB}, sw AS (SELECT CAST(m AS INTEGER) AS minpts, n_clicks, count(*) AS n, count(*) FILTER ((actor * m) % 7 < CAST(left(label, 1) AS INTEGER)) AS correct FROM lab, (SELECT unnest([5, 10, 20]) AS m) GROUP BY m, n_clicks)"


@query(
    "a14_sweep_summary",
    f"""WITH {SWEEP}, b AS (SELECT n_clicks, minpts AS best FROM (SELECT *, row_number() OVER (PARTITION BY n_clicks ORDER BY correct / n DESC, minpts) AS r FROM sw) WHERE r = 1),
g AS (SELECT minpts, n_clicks, sum(correct) / sum(n) AS accuracy FROM sw GROUP BY GROUPING SETS ((minpts), (n_clicks))) SELECT minpts, g.n_clicks, round(accuracy, 6) AS accuracy, best FROM g LEFT JOIN b ON b.n_clicks = g.n_clicks""",
)
def a14(spark, d):
    x = labelled(spark, d).select("n_clicks", "actor", "label", F.explode(F.array(*map(F.lit, (5, 10, 20)))).alias("minpts"))
    s = x.groupBy("minpts", "n_clicks").agg(F.count("*").alias("n"), F.count_if((F.col("actor") * F.col("minpts")) % 7 < F.substring("label", 1, 1).cast("int")).alias("correct"))
    return rounded(Q.sweep_summary(s, "minpts", "n_clicks"), "accuracy")


@query("a15_cluster_records", f"WITH {LAB} SELECT n_clicks, actor % 6 AS cluster, count(*) AS n, round(avg(dur), 10) AS mean_dur, count(*) FILTER (status = 'F') AS n_F, count(*) FILTER (status = 'O') AS n_O, count(*) FILTER (status = 'P') AS n_P FROM lab GROUP BY ALL")
def a15(spark, d):
    return rounded(Q.cluster_records(labelled(spark, d).withColumn("cluster", F.col("actor") % 6), "n_clicks", "cluster", "dur", "status", ["F", "O", "P"]), "mean_dur", digits=10)


@query(
    "a16_cluster_quality",
    f"""WITH {AQ}, {CENT}, {CLU}, x AS (SELECT cluster, cl.n_clicks, label, {DIST.format(a='cl.centroid', b='ce.centroid')} AS d FROM cl JOIN ce ON ce.n_clicks = cl.n_clicks), y AS (SELECT *, row_number() OVER (PARTITION BY cluster, n_clicks ORDER BY d, label) AS r FROM x),
v AS (SELECT cluster, qu.n_clicks, avg({ED.format(a='ici', b='centroid')}) AS mean_dist FROM qu JOIN cl ON cl.n_clicks = qu.n_clicks AND cl.cluster = qu.actor % 6 GROUP BY ALL)
SELECT v.cluster, v.n_clicks, round(v.mean_dist, 6) AS mean_dist, y.label AS nearest, round(CASE WHEN cd.mean_dist > 0 THEN v.mean_dist / cd.mean_dist END, 6) AS ratio, coalesce(CASE WHEN cd.mean_dist > 0 THEN v.mean_dist / cd.mean_dist END > 2, false) AS collapsed
FROM v JOIN y ON y.r = 1 AND y.cluster = v.cluster AND y.n_clicks = v.n_clicks LEFT JOIN cd ON cd.n_clicks = v.n_clicks AND cd.label = y.label""",
)
def a16(spark, d):
    a, o = anchors(spark, d), others(spark, d).withColumn("cluster", F.col("actor") % 6)
    cl = clusters(spark, d)
    v = o.join(cl.select("n_clicks", "cluster", "centroid").hint("shuffle_hash"), ["n_clicks", "cluster"]).groupBy("n_clicks", "cluster").agg(F.avg(M.distance(F.col("ici"), F.col("centroid"))).alias("mean_dist"))
    ref = M.centroids(a, ["n_clicks", "label"])
    spread = a.join(ref.select("n_clicks", "label", "centroid").hint("shuffle_hash"), ["n_clicks", "label"]).groupBy("n_clicks", "label").agg(F.avg(M.distance(F.col("ici"), F.col("centroid"))).alias("mean_dist"))
    return rounded(Q.cluster_quality(v, M.nearest_reference(cl, ref), spread), "mean_dist", "ratio")


