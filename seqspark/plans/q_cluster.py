"""Queries of density discovery, graphs and merges over order patterns, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.operators import cluster as K
from seqspark.operators import match as M
from seqspark.operators import quality as Q

from .q_context import POS, placed
from .q_match import kept
from .q_stats import rounded
from .registry import query
from .views import EV, LAB, labelled, table

NB = """nb AS (SELECT qid, aid FROM (SELECT a.vec_id AS qid, b.vec_id AS aid, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE r <= 6 AND d >= 0.2),
mu AS (SELECT x.qid AS a, x.aid AS b FROM nb x JOIN nb y ON x.qid = y.aid AND x.aid = y.qid)"""


@query("c03_mutual_knn_components", f"WITH RECURSIVE {NB}, w AS (SELECT a AS node, a AS o FROM mu UNION SELECT mu.b, w.o FROM w JOIN mu ON mu.a = w.node) SELECT node, min(o) AS comp FROM w GROUP BY node")
def c03(spark, d):
    return K.mutual_knn_components(table(spark, d, "embeddings"), ["label"], 6, 0.2)


@query("u05_mutual_edges", f"WITH {NB} SELECT a, b FROM mu WHERE a < b")
def u05(spark, d):
    e = table(spark, d, "embeddings")
    return K.mutual_edges(M.knn(e, e, ["label"], 6, "embedding", "vec_id", "vec_id", cosine=True, exclude_self=True).where("d >= 0.2"))


RATES = f"""{EV}, {POS}, pp AS (SELECT a.token AS a, b.token AS b, count(*) AS n FROM pos a JOIN pos b ON b.seq = a.seq AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 GROUP BY ALL), na AS (SELECT token, count(*) AS m FROM pos GROUP BY 1), rt AS (SELECT a, b, n / m AS rate FROM pp JOIN na ON token = a)"""


@query("c05_mutual_pair_score", f"WITH {RATES} SELECT x.a, x.b, round(sqrt(x.rate * y.rate), 6) AS score FROM rt x JOIN rt y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b ORDER BY round(sqrt(x.rate * y.rate), 9) DESC, x.a, x.b LIMIT 50")
def c05(spark, d):
    from pyspark.sql.window import Window

    p = placed(spark, d)
    w = Window.partitionBy("seq").orderBy("pos")
    ahead = p.select(F.col("token").alias("a"), F.array(*[F.lead("token", i).over(w) for i in (1, 2, 3)]).alias("x")).select("a", F.explode(F.array_compact("x")).alias("b"))
    n = p.groupBy(F.col("token").alias("a")).agg(F.count("*").alias("m"))
    r = ahead.groupBy("a", "b").agg(F.count("*").alias("n")).join(n.hint("merge"), "a").select("a", "b", (F.col("n") / F.col("m")).alias("rate"))
    return rounded(K.mutual_pair_score(r), "score")


@query("c01_density_clusters")
def c01(spark, d):
    from .flows import pooled

    x = pooled(kept(spark, d)).where("__pool").select("row_id", "n_clicks", "ici")
    return K.keep_large(K.density_clusters(x, eps=0.08, min_points=10))


@query("c02_hybrid_classifier")
def c02(spark, d):
    from .flows import hybrid

    return hybrid(kept(spark, d, "dur"))


W10 = f"""WITH {LAB}, g AS (SELECT n_clicks, CASE actor % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'D' WHEN 2 THEN 'i' ELSE '1+' || (n_clicks - 1) END AS shape, label AS cluster, round(avg(dur), 9) AS m FROM lab GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_clicks, shape ORDER BY m, cluster) AS r, count(*) OVER (PARTITION BY n_clicks, shape) AS c FROM g)"""


def shapes(spark, d):
    a = F.col("actor") % 4
    s = F.when(a == 0, "R").when(a == 1, "D").when(a == 2, "i").otherwise(F.concat(F.lit("1+"), (F.col("n_clicks") - 1).cast("string")))
    return labelled(spark, d).groupBy("n_clicks", s.alias("shape"), F.col("label").alias("cluster")).agg(F.round(F.avg("dur"), 9).alias("m"))


@query("w10_tempo_rank_names", W10 + " SELECT n_clicks, shape, cluster, CAST(CASE WHEN shape NOT LIKE '%+%' AND c > 1 THEN r END AS INTEGER) AS rank, CASE WHEN shape LIKE '%+%' THEN shape WHEN c > 1 THEN n_clicks || shape || r ELSE n_clicks || shape END AS name FROM r")
def w10(spark, d):
    return K.tempo_rank_names(shapes(spark, d), "n_clicks", "shape", "m").drop("m")


@query("w10_discovery_names", W10 + " SELECT n_clicks, shape, cluster, CAST(CASE WHEN shape NOT LIKE '%+%' THEN r END AS INTEGER) AS rank, CASE WHEN shape LIKE '%+%' THEN shape ELSE n_clicks || CASE WHEN n_clicks % 2 = 0 THEN shape ELSE '' END || 'P' || r END AS name FROM r")
def w10b(spark, d):
    s = shapes(spark, d)
    return K.tempo_rank_names(s, "n_clicks", "shape", "m", discovery=True, anchors=s.where("n_clicks % 2 = 0")).drop("m")


@query("c06_digram_merges")
def c06(spark, d):
    _, log = K.merge_rounds(placed(spark, d).select("seq", "pos", "token"), 80)
    return K.log_table(spark, log)


ROUND = f"""WITH {EV}, {POS}, x AS (SELECT seq, pos, CASE WHEN k % 3 = 0 THEN 'a' ELSE token END AS token FROM pos), p AS (SELECT seq, pos, token AS a, lead(token) OVER (PARTITION BY seq ORDER BY pos) AS b FROM x), c AS (SELECT a, b, count(*) AS c FROM p WHERE b IS NOT NULL GROUP BY ALL), t AS (SELECT * FROM c ORDER BY c DESC, a, b LIMIT 1),
g AS (SELECT x.*, row_number() OVER (PARTITION BY seq ORDER BY pos) - row_number() OVER (PARTITION BY seq, token ORDER BY pos) AS isl FROM x), r AS (SELECT seq, token, isl, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT CASE WHEN t.a = t.b THEN (SELECT sum(n // 2) FROM r WHERE r.token = t.a) ELSE t.c END AS m FROM t)"""


@query("c06_first_merge", ROUND + " SELECT CAST(1 AS INTEGER) AS round, a, b, c AS count, CAST((SELECT count(*) FROM x) - m AS BIGINT) AS tokens, round(((SELECT count(*) FROM x) - m) / (SELECT count(*) FROM x), 6) AS ratio FROM t, s")
def c06b(spark, d):
    x = placed(spark, d).select("seq", "pos", F.when(F.col("k") % 3 == 0, "a").otherwise(F.col("token")).alias("token"))
    return rounded(K.log_table(spark, K.merge_rounds(x, 1)[1]), "ratio")


@query("c07_pmi_merges")
def c07(spark, d):
    return K.log_table(spark, pmi_log(spark, d))


def pmi_log(spark, d):
    return K.merge_rounds(placed(spark, d).select("seq", "pos", "token"), 20, least=3, by_pmi=True)[1]


@query("a32_context_coverage")
def a32(spark, d):
    r = F.col("ratio")
    return K.log_table(spark, pmi_log(spark, d)).select("round", (100 * (1 - r)).alias("reduction"), (8 / r - 8).alias("extra"))


@query("c09_pca")
def c09(spark, d):
    return K.pca_2(labelled(spark, d).where("n_clicks between 3 and 10"))


@query("c09_variance_ratio")
def c09b(spark, d):
    return K.principal_components(labelled(spark, d).where("n_clicks between 3 and 10")).select("n_clicks", "n", "ratio1", "ratio2")


@query("c10_parameter_sweep")
def c10(spark, d):
    """Accuracy of majority labels for every radius and least number of points, by setting and by length."""
    x = labelled(spark, d).where("n_clicks between 3 and 10")
    c = K.density_grid(x, [0.04, 0.06, 0.08], [5, 10, 20], tag="label")
    c = c.withColumns({"setting": F.format_string("%.2f/%d", "eps", "min_points"), "cluster": F.coalesce("cluster", F.lit(-1))})
    return Q.sweep_summary(Q.vote_accuracy(c, ["setting", "n_clicks"], "cluster", "label", "n"), "setting", "n_clicks")


@query("c11_global_cluster_ids", f"WITH {LAB} SELECT n_clicks, cluster, CAST(row_number() OVER (ORDER BY n_clicks, cluster) - 1 AS INTEGER) AS gid FROM (SELECT DISTINCT n_clicks, actor % 6 AS cluster FROM lab WHERE actor % 7 <> 0)")
def c11(spark, d):
    x = labelled(spark, d).withColumn("cluster", F.when(F.col("actor") % 7 != 0, F.col("actor") % 6))
    return K.global_cluster_ids(x, "n_clicks", "cluster", "label")[0]


@query("c11_clusters_with_labels", f"WITH {LAB}, g AS (SELECT n_clicks, actor % 97 AS cluster, count(CASE WHEN row_id % 3 = 0 THEN label END) AS n FROM lab GROUP BY ALL) SELECT count(*) FILTER (n > 0) AS with_labels, count(*) FILTER (n = 0) AS without FROM g")
def c11b(spark, d):
    x = labelled(spark, d).withColumns({"cluster": F.col("actor") % 97, "label": F.when(F.col("row_id") % 3 == 0, F.col("label"))})
    return K.global_cluster_ids(x, "n_clicks", "cluster", "label")[1]


@query(
    "c11_noise_majority",
    f"WITH {LAB}, c AS (SELECT n_clicks, actor % 97 AS cluster, label, count(*) AS c FROM lab WHERE row_id % 3 = 0 GROUP BY ALL), g AS (SELECT n_clicks, cluster, arg_min(label, (-c, label)) LIKE '5%' AS lost, coalesce(sum(c) FILTER (label NOT LIKE '5%'), 0) AS r FROM c GROUP BY ALL) SELECT count(*) AS clusters, count(*) FILTER (lost) AS noise_clusters, CAST(coalesce(sum(r) FILTER (lost), 0) AS BIGINT) AS rows_inside FROM g",
)
def c11c(spark, d):
    x = labelled(spark, d).withColumns({"cluster": F.col("actor") % 97, "label": F.when(F.col("row_id") % 3 == 0, F.col("label"))})
    return K.noise_majority(x, "n_clicks", "cluster", "label", F.col("label").startswith("5"))


@query("u01_residual_pool", f"WITH {LAB} SELECT row_id FROM lab WHERE (row_id % 4 = 0 AND label LIKE '5%') OR (row_id % 4 <> 0 AND n_clicks > 6)")
def u01(spark, d):
    anchor = F.col("row_id") % 4 == 0
    return labelled(spark, d).where((anchor & F.col("label").startswith("5")) | (~anchor & (F.col("n_clicks") > 6))).select("row_id")


@query("u02_mixed_training_set", "SELECT doc_id, 'held' AS part FROM documents WHERE source LIKE 'src1%' UNION ALL SELECT doc_id, 'clean' FROM documents WHERE source NOT LIKE 'src1%' AND doc_id % 5 <> 0")
def u02(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source")
    held = F.col("source").startswith("src1")
    return x.where(held).select("doc_id", F.lit("held").alias("part")).unionByName(x.where(~held & (F.col("doc_id") % 5 != 0)).select("doc_id", F.lit("clean").alias("part")))


@query("u03_vocabulary_sets", f"WITH {EV}, a AS (SELECT DISTINCT k FROM ev WHERE seq % 2 = 0 AND event_id % 50 = 0), b AS (SELECT DISTINCT k FROM ev WHERE seq % 2 = 1 AND event_id % 50 = 1) SELECT (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS leaked")
def u03(spark, d):
    from .views import events

    e = events(spark, d)
    a, b = e.where("seq % 2 = 0 and event_id % 50 = 0").select("k").distinct(), e.where("seq % 2 = 1 and event_id % 50 = 1").select("k").distinct()
    one = lambda x, n: x.agg(F.count("*").alias(n))
    return one(a.union(b).distinct(), "both").crossJoin(one(a.intersect(b), "shared")).crossJoin(one(a.exceptAll(b), "leaked"))  # one row each


@query("u03_vocabulary_folds", f"WITH {EV}, a AS (SELECT DISTINCT k FROM ev WHERE seq % 2 = 0), b AS (SELECT DISTINCT k FROM ev WHERE seq % 2 = 1) SELECT (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS shared, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS leaked")
def u03_folds(spark, d):
    from .views import events

    e = events(spark, d)
    a, b = e.where("seq % 2 = 0").select("k").distinct(), e.where("seq % 2 = 1").select("k").distinct()
    one = lambda x, n: x.agg(F.count("*").alias(n))
    return one(a.union(b).distinct(), "both").crossJoin(one(a.intersect(b), "shared")).crossJoin(one(a.exceptAll(b), "leaked"))  # one row each


@query("u04_distinct_by_key", f"WITH {LAB} SELECT actor, arg_min(label, row_id) AS label, min(row_id) AS row_id FROM lab GROUP BY actor")
def u04(spark, d):
    return labelled(spark, d).groupBy("actor").agg(F.min_by("label", "row_id").alias("label"), F.min("row_id").alias("row_id"))


