"""Queries of pattern strings and their metrics over order patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import columns as C
from seqspark.operators import cluster as K
from seqspark.operators import patterns as P
from seqspark.operators.stages import written

from .q_stats import rounded
from .registry import query
from .views import LAB, labelled

ED = """el AS (SELECT row_id, i, ici[i] AS x FROM (SELECT row_id, ici, unnest(range(1, len(ici) + 1)) AS i FROM lab)), eg AS (SELECT i AS pos, list_sort(list_distinct(quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM el GROUP BY i HAVING count(*) >= 40),
ok AS (SELECT * FROM eg WHERE len(e) > 1), sy AS (SELECT row_id, string_agg(CASE WHEN e IS NULL THEN 'C' ELSE substr('ABCD', CAST(least(len(list_filter(e[2:len(e) - 1], lambda z: z < x)), 3) AS INTEGER) + 1, 1) END, '' ORDER BY i) AS sym FROM el LEFT JOIN ok ON pos = i GROUP BY row_id)"""
SYM = f"{LAB}, {ED}, st AS (SELECT lab.*, sym FROM lab JOIN sy USING (row_id))"


def strings(spark, d):
    """Rows with their symbol strings, written, as most readers take them several times, and the edges."""
    x = written(labelled(spark, d), "patterns")
    e = written(P.position_edges(x), "edges")
    return written(P.symbol_strings(x, e), "strings"), e


@query("a19_position_edges", f"WITH {LAB}, {ED} SELECT CAST(pos AS INTEGER) AS pos, list_transform(e, lambda z: round(z, 6)) AS edges FROM ok")
def a19(spark, d):
    return P.position_edges(labelled(spark, d)).withColumn("edges", F.transform("edges", lambda z: F.round(z, 6)))


@query("p20_symbolise", f"WITH {SYM} SELECT row_id, sym FROM st")
def p20(spark, d):
    return strings(spark, d)[0].select("row_id", "sym")


@query("a20_string_corpus", f"WITH {SYM}, x AS (SELECT sym || CASE WHEN dur < 0.45 THEN 'P' WHEN dur < 0.61 THEN 'Q' WHEN dur < 0.93 THEN 'R' WHEN dur < 1.08 THEN 'S' ELSE 'T' END AS string FROM st WHERE length(sym) >= 2) SELECT string, count(*) AS c FROM x GROUP BY string")
def a20(spark, d):
    return P.string_corpus(strings(spark, d)[0].withColumn("tempo", C.tempo_bucket(F.col("dur"))), tempo="tempo")


@query("w19_string_ids", f"WITH {SYM}, d AS (SELECT sym, CAST(row_number() OVER (ORDER BY sym) AS INTEGER) AS sid FROM (SELECT DISTINCT sym FROM st)) SELECT row_id, sym, sid FROM st JOIN d USING (sym)")
def w19(spark, d):
    return P.string_ids(strings(spark, d)[0]).select("row_id", "sym", "sid")


MEANS = """vm AS (SELECT el.i AS pos, substr(sym, CAST(el.i AS INTEGER), 1) AS symbol, avg(x) AS m FROM el JOIN sy USING (row_id) GROUP BY ALL), md AS (SELECT pos, substr('ABCD', CAST(i AS INTEGER), 1) AS symbol, (e[i] + e[i + 1]) / 2 AS mid FROM (SELECT pos, e, unnest(range(1, len(e))) AS i FROM ok)),
bm AS (SELECT coalesce(vm.pos, md.pos) AS pos, coalesce(vm.symbol, md.symbol) AS symbol, coalesce(m, mid) AS mean FROM vm FULL JOIN md ON vm.pos = md.pos AND vm.symbol = md.symbol)"""


@query("a22_bin_means", f"WITH {SYM}, {MEANS} SELECT CAST(pos AS INTEGER) AS pos, symbol, round(mean, 6) AS mean FROM bm")
def a22(spark, d):
    s, e = strings(spark, d)
    return rounded(P.bin_means(s, e).withColumn("pos", F.col("pos").cast("int")), "mean")


@query("p21_desymbolise", f"WITH {SYM}, {MEANS} SELECT el.row_id, list(round(coalesce(mean, 0.25), 6) ORDER BY el.i) AS timing FROM el JOIN sy USING (row_id) LEFT JOIN bm ON bm.pos = el.i AND bm.symbol = substr(sym, CAST(el.i AS INTEGER), 1) GROUP BY el.row_id")
def p21(spark, d):
    s, e = strings(spark, d)
    return P.desymbolise(s, P.bin_means(s, e), "row_id").withColumn("timing", F.transform("timing", lambda x: F.round(x, 6)))


@query("a23_label_strings", f"WITH {SYM}, c AS (SELECT label, sym AS string, count(*) AS c FROM st GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY c DESC, string) AS INTEGER) AS r FROM c")
def a23(spark, d):
    return P.label_strings(strings(spark, d)[0], "label")


#: Segments of two symbols, the last one shorter.
TWO = "sg AS (SELECT DISTINCT sym AS string, list_transform(range(0, CAST((length(sym) + 1) // 2 AS INTEGER)), lambda i: substr(sym, CAST(2 * i + 1 AS INTEGER), 2)) AS segs FROM st)"


def two(s):
    return s.select(F.col("sym").alias("string")).distinct().withColumn("segs", F.transform(F.sequence(F.lit(0), F.floor((F.length("string") - 1) / 2).cast("int")), lambda i: F.substring(F.col("string"), i * 2 + 1, F.lit(2))))


@query("a21_segment_inventory", f"WITH {SYM}, {TWO}, c AS (SELECT sym AS string, count(*) AS c FROM st WHERE length(sym) >= 2 GROUP BY 1) SELECT segment, CAST(sum(c) AS BIGINT) AS freq, count(*) AS strings FROM (SELECT c, unnest(segs) AS segment FROM c JOIN sg USING (string)) GROUP BY segment")
def a21(spark, d):
    s, _ = strings(spark, d)
    return P.segment_inventory(P.string_corpus(s), two(s))


PUR = f"WITH {SYM}, {TWO}, x AS (SELECT label, unnest(list_distinct(segs)) AS segment FROM st JOIN sg ON string = sym), c AS (SELECT segment, label, count(*) AS c FROM x GROUP BY ALL), pu AS (SELECT segment, CAST(sum(c) AS BIGINT) AS n, count(*) AS labels, max(c) / sum(c) AS purity FROM c GROUP BY segment)"


@query("a21_segment_purity", PUR + " SELECT segment, n, labels, round(purity, 6) AS purity FROM pu")
def a21b(spark, d):
    s, _ = strings(spark, d)
    return rounded(P.segment_purity(s, two(s), "sym", "label"), "purity")


@query(
    "a21_segment_features",
    f"WITH {SYM}, {TWO}, x AS (SELECT CASE WHEN dur < 0.45 THEN 1 WHEN dur < 0.61 THEN 2 WHEN dur < 0.93 THEN 3 WHEN dur < 1.08 THEN 4 ELSE 5 END AS tempo, CASE row_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '-' ELSE '\\' END AS trend, row_id % 2 AS orn, unnest(segs) AS segment FROM st JOIN sg ON string = sym) SELECT segment, count(*) AS n, round(avg(tempo), 6) AS tempo_mean, round(stddev_pop(tempo), 6) AS tempo_sd, count(*) FILTER (trend = '/') AS rising, count(*) FILTER (trend = '-') AS level, count(*) FILTER (trend = '\\') AS falling, round(avg(orn), 6) AS ornament_rate FROM x GROUP BY segment",
)
def a21c(spark, d):
    s, _ = strings(spark, d)
    r = F.col("row_id") % 3
    x = s.withColumns({"tempo": C.tempo_bucket(F.col("dur")), "trend": F.when(r == 0, "/").when(r == 1, "-").otherwise("\\"), "orn": F.col("row_id") % 2})
    return rounded(P.segment_features(x, two(s), "sym", "tempo", "trend", "orn"), "tempo_mean", "tempo_sd", "ornament_rate")


@query("a35_tension_summary", PUR + ", o AS (SELECT * FROM pu WHERE n >= 50), h AS (SELECT avg(purity) AS p FROM (SELECT purity FROM o ORDER BY n DESC, segment LIMIT 20)) SELECT count(*) FILTER (labels = 1) AS confined, count(*) FILTER (labels > 1) AS spanning, round(any_value(p), 6) AS top_purity FROM o, h")
def a35(spark, d):
    s, _ = strings(spark, d)
    return rounded(P.tension_summary(P.segment_purity(s, two(s), "sym", "label")), "top_purity")


def _bins(b):
    """SQL of one number of bins: strings, their cut into twos, and the shares."""
    edges = ", ".join(str(i / b) for i in range(b + 1))
    names = "ABCDEFGHIJ"[:b]
    return f"""eg{b} AS (SELECT i AS pos, list_sort(list_distinct(quantile_cont(x, [{edges}]))) AS e FROM el GROUP BY i HAVING count(*) >= {10 * b}), ok{b} AS (SELECT * FROM eg{b} WHERE len(e) > 1),
st{b} AS (SELECT lab.row_id, lab.label, sym FROM lab JOIN (SELECT row_id, string_agg(CASE WHEN e IS NULL THEN 'C' ELSE substr('{names}', CAST(least(len(list_filter(e[2:len(e) - 1], lambda z: z < x)), {b - 1}) AS INTEGER) + 1, 1) END, '' ORDER BY i) AS sym FROM el LEFT JOIN ok{b} ON pos = i GROUP BY row_id) USING (row_id)),
cu{b} AS (SELECT sym, label, list_transform(range(0, CAST((length(sym) + 1) // 2 AS BIGINT)), lambda i: substr(sym, CAST(2 * i + 1 AS INTEGER), 2)) AS segs FROM st{b} WHERE length(sym) >= 2),
sl{b} AS (SELECT seg, label, count(*) AS c FROM (SELECT label, unnest(list_distinct(segs)) AS seg FROM cu{b}) WHERE label IS NOT NULL GROUP BY ALL), pu{b} AS (SELECT seg AS segment, sum(c) AS n, count(*) AS labels, max(c) / sum(c) AS purity FROM sl{b} GROUP BY seg HAVING sum(c) >= 50),
rb{b} AS (SELECT {b} AS bins, (SELECT count(DISTINCT sym) FROM cu{b}) AS strings, (SELECT count(DISTINCT seg) FROM (SELECT unnest(segs) AS seg FROM cu{b})) AS inventory, (SELECT round(avg(CAST(len(segs) > 1 AS INTEGER)), 6) FROM cu{b}) AS segmented, (SELECT round(sum(length(sym)) / sum(len(segs)), 6) FROM cu{b}) AS mean_length,
  (SELECT round(avg(purity), 6) FROM (SELECT purity FROM pu{b} ORDER BY n DESC, segment LIMIT 20)) AS top_purity, (SELECT count(*) FILTER (labels = 1) FROM pu{b}) AS confined, (SELECT count(*) FILTER (labels > 1) FROM pu{b}) AS spanning)"""


BINS = (2, 3, 4, 7, 10)


@query("a31_bin_sensitivity", f"WITH {LAB}, {ED.split(', eg AS')[0]}, " + ", ".join(map(_bins, BINS)) + " " + " UNION ALL ".join(f"SELECT * FROM rb{b}" for b in BINS))
def a31(spark, d):
    in_twos = lambda corpus: corpus.select("string", F.regexp_extract_all("string", F.lit("..?"), F.lit(0)).alias("segs"))
    return rounded(P.bin_sensitivity(labelled(spark, d), in_twos, BINS), "segmented", "mean_length", "top_purity")


FOLDS = 3
PRED = f"""sq AS (SELECT row_id, CAST(actor % {FOLDS} AS INTEGER) AS own, label, sym, ici, lag(label) OVER (PARTITION BY actor ORDER BY row_id) AS b FROM st), fo AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold), tr AS (SELECT fold, sq.* FROM sq JOIN fo ON fold <> own),
nx AS (SELECT fold, b, arg_min(label, (-c, label)) AS nxt FROM (SELECT fold, b, label, count(*) AS c FROM tr WHERE b IS NOT NULL GROUP BY ALL) GROUP BY ALL), mo AS (SELECT fold, arg_min(label, (-c, label)) AS most FROM (SELECT fold, label, count(*) AS c FROM tr GROUP BY ALL) GROUP BY ALL),
be AS (SELECT fold, label, arg_min(sym, (-c, sym)) AS pred FROM (SELECT fold, label, sym, count(*) AS c FROM tr GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT sq.row_id, sym, ici, coalesce(be.pred, '') AS pred FROM sq JOIN mo ON mo.fold = own LEFT JOIN nx ON nx.fold = own AND nx.b = sq.b LEFT JOIN be ON be.fold = own AND be.label = coalesce(nxt, most))"""


def predicted(spark, d):
    """Strings with ``pred``: the string of the likeliest next label of the actor, both counted in the folds that don't test the actor."""
    s, e = strings(spark, d)
    x = s.select("row_id", F.col("actor").alias("seq"), F.col("row_id").alias("pos"), (F.col("actor") % FOLDS).cast("int").alias("own"), "label", "sym")
    return s, e, s.join(P.held_out_strings(x, FOLDS).hint("shuffle_hash"), "row_id")


@query("l12_string_metrics", f"WITH {SYM}, {PRED} SELECT row_id, CAST(pred = sym AS INTEGER) AS exact, round(len(list_filter(range(1, CAST(least(length(pred), length(sym)) AS INTEGER) + 1), lambda i: substr(pred, CAST(i AS INTEGER), 1) = substr(sym, CAST(i AS INTEGER), 1))) / greatest(length(pred), length(sym)), 6) AS symbol_acc, round(levenshtein(pred, sym) / greatest(length(pred), length(sym)), 6) AS norm_edit FROM pr")
def l12(spark, d):
    x = predicted(spark, d)[2]
    return rounded(x.select("row_id", P.string_metrics(F.col("pred"), F.col("sym")).alias("m")).select("row_id", "m.*"), "symbol_acc", "norm_edit")


@query("l13_timing_metrics")
def l13(spark, d):
    s, e, x = predicted(spark, d)
    t = P.desymbolise(x.select("row_id", F.col("pred").alias("sym")), P.bin_means(s, e), "row_id")
    return P.timing_summary(x.select("row_id", "ici", "n_clicks").join(t.hint("merge"), "row_id"), "timing", "ici", ["n_clicks"])


@query("l14_predicted_strings", f"WITH {SYM}, {PRED} SELECT row_id, pred FROM pr")
def l14(spark, d):
    return predicted(spark, d)[2].select("row_id", "pred")


@query(
    "l10_label_mixture_bits",
    f"""WITH {SYM}, lp AS (SELECT label, count(*) / (SELECT count(*) FROM st) AS p FROM st GROUP BY 1), tb AS (SELECT label, sym AS string, count(*) AS c FROM st WHERE row_id % 4 <> 0 GROUP BY ALL), n AS (SELECT label, sum(c) AS n FROM tb GROUP BY 1), v AS (SELECT count(DISTINCT string) AS v FROM tb), k AS (SELECT row_id, sym FROM st WHERE row_id % 4 = 0)
SELECT row_id AS key, round(-log2(greatest(sum(p * CASE WHEN n IS NULL THEN 1 / v ELSE (coalesce(c, 0) + 0.5) / (n + 0.5 * v) END), 1e-12)), 6) AS bits FROM k JOIN lp ON true JOIN v ON true LEFT JOIN n ON n.label = lp.label LEFT JOIN tb ON tb.label = lp.label AND tb.string = k.sym GROUP BY row_id""",
)
def l10(spark, d):
    s, _ = strings(spark, d)
    s = s.select("row_id", "label", "sym")
    total = s.agg(F.count("*").alias("t"))
    lp = s.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(total)).select("label", (F.col("c") / F.col("t")).alias("p"))
    test = s.where("row_id % 4 = 0").select(F.col("row_id").alias("key"), F.col("sym").alias("string"))
    shares = lp.agg(F.collect_list(F.struct("label", "p")).alias("ls"))  # one row: the labels are the model's
    probs = test.select("key").crossJoin(F.broadcast(shares)).select("key", F.explode("ls").alias("l")).select("key", "l.*")
    return rounded(P.label_mixture_bits(probs, P.label_strings(s.where("row_id % 4 <> 0"), "label"), test), "bits")


CTX = f"""sq AS (SELECT row_id, CAST(actor % {FOLDS} AS INTEGER) AS own, label AS l, sym AS s, lag(label) OVER (PARTITION BY actor ORDER BY row_id) AS b FROM st), fo AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold), tr AS (SELECT fold, sq.* FROM sq JOIN fo ON fold <> own), ls AS (SELECT DISTINCT l FROM sq), m AS (SELECT count(*) AS m FROM ls),
v AS (SELECT fold, count(DISTINCT s) AS v FROM tr GROUP BY 1), n AS (SELECT fold, l, count(*) AS n FROM tr GROUP BY ALL), c AS (SELECT fold, l, s, count(*) AS c FROM tr GROUP BY ALL), cb AS (SELECT fold, b, l, count(*) AS c FROM tr WHERE b IS NOT NULL GROUP BY ALL), tb AS (SELECT fold, b, sum(c) AS t FROM cb GROUP BY ALL), nt AS (SELECT fold, sum(n) AS t FROM n GROUP BY 1),
ps AS (SELECT row_id, own, sum(CASE WHEN tb.t IS NULL THEN (coalesce(n.n, 0) + 0.5) / (nt.t + 0.5 * m) ELSE (coalesce(cb.c, 0) + 0.5) / (tb.t + 0.5 * m) END * CASE WHEN n.n IS NULL THEN 1 / v ELSE (coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * v) END) AS p
  FROM sq JOIN ls ON true JOIN m ON true JOIN v ON v.fold = own JOIN nt ON nt.fold = own LEFT JOIN n ON n.fold = own AND n.l = ls.l LEFT JOIN c ON c.fold = own AND c.l = ls.l AND c.s = sq.s LEFT JOIN tb ON tb.fold = own AND tb.b = sq.b LEFT JOIN cb ON cb.fold = own AND cb.b = sq.b AND cb.l = ls.l GROUP BY ALL)"""


def sequenced(s):
    return s.select("row_id", F.col("actor").alias("seq"), F.col("row_id").alias("pos"), (F.col("actor") % FOLDS).cast("int").alias("own"), "label", "sym")


@query("l10_context_mixture_bits", f"WITH {SYM}, {CTX} SELECT row_id, own AS fold, round(-log2(greatest(p, 1e-12)), 6) AS bits FROM ps")
def l10b(spark, d):
    return rounded(P.context_mixture_bits(sequenced(strings(spark, d)[0]), FOLDS), "bits")


def segmented(s):
    """Rows with their strings in pieces of two symbols."""
    return sequenced(s).withColumn("segs", F.regexp_extract_all("sym", F.lit("..?"), F.lit(0)))


@query(
    "l14_greedy_strings",
    f"""WITH RECURSIVE {SYM}, sg AS (SELECT row_id, actor, CAST(actor % {FOLDS} AS INTEGER) AS own, list_transform(range(0, CAST((length(sym) + 1) // 2 AS BIGINT)), lambda i: substr(sym, CAST(2 * i + 1 AS INTEGER), 2)) AS segs FROM st), lb AS (SELECT *, coalesce(lag(segs[-1]) OVER (PARTITION BY actor ORDER BY row_id), '<B>') AS b FROM sg),
ch AS (SELECT own, unnest(list_concat([b], segs[1:len(segs) - 1])) AS b, unnest(segs) AS t FROM lb), fo AS (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS fold), tc AS (SELECT fold, b, t, count(*) AS c FROM ch JOIN fo ON fold <> own GROUP BY ALL), sc AS (SELECT fold, b, arg_min(t, (-c, t)) AS nxt FROM tc GROUP BY ALL),
mo AS (SELECT fold, arg_min(t, (-c, t)) AS most FROM (SELECT fold, t, sum(c) AS c FROM tc GROUP BY ALL) GROUP BY fold), r AS (SELECT row_id, own AS fold, len(segs) AS n, b AS at, 0 AS i, '' AS pred FROM lb UNION ALL SELECT row_id, r.fold, n, coalesce(nxt, most), i + 1, pred || coalesce(nxt, most) FROM r JOIN mo ON mo.fold = r.fold LEFT JOIN sc ON sc.fold = r.fold AND sc.b = r.at WHERE i < n)
SELECT row_id, fold, pred FROM r WHERE i = n""",
)
def l14b(spark, d):
    return P.greedy_strings(segmented(strings(spark, d)[0]), FOLDS)


@query("c08_segmentation")
def c08(spark, d):
    s, _ = strings(spark, d)
    return K.segment_strings(P.string_corpus(s), rounds=6)


@query("c08_expand_segments", f"WITH {SYM}, {TWO} SELECT actor AS seq, event, CAST(i AS INTEGER) AS sub, segs[i + 1] AS token, gap, i = 0 AS starts FROM (SELECT actor, row_id AS event, dur AS gap, segs, unnest(range(0, len(segs))) AS i FROM st JOIN sg ON string = sym)")
def c08b(spark, d):
    s, _ = strings(spark, d)
    x = K.expand_segments(s, two(s), "actor", "row_id", "sym", "dur")
    return x.select(F.col("actor").alias("seq"), "event", "sub", "token", F.col("dur").alias("gap"), "starts")
