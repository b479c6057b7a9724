"""Queries of the context windows and token tables over events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import columns as C
from seqspark.operators import context as X
from seqspark.operators import stats as S
from seqspark.operators import tokens as T

from .registry import query
from .views import EV, TURN, WORD, events, labelled, table, turns, words
from .views import LAB

HOUR = 3600.0
POS = "pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY t, event_id) - 1 AS INTEGER) AS pos FROM ev)"
#: An event's actor in a day's sequence; days are the recordings, users the actors.
DAY = "dy AS (SELECT event_id, us, t, token, value, k, us // 86400000000 AS day, CASE WHEN k % 8 = 0 THEN NULL ELSE seq END AS actor, k % 5 + 2 AS clicks, CASE WHEN k % 9 = 0 THEN NULL ELSE k % 2 + 1 END AS tempo, CASE WHEN k % 11 = 0 THEN NULL ELSE t END AS tt FROM ev)"


def placed(spark, d):
    return X.item_position(events(spark, d), "seq", "t", "event_id")


def days(spark, d):
    k = F.col("k")
    day = F.floor(F.col("us") / 86400000000).cast("long")
    return events(spark, d).select("event_id", "us", "t", "token", "value", "k", day.alias("day"), F.when(k % 8 != 0, F.col("seq")).alias("actor"), (k % 5 + 2).alias("clicks"), F.when(k % 9 != 0, k % 2 + 1).alias("tempo"), F.when(k % 11 != 0, F.col("t")).alias("tt"))


@query("w03_item_position", f"WITH {EV}, {POS} SELECT event_id, seq, pos FROM pos")
def w03(spark, d):
    return placed(spark, d).select("event_id", "seq", "pos")


@query(
    "w04_time_since_timed",
    f"""WITH {EV}, {DAY}, p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY tt NULLS LAST, event_id) AS n FROM dy),
l AS (SELECT *, last_value(tt IGNORE NULLS) OVER (PARTITION BY day ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM p)
SELECT event_id, round(CASE WHEN tt IS NULL THEN -1.0 WHEN lt IS NULL THEN 0.0 ELSE tt - lt END, 4) AS gap FROM l""",
)
def w04(spark, d):
    p = X.item_position(days(spark, d), "day", "tt", "event_id")
    return X.time_since_timed(p, "day", "tt", ["pos"]).select("event_id", F.round("gap", 4).alias("gap"))


@query(
    "w05_actor_switch",
    f"""WITH {EV}, {DAY}, l AS (SELECT *, lag(actor) OVER w AS pa, lag(tt) OVER w AS pt FROM dy WINDOW w AS (PARTITION BY day ORDER BY us, event_id))
SELECT event_id, CAST(coalesce(actor <> pa AND tt IS NOT NULL AND pt IS NOT NULL, false) AS INTEGER) AS strict, CAST(coalesce(actor <> pa, false) AS INTEGER) AS loose FROM l""",
)
def w05(spark, d):
    x = days(spark, d).withColumn("timed", F.col("tt").isNotNull())
    x = X.actor_switch(x, "day", "actor", ["us", "event_id"], "timed", out="strict")
    return X.actor_switch(x, "day", "actor", ["us", "event_id"], "timed", loose=True, out="loose").select("event_id", "strict", "loose")


@query(
    "w01_duration_trend",
    f"""WITH {EV}, {DAY}, e AS (SELECT * FROM dy WHERE actor IS NOT NULL AND tt IS NOT NULL AND tempo IS NOT NULL),
l AS (SELECT *, lag(tt) OVER w AS pt, lag(token) OVER w AS pl, lag(tempo) OVER w AS pm, lag(value) OVER w AS pv FROM e WINDOW w AS (PARTITION BY actor, day // 10 ORDER BY tt, event_id)),
r AS (SELECT event_id, CASE WHEN tt - pt <= 86400 AND pl = token AND pm = tempo THEN CASE WHEN value / 100 - pv / 100 < -0.021416925000000087 THEN '\\' WHEN value / 100 - pv / 100 < 0.018462550000000105 THEN '-' ELSE '/' END END AS trend FROM l)
SELECT dy.event_id, trend FROM dy LEFT JOIN r USING (event_id)""",
)
def w01(spark, d):
    x = days(spark, d).withColumns({"rec": F.floor(F.col("day") / 10), "v": F.col("value") / 100})
    return X.duration_trend(x, ["actor", "rec"], "tt", "event_id", "token", "tempo", "v", window=86400.0).select("event_id", "trend")


@query(
    "w02_ornament",
    f"""WITH {EV}, {DAY}, l AS (SELECT *, lag(tt) OVER w AS pt, lead(tt) OVER w AS nt, lag(clicks) OVER w AS pc, lead(clicks) OVER w AS nc FROM dy WHERE actor IS NOT NULL AND tt IS NOT NULL WINDOW w AS (PARTITION BY actor, day // 10 ORDER BY tt, event_id)),
r AS (SELECT event_id, CAST(coalesce(tt - pt <= 86400 AND pc = clicks - 1, false) OR coalesce(nt - tt <= 86400 AND nc = clicks - 1, false) AS INTEGER) AS ornament FROM l)
SELECT dy.event_id, ornament FROM dy LEFT JOIN r USING (event_id)""",
)
def w02(spark, d):
    x = days(spark, d).withColumn("rec", F.floor(F.col("day") / 10))
    return X.ornament(x, ["actor", "rec"], "tt", "event_id", "clicks", window=86400.0).select("event_id", "ornament")


@query(
    "j09_synchrony",
    f"""WITH {EV}, {DAY} SELECT a.event_id, CAST(a.actor IS NOT NULL AND EXISTS (SELECT 1 FROM dy b WHERE b.day = a.day AND b.us BETWEEN a.us - 300000000 AND a.us + 300000000 AND b.actor IS DISTINCT FROM a.actor) AS INTEGER) AS sync FROM dy a""",
)
def j09(spark, d):
    return X.synchrony(days(spark, d), "day", "actor", "us", 300_000_000).select("event_id", "sync")


@query(
    "w06_context_windows",
    f"""WITH {EV}, {POS}, l AS (SELECT seq, pos, token, k, coalesce(lag(token, 3) OVER w, '<PAD>') AS a, coalesce(lag(token, 2) OVER w, '<PAD>') AS b, coalesce(lag(token) OVER w, '<PAD>') AS c, lag(k, 3) OVER w AS ka, lag(k, 2) OVER w AS kb, lag(k) OVER w AS kc FROM pos WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT seq, pos, [a, b, c] AS context, token AS target, [ka, kb, kc] AS context_k FROM l WHERE pos > 0""",
)
def w06(spark, d):
    return T.context_windows(placed(spark, d), "seq", "pos", "token", 3, ["k"])


@query("w07_strict_windows", f"""WITH {EV}, {POS}, l AS (SELECT seq, pos, [lag(token, 2) OVER w, lag(token) OVER w, token] AS "window" FROM pos WINDOW w AS (PARTITION BY seq ORDER BY pos)) SELECT * FROM l WHERE pos >= 2""")
def w07(spark, d):
    return T.strict_windows(placed(spark, d), "seq", "pos", "token", 2)


PAUSE = "CASE WHEN g < 60 THEN '(pause ' || CAST(floor(g) AS BIGINT) || ' s)' WHEN g < 3600 THEN '(pause ' || CAST(floor(g / 60) AS BIGINT) || ' min)' WHEN g < 86400 THEN '(pause ' || CAST(floor(g / 3600) AS BIGINT) || ' h)' ELSE '(pause ' || CAST(floor(g / 86400) AS BIGINT) || ' d)' END"


@query(
    "w08_speaker_runs",
    f"""WITH {EV}, {DAY}, x AS (SELECT *, CAST(floor(tt) AS DOUBLE) AS ft FROM dy),
a AS (SELECT *, row_number() OVER w AS n, lag(actor) OVER w AS pa, last_value(ft IGNORE NULLS) OVER (PARTITION BY day ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM x WINDOW w AS (PARTITION BY day ORDER BY us, event_id)),
b AS (SELECT *, ft - lt AS g, coalesce(ft - lt > 600, false) AS pz FROM a),
c AS (SELECT *, sum(CAST(n = 1 OR pz OR actor IS DISTINCT FROM pa AS INTEGER)) OVER (PARTITION BY day ORDER BY n) AS run FROM b),
r AS (SELECT day, run, first(actor ORDER BY n) AS who, max(CASE WHEN pz THEN g END) AS g, string_agg(CASE WHEN n = 1 OR pz THEN token WHEN g IS NULL THEN 'Δt? ' || token ELSE printf('Δt%.2f', greatest(g, 0)) || ' ' || token END, ' ' ORDER BY n) AS body FROM c GROUP BY day, run)
SELECT day, CAST(run * 2 + (g IS NOT NULL)::INT AS BIGINT) AS line_no, '  ' || coalesce(CAST(who AS VARCHAR), '?') || ': ' || body AS line FROM r
UNION ALL SELECT day, CAST(run * 2 AS BIGINT), '  ' || {PAUSE} FROM r WHERE g IS NOT NULL""",
)
def w08(spark, d):
    x = days(spark, d).withColumn("ft", F.floor("tt").cast("double"))
    return X.speaker_runs(x, "day", ["us", "event_id"], "ft", "actor", "token", 600.0).withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "w09_utterance_runs",
    f"""WITH {EV}, {POS}, x AS (SELECT seq, pos, token, k % 3 AS actor, CASE k % 4 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.3 END AS dt FROM pos),
a AS (SELECT *, coalesce(actor <> lag(actor) OVER w OR dt = 2.0, true) AS new FROM x WINDOW w AS (PARTITION BY seq ORDER BY pos)),
b AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY seq ORDER BY pos) AS run FROM a)
SELECT seq, CAST(run AS BIGINT) AS run, first(actor ORDER BY pos) AS actor, string_agg(CASE WHEN new THEN token WHEN dt = 1.0 THEN '. ' || token WHEN dt = 0.5 THEN ', ' || token ELSE ' ' || token END, '' ORDER BY pos) AS text FROM b GROUP BY seq, run""",
)
def w09(spark, d):
    k = F.col("k")
    x = placed(spark, d).withColumns({"actor": k % 3, "dt": F.when(k % 4 == 0, 2.0).when(k % 4 == 1, 1.0).when(k % 4 == 2, 0.5).otherwise(0.3)})
    return X.utterance_runs(x, "seq", ["pos"], "actor", "token", "dt")


@query("w11_label_index", f"WITH {WORD} SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT token FROM word)")
def w11(spark, d):
    return T.label_index(words(spark, d), "token")


@query(
    "w12_actor_index",
    "SELECT actor, CAST(row_number() OVER (ORDER BY CASE WHEN actor LIKE '%::UNK' THEN 0 ELSE 1 END, actor) - 1 AS INTEGER) AS actor_id FROM (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN source || '::UNK' ELSE source || '::' || lang END AS actor FROM documents)",
)
def w12(spark, d):
    a = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("::UNK"))).otherwise(F.concat_ws("::", "source", "lang"))
    return T.actor_index(table(spark, d, "documents").select(a.alias("actor")), "actor")


@query(
    "w13_equal_population_bins",
    f"""WITH {EV}, e AS (SELECT list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS q FROM ev)
SELECT event_id, CAST(len(list_filter(q, lambda x: x < value)) AS INTEGER) AS bin FROM ev, e""",
)
def w13(spark, d):
    return T.equal_population_bins(events(spark, d), "value").select("event_id", "bin")


@query(
    "w14_compound_token",
    f"""WITH {EV}, c AS (SELECT DISTINCT token AS lab, k % 5 AS tempo, k % 2 AS orn, k % 3 AS sync FROM ev)
SELECT lab, tempo, orn, sync, CAST(row_number() OVER (ORDER BY lab, tempo, orn, sync) - 1 AS INTEGER) AS token, lab || '|' || tempo || '|' || orn || '|' || sync AS name FROM c""",
)
def w14(spark, d):
    k = F.col("k")
    return T.compound_index(events(spark, d).select(F.col("token").alias("lab"), (k % 5).alias("tempo"), (k % 2).alias("orn"), (k % 3).alias("sync")), ["lab", "tempo", "orn", "sync"])


@query("w15_recency_cache", f"WITH {EV}, {POS} SELECT seq, pos, count(*) OVER (PARTITION BY seq, token ORDER BY pos RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING) AS cached, least(pos, 20) AS cache_len FROM pos")
def w15(spark, d):
    return T.recency_counts(placed(spark, d), "seq", "pos", "token", 20).select("seq", "pos", "cached", "cache_len")


UTT = TURN + r""", utt AS (SELECT seq, pos, actor, n - 1 AS wpos, w, regexp_matches(text, '[.?!]$') AS ended FROM (SELECT *, unnest(string_split_regex(text, '[ \n]+')) AS w, generate_subscripts(string_split_regex(text, '[ \n]+'), 1) AS n FROM turn_) WHERE w <> ''),
gaps AS (SELECT *, row_number() OVER o AS rn, lag(actor) OVER o AS pa, lag(pos) OVER o AS pp, lag(ended) OVER o AS pe, lag(w) OVER o AS pw FROM utt WINDOW o AS (PARTITION BY seq ORDER BY pos, wpos))"""


def utterance_words(spark, d):
    t = turns(spark, d).select("seq", "pos", "actor", F.col("text").rlike(r"[.?!]$").alias("ended"), F.posexplode(F.split("text", r"[ \n]+")).alias("wpos", "w")).where("w <> ''")
    w = X.Window.partitionBy("seq").orderBy("pos", "wpos")
    return t.withColumn("comma", F.coalesce(F.lag("w").over(w).endswith(","), F.lit(False)))


@query("w16_estimated_gaps", f"WITH {UTT} SELECT seq, pos, wpos, CAST(CASE WHEN rn = 1 THEN 0.0 WHEN actor <> pa THEN 2.0 WHEN pos <> pp AND pe THEN 1.0 WHEN pw LIKE '%,' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS dt FROM gaps")
def w16(spark, d):
    return T.estimated_gaps(utterance_words(spark, d), "seq", ["pos", "wpos"], "actor", "pos", "ended", "comma").select("seq", "pos", "wpos", "dt")


@query(
    "w17_soft_chunks",
    rf"""WITH RECURSIVE {TURN}, n AS (SELECT seq, pos, actor, len(list_filter(string_split_regex(text, '[ \n]+'), lambda w: w <> '')) AS size, row_number() OVER (PARTITION BY seq ORDER BY pos) AS i FROM turn_),
r AS (SELECT seq, pos, actor, i, 0 AS chunk, CAST(size AS BIGINT) AS seen FROM n WHERE i = 1
  UNION ALL SELECT n.seq, n.pos, n.actor, n.i, r.chunk + CASE WHEN r.seen >= 80 AND n.actor <> r.actor THEN 1 ELSE 0 END, CASE WHEN r.seen >= 80 AND n.actor <> r.actor THEN 0 ELSE r.seen END + n.size FROM r JOIN n ON n.seq = r.seq AND n.i = r.i + 1)
SELECT seq, pos, chunk FROM r""",
)
def w17(spark, d):
    size = F.size(F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""))
    return T.soft_chunks(turns(spark, d).withColumn("size", size), "seq", "pos", "actor", "size").select("seq", "pos", "chunk")


@query(
    "w18_channel_encode",
    f"""WITH {EV}, {POS}, ix AS (SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id FROM (SELECT DISTINCT token FROM ev)),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY seq ORDER BY pos) AS gap FROM pos)
SELECT seq, pos, token_id, round(ln(0.1 + coalesce(gap, 0)), 4) AS dt_log, CAST(gap IS NOT NULL AS INTEGER) AS has_gap FROM g JOIN ix USING (token)""",
)
def w18(spark, d):
    p = placed(spark, d)
    w = X.Window.partitionBy("seq").orderBy("pos")
    g = p.withColumn("gap", F.col("t") - F.lag("t").over(w))
    return T.encode(g, T.label_index(p, "token", "token_id"), "token", "token_id").select("seq", "pos", "token_id", F.round(C.dt_log(F.col("gap")), 4).alias("dt_log"), F.col("gap").isNotNull().cast("int").alias("has_gap"))


@query("p28_p32_long_dims", f"WITH {EV} SELECT seq, event_id, dim, token FROM (SELECT seq, event_id, 'token' AS dim, token FROM ev UNION ALL SELECT seq, event_id, 'k', CAST(k AS VARCHAR) FROM ev UNION ALL SELECT seq, event_id, 'both', token || '_' || k FROM ev)")
def p28(spark, d):
    x = T.dims_of(events(spark, d), {"both": ["token", "k"]})
    return T.to_long(x, "seq", "event_id", ["token", "k", "both"])


@query("j10_realign", f"WITH {LAB}, p AS (SELECT row_id, actor, CAST(row_number() OVER (PARTITION BY actor ORDER BY day, row_id) - 1 AS INTEGER) AS pos FROM lab) SELECT actor, pos, row_id, CASE WHEN row_id % 3 <> 0 THEN n_clicks END AS n_clicks FROM p JOIN lab USING (row_id, actor)")
def j10(spark, d):
    x = labelled(spark, d)
    p = X.item_position(x, "actor", "day", "row_id").select("actor", "pos", "row_id")
    return T.realign(p, x.where("row_id % 3 <> 0").select("row_id", "n_clicks"), ["row_id"], ["n_clicks"]).select("actor", "pos", "row_id", "n_clicks")


@query("j11_encode_decode", "SELECT c_custkey, coalesce(n_name, '<' || c_nationkey || '>') AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0")
def j11(spark, d):
    n = table(spark, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    x = T.encode(table(spark, d, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "nation")
    return x.select("c_custkey", F.coalesce("nation", F.concat(F.lit("<"), F.col("c_nationkey").cast("string"), F.lit(">"))).alias("nation"))


@query("j12_stream_merge", f"WITH {TURN} SELECT seq, pos, dim, token FROM (SELECT seq, pos, 'actor' AS dim, actor AS token FROM turn_ WHERE seq % 2 = 0 UNION ALL SELECT seq, pos, 'first', string_split(text, ' ')[1] FROM turn_ WHERE seq % 3 = 0)")
def j12(spark, d):
    t = turns(spark, d)
    a = T.to_long(t.where("seq % 2 = 0"), "seq", "pos", ["actor"])
    b = T.to_long(t.where("seq % 3 = 0").withColumn("first", F.split("text", " ")[0]), "seq", "pos", ["first"])
    return T.merge_streams(a, b)


@query("j13_unknown_codes", f"WITH {EV} SELECT event_id, k FROM ev WHERE k NOT IN (SELECT DISTINCT k FROM ev WHERE event_id % 97 = 0)")
def j13(spark, d):
    e = events(spark, d).select("event_id", "k")
    return T.unknown_codes(e, e.where("event_id % 97 = 0").select("k"), "k")


@query("j14_membership", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j14(spark, d):
    return T.in_set(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query(
    "t08_cap_vocabulary",
    f"""WITH {WORD}, c AS (SELECT token, count(*) AS n FROM word GROUP BY token), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, token) AS k FROM c)
SELECT token, n, CAST(k - 1 AS INTEGER) AS id FROM r WHERE k < 500 UNION ALL SELECT '<unk>', CAST((SELECT sum(n) FROM r WHERE k >= 500) AS BIGINT), 499""",
)
def t08(spark, d):
    return T.cap_vocabulary(words(spark, d), "token", 500)


GAPPED = f"WITH {EV}, {POS}, gp AS (SELECT *, lag(t) OVER w AS pt, lag(token) OVER w AS pk FROM pos WINDOW w AS (PARTITION BY seq ORDER BY pos)), bk AS (SELECT *, CASE WHEN pt IS NULL THEN 0 WHEN token <> pk THEN 6 WHEN (t - pt) / 3600 < 0.42 THEN 1 WHEN (t - pt) / 3600 < 1.19 THEN 2 WHEN (t - pt) / 3600 < 2.37 THEN 3 WHEN (t - pt) / 3600 < 3.98 THEN 4 ELSE 5 END AS b FROM gp)"


@query(
    "flagship_gap_profile",
    GAPPED + """, c AS (SELECT token || '/' || b AS tok, count(*) AS n FROM bk GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, tok) AS k, sum(n) OVER () AS total FROM c)
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS v, round(-sum(n / total * log2(n / total)), 6) AS entropy, max(n) AS modal FROM r""",
)
def flagship(spark, d):
    p = X.time_since_timed(placed(spark, d), "seq", "t", ["pos"])
    p = X.actor_switch(p, "seq", "token", ["pos"])
    b = C.gap_bucket(F.col("gap") / HOUR, F.col("pos") > 0, F.col("switched"))
    tok = p.select(F.concat_ws("/", "token", b.cast("string")).alias("tok"))
    return S.freq_stats(tok, "tok").select("n", "v", F.round("entropy", 6).alias("entropy"), "modal")
