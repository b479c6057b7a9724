"""Queries of the scalar functions over orders' patterns, events, turns and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqspark.functions import columns as C

from .registry import query
from .views import EV, LAB, PAT, TURN, events, labelled, patterns, table, turns

TEMPO = "CASE WHEN dur IS NULL OR dur <= 0 THEN NULL WHEN dur < 0.45 THEN 1 WHEN dur < 0.61 THEN 2 WHEN dur < 0.93 THEN 3 WHEN dur < 1.08 THEN 4 ELSE 5 END"
GAPS = """g AS (SELECT *, list_transform(ici, lambda x: x > list_min(ici) * 3.0) AS gap FROM pat),
h AS (SELECT *, list_median_(list_filter(ici, lambda x: x > list_min(ici) * 3.0)) AS mg, list_median_(list_filter(ici, lambda x: NOT x > list_min(ici) * 3.0)) AS mr FROM g)""".replace("list_median_(", "list_median(")
GAPS = GAPS.replace("list_median(", "list_aggregate(").replace("x > list_min(ici) * 3.0)) AS mg", "x > list_min(ici) * 3.0), 'median') AS mg").replace("NOT x > list_min(ici) * 3.0)) AS mr", "NOT x > list_min(ici) * 3.0), 'median') AS mr")
GROUPS = "CASE WHEN len(ici) >= 2 AND list_min(ici) > 0 AND mg / mr >= 3.0 THEN list_transform(string_split(list_aggregate(list_transform(gap, lambda b: CASE WHEN b THEN 'G' ELSE 'n' END), 'string_agg', ''), 'G'), lambda s: len(s) + 1) END"
SHAPE = f"""{PAT}, {GAPS}, q AS (SELECT row_id, ici, {GROUPS} AS gr,
  list_transform(range(1, len(ici)), lambda i: ici[i + 1] - ici[i]) AS d, CASE WHEN list_avg(ici) > 0 THEN list_avg(ici) * 0.10 ELSE 1e-6 END AS tol FROM h),
shp AS (SELECT row_id, ici, CASE WHEN gr IS NOT NULL THEN array_to_string(gr, '+') WHEN len(ici) < 2 THEN 'R'
  WHEN list_min(d) >= -tol AND list_max(d) > tol THEN 'i' WHEN list_max(d) <= tol AND list_min(d) < -tol THEN 'D' ELSE 'R' END AS shape FROM q)"""


@query("p01_complete_pattern", f"WITH {PAT} SELECT row_id, n_clicks, n_clicks BETWEEN 3 AND 10 AND len(ici) = n_clicks - 1 AS complete FROM pat")
def p01(spark, d):
    return patterns(spark, d).select("row_id", "n_clicks", C.complete_pattern(F.col("n_clicks"), F.col("ici")).alias("complete"))


@query("p02_rename_upstream", "SELECT o_orderkey, o_orderstatus AS upstream_status, o_orderpriority AS upstream_priority FROM orders")
def p02(spark, d):
    return table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "upstream_status", "o_orderpriority": "upstream_priority"}).select("o_orderkey", "upstream_status", "upstream_priority")


LABELS = "l AS (SELECT row_id, CASE WHEN label LIKE '5%' THEN n_clicks || '-NOISE' WHEN label LIKE '1%' THEN n_clicks || 'R' WHEN label LIKE '2%' THEN n_clicks || 'D' || (actor % 4) WHEN label LIKE '3%' THEN n_clicks || 'i12' ELSE '1+1+' || n_clicks END AS name FROM lab)"


def _names(spark, d):
    n, lab = F.col("n_clicks").cast("string"), F.col("label")
    name = F.when(lab.startswith("5"), F.concat(n, F.lit("-NOISE"))).when(lab.startswith("1"), F.concat(n, F.lit("R"))).when(lab.startswith("2"), F.concat(n, F.lit("D"), (F.col("actor") % 4).cast("string"))).when(lab.startswith("3"), F.concat(n, F.lit("i12"))).otherwise(F.concat(F.lit("1+1+"), n))
    return labelled(spark, d).select("row_id", name.alias("name"))


@query("p03_noise_label", f"WITH {LAB}, {LABELS} SELECT row_id, name LIKE '%-NOISE' AS noise FROM l")
def p03(spark, d):
    return _names(spark, d).select("row_id", C.noise_label(F.col("name")).alias("noise"))


@query("p04_tempo_bucket", f"WITH {PAT} SELECT row_id, {TEMPO} AS tempo FROM pat")
def p04(spark, d):
    return patterns(spark, d).select("row_id", C.tempo_bucket(F.col("dur")).alias("tempo"))


@query("p05_delta_category", "SELECT event_id, CASE WHEN (value - 50) / 1000 < -0.021416925000000087 THEN '\\' WHEN (value - 50) / 1000 < 0.018462550000000105 THEN '-' ELSE '/' END AS trend FROM events")
def p05(spark, d):
    return events(spark, d).select("event_id", C.delta_category((F.col("value") - 50) / 1000).alias("trend"))


PHOTO, LOCAL = "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END", "CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END"


@query(
    "p06_p33_actor_keys",
    f"""SELECT c_custkey, coalesce({PHOTO}, CAST({LOCAL} AS VARCHAR)) AS actor,
  coalesce(c_mktsegment || '::photo:' || {PHOTO}, c_mktsegment || '::local:' || {LOCAL}, c_mktsegment || '::UNK') AS named, coalesce(CAST({LOCAL} AS VARCHAR), {PHOTO}, '?') AS shown FROM customer""",
)
def p06(spark, d):
    photo, local = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey"))
    return table(spark, d, "customer").select("c_custkey", C.actor_key(photo, local).alias("actor"), C.actor_namespaced(F.col("c_mktsegment"), photo, local).alias("named"), C.actor_display(photo, local).alias("shown"))


@query("p07_collapse_label", rf"WITH {LAB}, {LABELS} SELECT row_id, regexp_replace(name, '^(\d+[RDi])\d*$', '\1') AS collapsed FROM l")
def p07(spark, d):
    return _names(spark, d).select("row_id", C.collapse_label(F.col("name")).alias("collapsed"))


@query("p08_parse_shape", rf"WITH {LAB}, {LABELS} SELECT row_id, CASE WHEN regexp_matches(name, '^\d+[RDi]\d*$') THEN CAST(regexp_extract(name, '^(\d+)', 1) AS INTEGER) END AS n, CASE WHEN regexp_matches(name, '^\d+[RDi]\d*$') THEN regexp_extract(name, '([RDi])', 1) END AS rhythm FROM l")
def p08(spark, d):
    return _names(spark, d).select("row_id", C.parse_shape(F.col("name")).alias("s")).select("row_id", "s.n", "s.rhythm")


@query("p09_gap_groups", f"WITH {PAT}, {GAPS} SELECT row_id, array_to_string({GROUPS}, ',') AS groups FROM h")
def p09(spark, d):
    return patterns(spark, d).select("row_id", F.array_join(C.gap_groups(F.col("ici")).cast("array<string>"), ",").alias("groups"))


@query("p10_shape", f"WITH {SHAPE} SELECT row_id, shape FROM shp")
def p10(spark, d):
    return patterns(spark, d).select("row_id", C.shape(F.col("ici")).alias("shape"))


B26 = "CASE WHEN {k} < 0 THEN '?' WHEN {k} < 26 THEN chr(97 + {k}) ELSE chr(96 + {k} // 26) || chr(97 + {k} % 26) END"


@query("p11_base26", f"SELECT event_id, {B26.format(k='CAST(event_id % 702 AS INTEGER)')} AS letters FROM events")
def p11(spark, d):
    return events(spark, d).select("event_id", C.base26(F.col("event_id") % 702).alias("letters"))


@query(
    "p12_event_token",
    f"""WITH {EV}, x AS (SELECT *, CASE WHEN k % 10 = 0 THEN NULL ELSE k END AS lab, CASE WHEN k % 7 = 0 THEN NULL ELSE k % 5 + 1 END AS tempo,
  CASE WHEN value < 20 THEN '/' WHEN value < 40 THEN '-' WHEN value < 60 THEN '\\' END AS trend FROM ev)
SELECT event_id, CASE WHEN lab IS NULL OR tempo IS NULL THEN '?' ELSE coalesce(trend, '') || (CASE WHEN k % 2 = 1 THEN upper({B26.format(k='lab')}) ELSE {B26.format(k='lab')} END) || tempo END AS tok FROM x""",
)
def p12(spark, d):
    k, v = F.col("k"), F.col("value")
    lab, tempo = F.when(k % 10 != 0, k), F.when(k % 7 != 0, k % 5 + 1)
    trend = F.when(v < 20, "/").when(v < 40, "-").when(v < 60, "\\")
    return events(spark, d).select("event_id", C.event_token(lab, F.when(k % 2 == 1, 1), tempo, trend).alias("tok"))


@query(
    "p13_dt_and_pause",
    f"""WITH {EV} SELECT event_id, CASE WHEN k % 9 = 0 THEN 'Δt?' ELSE printf('Δt%.2f', greatest(floor(value * 4) / 4 - 20, 0)) END AS dt,
  CASE WHEN value < 10 THEN '(pause ' || CAST(floor(value) AS BIGINT) || ' s)' WHEN value < 50 THEN '(pause ' || CAST(floor(value * value / 60) AS BIGINT) || ' min)' ELSE NULL END AS pause FROM ev""",
)
def p13(spark, d):
    v = F.col("value")
    dt = F.when(F.col("k") % 9 != 0, F.floor(v * 4) / 4 - 20)
    seconds = F.when(v < 10, v).when(v < 50, F.greatest(v * v, F.lit(0.0)))
    pause = F.when(v < 50, C.format_pause(F.when(v < 10, v).otherwise(F.when(seconds < 60, 60.0).otherwise(seconds))))
    return events(spark, d).select("event_id", C.dt_token(dt).alias("dt"), pause.alias("pause"))


@query(
    "p14_grouping_key",
    f"""WITH {LAB}, x AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN actor END AS rec, CASE WHEN row_id % 2 = 0 THEN day END AS dd FROM lab)
SELECT row_id, coalesce('rec|' || rec, 'date|' || dd, 'source_only|') AS key, CASE WHEN rec IS NOT NULL THEN 'Recording ' || rec WHEN dd IS NOT NULL THEN 'Date ' || dd ELSE 'Unattributed' END AS name FROM x""",
)
def p14(spark, d):
    key = C.grouping_key(F.when(F.col("row_id") % 3 == 0, F.col("actor")), F.when(F.col("row_id") % 2 == 0, F.col("day")))
    return labelled(spark, d).select("row_id", key.alias("key"), C.grouping_label(key).alias("name"))


@query("p15_null_codes", f"WITH {EV} SELECT event_id, CASE WHEN k % 10 = 0 THEN 98 ELSE k END AS label, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 2 END AS ornament, CASE WHEN k % 6 = 0 THEN 0.0 ELSE value END AS duration FROM ev")
def p15(spark, d):
    k = F.col("k")
    return events(spark, d).select("event_id", C.label_code(F.when(k % 10 != 0, k)).alias("label"), F.coalesce(F.when(k % 4 != 0, k % 2), F.lit(0)).alias("ornament"), F.coalesce(F.when(k % 6 != 0, F.col("value")), F.lit(0.0)).alias("duration"))


@query("p16_dt_log", f"WITH {EV} SELECT event_id, round(ln(0.1 + greatest(CASE WHEN k % 5 = 0 THEN 0 ELSE value - 30 END, 0)), 6) AS dt_log FROM ev")
def p16(spark, d):
    return events(spark, d).select("event_id", F.round(C.dt_log(F.when(F.col("k") % 5 != 0, F.col("value") - 30)), 6).alias("dt_log"))


@query(
    "p17_p18_gap_buckets",
    f"""WITH {EV}, x AS (SELECT *, value / 20 - 0.5 AS dt, k % 6 <> 0 AS timed, k % 5 = 0 AS sw FROM ev),
y AS (SELECT *, CASE WHEN NOT timed OR dt < 0 THEN 0 WHEN sw THEN 6 WHEN dt < 0.42 THEN 1 WHEN dt < 1.19 THEN 2 WHEN dt < 2.37 THEN 3 WHEN dt < 3.98 THEN 4 ELSE 5 END AS b FROM x)
SELECT event_id, b AS event_bucket, CASE WHEN NOT timed OR dt < 0 THEN 3 WHEN dt >= 1.5 THEN 2 WHEN dt >= 0.75 THEN 1 ELSE 0 END AS dialogue_bucket,
  CASE WHEN NOT timed OR dt < 0 THEN 4 WHEN dt >= 1.5 THEN 3 WHEN dt >= 0.75 THEN 2 WHEN dt >= 0.15 THEN 1 ELSE 0 END AS subword_bucket,
  CASE b WHEN 6 THEN '<switch>' WHEN 1 THEN 'Δt0.20' WHEN 2 THEN 'Δt0.80' WHEN 3 THEN 'Δt1.80' WHEN 4 THEN 'Δt3.20' WHEN 5 THEN 'Δt6.00' ELSE 'Δt?' END AS shown,
  CAST(CASE b WHEN 1 THEN 0.2 WHEN 2 THEN 0.8 WHEN 3 THEN 1.8 WHEN 4 THEN 3.2 WHEN 5 THEN 6.0 END AS DOUBLE) AS midpoint FROM y""",
)
def p17(spark, d):
    k, dt = F.col("k"), F.col("value") / 20 - 0.5
    timed, sw = k % 6 != 0, k % 5 == 0
    b = C.gap_bucket(dt, timed, sw)
    return events(spark, d).select("event_id", b.alias("event_bucket"), C.gap_bucket(dt, timed, scheme="dialogue").alias("dialogue_bucket"), C.gap_bucket(dt, timed, scheme="subword").alias("subword_bucket"), C.gap_display(b).alias("shown"), C.gap_midpoint(b).alias("midpoint"))


@query("p19_tier_of", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'held' WHEN source LIKE 'src0%' THEN 'clean' ELSE 'other' END AS tier FROM documents")
def p19(spark, d):
    return table(spark, d, "documents").select("doc_id", C.tier_of(F.col("source"), {"src1": "held", "src0": "clean"}).alias("tier"))


@query("p22_click_times", f"WITH {PAT} SELECT row_id, list_transform(list_prepend(0.0, list_transform(range(1, len(ici) + 1), lambda i: list_sum(ici[1:i]))), lambda x: round(x, 6)) AS times FROM pat")
def p22(spark, d):
    return patterns(spark, d).select("row_id", F.transform(C.click_times(F.col("ici")), lambda x: F.round(x, 6)).alias("times"))


@query("p23_regular_spacing", f"WITH {PAT} SELECT row_id, n_clicks >= 4 AND list_min(ici) >= 0.1 AND list_max(ici) - list_min(ici) <= list_avg(ici) * 0.5 AS regular FROM pat")
def p23(spark, d):
    return patterns(spark, d).select("row_id", C.regular_spacing(F.col("n_clicks"), F.col("ici"), clicks=4, least=0.1).alias("regular"))


@query("p24_stratum_key", "SELECT doc_id, CASE WHEN source = 'src3' THEN 'special' ELSE coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END, '(NaN)') END AS stratum FROM documents")
def p24(spark, d):
    return table(spark, d, "documents").select("doc_id", C.stratum_key(F.when(F.col("doc_id") % 5 != 0, F.col("lang")), F.col("source"), "src3", "special").alias("stratum"))


@query(
    "p25_lemmas",
    r"""WITH x AS (SELECT event_id, 'n|' || event_type || '-PL pro:exist|' || left(event_type, 4) || '~cop|be&3S , v|x9 adj|''' || lower(event_type) || '''=q .' AS mor FROM events)
SELECT event_id, event_type || ' ' || left(event_type, 4) || ' be ''' || event_type || '''' AS lemmas, true AS ends FROM (SELECT x.event_id, event_type FROM x JOIN events USING (event_id))""",
)
def p25(spark, d):
    t = F.col("token")
    mor = F.concat(F.lit("n|"), t, F.lit("-PL pro:exist|"), F.substring(t, 1, 4), F.lit("~cop|be&3S , v|x9 adj|'"), F.lower(t), F.lit("'=q ."))
    return events(spark, d).select("event_id", F.array_join(C.lemmas(mor), " ").alias("lemmas"), C.ends_sentence(mor).alias("ends"))


@query(
    "p26_surface_words",
    f"""WITH {TURN} SELECT seq, pos, array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '&[=\\-+]\\S*|\\b(?:xxx|yyy|www)\\b|[<>]', ' ', 'g')), '[a-z]+(?:''[a-z]+)?'), ' ') AS words FROM turn_""".replace("\\\\", "\\"),
)
def p26(spark, d):
    return turns(spark, d).select("seq", "pos", F.array_join(C.surface_words(F.col("text")), " ").alias("words"))


@query(
    "p27_subword_split",
    r"""WITH s AS (SELECT DISTINCT lower(left(event_type, 1 + CAST(event_id % 5 AS INTEGER))) || CAST(event_id % 4 + 1 AS VARCHAR) AS syl, lower(event_type) AS w FROM events)
SELECT syl, w, regexp_extract(syl, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcs])?([a-z]*)(\d)$', 1) AS initial, regexp_extract(syl, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcs])?([a-z]*)(\d)$', 2) AS final, regexp_extract(syl, '^(zh|ch|sh|[bpmfdtnlgkhjqxrzcs])?([a-z]*)(\d)$', 3) AS tone,
  array_to_string(regexp_extract_all(w, '(?:[kgnhmrbp]y)[auo]|[sc]h[aiuo]|j[aiuo]|tsu|fu|[kgsztdnhbpmr][aeiou]|[wy][aeiou]|[aeiou]|n|[kgsztdpmrh]'), '.') AS moras FROM s""",
)
def p27(spark, d):
    n = (F.col("event_id") % 5 + 1).cast("int")
    s = events(spark, d).select(F.concat(F.lower(F.substring(F.col("token"), F.lit(1), n)), (F.col("event_id") % 4 + 1).cast("string")).alias("syl"), F.lower("token").alias("w")).distinct()
    p = C.syllable_parts(F.col("syl"))
    return s.select("syl", "w", p["initial"].alias("initial"), p["final"].alias("final"), p["tone"].alias("tone"), F.array_join(C.moras(F.col("w")), ".").alias("moras"))


@query("p29_sequence_ids", "SELECT doc_id, source || '::' || coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 50 AS VARCHAR) END, 'no_recording') AS sid, source AS stripped FROM documents")
def p29(spark, d):
    sid = C.sequence_id(F.col("source"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 50))
    return table(spark, d, "documents").select("doc_id", sid.alias("sid"), C.strip_chunk(sid).alias("stripped"))


@query("p30_silence_filter", f"WITH {EV} SELECT event_id, k FROM ev WHERE k IS NOT NULL AND k <> 98")
def p30(spark, d):
    return events(spark, d).where(F.col("k").isNotNull() & (F.col("k") != C.NO_LABEL)).select("event_id", "k")
