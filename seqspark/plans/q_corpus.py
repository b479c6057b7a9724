"""Queries of sources, corpus construction and flows."""

from __future__ import annotations

from pyspark.sql import functions as F


from seqspark.operators import corpus as K
from seqspark.operators import lm as L
from seqspark.operators import stages as ST
from seqspark.operators import stats as S
from seqspark.operators import tokens as T
from seqspark.sources import files as SRC

from . import flows as FL
from .q_context import DAY, POS, days, placed, utterance_words
from .q_stats import rounded
from .registry import query
from .views import EV, TURN, WORD, events, labelled, table, turns, words


@query("s01_event_scan", "SELECT event_id, user_id, event_type, value FROM events WHERE value > 100")
def s01(spark, d):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.read.schema(schema).parquet(f"{d}/events.parquet").where("value > 100").select("event_id", "user_id", "event_type", "value")


@query("s02_header_hygiene", "SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def s02(spark, d):
    return SRC.clean_headers(table(spark, d, "region").toDF("﻿ region_id ", " region_name"))


def transcript_lines(spark, d):
    """Conversations as transcript lines: a header, and for each turn a speaker line, a tier of its first words with a tabbed line, and a comment tier."""
    t = turns(spark, d).withColumn("w", F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +"), lambda x: x != ""))
    tag = lambda a: F.transform(a, lambda x: F.concat(F.lit("n|"), x))
    mor = F.array_join(tag(F.slice("w", 1, 4)), " ")
    rest = F.array_join(tag(F.slice("w", 5, 3)), " ")
    body = F.array(F.concat(F.lit("*"), F.upper(F.substring("actor", 1, 3)), F.lit(":\tx")), F.concat(F.lit("%mor:\t"), mor), F.concat(F.lit("\t"), rest), F.lit("%com:\tnone"), F.lit("\tn|skipped"))
    x = t.select(F.col("seq").cast("string").alias("path"), "pos", F.posexplode(F.when(F.col("pos") % 5 == 4, F.slice(body, 1, 1)).otherwise(body)).alias("i", "line"))
    return x.select("path", (F.col("pos") * 10 + F.col("i")).cast("int").alias("line_no"), "line")


CLEAN = "list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +'), lambda x: x <> '')"


@query(
    "s03_transcript_utterances",
    f"WITH {TURN}, x AS (SELECT CAST(seq AS VARCHAR) AS path, pos, upper(left(actor, 3)) AS speaker, {CLEAN} AS w FROM turn_) SELECT path, row_number() OVER (PARTITION BY path ORDER BY pos) AS utt, speaker, CASE WHEN pos % 5 <> 4 THEN trim(array_to_string(list_transform(w[1:4], lambda x: 'n|' || x), ' ') || ' ' || array_to_string(list_transform(w[5:7], lambda x: 'n|' || x), ' ')) END AS mor FROM x",
)
def s03(spark, d):
    return SRC.utterances(transcript_lines(spark, d))


@query(
    "s04_marked_dialogue",
    f"""WITH {EV}, {DAY}, x AS (SELECT day, event_id, row_number() OVER (PARTITION BY day ORDER BY event_id) AS n, chr(97 + k % 26) || (k % 5 + 1) AS tok, k FROM dy)
SELECT 'f' AS path, 'day ' || day AS section, CAST(event_id * 2 + 1 AS BIGINT) AS line_no, CAST(p AS INTEGER) AS pos, CASE p WHEN 0 THEN tok ELSE '/' || tok END AS token, CASE p WHEN 0 THEN tok ELSE '/' || tok END || CASE WHEN k % 3 = 0 THEN '*' ELSE '' END AS marked FROM x, (SELECT unnest([0, 1]) AS p)""",
)
def s04(spark, d):
    k = F.col("k")
    x = days(spark, d).withColumns({"tok": F.concat(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), k % 26 + 1, F.lit(1)), (k % 5 + 1).cast("string")), "n": F.row_number().over(ST.Window.partitionBy("day").orderBy("event_id"))})
    head = x.where("n = 1").select(F.lit("f").alias("path"), (F.col("event_id") * 2).alias("line_no"), F.concat(F.lit("File: day "), F.col("day").cast("string")).alias("line"))
    body = x.select(F.lit("f").alias("path"), (F.col("event_id") * 2 + 1).alias("line_no"), F.concat("tok", F.lit(" - /"), "tok", F.when(k % 3 == 0, " In chorus").otherwise("")).alias("line"))
    return SRC.marked_dialogue(head.unionByName(body))


@query("s05_child_age", "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 5 * 12 + c_custkey % 12 AS INTEGER) END AS months FROM customer WHERE c_custkey % 3 <> 0")
def s05(spark, d):
    k = F.col("c_custkey")
    age = F.when(k % 7 == 0, F.lit("unknown")).otherwise(F.format_string("%d;%02d.1", k % 5, k % 12))
    role = F.when(k % 3 == 0, "Mother").otherwise("Target_Child")
    lines = table(spark, d, "customer").select(k.cast("string").alias("path"), F.lit(0).alias("line_no"), F.concat(F.lit("@ID:\tzho|c|CHI|"), age, F.lit("|male|||"), role, F.lit("|||")).alias("line"))
    return SRC.child_age(lines)


@query("s06_json_inventory", f"WITH {EV} SELECT token AS segment, count(*) AS count FROM ev GROUP BY token")
def s06(spark, d):
    path = f"{ST.shared_dir(spark)}/inventory-{ST.uuid.uuid4().hex}"
    SRC.write_inventory(events(spark, d).groupBy(F.col("token").alias("segment")).agg(F.count("*").alias("count")), path)
    return SRC.read_inventory(spark, path, lines=True)


@query("s07_table_sink", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def s07(spark, d):
    path = f"{ST.shared_dir(spark)}/sink-{ST.uuid.uuid4().hex}"
    SRC.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "o_orderpriority")
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("s08_transcript_sink", f"WITH {TURN} SELECT actor, count(*) AS lines, sum(length(actor || ' ' || seq || ' ' || pos)) AS chars FROM turn_ GROUP BY actor")
def s08(spark, d):
    path = f"{ST.shared_dir(spark)}/text-{ST.uuid.uuid4().hex}"
    t = turns(spark, d)
    SRC.write_transcripts(t.select("actor", (F.col("seq") * 1000 + F.col("pos")).alias("line_no"), F.concat_ws(" ", "actor", F.col("seq").cast("string"), F.col("pos").cast("string")).alias("line")), path, "actor")
    return SRC.read_transcripts(spark, path, "actor").groupBy("actor").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("s09_stage_reuse", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def s09(spark, d):
    base = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey")
    at = f"{ST.shared_dir(spark)}/reuse"
    count = lambda x: x.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    ST.reuse(base, at, count)
    return ST.reuse(base, at, count)


@query("p31_restriction", f"WITH {WORD}, n AS (SELECT doc_id, count(*) AS n FROM word GROUP BY 1), k AS (SELECT doc_id FROM documents WHERE lang IN ('de', 'en') AND source IN ('src0', 'src1')) SELECT doc_id, n FROM n JOIN k USING (doc_id) WHERE n >= 200")
def p31(spark, d):
    w = words(spark, d).withColumn("conv", F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")))
    x = K.long_enough(K.restrict(w, "conv", {0: ["de", "en"], 1: ["src0", "src1"]}), "conv", 200)
    return x.groupBy("doc_id").agg(F.count("*").alias("n"))


CONV = f"WITH {WORD}, cv AS (SELECT doc_id, count(*) AS size, count(DISTINCT token) / count(*) AS ttr FROM word GROUP BY doc_id)"
ORD = "(doc_id * 7919) % 10007, doc_id"


def convs(spark, d):
    return S.type_token_ratio(words(spark, d), "doc_id", "token").select("doc_id", F.col("n").alias("size"), "ttr")


def mixed():
    return [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")]


@query("t02_sample_per_stratum", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {ORD}) AS r FROM documents) WHERE r <= 7")
def t02(spark, d):
    return K.sample_per_stratum(table(spark, d, "documents").select("doc_id", "source"), "source", 7, mixed())


@query("t03_bottom_ttr", CONV + ", r AS (SELECT *, row_number() OVER (ORDER BY ttr, doc_id) AS r, count(*) OVER () AS n FROM cv) SELECT doc_id, size FROM r WHERE r <= greatest(1, floor(n * 0.2))")
def t03(spark, d):
    return K.bottom_share(convs(spark, d), "ttr", "doc_id", "size", 0.2, 100).select("doc_id", "size")


@query("t04_budgeted_prefix", CONV + f", r AS (SELECT *, sum(size) OVER (ORDER BY {ORD}) AS s FROM cv) SELECT doc_id, size FROM r WHERE s - size < 50000")
def t04(spark, d):
    return K.budgeted_prefix(convs(spark, d), "size", 50000, mixed()).select("doc_id", "size")


@query("t05_weighted_sample", CONV + ", k AS (SELECT *, ln(((doc_id * 7919) % 10007 + 0.5) / 10007) / (1 / ttr) AS k FROM cv), r AS (SELECT *, sum(size) OVER (ORDER BY k DESC, doc_id) AS s FROM k) SELECT doc_id, size FROM r WHERE s - size < 50000")
def t05(spark, d):
    u = ((F.col("doc_id") * 7919) % 10007 + 0.5) / 10007
    return K.weighted_sample(convs(spark, d).withColumn("w", 1 / F.col("ttr")), "doc_id", "w", "size", 50000, uniform=u).select("doc_id", "size")


@query(
    "t06_tier_allocation",
    CONV + f""", r AS (SELECT *, sum(size) OVER (ORDER BY {ORD}) - size AS b FROM cv), e1 AS (SELECT max(b + size) AS e FROM r WHERE b < 15000), e2 AS (SELECT max(b + size) AS e FROM r, e1 WHERE b >= e1.e AND b - e1.e < 23000)
SELECT doc_id, size, CASE WHEN b < 15000 THEN 'first' WHEN b >= e1.e AND b - e1.e < 23000 THEN 'second' WHEN b >= e2.e AND b - e2.e < 62000 THEN 'third' END AS tier FROM r, e1, e2""",
)
def t06(spark, d):
    return K.allocate_tiers(convs(spark, d), "size", [("first", 15000), ("second", 23000), ("third", 62000)], mixed()).select("doc_id", "size", "tier")


@query(
    "t07_masking",
    f"""WITH {EV}, {POS}, c AS (SELECT seq, count(*) AS n FROM pos GROUP BY seq), r AS (SELECT *, sum(n) OVER (ORDER BY seq) AS s, sum(n) OVER () AS t FROM c), m AS (SELECT seq FROM r WHERE s - n < floor(t * 0.4))
SELECT seq, pos, CASE WHEN m.seq IS NULL THEN token ELSE 'UNK' END AS actor, CASE WHEN m.seq IS NULL THEN value ELSE -1.0 END AS gap, CASE WHEN m.seq IS NULL THEN 1 ELSE 0 END AS timed, m.seq IS NOT NULL AS masked FROM pos LEFT JOIN m USING (seq)""",
)
def t07(spark, d):
    x = placed(spark, d).select("seq", "pos", F.col("token").alias("actor"), F.col("value").alias("gap"), F.lit(1).alias("timed"))
    return K.mask_sequences(x, "seq", ["seq"], 0.4, "actor", "gap", "timed")


def classified(spark, d):
    from .q_match import kept

    x = kept(spark, d, "dur", "actor", "day").withColumn("t", F.unix_timestamp(F.to_date("day")).cast("double"))
    return FL.classify_events(x, "t", ["actor"])


@query("f01_classify_events")
def f01(spark, d):
    return classified(spark, d).select("row_id", "origin", "type", "type_id", "collapsed", "tempo", "trend", "ornament")


@query("f01_acceptance")
def f01b(spark, d):
    """One row: of the anchors' labels how many are kept, the share of noise, and how far labels agree by their first character, with the bounds that they must meet."""
    from seqspark.operators import quality as Q

    x = classified(spark, d).withColumn("known", F.when(F.col("row_id") % 4 == 0, F.col("label")))
    return Q.acceptance(x, "known", "type", F.substring("type", 1, 1), F.substring("label", 1, 1), F.col("origin") == "noise")


@query(
    "f02_token_table",
    f"""WITH {EV}, {DAY}, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY tt NULLS LAST, event_id) - 1 AS INTEGER) AS pos FROM dy), l AS (SELECT *, last_value(tt IGNORE NULLS) OVER (PARTITION BY day ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lt FROM p)
SELECT day AS seq, pos, coalesce(CAST(actor AS VARCHAR), day || '::UNK') AS actor, CASE WHEN k % 10 = 0 THEN 98 ELSE k END AS label, CASE WHEN k % 4 = 0 THEN 0 ELSE k % 2 END AS ornament, CAST(actor IS NOT NULL AND EXISTS (SELECT 1 FROM dy b WHERE b.day = l.day AND b.us BETWEEN l.us - 300000000 AND l.us + 300000000 AND b.actor IS DISTINCT FROM l.actor) AS INTEGER) AS sync,
  coalesce(CASE WHEN k % 6 <> 0 THEN value END, 0.0) AS duration, round(CASE WHEN tt IS NULL THEN -1.0 WHEN lt IS NULL THEN 0.0 ELSE tt - lt END, 4) AS gap, CAST(tt IS NOT NULL AS INTEGER) AS timed FROM l""",
)
def f02(spark, d):
    k = F.col("k")
    x = days(spark, d).withColumns({"lab": F.when(k % 10 != 0, k), "orn": F.when(k % 4 != 0, k % 2), "dur": F.when(k % 6 != 0, F.col("value"))})
    return rounded(FL.token_table(x, "day", "tt", "us", "event_id", "actor", "lab", "orn", "dur", 300_000_000), "gap", digits=4)


def _transcript_sql():
    """The SQL of speaker runs over event tokens."""
    from . import q_context  # noqa: F401
    from .q_columns import B26
    from .registry import REGISTRY

    letters = B26.format(k="k")
    token = f"CASE WHEN k IS NULL OR tempo IS NULL THEN '?' ELSE CASE WHEN k % 3 = 0 THEN '/' ELSE '' END || CASE WHEN k % 2 = 1 THEN upper({letters}) ELSE {letters} END || tempo END"
    return REGISTRY["w08_speaker_runs"][1].replace("SELECT *, CAST(floor(tt)", f"SELECT * EXCLUDE (token), {token} AS token, CAST(floor(tt)")


@query("f03_transcript", _transcript_sql())
def f03(spark, d):
    k = F.col("k")
    x = days(spark, d).withColumns({"orn": k % 2, "trend": F.when(k % 3 == 0, "/"), "ft": F.floor("tt").cast("double")})
    return FL.transcript(x, "day", ["us", "event_id"], "ft", "actor", "k", "orn", "tempo", "trend", 600.0)


@query("f04_dialogue_corpus")
def f04(spark, d):
    """Turns to words with estimated gaps, chunked, capped, tiered and partly masked."""
    w = T.estimated_gaps(utterance_words(spark, d), "seq", ["pos", "wpos"], "actor", "pos", "ended", "comma")
    size = w.groupBy("seq", "pos", "actor").agg(F.count("*").alias("size"))
    chunk = T.soft_chunks(size, "seq", "pos", "actor", "size").select("seq", "pos", "chunk")
    x = w.join(chunk.hint("shuffle_hash"), ["seq", "pos"]).withColumn("cid", F.concat_ws("::", F.col("seq").cast("string"), F.col("chunk").cast("string")))
    v = T.cap_vocabulary(x.select("w"), "w", 500)
    x = T.encode(x, v.where("w <> '<unk>'").select("w", F.col("id").alias("word_id")), "w", "word_id", 499)
    x = x.withColumns({"actor_": F.col("actor"), "timed": F.lit(1)}).select("cid", "pos", "wpos", "word_id", F.col("actor_").alias("actor"), "dt", "timed")
    convs_ = x.groupBy("cid").agg(F.count("*").alias("size"))
    tiers = K.allocate_tiers(convs_, "size", [("first", 4000), ("second", 7000), ("third", 20000)], [F.xxhash64("cid"), "cid"]).select("cid", "tier")
    return K.mask_sequences(x.join(tiers.hint("shuffle_hash"), "cid"), "cid", [F.xxhash64("cid", F.lit(1)), "cid"], 0.3, "actor", "dt", "timed")


@query("f04_dialogue_transcripts")
def f04b(spark, d):
    return FL.dialogue_corpus(transcript_lines(spark, d), budget=4000)


@query("f06_structure_report")
def f06(spark, d):
    """``(part, key, value)``: Zipf fit, information by lag in true and shuffled order, which decay fits it, pause divergence, and compression by digram merges."""
    from seqspark.operators.merges import merge_rounds

    from .q_stats import gapped

    p = placed(spark, d)
    z = S.zipf_fit(p, "token").select(F.lit("zipf").alias("part"), F.lit("alpha").alias("key"), F.col("alpha").alias("value"))
    info = ST.written(S.mi_decay(p, "seq", "pos", "token"), "decay")
    m = info.select(F.lit("mi"), F.col("lag").cast("string"), "mi")
    s = S.mi_decay(S.shuffled_positions(p, "seq", "pos"), "seq", "pos", "token").select(F.lit("mi_shuffled"), F.col("lag").cast("string"), "mi")
    fit = S.decay_models(info).select(F.lit("decay_aic"), "model", "aic")
    j = S.pause_context_jsd(gapped(spark, d), "seq", "pos", "token", "b").select(F.lit("pause_jsd"), F.col("bucket").cast("string"), "jsd")
    log = merge_rounds(p.select("seq", "pos", "token"), 80)[1]
    c = spark.createDataFrame([("merges", str(r["round"]), float(r["ratio"])) for r in log], "part string, key string, value double")
    return z.union(m).union(s).union(fit).union(j).union(c)


@query("f07_sequence_benchmark")
def f07(spark, d):
    """``(model, bits, bits_sd, perplexity, acc, acc_sd)`` of all models over the same folds and positions; the count models of a stream share one set of suffix counts."""
    from seqspark.operators import ngrams as N

    from .q_lm import compound

    folds = 3
    own = lambda x: L.with_folds(x, "seq", folds, F.col("seq") % folds)
    plain = own(placed(spark, d).select("seq", "pos", "token"))
    counts, joint = N.SuffixCounts(plain, folds, 7), N.SuffixCounts(compound(spark, d).select("own", "seq", "pos", "token", "label"), folds, 4)
    models = {
        "unigram": N.markov(counts, 0), "markov1": N.markov(counts, 1), "markov2": N.markov(counts, 2), "joint_markov": L.markov_labels(joint.rows.select("own", "seq", "pos", "token", "label"), folds),
        "kneser_ney5": N.kneser_ney(counts, 5), "kneser_ney5_cache": L.kneser_ney_cached(plain, folds, 5, counts=counts), "ppm_d7": N.ppm_d(counts, 7), "joint_kneser_ney5": N.kneser_ney_labels(joint, 5),
    }
    out = L.learned_baseline(plain, folds).withColumn("model", F.lit("learned"))
    for name, scored in models.items():  # one plan, a branch a model
        out = out.unionByName(L.summary(scored.where("pos > 0").select("fold", "p", "hit")).withColumn("model", F.lit(name)))
    return L.fold_summary(out)


@query("f08_match_validation")
def f08(spark, d):
    """``(n_clicks, total, correct, mismatch, reject, types, mean_tau)`` of the leave-one-out check and the threshold table."""
    from seqspark.operators import match as M
    from seqspark.operators import quality as Q

    from .q_match import kept_anchors

    a = kept_anchors(spark, d)
    tau = ST.written(M.tau_table(a))
    x = M.accept(M.loo_match(a, ["n_clicks"], also=["label"]), tau)
    o = Q.outcome_rollup(x, "n_clicks", F.col("label"), F.col("predicted"), F.col("accepted"))
    t = tau.groupBy("n_clicks").agg(F.count("*").alias("types"), F.avg("tau").alias("mean_tau"))
    return o.join(t.hint("merge"), "n_clicks", "left")


def _report():
    """Parts of the report: name, query, its key columns and the value."""
    return [
        ("tau", "a01_tau_table", ["n_clicks", "label"], "tau"), ("mean_dist", "a02_class_variance", ["n_clicks", "label"], "mean_dist"), ("r95", "a02_class_variance", ["n_clicks", "label"], "r95"), ("nearest_p99", "a02_class_variance", ["n_clicks", "label"], "p99"),
        ("loo_correct", "a13_loo_outcomes", ["n_clicks"], "correct"), ("loo_total", "a13_loo_outcomes", ["n_clicks"], "total"), ("margin", "j06_runner_up_margin", ["row_id"], "margin"), ("group_spread", "a03_group_summary", ["status"], "spread"),
        ("group_coverage", "a03_group_summary", ["status"], "coverage"), ("cluster_ratio", "a16_cluster_quality", ["cluster", "n_clicks"], "ratio"), ("top5_coverage", "a10_top_label_coverage", ["nation"], "cover_5"),
    ]


def _report_sql():
    from . import q_match  # noqa: F401  its queries are the parts
    from .registry import REGISTRY

    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'all')"
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {' || chr(47) || '.join(map(text, keys))} AS key, CAST({value} AS DOUBLE) AS value FROM ({REGISTRY[name][1]})" for part, name, keys, value in _report())


@query("f08_match_report", _report_sql())
def f08b(spark, d):
    """``(part, key, value)``: thresholds, class variance, leave-one-out outcomes, margins to the runner-up, group summaries, label coverage and cluster quality as one table."""
    from .registry import REGISTRY

    made, out = {}, None
    for part, name, keys, value in _report():
        if name not in made:
            made[name] = ST.written(REGISTRY[name][0](spark, d), "report")
        key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("all")) for k in keys])
        x = made[name].select(F.lit(part).alias("part"), key.alias("key"), F.col(value).cast("double").alias("value"))
        out = x if out is None else out.unionByName(x)
    return out


def _bits_sql():
    from . import q_lm  # noqa: F401  one of its queries is a part
    from .q_patterns import CTX, SYM
    from .registry import REGISTRY

    return f"SELECT 'label_mixture' AS model, * FROM (WITH {SYM}, {CTX} SELECT own AS fold, count(*) AS n, round(avg(-log2(greatest(p, 1e-12))), 6) AS bits FROM ps GROUP BY own) UNION ALL SELECT 'segment_chain', fold, n, bits FROM ({REGISTRY['l11_segment_chain_bits'][1]})"


@query("f09_pattern_bits", _bits_sql())
def f09b(spark, d):
    """``(model, fold, n, bits)``: bits a pattern of the label mixture in context and of the segment chain."""
    from seqspark.operators import patterns as P

    from .q_lm import l11
    from .q_patterns import sequenced, strings

    mixture = P.context_mixture_bits(sequenced(strings(spark, d)[0]), 3).groupBy("fold").agg(F.count("*").alias("n"), F.avg("bits").alias("bits")).withColumn("model", F.lit("label_mixture"))
    return rounded(mixture.unionByName(l11(spark, d).withColumn("model", F.lit("segment_chain"))).select("model", "fold", "n", "bits"), "bits")


@query("f09_pattern_benchmark")
def f09(spark, d):
    """One row: string agreement and timing of the label model's predicted patterns."""
    from seqspark.operators import patterns as P

    from .q_patterns import predicted

    s, e, x = predicted(spark, d)
    t = P.desymbolise(x.select("row_id", F.col("pred").alias("sym")), P.bin_means(s, e), "row_id")
    y = x.select("row_id", "ici", "sym", "pred").join(t.hint("merge"), "row_id")
    m = y.select(P.string_metrics(F.col("pred"), F.col("sym")).alias("m"), P.timing_metrics(F.col("timing"), F.col("ici")).alias("t")).select("m.*", "t.*")
    return m.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in m.columns])


