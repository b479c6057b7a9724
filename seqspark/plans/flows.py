"""Flows that a user calls: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqspark.functions import columns as C
from seqspark.operators import cluster as K
from seqspark.operators import context as X
from seqspark.operators import corpus as CO
from seqspark.operators import match as M
from seqspark.operators import tokens as T
from seqspark.operators.stages import written
from seqspark.sources import files as SRC


def pooled(rows: DataFrame, anchor: Column | None = None, noise: Column | None = None) -> DataFrame:
    """``rows`` with ``__anchor``, the match (``predicted``, ``nearest``, ``accepted``) of the others, and ``__pool``: noise anchors and rows no anchor accepts, as :func:`hybrid` searches them. ``rows`` are read several times: write costly ones first."""
    anchor = F.col("row_id") % 4 == 0 if anchor is None else anchor
    noise = F.col("label").startswith("5") if noise is None else noise
    rows = rows.withColumns({"__anchor": anchor, "__noise": noise})
    real = rows.where("__anchor and not __noise")
    other = rows.where("not __anchor")
    hit = M.accept(M.knn_match(other, real, ["n_clicks"]), M.tau_table(real)).select(F.col("qid").alias("row_id"), "predicted", "nearest", "accepted")
    return written(rows.join(hit.hint("shuffle_hash"), "row_id", "left"), "hybrid").withColumn("__pool", (F.col("__anchor") & F.col("__noise")) | (~F.col("__anchor") & ~F.coalesce("accepted", F.lit(False))))


def hybrid(rows: DataFrame, anchor: Column | None = None, noise: Column | None = None, eps: float = 0.10, min_points: int = 10) -> DataFrame:
    """``(row_id, origin, type, distance)`` of labelled and unlabelled patterns (row_id, n_clicks, ici, label).

    Anchors keep their label (``anchor``); other rows take the label of their nearest anchors if within its threshold (``matched``); noise anchors and
    unmatched rows are searched for dense groups (``discovered``); the rest is ``{n}-NOISE`` (``noise``). The distance is kept for every queried row.
    """
    return _hybrid(rows, anchor, noise, eps, min_points).select("row_id", "origin", "type", "distance")


def _hybrid(rows: DataFrame, anchor: Column | None = None, noise: Column | None = None, eps: float = 0.10, min_points: int = 10) -> DataFrame:
    """``rows`` with origin, type and distance."""
    x = pooled(rows, anchor, noise)
    real = x.where("__anchor and not __noise")
    found = K.keep_large(K.density_clusters(x.where("__pool").select("row_id", "n_clicks", "ici"), eps=eps, min_points=min_points), min_points)
    c = written(found.where("cluster is not null").join(x.select("row_id", "ici", "dur").hint("merge"), "row_id").select("n_clicks", "cluster", "ici", "dur"), "members")
    cent = M.centroids(c, ["n_clicks", "cluster"]).join(c.groupBy("n_clicks", "cluster").agg(F.avg("dur").alias("mean")).hint("merge"), ["n_clicks", "cluster"])
    known = M.centroids(real, ["n_clicks", "label"]).select("n_clicks", C.shape(F.col("centroid")).alias("shape"))
    names = K.tempo_rank_names(cent.select("n_clicks", "cluster", C.shape(F.col("centroid")).alias("shape"), "mean"), "n_clicks", "shape", "mean", discovery=True, anchors=known)
    named = found.join(names.select("n_clicks", "cluster", F.col("name").alias("__name")).hint("shuffle_hash"), ["n_clicks", "cluster"], "left").select("row_id", "__name")
    out = x.join(named.hint("merge"), "row_id", "left")
    origin = F.when(~F.col("__pool") & F.col("__anchor"), "anchor").when(~F.col("__pool"), "matched").when(F.col("__name").isNotNull(), "discovered").otherwise("noise")
    kind = F.when(~F.col("__pool") & F.col("__anchor"), F.col("label")).when(~F.col("__pool"), F.col("predicted")).otherwise(F.coalesce("__name", F.concat(F.col("n_clicks").cast("string"), F.lit("-NOISE"))))
    return out.select(*rows.columns, origin.alias("origin"), kind.alias("type"), F.col("nearest").alias("distance"))


def classify_events(rows: DataFrame, time: str, keys: list[str], **kw) -> DataFrame:
    """``rows`` with origin, type, distance, label id, tempo, trend and ornament."""
    x = written(_hybrid(rows, **kw), "classified")
    ids = T.label_index(x, "type", "type_id")
    x = T.encode(x, ids, "type", "type_id").withColumns({"collapsed": C.collapse_label(F.col("type")), "tempo": C.tempo_bucket(F.col("dur"))})
    x = X.duration_trend(x, keys, time, "row_id", "type", "tempo", "dur")
    return X.ornament(x, keys, time, "row_id", "n_clicks")


def token_table(rows: DataFrame, seq: str, time: str, micros: str, row_id: str, actor: str, label: str, ornament: str, dur: str, within: int = 300_000) -> DataFrame:
    """``(seq, pos, actor, label, ornament, sync, duration, gap, timed)``: one shuffle by sequence; missing values take their codes."""
    x = X.item_position(rows, seq, time, row_id)
    x = X.time_since_timed(x, seq, time, ["pos"])
    x = X.synchrony(x, seq, actor, micros, within)
    return x.select(
        F.col(seq).alias("seq"), "pos", F.coalesce(F.col(actor).cast("string"), F.concat(F.col(seq).cast("string"), F.lit("::UNK"))).alias("actor"), C.label_code(F.col(label)).alias("label"), F.coalesce(F.col(ornament).cast("int"), F.lit(0)).alias("ornament"),
        F.col("sync").alias("sync"), F.coalesce(F.col(dur), F.lit(0.0)).alias("duration"), "gap", F.col(time).isNotNull().cast("int").alias("timed"),
    )


def transcript(rows: DataFrame, seq: str, order: list[str], time: str, actor: str, label: str, ornament: str, tempo: str, trend: str, pause: float = 10.0) -> DataFrame:
    """``(seq, line_no, line)``: event tokens as lines of actors."""
    x = rows.withColumn("__tok", C.event_token(F.col(label), F.col(ornament), F.col(tempo), F.col(trend)))
    return X.speaker_runs(x, seq, order, time, actor, "__tok", pause)


def dialogue_corpus(lines: DataFrame, share: float = 0.9, budget: int = 20_000, cap: int = 500, target: int = 80, tiers: list | None = None, masked: float = 0.3) -> DataFrame:
    """``(cid, seq, pos, wpos, word_id, actor, dt, timed, tier, masked)`` from transcript lines (path, line_no, line): a corpus of the lemmas of conversations.

    The ``share`` of conversations with the fewest distinct words a word is the pool, unless that holds less than twice the ``budget``; of the pool a sample weighted by the inverse of that ratio is drawn up to the budget. Gaps are
    estimated from turns and sentence ends, conversations are cut into chunks at a change of speaker after ``target`` words, rare words take the last id, chunks are dealt to disjoint ``tiers``
    ``(name, words)``, and whole chunks are masked up to the share ``masked``.
    """
    u = SRC.utterances(lines).where("mor is not null")
    words = u.select(F.col("path").alias("seq"), F.col("utt").alias("pos"), F.col("speaker").alias("actor"), C.ends_sentence(F.col("mor")).alias("ended"), F.posexplode(C.lemmas(F.col("mor"))).alias("wpos", "w"))
    words = written(words.withColumn("comma", F.lit(False)), "dialogue")
    convs = words.groupBy("seq").agg(F.count("*").alias("size"), (F.count_distinct("w") / F.count("*")).alias("ttr")).withColumn("weight", 1 / F.col("ttr"))
    pool = CO.bottom_share(written(convs, "dialogue"), "ttr", "seq", "size", share, budget)
    kept = written(CO.weighted_sample(pool, "seq", "weight", "size", budget).select("seq"), "dialogue")
    words = words.join(kept.hint("shuffle_hash"), "seq", "left_semi")
    words = T.estimated_gaps(words, "seq", ["pos", "wpos"], "actor", "pos", "ended", "comma")
    size = words.groupBy("seq", "pos", "actor").agg(F.count("*").alias("size"))
    chunk = T.soft_chunks(size, "seq", "pos", "actor", "size", target).select("seq", "pos", "chunk")
    x = written(words.join(chunk.hint("shuffle_hash"), ["seq", "pos"]).withColumn("cid", F.concat_ws("::", F.col("seq").cast("string"), F.col("chunk").cast("string"))), "dialogue")
    v = T.cap_vocabulary(x.select("w"), "w", cap)
    x = T.encode(x, v.where("w <> '<unk>'").select("w", F.col("id").alias("word_id")), "w", "word_id", cap - 1)
    x = x.select("cid", "seq", "pos", "wpos", "word_id", "actor", "dt", F.lit(1).alias("timed"))
    chunks = x.groupBy("cid").agg(F.count("*").alias("size"))
    dealt = CO.allocate_tiers(chunks, "size", tiers or [("first", budget * 15 // 100), ("second", budget * 23 // 100), ("third", budget)], [F.xxhash64("cid"), "cid"]).select("cid", "tier")
    return CO.mask_sequences(x.join(dealt.hint("shuffle_hash"), "cid"), "cid", [F.xxhash64("cid", F.lit(1)), "cid"], masked, "actor", "dt", "timed")
