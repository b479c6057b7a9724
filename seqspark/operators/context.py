"""Context features by window logic over timed, labelled events of actors in sequences.

Every function takes column names; windows are partitioned by the sequence (and actor), so the ones of a flow share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqspark.functions import columns as C


def item_position(df: DataFrame, seq: str, time: str, row_id: str, out: str = "pos") -> DataFrame:
    """0-based position: by time, untimed rows last, then by ``row_id``. A null sequence is one of its own."""
    w = Window.partitionBy(seq).orderBy(F.col(time).asc_nulls_last(), row_id)
    return df.withColumn(out, F.row_number().over(w) - 1)


def time_since_timed(df: DataFrame, seq: str, time: str, order: list[str], out: str = "gap") -> DataFrame:
    """Time since the last timed event: 0 for the first timed one, -1 for an untimed one."""
    w = Window.partitionBy(seq).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(time, ignorenulls=True).over(w)
    return df.withColumn(out, F.when(F.col(time).isNull(), F.lit(C.NO_TIME)).when(last.isNull(), F.lit(0.0)).otherwise(F.col(time) - last))


def actor_switch(df: DataFrame, seq: str, actor: str, order: list[str], timed: str | None = None, loose: bool = False, out: str = "switched") -> DataFrame:
    """1 if the actor differs from the previous row's; with ``timed``, only if both rows are timed unless ``loose``."""
    w = Window.partitionBy(seq).orderBy(*order)
    changed = F.col(actor) != F.lag(actor).over(w)
    if timed is not None and not loose:
        changed &= F.col(timed).cast("boolean") & F.lag(timed).over(w).cast("boolean")
    return df.withColumn(out, F.coalesce(changed, F.lit(False)).cast("int"))


def duration_trend(df: DataFrame, keys: list[str], time: str, row_id: str, label: str, tempo: str, dur: str, window: float = 10.0, out: str = "trend") -> DataFrame:
    """Trend against the same actor's previous eligible event, if it is at most ``window`` before with the same label and tempo; else null.

    Eligible: keys, time, label and tempo are known. Ineligible rows get null and don't stand between others.
    """
    known = F.lit(True)
    for c in [*keys, time, label, tempo]:
        known &= F.col(c).isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(time, row_id)
    prev = lambda c: F.lag(c).over(w)
    same = known & (F.col(time) - prev(time) <= window) & (prev(label) == F.col(label)) & (prev(tempo) == F.col(tempo))
    return df.withColumn(out, F.when(same, C.delta_category(F.col(dur) - prev(dur))))


def ornament(df: DataFrame, keys: list[str], time: str, row_id: str, clicks: str, window: float = 10.0, out: str = "ornament") -> DataFrame:
    """1 if the actor's neighbour before or after, at most ``window`` away, has one click fewer; 0 otherwise; null where a key or the time is null."""
    known = F.lit(True)
    for c in [*keys, time]:
        known &= F.col(c).isNotNull()
    w = Window.partitionBy(*keys, known).orderBy(time, row_id)
    near = lambda f: (F.abs(f(time).over(w) - F.col(time)) <= window) & (f(clicks).over(w) == F.col(clicks) - 1)
    hit = F.coalesce(near(F.lag), F.lit(False)) | F.coalesce(near(F.lead), F.lit(False))
    return df.withColumn(out, F.when(known, hit.cast("int")))


def synchrony(df: DataFrame, seq: str, actor: str, micros: str, within: int = 300_000, out: str = "sync") -> DataFrame:
    """1 if another actor's event of the sequence lies within ``within`` microseconds; 0 for an unknown actor or time.

    The count over the band less that of the own actor: two range frames, no join. Unknown actors count as others.
    """
    band = lambda *by: Window.partitionBy(*by).orderBy(micros).rangeBetween(-within, within)
    other = F.count(micros).over(band(seq)) - F.count(micros).over(band(seq, actor))
    return df.withColumn(out, F.when(F.col(actor).isNull() | F.col(micros).isNull(), 0).otherwise((other > 0).cast("int")))


def speaker_runs(df: DataFrame, seq: str, order: list[str], time: str, actor: str, token: str, pause: float = 10.0) -> DataFrame:
    """``(seq, line_no, line)``: consecutive tokens of an actor as one line, a line for every pause longer than ``pause``.

    Between tokens stands the gap token; after a change of actor it opens the new line. A pause line replaces it and ends the run.
    A sequence's rows without a known time have ``Δt?``.
    """
    w = Window.partitionBy(seq).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_t = F.last(time, ignorenulls=True).over(before)
    gap = F.col(time) - last_t
    n = F.row_number().over(w)
    x = df.select(seq, F.col(actor).alias("__a"), F.col(token).alias("__t"), gap.alias("__g"), n.alias("__n"), F.lag(actor).over(w).alias("__p"))
    paused = F.coalesce(F.col("__g") > pause, F.lit(False))
    x = x.withColumn("__pause", paused).withColumn("__new", (F.col("__n") == 1) | paused | ~F.col("__a").eqNullSafe(F.col("__p")))
    x = x.withColumn("__run", F.sum(F.col("__new").cast("int")).over(Window.partitionBy(seq).orderBy("__n")))
    text = F.when((F.col("__n") == 1) | F.col("__pause"), F.col("__t")).otherwise(F.concat_ws(" ", C.dt_token(F.col("__g")), F.col("__t")))
    runs = x.withColumn("__x", text).groupBy(seq, "__run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__x"))), lambda s: s["__x"]), " ").alias("body"), F.first("__a").alias("who"), F.max(F.when(F.col("__pause"), F.col("__g"))).alias("pause")
    )
    spoken = F.concat(F.lit("  "), F.coalesce(F.col("who").cast("string"), F.lit("?")), F.lit(": "), F.col("body"))
    lines = F.when(F.col("pause").isNotNull(), F.array(F.concat(F.lit("  "), C.format_pause(F.col("pause"))), spoken)).otherwise(F.array(spoken))
    return runs.select(seq, "__run", F.posexplode(lines).alias("part", "line")).select(seq, (F.col("__run") * 2 + F.col("part")).alias("line_no"), "line")


def utterance_runs(df: DataFrame, seq: str, order: list[str], actor: str, word: str, dt: str) -> DataFrame:
    """``(seq, run, actor, text)``: a new utterance where the actor changes or the estimated gap is 2.0; ``.`` before a gap of 1.0 and a comma before 0.5."""
    w = Window.partitionBy(seq).orderBy(*order)
    new = F.coalesce((F.col(actor) != F.lag(actor).over(w)) | (F.col(dt) == 2.0), F.lit(True))
    x = df.select(seq, F.col(actor).alias("who"), F.col(word).alias("w"), F.col(dt).alias("dt"), F.row_number().over(w).alias("n"), new.cast("int").alias("new"))
    x = x.withColumn("run", F.sum("new").over(Window.partitionBy(seq).orderBy("n")))
    part = F.when(F.col("new") == 1, F.col("w")).when(F.col("dt") == 1.0, F.concat(F.lit(". "), F.col("w"))).when(F.col("dt") == 0.5, F.concat(F.lit(", "), F.col("w"))).otherwise(F.concat(F.lit(" "), F.col("w")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "p"))), lambda s: s["p"]), "")
    return x.withColumn("p", part).groupBy(seq, "run").agg(F.first("who").alias(actor), joined.alias("text"))
