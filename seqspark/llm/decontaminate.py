"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

An item's window is ``window`` consecutive words (the whole item if it is shorter). A document holds a window exactly when
it holds all its words in a row, a containment of 1, so the necessary prefix of a window is its rarest shingle alone. A shingle is one
word: a longer one would only do part of the verification's work. Rarity is the count over all documents, and a window with a word
that no document has is dropped. Every document word is looked up among the prefix words; the positional bound gives the only
place where the window could start, the length bound that it fits, and the verification compares all words at that place.

Documents are cut into words in each pass (rarity, look-up, word counts), as writing the words takes more time, disk and memory. Windows of measured small size are broadcast. Larger ones meet the words by shuffle: a row is then
a word and its place alone, frequent words are dropped where no window needs them and dealt to several tasks where one does, and the few
candidates are verified in a second join that fetches only the documents that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqspark.operators import stages

from .common import ascii_lower, dealt_join, discard, hot_keys, sized, spare, table, written

WINDOW = 13
#: At least one word in this many is hit in a contaminated document.
SHARE = 20
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) words of ASCII letters, digits and all characters from U+0080; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(window, words, item)``, each once: the windows of every item, ``window`` being a digest of the words."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = items.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("words"))
    return cut.select(F.md5(F.encode(F.array_join("words", " "), "utf-8")).alias("window"), "words", "item").distinct()


def _fits(df: DataFrame) -> bool:
    return stages.taken_bytes(df) <= stages.BROADCAST_BYTES


def rarity(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, n)``, written: how often each word of ``vocabulary`` occurs in ``rows`` (w); if the vocabulary is too large to broadcast, every other word too."""
    each = rows.select(F.explode("w").alias("token"))
    if _fits(vocabulary):
        each = each.join(F.broadcast(vocabulary), "token", "left_semi")  # measured just above
    return written(each.groupBy("token").agg(F.count("*").alias("n")), "op7-rarity")


def prefix_entries(windows: DataFrame, seen: DataFrame) -> DataFrame:
    """``(token, offset, words, window)``: each window under its rarest word, ties to the smaller word, then the first place."""
    placed = windows.select("window", "words").distinct().select("window", "words", F.posexplode("words").alias("offset", "token"))
    key = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")
    rarest = placed.join(sized(seen, "merge"), "token", "left").groupBy("window").agg(F.min(key).alias("k"), F.first("words").alias("words"))
    return rarest.where("k.n > 0").select("k.token", "k.offset", "words", "window")


def occurrences(rows: DataFrame, entries: DataFrame, seen: DataFrame) -> DataFrame:
    """``(key, from, to, window)``, each once: where the words of ``rows`` (key, id, w) hold a window, as word places, the end exclusive; ``key`` is the text's digest."""
    start = F.col("pos") - F.col("offset")
    till = start + F.size("words")
    found = [start.alias("from"), till.alias("to"), "window"]
    if _fits(entries):
        placed = rows.select("key", "w", F.posexplode("w").alias("pos", "token"))
        fits = (start >= 0) & (till <= F.size("w"))
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")
        few = F.broadcast(entries.withColumnRenamed("token", "prefix"))  # measured just above
        return placed.join(few, (F.col("token") == F.col("prefix")) & fits & same).select("key", *found).distinct()
    total = seen.agg(F.sum("n")).first()[0] or 0
    hot = written(hot_keys(seen, "token", "n", total), "op7-hot")
    needless = hot.join(entries.select("token").distinct().hint("merge"), "token", "left_anti")
    narrow = rows.select("key", F.xxhash64(F.col("id").cast("string")).alias("spread"), F.size("w").alias("n_words"), F.posexplode("w").alias("pos", "token"))
    narrow = narrow.join(F.broadcast(needless), "token", "left_anti")  # a row a shuffle partition at most
    met = dealt_join(narrow, entries, "token", hot, ["key", "spread", "pos"], cond=(start >= 0) & (till <= F.col("n_words")))
    maybe = written(met.select("key", *found).distinct(), "op7-candidates")
    words = entries.select("window", "words")
    asked = maybe.join(words.hint("merge"), "window").select("key", "from", "to", "window", "words")
    texts = rows.join(sized(written(maybe.select("key").distinct(), "op7-asked"), "merge"), "key", "left_semi").groupBy(F.col("key").alias("__text")).agg(F.first("w").alias("w"))
    same = F.slice("w", F.col("from") + 1, F.size("words")) == F.col("words")
    return asked.join(texts.hint("merge"), (F.col("key") == F.col("__text")) & same).select("key", "from", "to", "window")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """``(id_col, text_md5, n_words, n_hit, n_items, items, spans, contaminated)`` for every row of ``docs``.

    ``items`` are the sorted ids of the items with windows in the document, ``spans`` the sorted (from, to) word intervals of
    the occurrences. Null and empty texts have no words and are never contaminated. Benchmark rows without words have no
    window; a null item id reads as ''. Repeated rows give repeated rows, null document ids are kept, other columns are
    ignored. An empty benchmark hits nothing. A text of any length is one row while it is cut and verified, a place a word while it is looked up.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.encode(text, "utf-8")).alias("key"), words_of(F.col(text_col)).alias("w"))
    windows = written(item_windows(benchmark, item_col, item_text, window), "op7-windows")
    seen = rarity(rows, written(windows.select(F.explode("words").alias("token")).distinct(), "op7-vocabulary"))
    entries = written(prefix_entries(windows, seen), "op7-entries")
    hits = written(occurrences(rows, entries, seen), "op7-hits")
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("spans"))
    listed = hits.select("key", "window").distinct().join(sized(windows.select("window", "item"), "merge"), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per = written(spans.join(listed.hint("merge"), "key"), "op7-texts")
    discard(hits, entries, seen)
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("till"))
    covered = F.aggregate(
        "spans", zero, lambda a, s: F.struct((a["hit"] + F.greatest(s["to"] - F.greatest(s["from"], a["till"]), F.lit(0))).alias("hit"), F.greatest(a["till"], s["to"]).alias("till"))
    )["hit"]
    none = F.array().cast("array<string>")
    all_ = rows.select("id", "key", F.size("w").cast("long").alias("n_words")).join(sized(per, "merge"), "key", "left")
    items = F.coalesce("items", none)
    out = all_.select(
        F.col("id").alias(id_col), F.col("key").alias("text_md5"), "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.coalesce("spans", F.array().cast(per.schema["spans"].dataType)).alias("spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, repeated ones included; columns stay, whatever their names. Null, empty and blank texts stay."""
    md5 = spare("text_md5", docs)
    bad = contamination(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("text_md5").alias(md5)).distinct()
    keyed = docs.withColumn(md5, F.md5(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")))
    return keyed.join(sized(written(bad, "op7-contaminated")), md5, "left_anti").select(*docs.columns)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT rid, dw.n AS n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""
