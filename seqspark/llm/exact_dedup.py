"""Exact deduplication by content-defined chunk recipes.

A text, A-Z lower-cased, is cut where a rolling hash of its last ``WINDOW`` bytes says so: a cut depends on the bytes around it, so a passage that texts
share is mostly the same chunks in all of them. Each chunk has an identifier, a hash of its bytes, and a text is the ordered list of its chunks' identifiers,
its recipe: some hundredths of the text's bytes. Texts are compared, grouped and joined as recipes; the bytes move once, as chunks that are brought together
before and after the shuffle. There the identifiers are verified: no two different chunks share one. If two do, every identifier is lengthened by
another hash and the recipes are made anew, until none do. So equal recipes are equal texts, without trust in a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, dealt_join, hot_keys, spare, table, written

#: Least, mean (beyond the least, as bits) and most bytes of a chunk; bytes that the rolling hash covers.
LEAST, MEAN_BITS, MOST, WINDOW = 512, 11, 1 << 14, 32
#: Bytes that are hashed, and chunk bytes that are passed on, at a time.
SLICE = 1 << 22
#: The rolling hash's value of each byte, by multiplication.
GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)


def marks(data: bytes, bits: int = MEAN_BITS) -> Iterator[int]:
    """Ends of the windows of ``data`` whose rolling hash has ``bits`` leading zeros, ascending; a long text is hashed in overlapping slices."""
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, len(raw), SLICE):
        lead = min(start, WINDOW - 1)
        h = GEAR[raw[start - lead : start + SLICE]]
        k = 1
        while k < WINDOW and k < len(h):  # each step doubles the window
            h[k:] += h[:-k] << np.uint32(k)
            k *= 2
        at = np.flatnonzero(h >> np.uint32(32 - bits) == 0)
        yield from (at[at >= lead] + (start - lead + 1)).tolist()


def cuts(data: bytes, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Where the chunks of ``data`` end; no bytes, no chunk. ``least`` isn't below :data:`WINDOW`, so that no window reaches over the start."""
    ends, at, n = [], 0, len(data)
    for p in marks(data, bits) if n > least else ():
        while p - at > most:
            at += most
            ends.append(at)
        if p - at >= least:
            ends.append(at := p)
    while n - at > most:
        at += most
        ends.append(at)
    return [*ends, n] if at < n else ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def identifier(chunk: bytes, width: int, bits: int = 64) -> list[int]:
    """``width`` hashes of ``bits`` bits as signed longs."""
    out = []
    for seed in range(width):
        x = xxhash.xxh3_64_intdigest(chunk, seed) >> (64 - bits)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(rid, id, text)``: the text as bytes, null as none; ``rid`` tells repeated rows apart."""
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("text"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 1, bits: int = 64) -> DataFrame:
    """``(rid, id, text_sha256, recipe)`` for every row: ``recipe`` lists ``width`` longs a chunk in order, none for a null or empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py().lower() for t in b.column(2)]  # of bytes: only A-Z change
            lists = [[x for c in chunks(t) for x in identifier(c, width, bits)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(lists, pa.list_(pa.int64()))], ["rid", "id", "text_sha256", "recipe"])

    src = _texts(docs, id_col, text_col)
    return src.mapInArrow(run, f"rid long, id {src.schema['id'].dataType.simpleString()}, text_sha256 string, recipe array<bigint>")


def chunk_store(docs: DataFrame, text_col: str = "text", width: int = 1, bits: int = 64) -> DataFrame:
    """``(chunk_id, chunk)``: the distinct chunks of all texts. Chunks that a batch repeats are dropped before the shuffle, the others behind it, by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([identifier(c, width, bits) for c in seen], pa.list_(pa.int64())), pa.array(list(seen), pa.binary())], ["chunk_id", "chunk"])

        for b in batches:
            seen, held = {}, 0
            for t in b.column(0):
                for c in chunks(t.as_py().lower()):
                    if c not in seen:
                        seen[c] = None
                        held += len(c)
                        if held >= SLICE:
                            yield batch()
                            seen, held = {}, 0
            if seen:
                yield batch()

    src = docs.select(F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    return src.mapInArrow(run, "chunk_id array<bigint>, chunk binary").distinct()


def verified_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> tuple[DataFrame, int]:
    """:func:`recipes`, written, and the width at which no two different chunks of ``docs`` share an identifier; 1 but for a collision of ``bits`` bits."""
    width = 1
    while chunk_store(docs, text_col, width, bits).groupBy("chunk_id").count().where("count > 1").limit(1).count():
        width += 1
    return written(recipes(docs, id_col, text_col, width, bits), "op11-recipes"), width


def restored(rows: DataFrame, store: DataFrame, width: int = 1) -> DataFrame:
    """``(rid, text)``: the normalised text of each recipe from the chunks of ``store``."""
    n = F.size("recipe") / width
    each = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.slice("recipe", i * width + 1, width))
    asked = rows.select("rid", F.posexplode(F.when(n > 0, each).otherwise(F.array())).alias("i", "chunk_id"))
    found = asked.join(store.hint("merge"), "chunk_id").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("i", "chunk"))).alias("c"))
    text = F.aggregate("c", F.lit(b""), lambda s, x: F.concat(s, x["chunk"]))
    return rows.select("rid").join(found.hint("merge"), "rid", "left").select("rid", F.coalesce(text, F.lit(b"")).cast("string").alias("text"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``: of equal texts the row with the largest id is kept.

    Texts are equal if they are identical once A-Z are lower-cased. Null counts as empty. A null id is smaller than any other. Of repeated rows with the
    largest id one is kept. Other columns are ignored. An empty table gives an empty result.
    """
    rows, _ = verified_recipes(docs, id_col, text_col, bits)
    rows = rows.withColumn("key", F.xxhash64("recipe"))
    groups = rows.groupBy("key", F.col("recipe").alias("same")).agg(F.max(F.struct("id", "rid")).alias("top"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups, "op11-groups")  # texts that occur once need no partner
    hot = hot_keys(groups.groupBy("key").agg(F.max("n").alias("n")), "key", "n", rows.count())
    met = dealt_join(rows, groups, "key", hot, ["rid"], "left", F.col("recipe") == F.col("same"))
    alone = F.col("n").isNull()
    return met.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("top.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, as :func:`exact_groups` keeps it; of repeats of that row one stays. Columns stay, whatever their names."""
    kept = exact_groups(docs, id_col, text_col)
    name = spare("text_key", docs)
    key = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col(id_col).cast("string"), F.lit("\u0001")), F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)), 256)
    mine = F.sha2(F.concat_ws("\u0000", F.coalesce(F.col(id_col).cast("string"), F.lit("\u0001")), "text_sha256"), 256)
    keys = written(kept.select(mine.alias(name), "kept").groupBy(name).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "op11-kept")
    keyed = docs.withColumn(name, key)
    once = keyed.join(keys.where("n = 1").select(name).hint("shuffle_hash"), name, "left_semi")
    more = keyed.join(keys.where("n > 1").select(name).hint("shuffle_hash"), name, "left_semi").dropDuplicates([name])
    return once.unionByName(more).select(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: Equal texts by themselves.
SQL = """WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
