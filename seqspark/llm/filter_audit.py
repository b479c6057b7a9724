"""Filter interaction audit by incremental retraction streaming.

What five filters do to each other needs, for each part, only how many documents fail which set of filters. Four of the filters look at the text alone. The
fifth asks whether any document with a smaller id has the same text, so an early verdict may have to be taken back. All files are processed as
available-now micro-batches. Each document is counted at once as if no smaller id came; a task settles at once what its own rows decide. The state of a text, known by
its SHA-256, is its smallest id so far with the masks counted for it: of a new and the known smallest, the larger one's masks are retracted from the part
counters and counted again with the fifth filter failed. A state entry holds the few texts of one bucket of hashes, as a call for each text costs more than its work; there are as many buckets as the
input's bytes ask for. A micro-batch adds its changes, a row for a part and mask, to a table of its own, written anew if the batch is
run again; the counters are their sums. Only the state stays, in the session's state store (its heap; set RocksDB's provider for state beyond that), and a hot text arrives as a row a task.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, discard, shared_dir, sized, table, written

FILTERS = "ABCDE"
REPEATED, GOOD, TOXIC = 16, 32, 64
#: Bytes of input a core and micro-batch, and a bucket of texts; texts that a task holds before it passes them on.
CORE_BYTES, BUCKET_BYTES, HELD = 64 << 20, 64 << 10, 200_000
BLANK = " \t\n\v\f\r"


def masked(docs: DataFrame, text: str, name: str = "mask") -> DataFrame:
    """``docs`` with bits 1, 2, 4, 8: under 200 words; fewer than half of the words distinct; over 2 % of A-Z; any of ``#$%&*|``. ``text`` has no nulls."""
    bare = F.btrim(F.col(text), F.lit(BLANK))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    n, m = F.size("__words"), F.size(F.array_distinct("__words"))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [n < 200, 100 * m < 50 * n, 100 * capitals > 2 * F.length(text), F.col(text).rlike("[#$%&*|]")]
    return docs.withColumn("__words", words).withColumn(name, sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))).drop("__words")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, key, id, part, mask)`` to those with ``n``: each text's smallest id of this task, and counts that need no state (a bucket below 0 of the task's own)."""
    best: dict[str, tuple[int, Counter]] = {}
    home: dict[str, int] = {}
    own = -1 - TaskContext.get().partitionId()
    counted: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(home[key], key, i, part, mask, n) for key, (i, c) in best.items() for (part, mask), n in c.items()]
        for *_, part, mask, n in rows:
            counted[part, mask] += n
        rows += [(own, None, None, part, mask, n) for (part, mask), n in counted.items()]
        for held in (best, home, counted):
            held.clear()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["bucket", "key", "id", "part", "mask", "n"])

    for b in batches:
        for bucket, key, i, part, mask in zip(*[c.to_pylist() for c in b.columns]):
            if i is None:
                counted[part, mask] += 1  # no id is smaller than none
                continue
            now = best.get(key)
            if now is None:
                best[key], home[key] = (i, Counter({(part, mask): 1})), bucket
            elif i > now[0]:
                counted[part, mask | REPEATED] += 1
            elif i == now[0]:
                now[1][part, mask] += 1
            else:
                for (p, m), n in now[1].items():
                    counted[p, m | REPEATED] += n
                best[key] = (i, Counter({(part, mask): 1}))
        if len(best) >= HELD:
            yield flush()
    yield flush()


def retracted(bucket: tuple, frames: Iterator, state) -> Iterator:
    """``(part, mask, n)``: the changes to the counters when ``frames`` bring ids of a bucket's texts. The state has each text's smallest id and the masks counted for that."""
    import pandas as pd  # here, as the workers that only combine do without

    if bucket[0] < 0:
        for f in frames:
            yield f[["part", "mask", "n"]]
        return
    held = json.loads(state.get[0]) if state.exists else {}
    out: Counter = Counter()
    for f in frames:
        for key, i, part, mask, n in zip(*[f[c].tolist() for c in ("key", "id", "part", "mask", "n")]):
            low, masks = held.get(key, (None, []))
            if low is None or i < low:
                for p, m, c in masks:
                    out[p, m] -= c
                    out[p, m | REPEATED] += c
                held[key] = (i, [[part, mask, n]])
            elif i == low:
                masks.append([part, mask, n])
            else:
                out[part, mask] -= n
                out[part, mask | REPEATED] += n
    state.update((json.dumps(held, separators=(",", ":")),))
    if out:
        yield pd.DataFrame([(p, m, n) for (p, m), n in out.items()], columns=["part", "mask", "n"])


def _fs(spark: SparkSession, path: str):
    """The path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _streamable(spark: SparkSession, path: str) -> str:
    """``path``; a lone file as a pattern that it alone matches, as a stream takes folders and patterns."""
    at, fs = _fs(spark, path)
    return f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(at).isFile() else path


def counters(spark: SparkSession, path: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", batch_bytes: int | None = None) -> DataFrame:
    """``(part, mask, n)``: documents of each part by the filters they fail (bits from A), quality label 1 (32) and toxic label 1 (64).

    ``path``: Parquet files, streamed by about ``batch_bytes`` a micro-batch (the cluster's cores times ``CORE_BYTES`` by default). ``labels``: ``doc_id, quality, toxic``.
    """
    home = f"{shared_dir(spark)}/op12-{uuid.uuid4().hex}"
    at, fs = _fs(spark, path)
    buckets = 1 + fs.getContentSummary(at).getLength() // BUCKET_BYTES
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    flags = written(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("flags")), "op12-labels")
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", str(batch_bytes or spark.sparkContext.defaultParallelism * CORE_BYTES)).parquet(_streamable(spark, path))
    docs = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    seen = masked(docs, "text").select(F.base64(F.unhex(F.sha2("text", 256))).alias("key"), "id", "part", "mask")
    labelled = seen.join(sized(flags, "merge"), F.col("id") == F.col("__of"), "left")
    labelled = labelled.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", "id", "part", (F.col("mask") + F.coalesce("flags", F.lit(0))).cast("int").alias("mask"))
    small = labelled.mapInArrow(_combined, "bucket long, key string, id long, part string, mask int, n long")
    changes = small.groupBy("bucket").applyInPandasWithState(retracted, "part string, mask int, n long", "texts string", "update", "NoTimeout")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{home}/changes/batch={number}")

    query = changes.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    none = spark.createDataFrame([], "part string, mask int, n long")
    at, fs = _fs(spark, f"{home}/changes")  # no batch, no folder
    got = spark.read.schema("part string, mask int, n long").parquet(f"{home}/changes") if fs.exists(at) else none
    out = written(got.groupBy("part", "mask").agg(F.sum("n").alias("n")).where("n <> 0"), "op12-counters")
    discard(flags)
    top, fs = _fs(spark, home)
    fs.delete(top, True)
    return out


def interactions(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step, from :func:`counters`: what the step's filter removes, finds removed, alone removes, and its share over all orders."""
    fails = F.col("mask").bitwiseAND(31)
    total = lambda m, *bits: F.coalesce(F.sum(F.when((fails == m) & (F.lit(True) if not bits else F.col("mask").bitwiseAND(bits[0]) != 0), F.col("n"))), F.lit(0).cast("long"))
    each = counts.groupBy("part").agg(*[F.array(*[total(m, *bits) for m in range(32)]).alias(name) for name, bits in (("n", ()), ("good", (GOOD,)), ("toxic", (TOXIC,)))])
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    steps = each.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    bit = lambda i: F.get(F.array(*[F.lit(1 << b) for b in range(5)]), F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), i, F.lit(1))) - 1)
    steps = steps.withColumn("bit", bit(F.col("step"))).withColumn("before", F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0), lambda s, i: s + F.when(i < F.col("step"), bit(i)).otherwise(0)))

    def over(values: str, cond, weight=None) -> Column:
        one = lambda m: F.get(F.col(values), m) if weight is None else F.get(F.col(values), m) * weight(m)
        return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, m: s + F.when(cond(m), one(m)).otherwise(F.lit(0).cast("long")))

    here, before = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: here(m) & ~before(m)
    return steps.select(
        "part", "filter_order", "step",
        over("n", lambda m: ~here(m) & ~before(m)).alias("kept"),
        over("n", removed).alias("removed"),
        over("n", lambda m: here(m) & before(m)).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"),
        over("good", removed).alias("good_lost"),
        over("toxic", removed).alias("toxic_lost"),
        # the first of a set's filters to come is each of them in as many orders
        over("n", here, lambda m: (F.lit(120) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", batch_bytes: int | None = None) -> DataFrame:
    """:func:`interactions` of the documents under ``path``.

    Null texts are empty, null parts the empty part. A null id is never compared: its document repeats none and is repeated by none. Rows with one id and text are all
    first of their text, or none is. A label counts if any of the id's label rows has it. Other columns are ignored. Without documents there is no row.
    """
    return interactions(counters(spark, path, labels, id_col, text_col, part_col, batch_bytes))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


SQL = r"""WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t FROM documents), lo AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t), lb AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY 1),
w AS (SELECT d.*, lo, coalesce(q, 0) AS q, coalesce(x, 0) AS x, list_filter(string_split_regex(d.t, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS ws FROM d JOIN lo ON lo.t = d.t LEFT JOIN lb ON lb.doc_id = d.doc_id),
f AS (SELECT part, q, x, CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(doc_id > lo AS INT) AS m FROM w),
c AS (SELECT part, m, count(*) AS n, count(*) FILTER (q = 1) AS g, count(*) FILTER (x = 1) AS x FROM f GROUP BY ALL), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.l || l2.l || l3.l || l4.l || l5.l AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bs FROM l l1, l l2, l l3, l l4, l l5 WHERE l1.b + l2.b + l3.b + l4.b + l5.b = 31 AND len(list_distinct([l1.b, l2.b, l3.b, l4.b, l5.b])) = 5),
s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bs[i] AS bit, CAST(coalesce(list_sum(bs[1:i-1]), 0) AS INT) AS bef FROM o, (SELECT unnest(range(1, 6)) AS i)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (m & bit = 0 AND m & bef = 0), 0) AS kept, coalesce(sum(n) FILTER (m & bit <> 0 AND m & bef = 0), 0) AS removed, coalesce(sum(n) FILTER (m & bit <> 0 AND m & bef <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails, coalesce(sum(g) FILTER (m & bit <> 0 AND m & bef = 0), 0) AS good_lost, coalesce(sum(x) FILTER (m & bit <> 0 AND m & bef = 0), 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""
