"""Written stages: tables in the folder that driver and executors share, ranks over whole tables, and stage reuse."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of a join side up to which it is broadcast; a larger side is shuffled.
BROADCAST_BYTES = 8 << 20
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset: a folder of our own in local mode, else an error, as executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: the lineage ends there, and Spark knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def together(schema: str, *tables: DataFrame) -> DataFrame:
    """The columns of ``schema`` of several tables made by :func:`written`, as one table."""
    return tables[0].sparkSession.read.schema(schema).parquet(*[_paths[t] for t in tables])


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables made by :func:`written` that nothing reads any more; other tables are left alone."""
    for df in tables:
        path = _paths.pop(df, None) if df is not None else None
        if path:
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def taken_bytes(df: DataFrame) -> int:
    """About the bytes of all rows of ``df``: it is run for this, so write a costly one first."""
    row = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(8)) for c in df.columns), F.lit(16))
    return df.agg(F.sum(row)).first()[0] or 0


def sized(df: DataFrame, other: str = "shuffle_hash", limit: int | None = None) -> DataFrame:
    """``df`` with a join hint: broadcast if its measured rows take at most ``limit`` bytes (``BROADCAST_BYTES``), else ``other``."""
    return df.hint("broadcast" if taken_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else other)


def spare(name: str, *tables: DataFrame) -> str:
    """``name``, or a longer name that no column of ``tables`` has, in any case."""
    used = {c.lower() for t in tables for c in t.columns}
    while name.lower() in used:
        name += "_"
    return name


def running(df: DataFrame, order: list, add: str | None = None, rank: str = "rank", total: str = "running") -> DataFrame:
    """``df`` with its 1-based rank in a total ``order`` and, for ``add``, the running sum up to and with the row.

    The rows are range-partitioned and numbered inside each partition; the partitions' own counts and sums, a row each, give the
    offsets. So no task holds more than a partition, unlike a window without partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(*order)
    inside = dealt.withColumns({"__in": F.row_number().over(w), "__is": F.sum(F.col(add) if add else F.lit(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    inside = written(inside, "ranks")
    each = inside.groupBy("__p").agg(F.max("__in").alias("n"), F.max_by("__is", "__in").alias("s"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__bn"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__bs"))  # a row a partition
    out = inside.join(F.broadcast(offsets), "__p").withColumn(rank, (F.col("__bn") + F.col("__in")).cast("long"))
    if add:
        out = out.withColumn(total, F.col("__bs") + F.col("__is"))
    return out.drop("__p", "__in", "__is", "__bn", "__bs")


#: Rows up to which exact quantiles are left to one aggregate, which holds a group's distinct values in a task.
FEW_ROWS = 1_000_000


def small(df: DataFrame, other: str = "shuffle_hash") -> DataFrame:
    """:func:`sized` of a table that is written first, so that it is computed once."""
    return sized(written(df, "side"), other)


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], out: str = "q", few: int | None = None, weight: str | None = None) -> DataFrame:
    """``(by.., out)``: exact interpolated quantiles of each group as an array; nulls don't count, a group without values is left out.

    Equal values of a group become one row with their count (or the sum of their ``weight``) before anything is shuffled. Beyond ``few`` such rows they are ranked over the whole table by ranges
    and only the two neighbours of each quantile are picked, so no task holds a group.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("__c"))
    x = written(x, "values")
    if x.count() <= (FEW_ROWS if few is None else few):
        got = x.groupBy(*by).agg(F.percentile("__v", F.array(*map(F.lit, probs)), F.col("__c")).alias(out))
        return got if by else got.where(F.col(out).isNotNull())
    ranked = running(x, [*by, "__v"], add="__c", total="__r")
    each = small(ranked.groupBy(*by).agg(F.sum("__c").alias("__n"), F.min(F.col("__r") - F.col("__c")).alias("__s")), "merge")
    same = F.lit(True)
    for b in by:
        same &= ranked[b].eqNullSafe(each[b])
    last = F.col("__r") - F.col("__s") - 1  # from 0 in the group
    first = last - F.col("__c") + 1
    place = [F.lit(float(p)) * (F.col("__n") - 1) for p in probs]
    near = F.lit(False)
    for x_ in place:
        near |= F.floor(x_).between(first, last) | F.ceil(x_).between(first, last)
    few_ = ranked.join(each, same).where(near).select(*[ranked[b] for b in by], "__v", "__n", first.alias("__first"), last.alias("__last"))
    value_at = lambda i: F.max(F.when(i.between(F.col("__first"), F.col("__last")), F.col("__v")))
    got = few_.groupBy(*by, "__n").agg(*[f for i, x_ in enumerate(place) for f in (value_at(F.floor(x_)).alias(f"__l{i}"), value_at(F.ceil(x_)).alias(f"__h{i}"))])
    # between equal values no sum of two shares: it may miss the value by its last bit, and what equals an edge would lie beyond it
    mid = lambda i, x_: F.when((F.floor(x_) == F.ceil(x_)) | (F.col(f"__l{i}") == F.col(f"__h{i}")), F.col(f"__l{i}")).otherwise((F.ceil(x_) - x_) * F.col(f"__l{i}") + (x_ - F.floor(x_)) * F.col(f"__h{i}"))
    return got.select(*by, F.array(*[mid(i, x_) for i, x_ in enumerate(place)]).alias(out))


def fingerprint(df: DataFrame) -> str:
    """A content fingerprint that doesn't depend on the order of the rows."""
    r = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{r[0]}-{r[1] or 0}"


def reuse(df: DataFrame, path: str, compute, refresh: bool = False) -> DataFrame:
    """``compute(df)`` kept under ``path`` by the fingerprint of ``df``: read again for the same rows, else computed and written."""
    spark = df.sparkSession
    at = f"{path}/{fingerprint(df)}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if refresh or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        compute(df).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
