"""Readers and writers: event tables, transcript text, marked dialogues, JSON inventories, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqspark.functions import columns as C
from seqspark.operators.stages import small, written

#: Line numbers of a stretch of a path; about the lines that a task sorts.
STRETCH, TASK_LINES = 1 << 16, 1 << 20


def event_schema(intervals: int = 40) -> T.StructType:
    """The wide event table: keys, actor, time, clicks, and one column an interval. The names are fixed values of the file format."""
    text = ["source", "source_coda_id", "recording_id", "date", "clan", "whale_photo_id", "local_speaker_id"]
    fields = [T.StructField(c, T.StringType()) for c in text] + [T.StructField("time_in_recording_s", T.DoubleType()), T.StructField("n_clicks", T.IntegerType()), T.StructField("coda_duration_s", T.DoubleType())]
    fields += [T.StructField(f"ICI{i}", T.DoubleType()) for i in range(1, intervals + 1)]
    return T.StructType([*fields, T.StructField("rhythm", T.IntegerType()), T.StructField("extra_click", T.IntegerType())])


def read_events(spark: SparkSession, path: str, intervals: int = 40, fmt: str = "csv") -> DataFrame:
    """Events with an explicit schema and their intervals packed as ``ici``."""
    schema = event_schema(intervals)
    df = spark.read.schema(schema).option("header", True).csv(path) if fmt == "csv" else spark.read.schema(schema).parquet(path)
    names = [f"ICI{i}" for i in range(1, intervals + 1)]
    return df.withColumn("ici", C.pack_pattern(names, F.col("n_clicks"))).drop(*names)


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without byte-order mark and outer spaces."""
    return df.toDF(*[C.clean_header(c) for c in df.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, line)`` of text files; each file is one row first, so its lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def utterances(lines: DataFrame) -> DataFrame:
    """``(path, utt, speaker, mor)`` of transcript lines.

    A line ``*SPK:`` opens an utterance, an ``@`` line ends it. Its last ``%mor:`` line and the tabbed lines that go on from it are the tier; other tiers and
    lines end the tier. An utterance without the tier has null. Lines before the first speaker are left out.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    x = lines.where("line <> ''")
    opens, at = F.col("line").startswith("*"), F.col("line").startswith("@")
    x = x.withColumn("utt", F.sum((opens | at).cast("int")).over(w)).withColumn("speaker", F.regexp_extract(F.first("line").over(Window.partitionBy("path", "utt").orderBy("line_no")), r"^\*([A-Za-z0-9]+):", 1))
    tab, mor = F.col("line").startswith("\t"), F.col("line").startswith("%mor:")
    u = Window.partitionBy("path", "utt").orderBy("line_no")
    x = x.withColumn("block", F.sum((~tab).cast("int")).over(u)).withColumn("is_mor", F.first("line").over(Window.partitionBy("path", "utt", "block").orderBy("line_no")).startswith("%mor:"))
    x = x.withColumn("last_mor", F.max(F.when(mor, F.col("block"))).over(Window.partitionBy("path", "utt")))
    part = F.when(F.col("is_mor") & (F.col("block") == F.col("last_mor")), F.struct("line_no", F.trim(F.regexp_replace(F.col("line"), r"^%mor:|\t", " ")).alias("t")))
    g = x.where("speaker <> ''").groupBy("path", "utt", "speaker").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return g.select("path", "utt", "speaker", F.when(F.size("p") > 0, F.trim(F.array_join(F.transform("p", lambda s: s["t"]), " "))).alias("mor"))


def marked_dialogue(lines: DataFrame, token: str = r"[/\\-]?[a-zA-Z]\d+", header: str = "File:", chorus: str = "In chorus", stretch: int = STRETCH) -> DataFrame:
    """``(path, section, line_no, pos, token, marked)``: tokens of each section; ``marked`` has a ``*`` on chorus lines. Lines before a header belong to ``unknown``.

    A path of any length is read in stretches of ``stretch`` line numbers, each a window of its own; what a stretch takes over from those before it is a row a stretch. ``lines`` are read twice.
    """
    head = F.when(F.col("line").startswith(header), F.trim(F.substring(F.col("line"), F.lit(len(header) + 1), F.length("line"))))
    x = lines.withColumns({"stretch": F.floor(F.col("line_no") / stretch).cast("long"), "head": head})
    every = written(x.groupBy("path", "stretch").agg(F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line_no"))).alias("head"), F.count("*").alias("n")), "stretches")
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), (every.agg(F.sum("n")).first()[0] or 0) // TASK_LINES + 1)
    before = F.last("head", ignorenulls=True).over(Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    carried = small(every.select("path", "stretch", before.alias("carried")).where("carried is not null"))
    w = Window.partitionBy("path", "stretch").orderBy("line_no")
    x = x.repartition(parts, "path", "stretch").withColumn("own", F.last("head", ignorenulls=True).over(w)).where("head is null").join(carried, ["path", "stretch"], "left").withColumn("section", F.coalesce("own", "carried", F.lit("unknown")))
    t = x.select("path", "section", "line_no", F.col("line").contains(chorus).alias("c"), F.posexplode(F.regexp_extract_all("line", F.lit(token), F.lit(0))).alias("pos", "token"))
    return t.select("path", "section", "line_no", "pos", "token", F.concat("token", F.when(F.col("c"), "*").otherwise("")).alias("marked"))


def child_age(lines: DataFrame, role: str = "Target_Child") -> DataFrame:
    """``(path, months)``: the age of the first ``@ID:`` line with the role; null if it can't be read, no row without such a line."""
    f = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    ids = lines.where(F.col("line").startswith("@ID:")).select("path", "line_no", f.alias("f")).where((F.size("f") >= 8) & (F.get("f", F.lit(7)) == role))
    first = ids.groupBy("path").agg(F.min_by("f", "line_no").alias("f"))
    age = F.get("f", F.lit(3))
    months = F.when(age.rlike(r"^\d+;"), F.regexp_extract(age, r"^(\d+);", 1).cast("int") * 12 + F.coalesce(F.expr("try_cast(regexp_extract(f[3], '^[0-9]+;([0-9]+)', 1) as int)"), F.lit(0)))
    return first.select("path", months.alias("months"))


def read_inventory(spark: SparkSession, path: str, field: str = "morpheme_inventory", lines: bool = False) -> DataFrame:
    """``(segment, count)`` of a JSON file whose ``field`` is a list of pairs, or of :func:`write_inventory`'s ``lines``."""
    if lines:
        return spark.read.schema("segment string, count long").json(path)
    df = spark.read.schema(f"{field} array<array<string>>").json(path, multiLine=True)
    return df.select(F.explode(field).alias("p")).select(F.get("p", F.lit(0)).alias("segment"), F.get("p", F.lit(1)).cast("long").alias("count"))


def write_inventory(df: DataFrame, path: str) -> None:
    """``(segment, count)`` as JSON, an object a line, by as many tasks as there are partitions."""
    df.select("segment", F.col("count").cast("long").alias("count")).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: str | None = None, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    w = w.partitionBy(by) if by else w
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def write_transcripts(lines: DataFrame, path: str, group: str, parts: int | None = None) -> None:
    """One text folder a group: ``lines`` has (group, line_no, line). Tasks write ranges of (group, line_no), so a group of any size is files whose numbers follow its lines."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, group, "line_no").sortWithinPartitions(group, "line_no")
    dealt.select(group, F.col("line").alias("value")).write.mode("overwrite").partitionBy(group).text(path)


def read_transcripts(spark: SparkSession, path: str, group: str) -> DataFrame:
    """``(group, part, at, line)`` of :func:`write_transcripts`: a group's lines are in the order of ``part, at``."""
    x = spark.read.option("wholetext", True).text(path).select(group, F.col("_metadata.file_name").alias("part"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("v"))
    return x.select(group, "part", F.posexplode("v").alias("at", "line"))
