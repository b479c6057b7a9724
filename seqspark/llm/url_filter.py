"""URL filters by a sort-merge range join, in DataFrame functions only.

A url's host is reversed label by label (``www.example.org`` is ``org.example.www.``), so the hosts that a rule covers are one interval of sorted
keys, ``[key, key 0xFF)``, and so are the paths of a host that begin with a rule's path. Such intervals nest or are disjoint, and one
sorted sweep meets them like brackets: it goes up a level at a start, down at an end, and the last start of each level up to the present one is the
stack of the intervals still open. A first sweep over the distinct hosts reads the whole stack, the rules' hosts at or above each host; a second one over the
distinct (rule's host, path) reads the top of the stack, the longest path rule that fits.

A sweep is range-partitioned by key, so that each rule is in one or two ranges, however many there are. The level and the stack at the start of a
range are carried from the ranges before it: a row a range and level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, discard, sized, table, written

RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
RULES_SCHEMA = "host string, path string, verdict string"
_URL = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def host_key(host: Column) -> Column:
    """The canonical key of a host as bytes: they sort like code points, and 0xFF ends every prefix."""
    return F.encode(reversed_host(host), "utf-8")


def path_key(host: Column, path: Column) -> Column:
    """The same of a host and a path, parted by a byte that no text has."""
    return F.concat(host_key(host), F.unhex(F.lit("FE")), F.encode(path, "utf-8"))


def open_intervals(points: DataFrame, intervals: DataFrame, whole: bool, ranges: int) -> DataFrame:
    """``(point, rule)`` for ``points`` (key, point) and ``intervals`` (key, rule), which cover the keys that begin with theirs: every interval open at a point, or, unless ``whole``, the innermost.

    Keys of intervals are distinct. Points in no interval are left out.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    starts = intervals.select("key", F.lit(0).alias("ord"), F.lit(1).alias("step"), "rule", none(points, "point"))
    ends = intervals.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("ord"), F.lit(-1).alias("step"), none(intervals, "rule"), none(points, "point"))
    asked = points.select("key", F.lit(1).alias("ord"), F.lit(0).alias("step"), none(intervals, "rule"), "point")
    events = starts.unionByName(ends).unionByName(asked).repartitionByRange(ranges, "key", "ord")
    events = written(events.withColumn("range", F.spark_partition_id()), "op6-events")
    each = events.groupBy("range").agg(F.sum("step").alias("change"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    level0 = written(each.select("range", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("before")), "op6-ranges")  # a row a range
    here = Window.partitionBy("range").orderBy("key", "ord")
    level = (F.col("before") + F.sum("step").over(here)).cast("int")
    placed = written(events.join(F.broadcast(level0), "range").withColumn("level", level).select("range", "key", "ord", "step", "level", "rule", "point"), "op6-levels")  # a row a range
    opened = placed.where("step = 1").select("range", "level", "key", "ord", "rule", "point")
    last = opened.groupBy("range", "level").agg(F.max_by("rule", "key").alias("rule"))
    wanted = level0.where("before > 0").select("range", F.explode(F.sequence(F.lit(1), F.col("before").cast("int"))).alias("level"))
    both = last.withColumn("wanted", F.lit(False)).unionByName(wanted.select("range", "level", none(intervals, "rule"), F.lit(True).alias("wanted"))).groupBy("range", "level").agg(F.max("rule").alias("rule"), F.max("wanted").alias("wanted"))
    carried = both.withColumn("rule", F.last("rule", ignorenulls=True).over(Window.partitionBy("level").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).where("wanted")
    carried = carried.select("range", "level", F.unhex(F.lit("")).alias("key"), F.lit(-1).alias("ord"), "rule", none(points, "point"))
    levels = F.explode(F.sequence(F.lit(1), F.col("level"))) if whole else F.col("level")
    read = placed.where("step = 0 and level > 0").select("range", levels.alias("level"), "key", "ord", "rule", "point")
    stack = Window.partitionBy("range", "level").orderBy("key", "ord").rowsBetween(Window.unboundedPreceding, 0)
    swept = opened.unionByName(carried).unionByName(read).withColumn("rule", F.last("rule", ignorenulls=True).over(stack))
    out = written(swept.where("ord = 1").select("point", "rule"), "op6-open")
    discard(events, level0, placed)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``, repeated rows included.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The longest fitting rule wins,
    measured as host plus path, then by the longer host; of equal (host, path) rules ``block`` wins over ``allow``. Without one, ``rule`` is null and the verdict
    is ``default``. Rules with a null are left out.
    A null url, one without ``://`` and an empty url have empty host and path and fit no rule with a host. Null ids are kept. Other columns are ignored. An empty
    table gives an empty result, and so does one of rules give everything the default. Hosts of any number of labels and urls of any length are one key.
    """
    ranges = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    asked = written(urls.groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path"), "op6-asked")
    hosts = asked.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("point"))
    above = open_intervals(hosts, rules.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("rule")), True, ranges)
    pairs = written(asked.join(sized(above.select(F.col("point").alias("host"), F.col("rule").alias("at")), "merge"), "host"), "op6-pairs")
    points = pairs.select("at", "path").distinct().select(path_key(F.col("at"), F.col("path")).alias("key"), F.struct("at", "path").alias("point"))
    top = open_intervals(points, rules.select(path_key(F.col("host"), F.col("path")).alias("key"), F.struct("path", "verdict").alias("rule")), False, ranges)
    fit = pairs.join(sized(top.select("point.at", "point.path", F.col("rule.path").alias("rule"), "rule.verdict"), "merge"), ["at", "path"])
    best = F.max(F.struct((F.length("at") + F.length("rule")).alias("n"), F.length("at").alias("h"), F.concat("at", "rule").alias("rule"), "verdict"))
    found = written(fit.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict"), "op6-found")
    discard(asked, above, pairs, top)
    out = urls.join(sized(found, "merge"), ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, RULES_SCHEMA))


SQL = r"""
WITH rules(rh, rp, rv) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'), ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
f AS (
  SELECT rid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, f.rule AS rule, coalesce(f.rv, 'allow') AS verdict FROM p LEFT JOIN f ON p.rid = f.rid AND f.k = 1
"""
