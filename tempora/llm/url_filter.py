"""URL filters: host and path prefix rules applied to urls by a sort-merge range join.

A host is turned round into a key (``www.example.com`` -> ``com.example.www.``), so that a rule's
host and all its subdomains are the keys of one interval [``com.example.``, ``com.example/``).
The paths of one rule host make intervals as well: a rule's path opens one that ends behind all paths it starts.
Intervals of either kind nest or are apart, so bounds and urls sorted together are swept with a stack: a bound pushes or pops,
the depth is a running sum, and the rule at level k of the stack is the last one that was pushed to that level.

There are two sweeps.  The first is over hosts, and a url takes every level of the stack, which are the rule hosts that it is
under.  The second is over (rule host, path), and each of these takes the top of the stack, its host's longest rule.  The longest of those is the url's.

Scale: bounds and urls are dealt into ranges of the key, in which a hot host is cut as well, as equal keys are spread by a
hash behind the key.  The ranges are a table in the shared folder; a window sweeps each.  A range begins with the
stack that is open where the one before it ends: a depth for each range, which is broadcast (as many rows as partitions), and one row for each range and
level.  A host's rules are rows like others, however many there are, and are never copied to its subdomains or to urls.

Defined results: a null url, or one without ``://``, has an empty host and path; a host that no
rule fits gets a null rule and the default verdict; rules with a null host, path or verdict take no
part, nor do those whose host holds ``/``, ``?`` or ``#``, which no url's host does; of the same (host, path) the smallest verdict counts, so allow comes before block; of equally
long rules the one with the longer host wins.  Rows are kept as they are, repeated rows and other
columns included; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lower_ascii, packed, shuffle_partitions, stored, table

END = "X'FF'"  # a byte that UTF-8 has not: behind every text that goes on


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_bounds(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bounds (key, step, entry) of rule hosts, whose entry is the host's key, and of their paths, whose entry is the rule; a step of 1 pushes, -1 pops."""
    sound = rules.dropna(subset=["host", "path", "verdict"]).select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where("NOT host RLIKE '[/?#]'")
    one = sound.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("above", host_key(F.col("host")))
    text = F.concat("host", "path")
    hosts = one.select("above").distinct().select(_bounds(F.col("above").cast("binary"), F.expr("left(above, length(above) - 1) || '/'").cast("binary"), F.col("above")))
    rule = F.struct(F.length(text).alias("size"), F.length("host").alias("host_size"), text.alias("rule"), "verdict")
    begin = path_key(F.col("above"), F.col("path"))
    return hosts.select("b.*"), one.select(_bounds(begin, F.concat(begin, F.expr(END)), rule)).select("b.*")


def _bounds(opens: Column, closes: Column, entry: Column) -> Column:
    bound = lambda key, step: F.struct(key.alias("key"), F.lit(step).alias("step"), entry.alias("entry"))
    return F.explode(F.array(bound(opens, 1), bound(closes, -1))).alias("b")


def path_key(above: Column, path: Column) -> Column:
    return F.concat(above.cast("binary"), F.expr(END), path.cast("binary"))


def dealt(points: DataFrame, bounds: DataFrame, name: str) -> DataFrame:
    """Points (key, spread, point) and bounds in ranges of the key, as a table (range, id, key, kind, point, step, entry)."""
    marks = bounds.select("key", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("spread"), F.lit(None).cast(points.schema["point"].dataType).alias("point"), "step", "entry")
    rows = points.select("key", F.lit(1).alias("kind"), "spread", "point", F.lit(None).cast("int").alias("step"), F.lit(None).cast(bounds.schema["entry"].dataType).alias("entry"))
    ranged = rows.unionAll(marks).repartitionByRange(4 * shuffle_partitions(points.sparkSession), "key", "kind", "spread")
    return stored(ranged.withColumns({"range": F.spark_partition_id(), "id": F.monotonically_increasing_id()}), name)


def swept(ranges: DataFrame, point: Column, whole_stack: bool) -> DataFrame:
    """(id, point, entry): each point of ``dealt`` rows with every entry of the stack where it stands, or with the top one. One without any gives no row."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = ranges.where("kind = 0").groupBy("range").agg(F.sum("step").alias("net"))
    one_a_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("range").distinct().join(steps, "range", "left").select("range", F.coalesce(F.sum("net").over(one_a_range), F.lit(0)).alias("before"))
    # columns that the sweep needs only: it sorts them once
    thin = ranges.select("range", "id", "key", "kind", point.alias("point"), "step", "entry")
    depth = lambda df: df.withColumn("sum", F.sum(F.coalesce("step", F.lit(0))).over(upto(Window.partitionBy("range").orderBy("key", "kind")))).join(F.broadcast(before), "range").withColumn("depth", F.col("sum") + F.col("before"))
    pushed = depth(thin.where("kind = 0")).where("step = 1").select("range", F.col("depth").alias("level"), "key", "entry")
    # the stack that is open where a range begins
    asked = before.where("before > 0").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "before")).alias("level"), "range", F.lit(0).alias("kind"), F.lit(None).cast(ranges.schema["entry"].dataType).alias("entry"))
    last = pushed.groupBy("level", "range").agg(F.max_by("entry", "key").alias("entry")).select("level", "range", F.lit(1).alias("kind"), "entry")
    opened = asked.unionAll(last).withColumn("entry", F.last("entry", ignorenulls=True).over(upto(Window.partitionBy("level").orderBy("range", "kind")))).where("kind = 0")
    levels = F.explode(F.sequence(F.lit(1).cast("bigint"), "depth")) if whole_stack else F.col("depth")
    points = depth(thin).where("kind = 1 AND depth > 0").select("range", levels.alias("level"), "key", F.lit(1).alias("kind"), "entry", "id", "point")
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("id", "point")]
    stack = opened.select("range", "level", F.lit(b"").alias("key"), F.lit(-1).alias("kind"), "entry", *none).unionAll(pushed.select("range", "level", "key", F.lit(0).alias("kind"), "entry", *none))
    at_level = upto(Window.partitionBy("range", "level").orderBy("key", "kind"))
    return points.unionAll(stack).withColumn("entry", F.last("entry", ignorenulls=True).over(at_level)).where("kind = 1").select("id", "point", "entry")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; ``rules`` has (host, path, verdict)."""
    hosts, paths = rule_bounds(rules)
    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    point = F.struct(packed(pages), host.alias("host"), path.alias("path")).alias("point")
    urls = dealt(pages.select(host_key(host).cast("binary").alias("key"), F.xxhash64(F.to_json(packed(pages))).alias("spread"), point), hosts, "url-hosts")
    under = swept(urls, F.col("point.path"), whole_stack=True)
    each = dealt(under.select(path_key(F.col("entry"), F.col("point")).alias("key"), F.col("id").alias("spread"), F.struct(F.col("id").alias("url")).alias("point")), paths, "url-paths")
    best = swept(each, F.col("point"), whole_stack=False).groupBy(F.col("point.url").alias("id")).agg(F.max("entry").alias("best"))
    taken = {"host", "path", "rule", "verdict"}
    return urls.where("kind = 1").select("id", "point").join(best, "id", "left").select(
        *[F.col(f"point.row.`{c}`") for c in pages.columns if c not in taken],
        "point.host", "point.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of op6.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every page's url."""
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS t(host, path, verdict)")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n
  FROM pages
), fits AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""
