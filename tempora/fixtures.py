"""Timelines derived from general event, conversation and measurement tables.

Times are integer milliseconds, so that every engine agrees on every comparison; tracks are keyed by
day, day and user, conversation or supplier.  ``*_SQL`` is the same view in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues: (track_id, id, ordinal, start_ms, end_ms, speaker, source, translated)."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = read(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd").cast("int").alias("day"), "event_id", "user_id", "event_type", "value", us.alias("us"), F.pmod("user_id", F.lit(10)).cast("int").alias("lane")
    )
    start = F.floor((F.col("us") % 86_400_000_000) / 100_000).cast("bigint")
    return base.select(
        (F.col("day") * 10 + F.col("lane")).cast("bigint").alias("track_id"),
        F.col("event_id").alias("id"),
        (F.row_number().over(Window.partitionBy("day", "lane").orderBy("us", "event_id")) - 1).cast("bigint").alias("ordinal"),
        start.alias("start_ms"), (start + F.floor(F.col("value") * 20).cast("bigint")).alias("end_ms"),
        F.when(F.col("event_type") != "error", F.pmod("user_id", F.lit(4)).cast("string")).alias("speaker"),
        F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 != 0, F.upper("event_type")).alias("translated"),
    )


CUES_SQL = """cues AS (
  SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) * 10 + user_id % 10 AS track_id, event_id AS id,
    row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d'), user_id % 10 ORDER BY epoch_us(ts), event_id) - 1 AS ordinal,
    (epoch_us(ts) % 86400000000) // 100000 AS start_ms,
    (epoch_us(ts) % 86400000000) // 100000 + CAST(floor(value * 20) AS BIGINT) AS end_ms,
    CASE WHEN event_type <> 'error' THEN CAST(user_id % 4 AS VARCHAR) END AS speaker,
    event_type AS source, CASE WHEN event_id % 3 <> 0 THEN upper(event_type) END AS translated
  FROM events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech spans: (track_id, start_ms, end_ms)."""
    return cues(spark, sf_dir).where("source IN ('click', 'view')").select("track_id", "start_ms", "end_ms")


SPANS_SQL = "spans AS (SELECT track_id, start_ms, end_ms FROM cues WHERE source IN ('click', 'view'))"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as words: (track_id, ordinal, speaker, text, start_ms, end_ms)."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.split("text", " ").alias("w"))
    each = turns.select("conv_id", "turn", "role", F.size("w").alias("n"), F.posexplode("w").alias("p", "text"))
    size = F.char_length("text")
    dur = F.when((F.col("turn") % 2 == 1) & (F.col("p") >= F.col("n") - 3), 10).otherwise(60 * size)
    gap = F.when(F.col("text").endswith("."), 900).when(F.col("text").endswith(","), 300).otherwise(40)
    order = Window.partitionBy("conv_id").orderBy("turn", "p")
    before = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.greatest(F.lit(0), before - 1200 * F.col("turn"))
    speaker = F.when(F.col("role") == "user", "0").when(F.col("role") == "assistant", "1")
    timed = each.withColumn("dur", dur).withColumn("gap", gap)
    return timed.select(F.col("conv_id").alias("track_id"), (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"), speaker.alias("speaker"), "text", start.cast("bigint").alias("start_ms"), "dur").withColumn("end_ms", F.col("start_ms") + F.col("dur")).drop("dur")


WORDS_SQL = """words AS (
  SELECT conv_id AS track_id, row_number() OVER o - 1 AS ordinal, CASE role WHEN 'user' THEN '0' WHEN 'assistant' THEN '1' END AS speaker, text,
    CAST(greatest(0, coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1200 * turn) AS BIGINT) AS start_ms,
    CAST(greatest(0, coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1200 * turn) AS BIGINT) + dur AS end_ms
  FROM (SELECT conv_id, turn, role, p, text, CASE WHEN turn % 2 = 1 AND p >= n - 3 THEN 10 ELSE 60 * length(text) END AS dur,
          CASE WHEN ends_with(text, '.') THEN 900 WHEN ends_with(text, ',') THEN 300 ELSE 40 END AS gap
        FROM (SELECT conv_id, turn, role, len(w) AS n, unnest(range(len(w))) AS p, unnest(w) AS text
              FROM (SELECT *, string_split(text, ' ') AS w FROM conversations)))
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn, p))"""


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements as a level series: (track_id, window_idx, level)."""
    t = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    level = F.when(F.col("l_returnflag") == "N", F.col("l_linenumber").cast("double")).otherwise(F.col("l_quantity").cast("double") * 20)
    return t.select(F.col("l_suppkey").alias("track_id"), (F.row_number().over(order) - 1).cast("bigint").alias("window_idx"), level.alias("level"))


LEVELS_SQL = """levels AS (
  SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS window_idx,
    CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) * 20 END AS level
  FROM lineitem)"""


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as task events: (operation_id, event_id, state, created_us, model, attempt)."""
    state = F.when(F.col("event_type") == "signup", "running").when(F.col("event_type").isin("click", "view"), "retrying").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    some = F.col("value") >= 5
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("operation_id"), "event_id", state.alias("state"), F.unix_micros(F.col("ts").cast("timestamp")).alias("created_us"),
        F.when(some, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"), F.when(some, F.col("event_id") % 5).alias("attempt"),
    )


TRACE_SQL = """trace AS (
  SELECT user_id AS operation_id, event_id, CASE WHEN event_type = 'signup' THEN 'running' WHEN event_type IN ('click', 'view') THEN 'retrying'
      WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS state, epoch_us(ts) AS created_us,
    CASE WHEN value >= 5 THEN 'm' || CAST(event_id % 3 AS VARCHAR) END AS model, CASE WHEN value >= 5 THEN event_id % 5 END AS attempt
  FROM events)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to batches of cues: (track_id, id, translated); some ids are missing, unknown or blank."""
    c = cues(spark, sf_dir).select("track_id", F.col("id").alias("k"), "source")
    known = c.where("k % 11 <> 0").select("track_id", F.col("k").cast("string").alias("id"), F.when(F.col("k") % 13 == 0, " ").otherwise(F.concat(F.lit("t-"), "source")).alias("translated"))
    unknown = c.where("k % 17 = 0").select("track_id", F.concat(F.lit("x"), F.col("k").cast("string")).alias("id"), F.lit("t").alias("translated"))
    return known.unionAll(unknown)


REPLIES_SQL = """replies AS (
  SELECT track_id, CAST(id AS VARCHAR) AS id, CASE WHEN id % 13 = 0 THEN ' ' ELSE 't-' || source END AS translated FROM cues WHERE id % 11 <> 0
  UNION ALL SELECT track_id, 'x' || CAST(id AS VARCHAR), 't' FROM cues WHERE id % 17 = 0)"""
