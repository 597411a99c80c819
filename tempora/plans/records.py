"""Queries over text records that Spark derives from the tables: logs, transcripts, word lists, replies, traces, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import journal as jr
from ..sources import records as rc
from .sql import MISSING

CUES, WORDS, LEVELS, REPLIES = fx.CUES_SQL, fx.WORDS_SQL, fx.LEVELS_SQL, fx.REPLIES_SQL


def _clock(ms):
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def _lines(spark, d):
    """Log lines of the tracks: cues, speech spans (some inverted), progress."""
    c = fx.cues(spark, d)
    s, e = F.col("start_ms"), F.col("end_ms")
    inverted = F.when(F.col("id") % 13 == 0, s - 5).otherwise(e)
    line = (
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), _clock(s), F.lit(" --> "), _clock(e), F.lit("]   "), "source"))
        .when(F.col("id") % 3 == 1, F.format_string("VAD segment %d: start = %.3f, end = %.3f", F.col("ordinal"), s / 1000, inverted / 1000))
        .when(F.col("id") % 2 == 0, F.format_string("progress = %d%%", F.col("id") % 150)).otherwise(F.format_string("[download] %d%%", F.col("id") % 100))
    )
    return c.select("track_id", F.col("id").alias("line_no"), line.alias("line"))


def _logs(spark, d):
    lines, none = _lines(spark, d), F.lit(None)
    cues = rc.log_cues(lines).select("track_id", "line_no", F.lit("cue").alias("kind"), "start_ms", "end_ms", "text", none.cast("double").alias("fraction"))
    spans = rc.log_spans(lines).select("track_id", "line_no", F.lit("span").alias("kind"), "start_ms", "end_ms", none.cast("string").alias("text"), none.cast("double").alias("fraction"))
    share = rc.log_progress(lines).select("track_id", "line_no", F.lit("progress").alias("kind"), none.cast("bigint").alias("start_ms"), none.cast("bigint").alias("end_ms"), none.cast("string").alias("text"), F.round("fraction", 9).alias("fraction"))
    return cues.unionAll(spans).unionAll(share)


def _transcripts(spark, d):
    """One transcript a track, in one of three forms; every seventh entry is blank."""
    c = fx.cues(spark, d)
    text = F.when(F.col("id") % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    form = F.col("track_id") % 3
    entry = F.struct(
        text.alias("text"),
        F.when(form == 0, F.struct(_clock(F.col("start_ms")).alias("from"), _clock(F.col("end_ms")).alias("to"))).alias("timestamps"),
        F.when(form == 1, F.col("start_ms") / 1000).alias("start"), F.when(form == 1, F.col("end_ms") / 1000).alias("end"),
        F.when(form == 2, F.struct(F.col("start_ms").alias("from"), F.col("end_ms").alias("to"))).alias("offsets"),
    )
    rows = c.select("track_id", F.struct("ordinal", entry.alias("entry")).alias("row")).groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list("row")), lambda r: r.entry).alias("entries"))
    body = F.struct(F.when(form != 1, F.col("entries")).alias("transcription"), F.when(form == 1, F.col("entries")).alias("segments"))
    return rows.select("track_id", F.to_json(body).alias("body"))


def _items(spark, d):
    """One word list a conversation: a space behind every word, before the first one too, and sounds between."""
    w = fx.words(spark, d)
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.concat(F.lit("speaker_"), "speaker").alias("speaker_id"))
    items = F.array(item("spacing", F.lit(" ")), item("audio_event", F.lit("(sound)")), item("word", F.col("text")))
    rows = w.select("track_id", F.struct("ordinal", items.alias("items")).alias("row")).groupBy("track_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["items"])).alias("items"))
    return rows.select("track_id", F.to_json("items").alias("items"))


def _reply_texts(spark, d):
    """The replies of a track as one text: plain, fenced, or inside talk and wrapped as a result."""
    r = fx.replies(spark, d).groupBy("track_id").agg(F.collect_list(F.struct("id", F.lit("s").alias("source"), "translated")).alias("cues"))
    body = F.to_json(F.struct("cues"))
    form = F.col("track_id") % 3
    text = F.when(form == 0, body).when(form == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).otherwise(F.to_json(F.struct(F.concat(F.lit("done "), body, F.lit(" ok")).alias("result"))))
    return r.select("track_id", F.lit(0).alias("batch_no"), text.alias("text"))


def _traces(spark, d):
    """Trace lines of the events: commands, calls, messages (some of them data), failures."""
    e = fx.read(spark, d, "events")
    key = F.col("event_id")
    kind = F.when(key % 2 == 0, "item.started").otherwise("item.completed")
    item = (
        F.when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("command_execution").alias("type"), key.cast("string").alias("id"), F.concat(F.lit("ls "), key).alias("command"), (key % 3).alias("exit_code"))))
        .when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("mcp_tool_call").alias("type"), key.cast("string").alias("id"), F.when(key % 5 > 0, "srv").alias("server"), F.lit("get").alias("tool"))))
        .otherwise(F.to_json(F.struct(F.lit("agent_message").alias("type"), key.cast("string").alias("id"), F.when(key % 3 == 0, '{"cues":[]}').otherwise("hello").alias("text"))))
    )
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('{"type":"error","message":"m'), key % 7, F.lit('"}'))).otherwise(F.concat(F.lit('{"type":"'), kind, F.lit('","item":'), item, F.lit("}")))
    return e.select("event_id", line.alias("line"))


def _messages(spark, d):
    """Conversation turns as trace lines of messages with a text and a tool block."""
    c = fx.read(spark, d, "conversations").where("role IN ('user', 'assistant')")
    text = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"), F.col("text").alias("text"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("content"))
    use = F.when(F.col("role") == "assistant", "tool_use").otherwise("tool_result")
    tool = F.struct(use.alias("type"), F.concat(F.lit("b"), F.col("turn")).alias("id"), F.lit(None).cast("string").alias("text"), F.lit("look").alias("name"), F.lit("t1").alias("tool_use_id"), F.lit("found").alias("content"))
    return c.select("conv_id", "turn", F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(text, tool).alias("content")).alias("message"))).alias("line"))


def _samples(spark, d):
    return fx.levels(spark, d).select("track_id", F.col("window_idx").alias("i"), F.col("level").alias("value"))


def _probes(spark, d):
    t = fx.read(spark, d, "lineitem")
    stream = F.struct(
        F.col("l_linenumber").alias("n"), F.when(F.col("l_returnflag") == "A", "audio").otherwise("video").alias("codec_type"), F.col("l_quantity").cast("int").alias("width"),
        (F.col("l_suppkey") % 50).cast("int").alias("height"), F.struct(F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("attached_pic")).alias("disposition"), "l_partkey",
    )
    rows = t.groupBy(F.col("l_orderkey").alias("track_id")).agg(F.array_sort(F.collect_list(stream)).alias("streams"))
    return rows.select("track_id", F.to_json(F.struct("streams")).alias("body"))


#: name: (query, SQL)
QUERIES = {
    "parse_logs": (
        _logs,
        f"""WITH {CUES} SELECT track_id, id AS line_no, 'cue' AS kind, start_ms, end_ms, source AS text, CAST(NULL AS DOUBLE) AS fraction FROM cues WHERE id % 3 = 0
UNION ALL SELECT track_id, id, 'span', start_ms, end_ms, NULL, NULL FROM cues WHERE id % 3 = 1 AND id % 13 <> 0
UNION ALL SELECT track_id, id, 'progress', NULL, NULL, NULL, round(CASE WHEN id % 2 = 0 THEN least(100.0::DOUBLE, id % 150) / 100 ELSE (id % 100) * 0.85::DOUBLE / 100 END, 9) FROM cues WHERE id % 3 = 2""",
    ),
    "transcript_cues": (
        lambda s, d: rc.cues_from_transcripts(_transcripts(s, d)).drop("metadata"),
        f"WITH {CUES} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS ordinal, start_ms, end_ms, source FROM cues WHERE id % 7 <> 0",
    ),
    "words_from_items": (
        lambda s, d: rc.words_from_items(_items(s, d)).drop("logprob"),
        f"""WITH {WORDS} SELECT track_id, ordinal, speaker, text || CASE WHEN lead(ordinal) OVER (PARTITION BY track_id ORDER BY ordinal) IS NULL THEN '' ELSE ' ' END AS text, start_ms, end_ms FROM words""",
    ),
    "reply_items": (lambda s, d: rc.reply_items(_reply_texts(s, d)).select("track_id", "id", "translated"), f"WITH {CUES}, {REPLIES} SELECT track_id, id, translated FROM replies"),
    "item_trace_events": (
        lambda s, d: rc.item_trace_events(_traces(s, d).withColumnRenamed("event_id", "line_id")),
        """WITH e AS (SELECT event_id AS k, event_type AS t, event_id % 2 = 0 AS started FROM events)
SELECT k AS line_id, 'error' AS kind, 'm' || CAST(k % 7 AS VARCHAR) AS message, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS detail FROM e WHERE t = 'error'
UNION ALL SELECT k, CASE WHEN started THEN 'tool_start' ELSE 'tool_result' END, 'Run ls ' || CAST(k AS VARCHAR) || CASE WHEN started THEN '' ELSE ' · exit ' || CAST(k % 3 AS VARCHAR) END, CAST(k AS VARCHAR), NULL FROM e WHERE t = 'click'
UNION ALL SELECT k, CASE WHEN started THEN 'tool_start' ELSE 'tool_result' END, 'Call ' || CASE WHEN k % 5 > 0 THEN 'srv.' ELSE '' END || 'get', CAST(k AS VARCHAR), NULL FROM e WHERE t = 'view'
UNION ALL SELECT k, 'agent_message', 'hello', CAST(k AS VARCHAR), NULL FROM e WHERE t NOT IN ('error', 'click', 'view') AND NOT started AND k % 3 <> 0""",
    ),
    "message_trace_events": (
        lambda s, d: rc.message_trace_events(_messages(s, d)),
        """SELECT conv_id, turn, 0 AS block, 'agent_message' AS kind, trim(text) AS message, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS detail FROM conversations WHERE role = 'assistant' AND trim(text) <> ''
UNION ALL SELECT conv_id, turn, 1, CASE role WHEN 'user' THEN 'tool_result' ELSE 'tool_start' END, CASE role WHEN 'user' THEN 'Tool result' ELSE 'Call look' END,
  CASE role WHEN 'user' THEN 't1' ELSE 'b' || CAST(turn AS VARCHAR) END, CASE role WHEN 'user' THEN 'found' END FROM conversations WHERE role IN ('user', 'assistant')""",
    ),
    "rms_levels": (
        lambda s, d: rc.rms_levels(_samples(s, d), 500).withColumn("level", F.round("level", 6)),
        f"WITH {LEVELS} SELECT track_id, window_idx // 10 AS window_idx, round(sqrt(avg(level * level)), 6) AS level FROM levels GROUP BY 1, 2",
    ),
    "frame_sizes": (
        lambda s, d: rc.frame_sizes(_probes(s, d)),
        """WITH k AS (SELECT l_orderkey, CAST(l_quantity AS INT) AS w, CAST(l_suppkey % 50 AS INT) AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
    CASE WHEN l_returnflag = 'A' THEN 'audio' ELSE 'video' END, CAST(l_quantity AS INT), l_suppkey % 50, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END, l_partkey) AS n,
    l_returnflag <> 'A' AND CAST(l_quantity AS INT) > 0 AND l_suppkey % 50 > 0 AND l_linestatus <> 'F' AS ok FROM lineitem)
SELECT l_orderkey AS track_id, CAST(coalesce(arg_min(w, n) FILTER (ok), 1920) AS INT) AS width, CAST(coalesce(arg_min(h, n) FILTER (ok), 1080) AS INT) AS height FROM k GROUP BY 1""",
    ),
    "cue_payloads": (
        lambda s, d: rc.cue_payloads(jr.missing_batches(fx.cues(s, d)), fx.cues(s, d)),
        f"""WITH {CUES}, {MISSING} SELECT b.track_id, b.batch_no, '[' || string_agg('{{"id":"' || id || '","source":"' || source || '","translated":null}}', ',' ORDER BY ordinal) || ']' AS payload
FROM batches b JOIN cues c ON b.track_id = c.track_id AND c.ordinal BETWEEN first AND last GROUP BY 1, 2""",
    ),
}
