"""Text records to typed rows.

Every reader takes rows that hold raw text next to their keys, so it works alike on files, tables and streams. What can't be
read gives no row, or a null where a row is due; it never fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock_ms, normalize_language, normalize_speaker
from ..functions.text import let as _let

ENTRY = "text string, start double, `end` double, timestamps struct<`from`:string,`to`:string>, offsets struct<`from`:bigint,`to`:bigint>"
ITEM = "array<struct<type:string,text:string,start:double,`end`:double,speaker_id:string,logprob:double>>"
ACTION = (
    "type string, message string, error string, item struct<type:string,id:string,text:string,command:string,aggregated_output:string,output:string,exit_code:string,"
    "server:string,tool:string,name:string,arguments:string,input:string,result:string,error:string,query:string,changes:string>"
)
# Titles of trace events.
AGENT_ERROR, AGENT_FAILED, THINKING, TOOL_RESULT, APPLY_CHANGES = "Agent error", "Agent operation failed", "Thinking…", "Tool result", "Apply file changes"
RUN, CALL, SEARCH = "Run ", "Call ", "Search web: "
BLOCK = "content array<struct<type:string,id:string,text:string,name:string,input:string,tool_use_id:string,content:string>>"


def ordered_text(position: Column | str, text: Column | str) -> Column:
    """Aggregate: texts joined in the order of their positions."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position), F.col(text)))), lambda x: x[text]), "")


def transcript_entries(docs: DataFrame, *kept: str) -> DataFrame:
    """(track_id, kept columns, position, start_ms, end_ms, source, metadata): the entries of transcripts (track_id, body) that are not blank."""
    lists = F.from_json("body", "transcription array<string>, segments array<string>")
    entries = F.when(F.size("lists.transcription") > 0, F.col("lists.transcription")).otherwise(F.col("lists.segments"))
    each = docs.select("track_id", *kept, lists.alias("lists")).select("track_id", *kept, F.posexplode(entries).alias("position", "metadata"))
    read = each.withColumn("e", F.from_json("metadata", ENTRY))
    time = lambda side, key: F.coalesce(clock_ms(F.col(f"e.timestamps.{side}")), F.rint(F.col(f"e.{key}") * 1000).cast("bigint"), F.col(f"e.offsets.{side}"))
    start = F.coalesce(time("from", "start"), F.lit(0))
    end = F.greatest(start, F.coalesce(time("to", "end"), start))
    return read.select("track_id", *kept, "position", start.alias("start_ms"), end.alias("end_ms"), F.trim("e.text").alias("source"), "metadata").where("source <> ''")


def cues_from_transcripts(docs: DataFrame, offset_ms: int = 0, first_ordinal: int = 0) -> DataFrame:
    """(track_id, ordinal, start_ms, end_ms, source, metadata) of (track_id, body).

    A body lists entries under ``transcription``, else ``segments``. An entry's time is its written time stamp, else its seconds,
    else its offset in milliseconds; without any, it starts at 0 and ends at its start. Blank entries go; metadata is the raw entry.
    """
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("position")) - 1 + first_ordinal
    moved = [(F.col(c) + offset_ms).alias(c) for c in ("start_ms", "end_ms")]
    return transcript_entries(docs).select("track_id", place.cast("bigint").alias("ordinal"), *moved, "source", "metadata")


def transcript_language(body: Column) -> Column:
    """The language a transcript names for its result, else for itself."""
    return normalize_language(F.coalesce(F.get_json_object(body, "$.result.language"), F.get_json_object(body, "$.language")))


def words_from_items(docs: DataFrame, offset_ms: int = 0) -> DataFrame:
    """(track_id, ordinal, speaker, text, start_ms, end_ms, logprob) of (track_id, items).

    Spacing is put behind the word before it, so joined texts give the transcript; leading spacing and sounds that are no speech go.
    """
    each = docs.select("track_id", F.posexplode(F.from_json("items", ITEM)).alias("position", "i")).select("track_id", "position", "i.*")
    each = each.withColumn("type", F.coalesce("type", F.lit("word"))).withColumn("text", F.coalesce("text", F.lit(""))).where("type <> 'audio_event'")
    spoken = F.col("type") != "spacing"
    number = F.sum(spoken.cast("bigint")).over(Window.partitionBy("track_id").orderBy("position")) - 1
    head = F.min_by(F.struct("start", "end", "speaker_id", "logprob"), "position").alias("head")
    words = each.withColumn("ordinal", number).where("ordinal >= 0").groupBy("track_id", "ordinal").agg(head, ordered_text("position", "text").alias("text"))
    start = F.rint(F.coalesce("head.start", F.lit(0.0)) * 1000).cast("bigint")
    end = F.greatest(start, F.coalesce(F.rint(F.col("head.end") * 1000).cast("bigint"), start))
    return words.select(
        "track_id", "ordinal", normalize_speaker(F.col("head.speaker_id")).alias("speaker"), "text",
        (start + offset_ms).alias("start_ms"), (end + offset_ms).alias("end_ms"), F.col("head.logprob").alias("logprob"),
    )


def log_cues(lines: DataFrame) -> DataFrame:
    """(track_id, line_no, start_ms, end_ms, text) of lines ``[hh:mm:ss.mmm --> hh:mm:ss.mmm] text``; ends are not before starts."""
    stamp = r"(\d+:\d{2}:\d{2}[.,]\d{3})"
    pattern = rf"^\s*\[{stamp}\s*-->\s*{stamp}\]\s*(.*)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    start = clock_ms(part(1))
    found = lines.where(F.col("line").rlike(pattern))
    return found.select("track_id", "line_no", start.alias("start_ms"), F.greatest(start, clock_ms(part(2))).alias("end_ms"), F.trim(part(3)).alias("text"))


def log_spans(lines: DataFrame, offset_ms: int = 0) -> DataFrame:
    """(track_id, line_no, start_ms, end_ms) of lines ``VAD segment n: start = a, end = b`` in seconds; inverted spans go."""
    pattern = r"VAD segment \d+: start = (-?\d+(?:\.\d+)?), end = (-?\d+(?:\.\d+)?)"
    ms = lambda i: F.rint(F.nullif(F.regexp_extract("line", pattern, i), F.lit("")).cast("double") * 1000).cast("bigint") + offset_ms
    return lines.select("track_id", "line_no", ms(1).alias("start_ms"), ms(2).alias("end_ms")).where("end_ms >= start_ms")


def log_progress(lines: DataFrame) -> DataFrame:
    """(track_id, line_no, fraction) of ``progress = n%`` (at most 1) and of ``[download] n%`` (0.85 of it)."""
    number = lambda pattern: F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).cast("double")
    told = number(r"progress\s*=\s*(\d+)%")
    share = F.coalesce(F.when(told.isNotNull(), F.least(F.lit(100.0), told)) / 100, number(r"\[download\]\s+(\d+(?:\.\d+)?)%") * 0.85 / 100)
    return lines.select("track_id", "line_no", share.alias("fraction")).where("fraction IS NOT NULL")


def rms_levels(samples: DataFrame, rate: int, seconds: float = 0.02) -> DataFrame:
    """(track_id, window_idx, level): root mean squares of windows of samples (track_id, i, value); the last may be short."""
    width = max(1, int(rate * seconds))
    return samples.groupBy("track_id", F.floor(F.col("i") / width).alias("window_idx")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("level"))


def frame_sizes(probes: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """(track_id, width, height) of the first stream of (track_id, body) that is a picture and no cover; else the given size."""
    streams = F.from_json("body", "streams array<struct<codec_type:string,width:int,height:int,disposition:struct<attached_pic:int>>>")["streams"]
    video = lambda s: (F.coalesce(s.codec_type, F.lit("video")) == "video") & (s.width > 0) & (s.height > 0) & (F.coalesce(s.disposition.attached_pic, F.lit(0)) == 0)
    first = F.try_element_at(F.filter(streams, video), F.lit(1))
    return probes.select("track_id", first.alias("s")).select("track_id", F.coalesce("s.width", F.lit(width)).alias("width"), F.coalesce("s.height", F.lit(height)).alias("height"))


def _kind(json: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def json_object(text: Column) -> Column:
    """The JSON object of a reply: the whole text, else its fenced block, else from the first to the last brace; null if there is none.

    An object whose ``result`` is a string stands for that string, two levels deep.
    """

    fence = lambda t: F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = lambda t: F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    # text that was read, and its value, which is asked for its kind without being read again
    valued = lambda t, v: F.struct(t.alias("t"), v.alias("v"))
    is_object = lambda t: F.btrim(t, F.lit(" \t\r\n")).startswith("{")

    def read(text: Column) -> Column:
        part = lambda t: _let(F.coalesce(F.nullif(fence(t), F.lit("")), braces(t)), lambda p: _let(F.try_parse_json(p), lambda v: F.when(v.isNotNull() & is_object(p), valued(p, v))))
        return _let(F.trim(text), lambda t: _let(F.try_parse_json(t), lambda v: F.when(v.isNull(), part(t)).when(is_object(t), valued(t, v))))

    def unwrap(found: Column) -> Column:
        kind = lambda f: F.schema_of_variant(F.try_variant_get(f["v"], "$.result", "variant"))
        return _let(found, lambda f: F.when(kind(f) == "STRING", read(F.get_json_object(f["t"], "$.result"))).otherwise(f))

    return unwrap(unwrap(read(text)))["t"]


def structured_message(text: Column) -> Column:
    """Whether a message is data rather than talk: an object with a list of cues."""
    return F.coalesce(_kind(json_object(text), "$.cues").startswith("ARRAY"), F.lit(False))


def reply_items(texts: DataFrame) -> DataFrame:
    """(track_id, batch_no, id, source, translated) of replies (track_id, batch_no, text); the last item of an id counts."""
    cues = F.from_json(json_object(F.col("text")), "cues array<struct<id:string,source:string,translated:string>>")["cues"]
    each = texts.select("track_id", "batch_no", F.posexplode(cues).alias("position", "c")).where("c.id IS NOT NULL")
    last = F.max_by(F.struct("c.source", "c.translated"), "position")
    return each.groupBy("track_id", "batch_no", F.col("c.id").alias("id")).agg(last.alias("c")).select("track_id", "batch_no", "id", "c.source", "c.translated")


def _filled(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def item_trace_events(lines: DataFrame) -> DataFrame:
    """The columns but ``line``, and (kind, message, event_id, detail), of trace lines that report an item's start or completion, or an error."""
    d = lines.withColumn("d", F.from_json("line", ACTION))
    kind, item, phase = F.col("d.type"), F.col("d.item.type"), F.element_at(F.split("d.type", r"\."), -1)
    started, done = phase == "started", phase == "completed"
    failed = kind.isin("turn.failed", "item.failed")
    said = F.trim("d.item.text")
    command = F.concat(F.lit(RUN), _filled(F.col("d.item.command"), F.lit("command")))
    title = F.concat(F.lit(CALL), F.concat_ws(".", _filled(F.trim("d.item.server")), _filled(F.col("d.item.tool"), F.col("d.item.name"), F.lit("tool"))))
    row = lambda kind, message, detail=None: F.struct(kind.alias("kind"), message.alias("message"), F.col("d.item.id").alias("event_id"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    step = F.when(started, "tool_start").otherwise("tool_result")
    f = lambda *names: _filled(*[F.col(f"d.item.{n}") for n in names])
    act = started | done
    event = (
        F.when(kind == "error", row(F.lit("error"), F.coalesce("d.message", F.lit(AGENT_ERROR))))
        .when(failed, row(F.lit("error"), _filled(F.col("d.error"), F.col("d.message"), F.lit(AGENT_FAILED))))
        .when((item == "agent_message") & done & (said != "") & ~structured_message(said), row(F.lit("agent_message"), said))
        .when((item == "reasoning") & started, row(F.lit("thinking"), F.lit(THINKING)))
        .when((item == "command_execution") & started, row(step, command))
        .when((item == "command_execution") & done, row(step, F.concat_ws(" · exit ", command, "d.item.exit_code"), f("aggregated_output", "output")))
        .when(item.isin("mcp_tool_call", "tool_call") & act, row(step, title, F.when(started, f("arguments", "input")).otherwise(f("result", "output", "error"))))
        .when((item == "web_search") & act, row(step, F.concat(F.lit(SEARCH), F.coalesce(f("query"), F.lit("web search")))))
        .when((item == "file_change") & act, row(step, F.lit(APPLY_CHANGES), f("changes")))
    )
    return d.select(*[c for c in lines.columns if c != "line"], event.alias("e")).where("e IS NOT NULL").select(*[c for c in lines.columns if c != "line"], "e.*")


def message_trace_events(lines: DataFrame) -> DataFrame:
    """As ``item_trace_events``, for trace lines that hold messages made of blocks; ``block`` is a block's place in its line."""
    keys = [c for c in lines.columns if c != "line"]
    d = lines.select(*keys, F.from_json("line", "type string, error string, message string").alias("d"))
    error = d.where("d.type IN ('error', 'system') AND d.error <> ''").select(*keys, F.lit(0).alias("block"), F.lit("error").alias("kind"), F.col("d.error").alias("message"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("detail"))
    blocks = d.where("d.type IN ('assistant', 'user')")
    each = blocks.select(*keys, F.col("d.type").alias("by"), F.posexplode(F.from_json("d.message", BLOCK)["content"]).alias("block", "b"))
    said = F.trim("b.text")
    row = lambda kind, message, event_id, detail: F.struct(F.lit(kind).alias("kind"), message.alias("message"), event_id.alias("event_id"), detail.alias("detail"))
    by, kind = F.col("by"), F.col("b.type")
    event = (
        F.when((by == "assistant") & (kind == "text") & (said != "") & ~structured_message(said), row("agent_message", said, F.col("b.id"), F.lit(None).cast("string")))
        .when((by == "assistant") & kind.isin("tool_use", "server_tool_use"), row("tool_start", F.concat(F.lit(CALL), _filled(F.col("b.name"), F.lit("tool"))), F.col("b.id"), _filled(F.col("b.input"))))
        .when((by == "user") & (kind == "tool_result"), row("tool_result", F.lit(TOOL_RESULT), _filled(F.col("b.tool_use_id"), F.col("b.id")), _filled(F.col("b.content"))))
    )
    return error.unionByName(each.select(*keys, "block", event.alias("e")).where("e IS NOT NULL").select(*keys, "block", "e.*"))


def cue_payloads(batches: DataFrame, cues: DataFrame) -> DataFrame:
    """(track_id, batch_no, payload): each batch's cues as a JSON list; null fields are kept."""
    inside = batches.select("track_id", "batch_no", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge").join(cues.select("track_id", "ordinal", "id", "source", "translated"), ["track_id", "ordinal"])
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "id", "source", "translated")))
    listed = F.transform(rows, lambda c: F.struct(c.id.cast("string").alias("id"), c.source.alias("source"), c.translated.alias("translated")))
    return inside.groupBy("track_id", "batch_no").agg(F.to_json(listed, {"ignoreNullFields": "false"}).alias("payload"))


def word_payloads(batches: DataFrame, words: DataFrame) -> DataFrame:
    """(track_id, batch_no, payload): each batch's words as a JSON list of i, t (seconds), s (left out if null) and w."""
    return word_lists(batches.select("track_id", "batch_no", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge").join(words.select("track_id", "ordinal", "start_ms", "speaker", "text"), ["track_id", "ordinal"]))


def word_lists(inside: DataFrame) -> DataFrame:
    """``word_payloads`` of the words (track_id, batch_no, ordinal, start_ms, speaker, text) of batches."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "start_ms", "speaker", "text")))
    listed = F.transform(rows, lambda w: F.struct(w.ordinal.alias("i"), (w.start_ms / 1000).alias("t"), w.speaker.alias("s"), w.text.alias("w")))
    return inside.groupBy("track_id", "batch_no").agg(F.to_json(listed).alias("payload"))
