"""Queries over the derived timelines, each with the same answer in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..operators import intervals as iv
from ..operators import journal as jr
from ..operators import words as wd
from . import compositions, records, requests, timelines
from .sql import ALIGNED, CROSS, MERGED, MERGED40, MISSING, SILENCES, word_batches

CUES, SPANS, WORDS, LEVELS, TRACE, REPLIES = fx.CUES_SQL, fx.SPANS_SQL, fx.WORDS_SQL, fx.LEVELS_SQL, fx.TRACE_SQL, fx.REPLIES_SQL
STAMP = "CAST(cs // 360000 AS VARCHAR) || ':' || lpad(CAST(cs // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0')"


def _stamp(ms: str) -> str:
    return STAMP.replace("cs", f"CAST(round_even({ms} / 10.0, 0) AS BIGINT)")


def _ranges(spark, d):
    """Every third stretch of 7 words of a track, as ranges that are covered."""
    w = fx.words(spark, d).withColumn("part", F.floor(F.col("ordinal") / 7))
    return w.where("part % 3 = 0").groupBy("track_id", "part").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).select("track_id", F.concat_ws("-", "first", "last").alias("id"), "first", "last")


RANGES = """ranges AS (SELECT track_id, CAST(min(ordinal) AS VARCHAR) || '-' || CAST(max(ordinal) AS VARCHAR) AS id, min(ordinal) AS first, max(ordinal) AS last
  FROM words WHERE ordinal // 7 % 3 = 0 GROUP BY track_id, ordinal // 7)"""


def _previews(spark, d):
    w = fx.words(spark, d).withColumn("part", F.floor(F.col("ordinal") / 5))
    return w.groupBy("track_id", "part").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).select("track_id", F.concat(F.lit("preview-"), "part").alias("id"), "first", "last")


def _changes(spark, d):
    c = fx.cues(spark, d)
    return c.where("id % 7 = 0").withColumn("id", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") + 10_000_000)).withColumn("end_ms", F.col("end_ms") + 1).withColumn("translated", F.when(F.col("id") % 4 == 0, F.lit("new")))


def _few_voices(spark, d):
    """Long cues of which only every fiftieth has a speaker, so that few of them are crosstalk."""
    return fx.cues(spark, d).withColumns({"end_ms": F.col("end_ms") + 20_000, "speaker": F.when(F.col("id") % 50 == 0, F.col("speaker"))})


def _final(spark, d):
    """A second transcript of the tracks: some cues are gone, the others end later and have another source."""
    return fx.cues(spark, d).where("id % 5 <> 0").withColumns({"end_ms": F.col("end_ms") + 7, "source": F.lit("new"), "translated": F.lit(None).cast("string")})


def _styled(spark, d):
    return fx.cues(spark, d).select("track_id", "id", "ordinal", "speaker", F.when(F.col("id") % 5 == 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).otherwise("Default").alias("style"))


def _other(spark, d):
    """The tracks once more: some without a few cues, some with moved ones."""
    c = fx.cues(spark, d).where("track_id % 4 <> 0 OR id % 31 <> 0")
    return c.withColumn("start_ms", F.when((F.col("track_id") % 4 == 1) & (F.col("id") % 97 == 0), F.col("start_ms") + 1).otherwise(F.col("start_ms")))


COLUMNS = ["track_id", "id", "ordinal", "start_ms", "end_ms"]

#: name: (query, SQL)
QUERIES = {
    "crosstalk_ids": (lambda s, d: iv.crosstalk_ids(fx.cues(s, d)), f"WITH {CUES}, {CROSS} SELECT * FROM cross_ids"),
    "extend_cue_ends": (
        lambda s, d: iv.extend_cue_ends(fx.cues(s, d)).select(*COLUMNS),
        f"""WITH {CUES}, {CROSS}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, ordinal) AS nx FROM cues)
SELECT track_id, id, ordinal, start_ms, CASE WHEN (track_id, id) IN (SELECT (track_id, id) FROM cross_ids) THEN end_ms ELSE greatest(start_ms,
  CASE WHEN nx IS NULL THEN end_ms + 500 WHEN nx - end_ms <= 700 THEN nx WHEN nx - end_ms < 1000 THEN (end_ms + nx) // 2 ELSE end_ms + 500 END) END AS end_ms FROM n""",
    ),
    "merge_intervals": (lambda s, d: iv.merge_intervals(fx.spans(s, d)), f"WITH {CUES}, {SPANS}, {MERGED} SELECT * FROM merged"),
    "normalize_renumber": (
        lambda s, d: iv.normalize_timeline(fx.cues(s, d), 800_000).select("track_id", "id", "parent_id", "start_ms", "end_ms"),
        f"""WITH {CUES}, {CROSS}, n AS (SELECT c.*, x.id IS NULL AS free, row_number() OVER (PARTITION BY c.track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS place
  FROM cues c LEFT JOIN cross_ids x ON c.track_id = x.track_id AND c.id = x.id)
SELECT track_id, place AS id, id AS parent_id, CASE WHEN free THEN least(greatest(start_ms, 0), 800000) ELSE start_ms END AS start_ms,
  CASE WHEN free THEN greatest(least(greatest(start_ms, 0), 800000), least(greatest(start_ms, end_ms), 800000)) ELSE end_ms END AS end_ms FROM n""",
    ),
    "event_defects": (
        lambda s, d: iv.event_defects(fx.cues(s, d).withColumn("start_ms", F.when(F.col("id") % 19 == 0, F.col("start_ms") + 5000).otherwise(F.col("start_ms")))),
        f"""WITH {CUES}, e AS (SELECT track_id, id, ordinal, coalesce(speaker, '') AS name, CASE WHEN id % 19 = 0 THEN start_ms + 5000 ELSE start_ms END AS s, end_ms AS e FROM cues),
m AS (SELECT *, max(s) OVER o AS latest, max(e) OVER o AS any_end, max(CASE WHEN name = '' THEN e END) OVER o AS blank_end,
  max(e) OVER (PARTITION BY track_id, name ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_end
  FROM e WINDOW o AS (PARTITION BY track_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT track_id, id, 'end_before_start' AS kind FROM m WHERE e < s UNION ALL SELECT track_id, id, 'out_of_order' FROM m WHERE s < latest
UNION ALL SELECT track_id, id, 'overlap' FROM m WHERE s < CASE WHEN name = '' THEN any_end ELSE greatest(own_end, blank_end) END""",
    ),
    "long_silence_start": (
        lambda s, d: iv.long_silence_starts(_few_voices(s, d), iv.merge_intervals(fx.spans(s, d), 40)).select("track_id", "id", "start_ms"),
        f"""WITH {CUES.replace("cues AS", "base AS", 1)}, cues AS (SELECT track_id, id, ordinal, start_ms, end_ms + 20000 AS end_ms, CASE WHEN id % 50 = 0 THEN speaker END AS speaker, source FROM base),
{CROSS}, spans AS (SELECT track_id, start_ms, end_ms FROM base WHERE source IN ('click', 'view')), {MERGED40},
gaps AS (SELECT * FROM (SELECT track_id, lag(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms) AS a, start_ms AS b FROM merged) WHERE a IS NULL OR b - a > 6000),
hit AS (SELECT c.track_id, c.id, max(b) AS b FROM cues c JOIN gaps g ON c.track_id = g.track_id AND b > start_ms AND b < end_ms AND b - greatest(start_ms, coalesce(a, start_ms)) > 6000
  WHERE (c.track_id, c.id) NOT IN (SELECT (track_id, id) FROM cross_ids) GROUP BY 1, 2)
SELECT c.track_id, c.id, coalesce(greatest(start_ms, b - 3000), start_ms) AS start_ms FROM cues c LEFT JOIN hit h ON c.track_id = h.track_id AND c.id = h.id""",
    ),
    "vad_start_candidates": (
        lambda s, d: iv.start_candidates(fx.cues(s, d), fx.spans(s, d)),
        f"""WITH {CUES}, {SPANS}, p AS (SELECT *, lag(end_ms) OVER (PARTITION BY track_id ORDER BY ordinal) AS prev FROM cues)
SELECT p.track_id, p.id, min(v.start_ms) AS candidate_ms FROM p JOIN spans v ON p.track_id = v.track_id AND v.end_ms >= p.start_ms - 40
  AND v.start_ms <= least(p.end_ms, p.start_ms + 2000) AND (prev IS NULL OR v.start_ms >= prev + 40) GROUP BY 1, 2""",
    ),
    "remaining_speech": (
        lambda s, d: iv.remaining_speech(fx.cues(s, d), fx.spans(s, d)),
        f"""WITH {CUES}, {SPANS} SELECT DISTINCT c.track_id, c.id FROM cues c JOIN spans v ON c.track_id = v.track_id
  AND v.start_ms <= c.start_ms + 40 AND v.end_ms >= c.start_ms - 40 AND v.end_ms - c.start_ms > 800""",
    ),
    "refined_end": (
        lambda s, d: iv.refined_ends(fx.cues(s, d), fx.spans(s, d)),
        f"""WITH {CUES}, {SPANS}, n AS (SELECT *, lead(start_ms) OVER (PARTITION BY track_id ORDER BY ordinal) AS nx FROM cues)
SELECT track_id, id, r AS refined_ms FROM (SELECT n.track_id, n.id, v.end_ms AS r, row_number() OVER (PARTITION BY n.track_id, n.id ORDER BY abs(v.end_ms - n.end_ms), v.end_ms DESC) AS k
  FROM n JOIN spans v ON n.track_id = v.track_id AND abs(v.end_ms - n.end_ms) <= 1000 AND v.start_ms <= n.end_ms + 40 AND v.end_ms >= n.start_ms AND (nx IS NULL OR v.end_ms <= nx)) WHERE k = 1""",
    ),
    "align_vad": (lambda s, d: iv.align_to_speech(fx.cues(s, d), iv.merge_intervals(fx.spans(s, d), 40)).select(*COLUMNS, "confidence"), f"WITH {CUES}, {SPANS}, {ALIGNED} SELECT track_id, id, ordinal, start_ms, end_ms, confidence FROM aligned"),
    "format_timestamp": (
        lambda s, d: fx.cues(s, d).select("track_id", "id", tx.format_timestamp(F.col("start_ms")).alias("stamp"), tx.parse_timestamp_ms(tx.format_timestamp(F.col("start_ms"))).alias("back_ms")),
        f"WITH {CUES} SELECT track_id, id, {_stamp('start_ms')} AS stamp, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) * 10 AS back_ms FROM cues",
    ),
    "text_weight": (
        lambda s, d: fx.read(s, d, "documents").select("doc_id", tx.text_weight(F.col("text")).cast("bigint").alias("weight"), tx.ends_sentence(F.col("text")).alias("closed")),
        "SELECT doc_id, CAST(length(text) AS BIGINT) AS weight, regexp_matches(text, '[.?!。？！…][\"''”’»›』」）)\\]]*\\s*$') AS closed FROM documents",
    ),
    "cue_text_lines": (
        lambda s, d: fx.cues(s, d).select("track_id", "id", *[F.array_join(tx.cue_lines(F.col("source"), F.col("translated"), m), "|").alias(m) for m in ("source", "translated", "bilingual")]),
        f"WITH {CUES} SELECT track_id, id, source, coalesce(translated, source) AS translated, CASE WHEN translated IS NULL THEN source ELSE translated || '|' || source END AS bilingual FROM cues",
    ),
    "speech_rates": (
        lambda s, d: wd.speech_rates(fx.words(s, d)).withColumn("rate", F.round("rate", 6)),
        f"""WITH {WORDS}, p AS (SELECT *, CASE WHEN end_ms - start_ms >= 50 THEN (end_ms - start_ms) / greatest(1, length(trim(text)))::DOUBLE END AS pace FROM words),
a AS (SELECT track_id, speaker, median(pace) AS own, count(pace) AS n FROM p GROUP BY 1, 2), b AS (SELECT track_id, median(pace) AS whole, count(pace) AS m FROM p GROUP BY 1)
SELECT a.track_id, speaker, round(CASE WHEN n >= 3 THEN own WHEN m >= 3 THEN whole ELSE 60.0 END, 6) AS rate FROM a JOIN b ON a.track_id = b.track_id""",
    ),
    "qualified_silences": (lambda s, d: wd.qualified_silences(fx.words(s, d)), f"WITH {WORDS}, {SILENCES} SELECT * FROM silences"),
    "dispatchable_prefix": (
        lambda s, d: wd.dispatchable_prefix(fx.words(s, d)),
        f"WITH {WORDS}, {SILENCES} SELECT w.track_id, coalesce(max(s.ordinal) + 1, 0) AS n_words FROM (SELECT DISTINCT track_id FROM words) w LEFT JOIN silences s ON w.track_id = s.track_id GROUP BY 1",
    ),
    "split_word_batches": (lambda s, d: wd.split_word_batches(fx.words(s, d), 50), f"WITH RECURSIVE {WORDS}, {word_batches(50)} SELECT * FROM walk"),
    "segment_words": (
        lambda s, d: wd.segment_words(fx.words(s, d).withColumn("text", F.concat("text", F.lit(" ")))),
        f"""WITH RECURSIVE {WORDS}, s AS (SELECT track_id, speaker, ordinal, start_ms, end_ms, text || ' ' AS text,
  coalesce(lag(regexp_matches(text, '[.?!。？！…]["''”’»›』」）)\\]]*\\s*$')) OVER o OR start_ms - lag(end_ms) OVER o >= 800, false) AS hard FROM words WINDOW o AS (PARTITION BY track_id, speaker ORDER BY ordinal)),
t AS (SELECT *, sum(CAST(hard AS INT)) OVER (PARTITION BY track_id, speaker ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS stretch FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY track_id, speaker, stretch ORDER BY ordinal) AS p FROM t),
fold AS (SELECT track_id, speaker, stretch, p, ordinal, start_ms, end_ms, 0 AS cue, start_ms AS since, text AS so_far FROM w WHERE p = 1
  UNION ALL SELECT track_id, speaker, stretch, p, ordinal, start_ms, end_ms, CASE WHEN ends THEN cue + 1 ELSE cue END, CASE WHEN ends THEN start_ms ELSE since END, CASE WHEN ends THEN text ELSE so_far || text END
  FROM (SELECT *, (span > 8000 AND 2 * wide >= 84) OR (wide > 84 AND 2 * span >= 8000) AS ends FROM (
    SELECT w.*, f.cue, f.since, f.so_far, w.end_ms - f.since AS span, length(trim(f.so_far || w.text)) AS wide FROM fold f JOIN w ON w.track_id = f.track_id AND w.speaker IS NOT DISTINCT FROM f.speaker AND w.stretch = f.stretch AND w.p = f.p + 1))),
c AS (SELECT track_id, speaker, min(ordinal) AS first, max(ordinal) AS last, arg_min(start_ms, ordinal) AS start_ms, greatest(arg_min(start_ms, ordinal), max(end_ms)) AS end_ms, trim(arg_max(so_far, ordinal)) AS text FROM fold GROUP BY track_id, speaker, stretch, cue)
SELECT track_id, 'preview-' || CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), first) AS VARCHAR) AS id, speaker, first, last, start_ms, end_ms, text FROM c WHERE text <> ''""",
    ),
    "uncovered_runs": (
        lambda s, d: wd.uncovered_runs(fx.words(s, d), _ranges(s, d)),
        f"""WITH {WORDS}, {RANGES} SELECT track_id, min(ordinal) AS first, max(ordinal) AS last FROM (SELECT track_id, ordinal, ordinal - row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS run
  FROM words w WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.track_id = w.track_id AND w.ordinal BETWEEN r.first AND r.last)) GROUP BY track_id, run""",
    ),
    "preview_overlay": (
        lambda s, d: wd.preview_overlay(_ranges(s, d), _previews(s, d)),
        f"""WITH {WORDS}, {RANGES}, previews AS (SELECT track_id, 'preview-' || CAST(ordinal // 5 AS VARCHAR) AS id, min(ordinal) AS first, max(ordinal) AS last FROM words GROUP BY track_id, ordinal // 5)
SELECT * FROM ranges UNION ALL SELECT * FROM previews p WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.track_id = p.track_id AND r.first <= p.last AND p.first <= r.last)""",
    ),
    "voiced_spans": (
        lambda s, d: jr.voiced_spans(fx.levels(s, d)),
        f"""WITH {LEVELS}, k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY level, window_idx) AS rnk, count(*) OVER (PARTITION BY track_id) AS n FROM levels),
lim AS (SELECT track_id, max(CASE WHEN rnk = least(n - 1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT)) + 1 THEN level END) AS flr, max(level) AS peak FROM k GROUP BY 1),
loud AS (SELECT l.track_id, window_idx, window_idx - row_number() OVER (PARTITION BY l.track_id ORDER BY window_idx) AS run FROM levels l JOIN lim ON l.track_id = lim.track_id WHERE peak > 0 AND level >= greatest(flr * 3, peak * 0.035::DOUBLE, 8)),
spans AS (SELECT track_id, min(window_idx) * 20 AS start_ms, max(window_idx) * 20 + 20 AS end_ms FROM loud GROUP BY track_id, run HAVING count(*) >= 3), {MERGED40} SELECT * FROM merged""",
    ),
    "upsert_cues": (
        lambda s, d: jr.upsert_cues(fx.cues(s, d), _changes(s, d)).select(*COLUMNS, "translated"),
        f"""WITH {CUES}, ch AS (SELECT track_id, CASE WHEN id % 2 = 0 THEN id ELSE id + 10000000 END AS id, ordinal, start_ms, end_ms + 1 AS end_ms, CASE WHEN (CASE WHEN id % 2 = 0 THEN id ELSE id + 10000000 END) % 4 = 0 THEN 'new' END AS translated FROM cues WHERE id % 7 = 0),
top AS (SELECT track_id, max(ordinal) + 1 AS nx FROM cues GROUP BY 1)
SELECT coalesce(c.track_id, n.track_id) AS track_id, coalesce(c.id, n.id) AS id, coalesce(c.ordinal, nx + n.ordinal) AS ordinal, coalesce(n.start_ms, c.start_ms) AS start_ms, coalesce(n.end_ms, c.end_ms) AS end_ms, coalesce(n.translated, c.translated) AS translated
FROM cues c FULL JOIN ch n ON c.track_id = n.track_id AND c.id = n.id LEFT JOIN top ON top.track_id = coalesce(c.track_id, n.track_id)""",
    ),
    "replace_transcript": (
        lambda s, d: jr.replace_transcript(fx.cues(s, d), _final(s, d)),
        f"""WITH {CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS place FROM cues WHERE id % 5 <> 0)
SELECT c.track_id, c.id, coalesce(place, c.ordinal + 1000000) AS ordinal, c.start_ms, CASE WHEN n.id IS NULL THEN c.end_ms ELSE c.end_ms + 7 END AS end_ms, c.speaker,
  CASE WHEN n.id IS NOT NULL AND c.translated IS NULL THEN 'new' ELSE c.source END AS source, c.translated, n.id IS NOT NULL AS stable FROM cues c LEFT JOIN n ON c.track_id = n.track_id AND c.id = n.id""",
    ),
    "overwrite_words": (
        lambda s, d: jr.overwrite_words(fx.words(s, d), fx.words(s, d).where("ordinal % 6 = 0").withColumn("text", F.concat("text", F.lit("!")))).select("track_id", "ordinal", "text"),
        f"WITH {WORDS} SELECT track_id, ordinal, CASE WHEN ordinal % 6 = 0 THEN text || '!' ELSE text END AS text FROM words",
    ),
    "fill_actor_styles": (
        lambda s, d: jr.fill_actor_styles(_styled(s, d)).select("track_id", "id", "style"),
        f"""WITH {CUES}, e AS (SELECT *, CASE WHEN id % 5 = 0 THEN 's' || CAST(id % 3 AS VARCHAR) ELSE 'Default' END AS style FROM cues),
own AS (SELECT track_id, speaker, arg_min(style, ordinal) AS own_style FROM e WHERE style <> 'Default' AND speaker <> '' GROUP BY 1, 2)
SELECT e.track_id, e.id, CASE WHEN style = 'Default' THEN coalesce(own_style, style) ELSE style END AS style FROM e LEFT JOIN own ON e.track_id = own.track_id AND e.speaker = own.speaker""",
    ),
    "document_drift": (
        lambda s, d: jr.document_drift(fx.cues(s, d), _other(s, d)),
        f"""WITH {CUES}, a AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS position, start_ms, end_ms, coalesce(speaker, '') AS name FROM cues),
b AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) - 1 AS position, CASE WHEN track_id % 4 = 1 AND id % 97 = 0 THEN start_ms + 1 ELSE start_ms END AS start_ms, end_ms, coalesce(speaker, '') AS name
  FROM cues WHERE track_id % 4 <> 0 OR id % 31 <> 0),
f AS (SELECT coalesce(a.track_id, b.track_id) AS track_id, count(a.position) AS n, count(b.position) AS m,
  min(CASE WHEN a.position IS NULL OR b.position IS NULL OR (a.start_ms, a.end_ms, a.name) <> (b.start_ms, b.end_ms, b.name) THEN coalesce(a.position, b.position) END) AS first
  FROM a FULL JOIN b ON a.track_id = b.track_id AND a.position = b.position GROUP BY 1)
SELECT track_id, CASE WHEN n = m THEN 'event' ELSE 'count' END AS kind, CASE WHEN n = m THEN first END AS position FROM f WHERE first IS NOT NULL""",
    ),
    "latest_state": (
        lambda s, d: jr.latest_by_key(fx.trace(s, d).select("operation_id", "created_us", "event_id", "state"), ["operation_id"], ["created_us", "event_id"]),
        f"WITH {TRACE} SELECT operation_id, created_us, event_id, state FROM trace QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY created_us DESC, event_id DESC) = 1",
    ),
    "missing_batches": (lambda s, d: jr.missing_batches(fx.cues(s, d)), f"WITH {CUES}, {MISSING} SELECT * FROM batches"),
    "batch_context": (
        lambda s, d: jr.batch_context(jr.missing_batches(fx.cues(s, d)), fx.cues(s, d)).select("track_id", "batch_no", F.array_join("preceding", ",").alias("preceding"), F.array_join("following", ",").alias("following")),
        f"""WITH {CUES}, {MISSING} SELECT b.track_id, b.batch_no, coalesce(string_agg(CASE WHEN ordinal < first THEN CAST(id AS VARCHAR) END, ',' ORDER BY ordinal), '') AS preceding,
  coalesce(string_agg(CASE WHEN ordinal > last THEN CAST(id AS VARCHAR) END, ',' ORDER BY ordinal), '') AS following
FROM batches b LEFT JOIN cues c ON b.track_id = c.track_id AND (c.ordinal BETWEEN first - 10 AND first - 1 OR c.ordinal BETWEEN last + 1 AND last + 5) GROUP BY 1, 2""",
    ),
    "response_problems": (
        lambda s, d: jr.reply_problems(fx.cues(s, d), fx.replies(s, d)),
        f"""WITH {CUES}, {REPLIES}, asked AS (SELECT track_id, CAST(id AS VARCHAR) AS id FROM cues)
SELECT r.track_id, r.id, 'unknown' AS kind FROM replies r ANTI JOIN asked a ON r.track_id = a.track_id AND r.id = a.id
UNION ALL SELECT a.track_id, a.id, 'missing' FROM asked a ANTI JOIN replies r ON r.track_id = a.track_id AND r.id = a.id
UNION ALL SELECT r.track_id, r.id, 'blank' FROM replies r SEMI JOIN asked a ON r.track_id = a.track_id AND r.id = a.id WHERE trim(translated) = ''""",
    ),
    "apply_batch": (
        lambda s, d: jr.apply_replies(fx.cues(s, d), fx.replies(s, d).withColumn("source", F.when(F.col("id").rlike("[05]$"), F.concat(F.lit(" fixed "), "id")).otherwise(" "))).select("track_id", "id", "source", "translated"),
        f"""WITH {CUES}, {REPLIES} SELECT c.track_id, c.id, CASE WHEN r.id IS NOT NULL AND c.id % 5 = 0 THEN 'fixed ' || c.id ELSE c.source END AS source, coalesce(nullif(trim(r.translated), ''), c.translated) AS translated
FROM cues c LEFT JOIN replies r ON c.track_id = r.track_id AND CAST(c.id AS VARCHAR) = r.id""",
    ),
    "task_state": (
        lambda s, d: jr.task_state(fx.trace(s, d)),
        f"""WITH {TRACE}, l AS (SELECT operation_id, arg_max(state, (created_us, event_id)) AS state, arg_max(model, (created_us, event_id)) FILTER (model IS NOT NULL) AS model,
  arg_max(attempt, (created_us, event_id)) FILTER (attempt IS NOT NULL) AS attempt, min(created_us) AS started_us, max(created_us) AS seen, count(*) AS n_events FROM trace GROUP BY 1)
SELECT operation_id, state, model, attempt, started_us, CASE WHEN state IN ('completed', 'failed') THEN seen END AS finished_us, n_events FROM l""",
    ),
    "render_documents": (
        lambda s, d: jr.render_documents(fx.cues(s, d)),
        f"""WITH {CUES} SELECT track_id, string_agg('Dialogue: 0,' || {_stamp('start_ms')} || ',' || {_stamp('end_ms')} || ',Default,' || coalesce(speaker, '') || ',0,0,0,,' ||
  CASE WHEN translated IS NULL THEN source ELSE translated || '\\N' || source END, chr(10) ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS document FROM cues GROUP BY 1""",
    ),
    "parse_documents": (
        lambda s, d: jr.parse_documents(jr.render_documents(fx.cues(s, d)).withColumn("document", F.concat(F.lit("[Events]\n"), "document"))).withColumn("lines", F.array_join("lines", "|")),
        f"""WITH {CUES} SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS line_no, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) * 10 AS start_ms,
  CAST(round_even(end_ms / 10.0, 0) AS BIGINT) * 10 AS end_ms, coalesce(speaker, '') AS name, CASE WHEN translated IS NULL THEN source ELSE translated || '|' || source END AS lines, CAST(NULL AS VARCHAR) AS problem FROM cues""",
    ),
    "progress_plan": (
        lambda s, d: jr.progress_plan(fx.read(s, d, "lineitem").select(F.col("l_suppkey").alias("plan"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("stage"), F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0")).alias("position"), (F.col("l_quantity").cast("double") - 5).alias("weight"))).withColumns({"start": F.round("start", 9), "span": F.round("span", 9)}),
        """WITH w AS (SELECT l_suppkey AS plan, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS stage, lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS position, CAST(l_quantity AS DOUBLE) - 5 AS weight FROM lineitem)
SELECT plan, stage, round(coalesce(sum(weight) OVER (PARTITION BY plan ORDER BY position, weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER (PARTITION BY plan), 9) AS start,
  round(weight / sum(weight) OVER (PARTITION BY plan), 9) AS span FROM w WHERE weight > 0""",
    ),
}


ALL = {**QUERIES, **records.QUERIES, **timelines.QUERIES, **compositions.QUERIES, **requests.QUERIES}


def queries():
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
