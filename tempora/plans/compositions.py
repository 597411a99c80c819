"""Queries over the derived timelines: token and forced alignment, coverage and resuming, journals, whole pipelines."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..operators import alignment as al
from ..operators import backends as bk
from ..operators import intervals as iv
from ..operators import journal as jr
from ..operators import progress as pg
from ..operators import resume as rs
from ..operators import words as wd
from ..sources.sinks import shared_folder
from ..streaming import feeds as fd
from .sql import ALIGNED, CROSS, MERGED40, MISSING, SILENCES, missing_word_batches
from .timelines import STRETCHES, _stretches

CUES, SPANS, WORDS, TRACE, REPLIES = fx.CUES_SQL, fx.SPANS_SQL, fx.WORDS_SQL, fx.TRACE_SQL, fx.REPLIES_SQL
DURATION = 870_000


def _tokens(spark, d):
    """Two tokens a cue, at places that follow from its id, behind a mark of the transcriber."""
    i = F.col("id")
    a = i * 79 % 12_000
    b = a + i % 5 * 60
    c = b + i % 3 * 20
    token = lambda text, x, y: F.struct(text.alias("text"), F.struct(x.alias("from"), y.alias("to")).alias("offsets"))
    listed = F.to_json(F.array(token(F.lit("[_BEG_]"), F.lit(0), F.lit(0)), token(F.when(i % 4 == 0, "私").otherwise("word"), a, b), token(F.lit("next"), c, c + i % 7 * 60)))
    return al.leading_tokens(fx.cues(spark, d).select("track_id", "id", listed.alias("tokens")))


def _long(spark, d):
    return fx.cues(spark, d).withColumn("end_ms", F.col("end_ms") + 60_000)


def _attempts(spark, d):
    """Two attempts for each cue that is no crosstalk, with times that follow from its id."""
    i, n = F.col("id"), F.col("attempt")
    w = al.attempt_windows(fx.cues(spark, d), DURATION)
    a = i % 7 * 100 + n * 10
    b = a + 80
    c = b + 50
    e = c + i % 3 * 100
    word = lambda x, y, s: F.struct(F.lit("w").alias("word"), (x / 1000).alias("start"), (y / 1000).alias("end"), s.alias("score"))
    one, two = word(a, b, i % 4 / 4), word(c, e, F.lit(0.5))
    segments = F.when(i % 2 == 0, F.array(F.struct(F.lit(" a ").alias("text"), F.array(one).alias("words")), F.struct(F.lit("b").alias("text"), F.array(two).alias("words")))).otherwise(F.array(F.struct(F.lit("c").alias("text"), F.array(two, one).alias("words"))))
    return w.withColumn("body", F.when((i % 9 != 0) | (n != 1), F.to_json(F.struct(segments.alias("segments")))))


ATTEMPTS = f"""a AS (SELECT c.track_id, c.id, c.ordinal, c.source, c.translated, n AS attempt, greatest(0, start_ms - CASE n WHEN 1 THEN 200 ELSE 2000 END) AS lo, least({DURATION}, end_ms + CASE n WHEN 1 THEN 500 ELSE 2000 END) AS hi
  FROM cues c CROSS JOIN (SELECT unnest([1, 2]) AS n) WHERE (c.track_id, c.id) NOT IN (SELECT (track_id, id) FROM cross_ids)),
b AS (SELECT *, lo + id % 7 * 100 + attempt * 10 AS s1, lo + id % 7 * 100 + attempt * 10 + 80 AS e1, lo + id % 7 * 100 + attempt * 10 + 130 AS s2, lo + id % 7 * 100 + attempt * 10 + 130 + id % 3 * 100 AS e2 FROM a),
judged AS (SELECT *, CASE WHEN id % 9 = 0 AND attempt = 1 THEN 'failed' WHEN id % 2 = 0 AND id % 4 = 0 THEN 'zero-first-token-score' WHEN e2 > {DURATION} THEN 'failed'
  WHEN (lo > 50 AND s1 <= lo + 50) OR (hi < {DURATION} - 50 AND e2 >= hi - 50) THEN 'boundary-clipped' ELSE 'success' END AS outcome FROM b)"""


def _artifacts(spark, d):
    o = fx.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("artifact_id"), F.col("o_orderpriority").alias("kind"), F.concat(F.lit("p/"), "o_orderkey").alias("path"))


def _plans(spark, d):
    k = F.col("c_custkey")
    bit = lambda n: F.pmod(F.floor(k / n), F.lit(2)) == 1
    return fx.read(spark, d, "customer").select(
        k.alias("plan"), bit(1).alias("needs_model"), bit(2).alias("is_url"), bit(4).alias("streaming"), bit(8).alias("needs_acquire"), bit(16).alias("needs_transcription"),
        bit(32).alias("needs_translation"), bit(64).alias("needs_post_translation"), (F.pmod(k, F.lit(13)) / 10).alias("transcription_scale"),
    )


WEIGHTS = """p AS (SELECT c_custkey AS plan, c_custkey % 2 = 1 AS m, c_custkey // 2 % 2 = 1 AS u, c_custkey // 4 % 2 = 1 AS s, c_custkey // 8 % 2 = 1 AS a, c_custkey // 16 % 2 = 1 AS t, c_custkey // 32 % 2 = 1 AS r,
  c_custkey // 64 % 2 = 1 AS q, least(1.0::DOUBLE, c_custkey % 13 / 10.0::DOUBLE) AS x FROM customer),
w AS (SELECT plan, 0 AS position, 'model' AS stage, CASE WHEN m THEN 14.0::DOUBLE ELSE 0 END AS weight FROM p UNION ALL SELECT plan, 1, 'acquire', CASE WHEN NOT a THEN 0 WHEN u AND s THEN 28 WHEN u THEN 16 ELSE 6 END FROM p
UNION ALL SELECT plan, 2, 'transcribe', CASE WHEN t THEN CASE WHEN u AND s THEN 28 ELSE 38 END * x ELSE 0 END FROM p UNION ALL SELECT plan, 3, 'translate', CASE WHEN NOT r THEN 0 WHEN u AND s THEN 14 ELSE 20 END FROM p
UNION ALL SELECT plan, 4, 'align', 8 FROM p UNION ALL SELECT plan, 5, 'post-align-translate', CASE WHEN q THEN 10 ELSE 0 END FROM p UNION ALL SELECT plan, 6, 'publish', 2 FROM p)"""


def _stage_values(spark, d):
    plan = jr.progress_plan(rs.stage_weights(_plans(spark, d)))
    seen = _plans(spark, d).select("plan", F.explode(F.array(F.lit("transcribe"), F.lit("align"))).alias("stage"), (F.pmod("plan", F.lit(17)) / 8 - 0.5).alias("fraction"))
    return rs.stage_value(seen, plan).withColumn("value", F.round("value", 9))


def _statuses(spark, d):
    """Batches of the tracks with a status each, and tracks that are still transcribed."""
    c = fx.cues(spark, d)
    b = jr.missing_batches(c).select("track_id", "batch_no", F.when(F.col("first") % 3 == 0, "complete").otherwise("running").alias("status"))
    heard = c.where("track_id % 2 = 0").groupBy("track_id").agg((F.max("end_ms") / 800_000).alias("fraction"))
    return rs.batch_progress(b, heard).withColumn("fraction", F.round("fraction", 9))


def _echo_words(payload, error):
    """Stands for a service: a cue for each stretch of at most seven words of one speaker."""
    cues = []
    for w in json.loads(payload):
        if cues and cues[-1]["s"] == w.get("s") and w["i"] - cues[-1]["first_word"] < 7:
            cues[-1]["last_word"] = w["i"]
            cues[-1]["source"] += " " + w["w"]
        else:
            cues.append({"s": w.get("s"), "first_word": w["i"], "last_word": w["i"], "source": w["w"]})
    return json.dumps({"cues": [{**{k: v for k, v in c.items() if k != "s"}, "source": c["source"] or "-", "translated": "t"} for c in cues]})


def _segmented(spark, d):
    folder = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    return bk.segment_and_translate(fx.words(spark, d), _echo_words, folder, target=50)[0].select("track_id", "id", "first", "last", "start_ms", "end_ms", "speaker", "source")


def _lists(spark, d):
    """One word list a track, with the spaces between the words."""
    w = fx.words(spark, d)
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("speaker").alias("speaker_id"))
    rows = w.select("track_id", F.struct("ordinal", F.array(item("word", F.col("text")), item("spacing", F.lit(" "))).alias("items")).alias("row"))
    return rows.groupBy("track_id").agg(F.to_json(F.flatten(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["items"]))).alias("items"))


def _ready(spark, d):
    w = fx.words(spark, d)
    return wd.ready_word_batches(w, _stretches(spark, d).where("id % 20 = 0"), wd.missing_word_batches(w, _stretches(spark, d).where("id % 20 = 0"), 40).where("track_id % 3 = 0"), 40)


def _timeline_sql():
    """Silences cut, aligned to speech, ends extended, numbered."""
    cut = f"""{CUES.replace("cues AS", "base AS", 1)}, spans AS (SELECT track_id, start_ms, end_ms FROM base WHERE source IN ('click', 'view')), {MERGED40.replace("merged AS", "pauses AS", 1)},
{CROSS.replace("cross_ids", "cross0").replace("cues a", "base a").replace("cues b", "base b")},
gaps AS (SELECT * FROM (SELECT track_id, lag(end_ms) OVER (PARTITION BY track_id ORDER BY start_ms) AS a, start_ms AS b FROM pauses) WHERE a IS NULL OR b - a > 6000),
hit AS (SELECT c.track_id, c.id, max(b) AS b FROM base c JOIN gaps g ON c.track_id = g.track_id AND b > start_ms AND b < end_ms AND b - greatest(start_ms, coalesce(a, start_ms)) > 6000
  WHERE (c.track_id, c.id) NOT IN (SELECT (track_id, id) FROM cross0) GROUP BY 1, 2),
cues AS (SELECT c.track_id, c.id, ordinal, coalesce(greatest(start_ms, b - 3000), start_ms) AS start_ms, end_ms, speaker, source FROM base c LEFT JOIN hit h ON c.track_id = h.track_id AND c.id = h.id)"""
    cross = lambda name, rows: CROSS.replace("cross_ids", name).replace("cues a", f"{rows} a").replace("cues b", f"{rows} b")
    end = f"""{cross("cross2", "aligned")}, nx AS (SELECT l.*, x.id IS NULL AS free, lead(start_ms) OVER (PARTITION BY l.track_id ORDER BY start_ms, end_ms, ordinal) AS nx0 FROM aligned l LEFT JOIN cross2 x ON l.track_id = x.track_id AND l.id = x.id),
ex AS (SELECT *, least(start_ms, {DURATION}) AS s, least(greatest(least(start_ms, {DURATION}), end_ms), {DURATION}) AS e, CASE WHEN nx0 IS NOT NULL THEN least(greatest(nx0, 0), {DURATION}) END AS nx FROM nx),
ended AS (SELECT track_id, id, ordinal, speaker, CASE WHEN free THEN s ELSE start_ms END AS start_ms, CASE WHEN NOT free THEN end_ms ELSE greatest(s, CASE WHEN nx IS NULL THEN least(e + 500, {DURATION}) WHEN nx - e <= 700 THEN nx
  WHEN nx - e < 1000 THEN (e + nx) // 2 ELSE least(e + 500, {DURATION}) END) END AS end_ms FROM ex),
{cross("cross3", "ended")}, last AS (SELECT d.*, x.id IS NULL AS free, row_number() OVER (PARTITION BY d.track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS place FROM ended d LEFT JOIN cross3 x ON d.track_id = x.track_id AND d.id = x.id)"""
    return f"""WITH {cut}, {ALIGNED}, {end} SELECT track_id, place AS id, id AS parent_id, CASE WHEN free THEN least(greatest(start_ms, 0), {DURATION}) ELSE start_ms END AS start_ms,
  CASE WHEN free THEN greatest(least(greatest(start_ms, 0), {DURATION}), least(end_ms, {DURATION})) ELSE end_ms END AS end_ms FROM last"""


PICKS = "picked AS (SELECT track_id, id, min(attempt) AS attempt FROM judged WHERE outcome = 'success' GROUP BY 1, 2)"

QUERIES = {
    "align_timeline": (lambda s, d: bk.align_timeline(fx.cues(s, d), fx.spans(s, d), None, DURATION).select("track_id", "id", "parent_id", "start_ms", "end_ms"), _timeline_sql()),
    "token_starts": (
        lambda s, d: al.token_starts(_long(s, d), iv.merge_intervals(fx.spans(s, d), 40), _tokens(s, d), fx.spans(s, d).where("start_ms % 3 = 0")).withColumn("token_ms", F.col("token_ms").cast("bigint")),
        f"""WITH {CUES}, {SPANS}, {MERGED40}, x AS (SELECT track_id, start_ms AS l, end_ms AS r, coalesce(sum(end_ms - start_ms + 200) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS axis, lead(start_ms) OVER o AS speech
  FROM merged WINDOW o AS (PARTITION BY track_id ORDER BY start_ms)),
g AS (SELECT *, axis + r - l + 100 AS quiet FROM x WHERE speech IS NOT NULL),
k AS (SELECT track_id, id, end_ms + 60000 AS e, lag(end_ms + 60000) OVER (PARTITION BY track_id ORDER BY ordinal) AS prev, CASE WHEN id % 4 = 0 THEN 0 ELSE 320 END AS least, id * 79 % 12000 AS a, id * 79 % 12000 + id % 5 * 60 AS b,
  id * 79 % 12000 + id % 5 * 60 + id % 3 * 20 AS c, id * 79 % 12000 + id % 5 * 60 + id % 3 * 20 + id % 7 * 60 AS d FROM cues),
h AS (SELECT k.track_id, k.id, speech, a <= quiet AND b >= quiet + 100 AS across, l + a - axis AS f, l + b - axis AS t FROM k JOIN g ON k.track_id = g.track_id AND speech - r >= least AND speech <= e AND (prev IS NULL OR speech >= prev + 40)
  AND ((a <= quiet AND b >= quiet + 100) OR (b <= quiet AND quiet - b <= 100 AND c <= quiet AND d >= quiet + 100 AND a >= axis)))
SELECT track_id, id, CAST(max(speech) AS BIGINT) AS token_ms FROM h WHERE across OR NOT EXISTS (SELECT 1 FROM spans v WHERE v.start_ms % 3 = 0 AND v.track_id = h.track_id AND v.end_ms >= f - 40 AND v.start_ms <= t + 40) GROUP BY 1, 2""",
    ),
    "align_attempts": (
        lambda s, d: al.judged_attempts(_attempts(s, d), DURATION).select("track_id", "id", "attempt", "from_ms", "to_ms", "outcome"),
        f"WITH {CUES}, {CROSS}, {ATTEMPTS} SELECT track_id, id, attempt, lo AS from_ms, hi AS to_ms, outcome FROM judged",
    ),
    "aligned_cues": (
        lambda s, d: al.aligned_cues(fx.cues(s, d), al.judged_attempts(_attempts(s, d), DURATION)).select("track_id", "id", "part", "start_ms", "end_ms", "source", "translated", F.round("confidence", 6).alias("confidence")),
        f"""WITH {CUES}, {CROSS}, {ATTEMPTS}, {PICKS}, j AS (SELECT judged.* FROM judged JOIN picked USING (track_id, id, attempt))
SELECT track_id, id, 0 AS part, s1 AS start_ms, e1 AS end_ms, 'a' AS source, NULL AS translated, id % 4 / 4.0::DOUBLE AS confidence FROM j WHERE id % 2 = 0 UNION ALL SELECT track_id, id, 1, s2, e2, 'b', NULL, 0.5::DOUBLE FROM j WHERE id % 2 = 0
UNION ALL SELECT track_id, id, 0, s1, e2, source, translated, round((id % 4 / 4.0::DOUBLE + 0.5) / 2, 6) FROM j WHERE id % 2 = 1""",
    ),
    "align_external": (lambda s, d: al.align(fx.cues(s, d), "external", DURATION, iv.merge_intervals(fx.spans(s, d), 40), _attempts(s, d)).select("track_id", "id", "parent_id", "start_ms", "end_ms", "backend"), None),
    "preview_cues": (
        lambda s, d: rs.preview_cues(jr.render_documents(fx.cues(s, d)).withColumn("document", F.concat(F.lit("[events]\r\n"), F.replace("document", F.lit("\n"), F.lit("\r\n"))))),
        f"""WITH {CUES}, r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS n FROM cues)
SELECT track_id, n AS id, n - 1 AS ordinal, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) * 10 AS start_ms, CAST(round_even(end_ms / 10.0, 0) AS BIGINT) * 10 AS end_ms, speaker, source, translated FROM r""",
    ),
    "journal_lookup": (
        lambda s, d: rs.cues_by_id(fx.cues(s, d).withColumn("stable", F.col("id") % 3 != 0), fx.cues(s, d).where("id % 7 = 0"), stable_only=True).select("track_id", "id", "ordinal"),
        f"WITH {CUES} SELECT track_id, id, ordinal FROM cues WHERE id % 7 = 0 AND id % 3 <> 0",
    ),
    "journal_scan": (
        lambda s, d: rs.scan_cues(fx.cues(s, d).withColumn("stable", F.col("id") % 3 != 0), True).select("track_id", "ordinal", "id").unionAll(rs.scan_words(fx.words(s, d)).select("track_id", "ordinal", F.lit(None).cast("bigint"))),
        f"WITH {CUES}, {WORDS} SELECT track_id, ordinal, id FROM cues WHERE id % 3 <> 0 UNION ALL SELECT track_id, ordinal, NULL FROM words",
    ),
    "cue_checks": (
        lambda s, d: rs.broken_cues(rs.with_timing(fx.cues(s, d).withColumn("confidence", F.lit(0.5)), fx.cues(s, d).where("id % 5 = 0").select("track_id", "id", (F.col("start_ms") - 300_000).alias("start_ms"), (F.col("end_ms") - 300_500).alias("end_ms"), F.lit(None).cast("double").alias("confidence")))).select("track_id", "id", "start_ms", "end_ms", "confidence"),
        f"WITH {CUES} SELECT track_id, id, start_ms - 300000 AS start_ms, end_ms - 300500 AS end_ms, CAST(NULL AS DOUBLE) AS confidence FROM cues WHERE id % 5 = 0 AND (start_ms < 300000 OR end_ms - 500 < start_ms)",
    ),
    "metadata_merge": (
        lambda s, d: rs.merged_metadata(fx.cues(s, d).select("track_id", "id", F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("1")).alias("metadata")), fx.cues(s, d).where("id % 2 = 0").select("track_id", "id", F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.lit("2")).alias("metadata")))
        .select("track_id", "id", *[F.col("metadata")[k].alias(k) for k in "abc"]),
        f"WITH {CUES} SELECT track_id, id, CASE WHEN id % 2 = 0 THEN 'new' ELSE source END AS a, '1' AS b, CASE WHEN id % 2 = 0 THEN '2' END AS c FROM cues",
    ),
    "junctions": (
        lambda s, d: wd.junctions(fx.words(s, d), _stretches(s, d), fx.words(s, d).where("ordinal % 70 = 6").select("track_id", "ordinal")),
        f"""WITH {WORDS}, {STRETCHES}, o AS (SELECT w.track_id, w.ordinal, cs.* EXCLUDE (track_id) FROM words w JOIN cs ON w.track_id = cs.track_id AND w.ordinal BETWEEN cs.first AND cs.last)
SELECT a.track_id, a.ordinal FROM o a JOIN o b ON a.track_id = b.track_id AND b.ordinal = a.ordinal + 1 AND a.id <> b.id WHERE a.ordinal % 70 = 6 OR (coalesce(a.speaker, '') = coalesce(b.speaker, '') AND b.start_ms - a.end_ms < 800)""",
    ),
    "repair_spans": (
        lambda s, d: wd.repair_spans(fx.words(s, d).where("ordinal % 21 = 6").select("track_id", "ordinal"), _stretches(s, d)).withColumn("replaced", F.array_join("replaced", ",")),
        f"""WITH {WORDS}, {STRETCHES} SELECT w.track_id, w.ordinal, l.first AS low, r.last AS high, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM cs WHERE cs.track_id = w.track_id AND cs.first >= l.first AND cs.last <= r.last) AS replaced
FROM words w JOIN cs l ON l.track_id = w.track_id AND w.ordinal BETWEEN l.first AND l.last JOIN cs r ON r.track_id = w.track_id AND w.ordinal + 1 BETWEEN r.first AND r.last WHERE w.ordinal % 21 = 6""",
    ),
    "missing_word_batches": (
        lambda s, d: wd.missing_word_batches(fx.words(s, d), _stretches(s, d).where("id % 9 = 0"), 50),
        f"WITH RECURSIVE {WORDS}, {STRETCHES}, r AS (SELECT * FROM cs WHERE id % 9 = 0), {missing_word_batches(50, 'r')} SELECT * FROM missing",
    ),
    "ready_word_batches": (
        _ready,
        f"""WITH d AS (WITH RECURSIVE {WORDS}, {STRETCHES}, r AS (SELECT * FROM cs WHERE id % 20 = 0), {missing_word_batches(40, "r")} SELECT track_id, first, last FROM missing WHERE track_id % 3 = 0),
ready AS (WITH RECURSIVE {WORDS}, {STRETCHES}, {SILENCES}, r AS (SELECT * FROM cs WHERE id % 20 = 0), usable AS (SELECT * FROM words w WHERE ordinal <= (SELECT max(ordinal) FROM silences s WHERE s.track_id = w.track_id)),
  {missing_word_batches(40, "r", "usable")} SELECT track_id, first, last FROM missing WHERE last - first + 1 >= 40)
SELECT * FROM ready ANTI JOIN d USING (track_id, first, last)""",
    ),
    "resume_points": (
        lambda s, d: rs.resume_points(fx.cues(s, d).where("track_id % 5 <> 0"), fx.cues(s, d).groupBy("track_id").agg((F.max("end_ms") + F.col("track_id") % 3 * 50_000 - 20_000).alias("duration_ms"))).withColumn("remaining", F.round("remaining", 9)),
        f"""WITH {CUES}, t AS (SELECT track_id, max(end_ms) + track_id % 3 * 50000 - 20000 AS n, CASE WHEN track_id % 5 <> 0 THEN max(end_ms) ELSE 0 END AS e FROM cues GROUP BY 1)
SELECT track_id, e AS durable_ms, greatest(0, e - 5000) AS resume_ms, round(CASE WHEN n > 0 THEN greatest(0.01::DOUBLE, least(1.0::DOUBLE, (n - e) / n::DOUBLE)) ELSE 1 END, 9) AS remaining FROM t""",
    ),
    "word_coverage": (
        lambda s, d: rs.word_coverage(fx.words(s, d), _stretches(s, d)),
        f"WITH {WORDS} SELECT track_id, count(*) AS n_words, count(*) FILTER (track_id % 3 <> 0 OR ordinal < 63) AS n_covered, bool_and(track_id % 3 <> 0 OR ordinal < 63) AS complete FROM words GROUP BY 1",
    ),
    "leftover_failures": (
        lambda s, d: rs.leftover_failures(fx.cues(s, d).where("track_id % 2 = 0 OR translated IS NOT NULL")).withColumn("ids", F.array_join("ids", ",")),
        f"""WITH {CUES}, l AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS k FROM cues WHERE track_id % 2 = 0 AND translated IS NULL)
SELECT track_id, count(*) AS n, string_agg(CASE WHEN k <= 20 THEN CAST(id AS VARCHAR) END, ',' ORDER BY k) AS ids FROM l GROUP BY 1""",
    ),
    "uncovered_failures": (
        lambda s, d: rs.uncovered_failures(fx.words(s, d), _stretches(s, d)).withColumn("ordinals", F.array_join("ordinals", ",")),
        f"WITH {WORDS} SELECT track_id, count(*) AS n, string_agg(CASE WHEN ordinal < 83 THEN CAST(ordinal AS VARCHAR) END, ',' ORDER BY ordinal) AS ordinals FROM words WHERE track_id % 3 = 0 AND ordinal >= 63 GROUP BY 1",
    ),
    "late_results": (
        lambda s, d: rs.late_results(fx.replies(s, d).withColumn("batch_no", F.length("id")), fx.cues(s, d).where("id % 5 <> 0")),
        f"""WITH {CUES}, {REPLIES} SELECT track_id, length(id) AS batch_no, count(*) AS n FROM replies r WHERE NOT EXISTS (SELECT 1 FROM cues c WHERE c.track_id = r.track_id AND CAST(c.id AS VARCHAR) = r.id AND c.id % 5 <> 0) GROUP BY 1, 2""",
    ),
    "batch_summaries": (
        lambda s, d: rs.batch_summaries(jr.missing_batches(fx.cues(s, d)), fx.cues(s, d), fx.replies(s, d).withColumn("source", F.when(F.col("id").rlike("[05]$"), "fixed"))).withColumn("pairs", F.array_join("pairs", ";")),
        f"""WITH {CUES}, {REPLIES}, {MISSING}, r AS (SELECT b.track_id, b.batch_no, c.ordinal, c.source, CASE WHEN c.id % 5 = 0 THEN 'fixed' ELSE c.source END AS s, c.translated, coalesce(nullif(trim(r.translated), ''), c.translated) AS t FROM batches b
  JOIN cues c ON b.track_id = c.track_id AND c.ordinal BETWEEN first AND last JOIN replies r ON r.track_id = c.track_id AND r.id = CAST(c.id AS VARCHAR))
SELECT track_id, batch_no, count(*) AS processed, count(*) FILTER (s <> source) AS corrected, count(*) FILTER (t IS DISTINCT FROM translated) AS updated, string_agg(s || ' → ' || coalesce(t, ''), ';' ORDER BY ordinal) AS pairs FROM r GROUP BY 1, 2""",
    ),
    "active_operations": (
        lambda s, d: rs.active_operations(fx.trace(s, d).withColumn("job", F.col("operation_id") % 10), "job"),
        f"""WITH {TRACE}, l AS (SELECT operation_id, arg_max(state, (created_us, event_id)) AS state FROM trace GROUP BY 1) SELECT operation_id % 10 AS job, count(*) FILTER (state NOT IN ('completed', 'failed')) AS active FROM l GROUP BY 1""",
    ),
    "elapsed_seconds": (
        lambda s, d: rs.elapsed_seconds(jr.task_state(fx.trace(s, d)), 1_706_000_000_000_000).select("operation_id", "elapsed_s"),
        f"""WITH {TRACE}, l AS (SELECT operation_id, arg_max(state, (created_us, event_id)) AS state, min(created_us) AS a, max(created_us) AS z FROM trace GROUP BY 1)
SELECT operation_id, greatest(0, CAST(round_even((CASE WHEN state IN ('completed', 'failed') THEN z ELSE 1706000000000000 END - a) / 1000000.0, 0) AS BIGINT)) AS elapsed_s FROM l""",
    ),
    "batch_progress": (
        _statuses,
        f"""WITH {CUES}, {MISSING}, d AS (SELECT track_id, count(*) FILTER (first % 3 = 0) / count(*)::DOUBLE AS part FROM batches GROUP BY 1), h AS (SELECT track_id, max(end_ms) / 800000::DOUBLE AS f FROM cues WHERE track_id % 2 = 0 GROUP BY 1)
SELECT coalesce(d.track_id, h.track_id) AS track_id, round(CASE WHEN f IS NULL THEN part ELSE 0.85::DOUBLE * least(1.0::DOUBLE, f) + 0.15::DOUBLE * coalesce(part, 1.0::DOUBLE) END, 9) AS fraction FROM d FULL JOIN h ON d.track_id = h.track_id""",
    ),
    "stage_weights": (lambda s, d: rs.stage_weights(_plans(s, d)).withColumn("weight", F.round("weight", 9)), f"WITH {WEIGHTS} SELECT plan, position, stage, round(weight, 9) AS weight FROM w"),
    "stage_values": (
        _stage_values,
        f"""WITH {WEIGHTS}, k AS (SELECT plan, stage, coalesce(sum(weight) OVER (PARTITION BY plan ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(weight) OVER (PARTITION BY plan) AS a, weight / sum(weight) OVER (PARTITION BY plan) AS b FROM w WHERE weight > 0)
SELECT plan, stage, plan % 17 / 8.0::DOUBLE - 0.5::DOUBLE AS fraction, round(a + greatest(0::DOUBLE, least(1::DOUBLE, plan % 17 / 8.0::DOUBLE - 0.5::DOUBLE)) * b, 9) AS value FROM k WHERE stage IN ('transcribe', 'align')""",
    ),
    "published_languages": (
        lambda s, d: fx.read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, " AUTO").when(F.col("doc_id") % 3 == 1, "Fr_ca").alias("c"), F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).alias("l")).select("doc_id", rs.published_language("c", "l").alias("language")),
        "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'fr' WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 3 = 0 THEN ' AUTO' END AS language FROM documents",
    ),
    "source_kinds": (
        lambda s, d: fx.read(s, d, "pages").select("page_id", tx.is_url(F.col("url")).alias("is_url")).unionAll(fx.cues(s, d).select("id", tx.is_word_range_id(F.when(F.col("id") % 2 == 0, tx.word_range_id(F.col("id"), F.col("ordinal"))).otherwise(F.concat(F.lit("preview-"), "id"))))),
        f"WITH {CUES} SELECT page_id, coalesce(regexp_matches(url, '^[hH][tT][tT][pP][sS]?://[^/?#\\s]+'), NULL) AS is_url FROM pages UNION ALL SELECT id, id % 2 = 0 FROM cues",
    ),
    "latest_artifacts": (
        lambda s, d: rs.artifact(_artifacts(s, d), "1-URGENT"),
        "SELECT o_custkey AS job_id, 'p/' || CAST(max(o_orderkey) AS VARCHAR) AS path FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    ),
    "checkpoint_values": (
        lambda s, d: rs.checkpoint(fx.trace(s, d).select(F.col("operation_id").alias("job_id"), F.col("state").alias("name"), F.col("event_id").cast("string").alias("value"), F.col("created_us").alias("at_us"), F.col("event_id").alias("seq")), "completed", "none"),
        f"WITH {TRACE} SELECT operation_id AS job_id, coalesce(CAST(arg_max(event_id, (created_us, event_id)) FILTER (state = 'completed') AS VARCHAR), 'none') AS value FROM trace GROUP BY 1",
    ),
    "job_rows": (
        lambda s, d: rs.set_status(rs.create_jobs(_jobs(s, d).where("job_id % 2 = 0"), _jobs(s, d).withColumn("status", F.lit("new"))), _jobs(s, d).where("job_id % 5 = 0").select("job_id", F.lit("failed").alias("status"), F.concat(F.lit("e"), "job_id").alias("error"))),
        "SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS status, CASE WHEN c_custkey % 5 = 0 THEN 'e' || CAST(c_custkey AS VARCHAR) END AS error FROM customer",
    ),
    "outer_context": (
        lambda s, d: rs.outer_context(jr.missing_batches(fx.cues(s, d).where("ordinal >= 8")), fx.cues(s, d).where("ordinal >= 8"), fx.cues(s, d).where("ordinal < 8")).select("track_id", "batch_no", F.array_join("preceding", ",").alias("preceding"), F.array_join("following", ",").alias("following")),
        f"""WITH {CUES.replace("cues AS", "every AS", 1)}, cues AS (SELECT * FROM every WHERE ordinal >= 8), {MISSING} SELECT b.track_id, b.batch_no, coalesce(string_agg(CASE WHEN ordinal < first THEN CAST(id AS VARCHAR) END, ',' ORDER BY ordinal), '') AS preceding,
  coalesce(string_agg(CASE WHEN ordinal > last THEN CAST(id AS VARCHAR) END, ',' ORDER BY ordinal), '') AS following
FROM batches b LEFT JOIN every c ON b.track_id = c.track_id AND (c.ordinal BETWEEN first - 10 AND first - 1 OR c.ordinal BETWEEN last + 1 AND last + 5) GROUP BY 1, 2""",
    ),
    "final_over_live": (
        lambda s, d: fd.final_over_live(fx.cues(s, d), fx.cues(s, d).where("track_id % 3 = 0 AND id % 2 = 0")).select("track_id", "id", "final"),
        f"WITH {CUES}, f AS (SELECT * FROM cues WHERE track_id % 3 = 0 AND id % 2 = 0) SELECT track_id, id, TRUE AS final FROM f UNION ALL SELECT track_id, id, FALSE FROM cues WHERE track_id NOT IN (SELECT track_id FROM f)",
    ),
    "import_words": (lambda s, d: wd.import_words(_lists(s, d))[1], None),
    "segment_and_translate": (_segmented, None),
}


def _jobs(spark, d):
    return fx.read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.lit("old").alias("status"), F.lit(None).cast("string").alias("error"))
