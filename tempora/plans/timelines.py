"""More queries over the derived timelines: onsets, settlement, merging, word replies, journals, feeds."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import backends as bk
from ..operators import intervals as iv
from ..operators import journal as jr
from ..operators import progress as pg
from ..operators import publish as pb
from ..operators import words as wd
from ..streaming import feeds as fd
from .sql import word_batches

CUES, WORDS, LEVELS, TRACE = fx.CUES_SQL, fx.WORDS_SQL, fx.LEVELS_SQL, fx.TRACE_SQL


def _stamp(ms):
    cs = f"CAST(round_even({ms} / 10.0, 0) AS BIGINT)"
    return f"CAST({cs} // 360000 AS VARCHAR) || ':' || lpad(CAST({cs} // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({cs} // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({cs} % 100 AS VARCHAR), 2, '0')"


STAMP_START, STAMP_END = _stamp("start_ms"), _stamp("end_ms")


def _header(width, height):
    """The header of a frame, in plain Python."""
    scale = min(width / 1920, height / 1080)
    style = pb.STYLES % (max(1, round(64 * scale)), f"{round(3 * scale, 2):g}", f"{round(1.5 * scale, 2):g}", round(60 * width / 1920), round(60 * width / 1920), round(40 * height / 1080))
    return pb.INFO % (width, height) + style + pb.EVENTS


HEADERS = "headers(kind, header) AS (VALUES " + ", ".join(f"({i}, '{_header(i * 640 + 640, 720)}')" for i in range(3)) + ")"


def _level_cues(spark, d):
    """Cues of 25 windows each over the level series."""
    part = F.floor(F.col("window_idx") / 25)
    g = fx.levels(spark, d).groupBy("track_id", part.alias("id")).agg(F.min("window_idx").alias("a"), F.max("window_idx").alias("b"))
    return g.select("track_id", "id", F.col("id").alias("ordinal"), (F.col("a") * 20 + F.col("id") % 3 * 7).alias("start_ms"), (F.col("b") * 20 + 20).alias("end_ms"), F.lit(None).cast("string").alias("speaker"))


def _stretches(spark, d):
    """Cues of 7 words; in every third track, the last words have none."""
    w = fx.words(spark, d).withColumn("part", F.floor(F.col("ordinal") / 7))
    w = w.where("track_id % 3 <> 0 OR ordinal < 63")
    return w.groupBy("track_id", F.col("part").alias("id")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min_by("start_ms", "ordinal").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min_by("speaker", "ordinal").alias("speaker"))


STRETCHES = """cs AS (SELECT track_id, ordinal // 7 AS id, min(ordinal) AS first, max(ordinal) AS last, arg_min(start_ms, ordinal) AS start_ms, max(end_ms) AS end_ms, arg_min_null(speaker, ordinal) AS speaker
  FROM words WHERE track_id % 3 <> 0 OR ordinal < 63 GROUP BY track_id, ordinal // 7)"""


def _pending(spark, d):
    return fx.words(spark, d).where("track_id % 2 = 1 AND ordinal % 35 = 34").select("track_id", "ordinal")


def _heard(spark, d):
    """The cues of a track heard again: same texts, other times."""
    return fx.cues(spark, d).withColumn("start_ms", F.col("start_ms") + (F.col("id") % 7) * 700).withColumn("end_ms", F.col("start_ms") + 500)


def _attempts(spark, d):
    t = fx.trace(spark, d)
    status = F.when(F.col("state") == "completed", "complete").when(F.col("state") == "failed", "failed").otherwise("running")
    return t.select(F.col("operation_id").alias("batch_id"), F.col("created_us").alias("at_us"), F.col("event_id").alias("seq"), status.alias("status"), F.when(status == "complete", F.col("model")).alias("response"), F.when(status == "failed", F.concat(F.lit("e"), "event_id")).alias("error"))


def _word_items(spark, d):
    """Replies over the words: stretches of one speaker's turn; some outside, inverted, doubled, blank or missing."""
    w = fx.words(spark, d).withColumn("position", F.floor(F.col("ordinal") / 9))
    g = w.groupBy("track_id", "position").agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count("*").alias("n")).where("position % 8 <> 5")
    first = F.when(F.col("position") % 11 == 3, F.col("a") - 2).otherwise(F.col("a"))
    last = F.when(F.col("position") % 13 == 6, F.col("b") + 100_000).when(F.col("position") % 7 == 4, F.col("a") - 1).otherwise(F.col("b"))
    source = F.when(F.col("position") % 6 == 1, " ").otherwise(F.repeat(F.lit("word "), (F.col("n") * (F.col("position") % 4)).cast("int")))
    return g.select("track_id", "position", first.alias("first"), last.alias("last"), source.alias("source"), F.when(F.col("position") % 5 == 2, "").otherwise("t").alias("translated"))


def _feed(spark, d):
    return fx.words(spark, d).select("track_id", F.col("ordinal").alias("seq"), "start_ms", "text")


def _echo(payload, error):
    """Stands for a service: its reply repeats each source."""
    return json.dumps({"cues": [{"id": c["id"], "source": c["source"], "translated": "t:" + c["source"]} for c in json.loads(payload)]})


def _published(spark, d):
    c = fx.cues(spark, d)
    frames = c.select("track_id").distinct().select("track_id", (F.col("track_id") % 3 * 640 + 640).cast("int").alias("width"), F.lit(720).alias("height"))
    return pb.publish_documents(c, frames, ["all"], "en", "xx"), frames


def _reviewed(spark, d):
    """The published files, in some tracks damaged: a comma lost, all events gone, a time moved in one mode."""
    own, _ = _published(spark, d)
    kind = F.col("track_id") % 7
    one = F.col("mode") == "translated"
    text = (
        F.when((kind == 1) & one, F.regexp_replace("document", "(?m)^(Dialogue: 0),", "$1")).when((kind == 2) & one, F.regexp_replace("document", "(?m)^Dialogue:.*$", ""))
        .when((kind == 3) & one, F.regexp_replace("document", r"(?m)^Dialogue: 0,0:", "Dialogue: 0,1:")).otherwise(F.col("document"))
    )
    return own, own.withColumn("document", text)


def _damaged(spark, d):
    """Files whose lines of one kind have lost their text, those of another their last fields."""
    text = F.regexp_replace(F.regexp_replace("document", "(?m),,signup$", ",,"), "(?m),0,0,0,,click$", ",0,0")
    return jr.render_documents(fx.cues(spark, d)).select("track_id", F.concat(F.lit("[Events]\n"), text).alias("document"))


def _canonical(spark, d):
    """Rewritten files of one mode; those of every second track have lost the header's first line."""
    own, frames = _published(spark, d)
    docs = own.where("mode = 'bilingual'").withColumn("document", F.when(F.col("track_id") % 2 == 0, F.regexp_replace("document", r"^\[Script Info\]\n", "")).otherwise(F.col("document")))
    return pb.canonical_documents(docs.drop("mode", "file"), frames, finer=True)


def _progress(spark, d):
    """Progress of users' plans: their events in the order of time, stage by event type, fractions by value."""
    e = fx.read(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("plan"), seq.cast("bigint").alias("seq"), F.col("event_type").alias("stage"), F.least(F.lit(1.2), F.col("value") / 40).alias("fraction"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at_s"))


def _stages(spark, d):
    stages = F.explode(F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(a).alias("start"), F.lit(b).alias("span")) for n, a, b in (("signup", 0.0, 0.25), ("click", 0.25, 0.25), ("view", 0.5, 0.25), ("purchase", 0.75, 0.25))]))
    return fx.read(spark, d, "events").select(F.col("user_id").alias("plan")).distinct().select("plan", stages.alias("s")).select("plan", "s.*")


QUERIES = {
    "onset_refine": (
        lambda s, d: iv.onset_starts(_level_cues(s, d), fx.levels(s, d)).select("track_id", "id", "start_ms"),
        f"""WITH {LEVELS}, c AS (SELECT track_id, window_idx // 25 AS id, min(window_idx) * 20 + window_idx // 25 % 3 * 7 AS s, max(window_idx) * 20 + 20 AS e FROM levels GROUP BY track_id, window_idx // 25),
k AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY level, window_idx) AS r, count(*) OVER (PARTITION BY track_id) AS n FROM levels),
fl AS (SELECT track_id, max(CASE WHEN r = least(n - 1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) + 1 THEN level END) AS whole FROM k GROUP BY 1),
h AS (SELECT c.*, l.window_idx AS w, level, l.window_idx >= s // 20 AS inside FROM c JOIN levels l ON c.track_id = l.track_id AND l.window_idx BETWEEN s // 20 - 20 AND CAST(ceil(e / 20.0) AS BIGINT) - 1),
o AS (SELECT track_id, id, list_sort(list(level) FILTER (NOT inside)) AS b, max(level) FILTER (inside) AS peak FROM h GROUP BY 1, 2),
t AS (SELECT o.track_id, o.id, peak, greatest(whole, least(coalesce(b[least(len(b) - 1, CAST(floor(len(b) * 0.2::DOUBLE) AS BIGINT)) + 1], whole), whole * 1.5::DOUBLE + 3)) AS noise FROM o JOIN fl ON o.track_id = fl.track_id),
x AS (SELECT h.*, level > greatest(noise * 1.3::DOUBLE, peak * 0.0005::DOUBLE, 4) AS weak, level > greatest(noise * 2, peak * 0.003::DOUBLE, 8) AS strong FROM h JOIN t ON h.track_id = t.track_id AND h.id = t.id WHERE inside),
y AS (SELECT *, strong AND sum(CAST(weak AS INT)) OVER (q ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) >= 2 AS loud, sum(CAST(weak AS INT)) OVER (q ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 AS long FROM x WINDOW q AS (PARTITION BY track_id, id ORDER BY w)),
f AS (SELECT track_id, id, arg_min(w - CASE WHEN loud THEN 0 ELSE 3 END, w) AS onset FROM y WHERE loud OR long GROUP BY 1, 2)
SELECT c.track_id, c.id, CAST(CASE WHEN greatest(s, onset * 20) - 60 > s + 5 THEN greatest(s, onset * 20) - 60 ELSE s END AS BIGINT) AS start_ms FROM c LEFT JOIN f ON c.track_id = f.track_id AND c.id = f.id""",
    ),
    "settled_prefix": (
        lambda s, d: wd.settled_prefix(fx.words(s, d), _stretches(s, d), _pending(s, d)),
        f"""WITH {WORDS}, {STRETCHES}, own AS (SELECT w.track_id, w.ordinal, w.start_ms, cs.first FROM words w LEFT JOIN cs ON w.track_id = cs.track_id AND w.ordinal BETWEEN cs.first AND cs.last),
g AS (SELECT track_id, min(ordinal) FILTER (first IS NULL) AS gap, max(ordinal) AS top FROM own GROUP BY 1),
b AS (SELECT track_id, gap - 1 AS ordinal FROM g WHERE gap > 0 UNION ALL SELECT track_id, ordinal FROM words WHERE track_id % 2 = 1 AND ordinal % 35 = 34),
m AS (SELECT g.track_id, coalesce(min(own.first), any_value(top) + 1) AS mutable FROM g LEFT JOIN b ON b.track_id = g.track_id LEFT JOIN own ON own.track_id = b.track_id AND own.ordinal = b.ordinal WHERE gap IS NULL OR gap > 0 GROUP BY 1),
f AS (SELECT m.track_id, any_value(mutable) AS mutable, min(w.start_ms) AS frontier FROM m LEFT JOIN words w ON w.track_id = m.track_id AND w.ordinal >= mutable GROUP BY 1),
p AS (SELECT cs.track_id, cs.id, row_number() OVER q AS final_id, max(CASE WHEN last < mutable AND (frontier IS NULL OR start_ms < frontier) THEN 0 ELSE 1 END) OVER (q ROWS UNBOUNDED PRECEDING) AS open
  FROM cs JOIN f ON cs.track_id = f.track_id WINDOW q AS (PARTITION BY cs.track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), first))
SELECT track_id, id, final_id FROM p WHERE open = 0""",
    ),
    "overlap_merge": (
        lambda s, d: wd.overlap_merge(fx.cues(s, d).where("id % 3 <> 1"), _heard(s, d)),
        f"""WITH RECURSIVE {CUES}, h AS (SELECT track_id, ordinal, start_ms + id % 7 * 700 AS start_ms, start_ms + id % 7 * 700 + 500 AS end_ms, source FROM cues),
f AS (SELECT *, row_number() OVER (PARTITION BY track_id, source ORDER BY ordinal, start_ms) AS p FROM h WHERE NOT EXISTS (
  SELECT 1 FROM cues e WHERE e.id % 3 <> 1 AND e.track_id = h.track_id AND e.source = h.source AND e.start_ms BETWEEN h.start_ms - 2500 AND h.start_ms + 2500)),
fold AS (SELECT DISTINCT track_id, source, CAST(0 AS BIGINT) AS p, false AS keep, CAST(0 AS BIGINT) AS ordinal, CAST(0 AS BIGINT) AS start_ms, CAST(0 AS BIGINT) AS end_ms, CAST([] AS BIGINT[]) AS starts FROM f
  UNION ALL SELECT track_id, source, p, keep, ordinal, start_ms, end_ms, CASE WHEN keep THEN list_append(starts, start_ms) ELSE starts END
  FROM (SELECT f.*, o.starts, len(list_filter(o.starts, lambda x: abs(x - f.start_ms) <= 2500)) = 0 AS keep FROM fold o JOIN f ON f.track_id = o.track_id AND f.source = o.source AND f.p = o.p + 1))
SELECT track_id, ordinal, start_ms, end_ms, source FROM fold WHERE keep""",
    ),
    "repair_squeezed_words": (lambda s, d: wd.repair_squeezed_words(fx.words(s, d)).drop("text"), None),
    "word_context": (
        lambda s, d: wd.word_context(wd.split_word_batches(fx.words(s, d), 50), fx.words(s, d), _stretches(s, d)).select("track_id", "batch_no", F.array_join("preceding", ",").alias("preceding"), F.array_join("following", ",").alias("following")),
        f"""WITH RECURSIVE {WORDS}, {STRETCHES}, {word_batches(50)}, c AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, id) AS place FROM cs),
b AS (SELECT w.*, s.start_ms AS at, (SELECT count(*) FROM cs WHERE cs.track_id = w.track_id AND cs.start_ms < s.start_ms) AS n FROM walk w JOIN words s ON s.track_id = w.track_id AND s.ordinal = w.first)
SELECT track_id, batch_no, (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FROM c WHERE c.track_id = b.track_id AND place BETWEEN n - 9 AND n) AS preceding,
  (SELECT string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) FROM words s WHERE s.track_id = b.track_id AND ordinal BETWEEN last + 1 AND last + 40) AS following FROM b""",
    ),
    "word_response_problems": (
        lambda s, d: jr.word_reply_problems(_word_items(s, d), fx.words(s, d)),
        f"""WITH {WORDS}, g AS (SELECT track_id, ordinal // 9 AS position, min(ordinal) AS a, max(ordinal) AS b, count(*) AS n FROM words WHERE ordinal // 9 % 8 <> 5 GROUP BY 1, 2),
i AS (SELECT track_id, position, CASE WHEN position % 11 = 3 THEN a - 2 ELSE a END AS first, CASE WHEN position % 13 = 6 THEN b + 100000 WHEN position % 7 = 4 THEN a - 1 ELSE b END AS last,
  CASE WHEN position % 6 = 1 THEN 0 ELSE greatest(0, n * (position % 4) * 5 - 1) END AS ws, CASE WHEN position % 5 = 2 THEN 0 ELSE 1 END AS wt FROM g),
w AS (SELECT *, coalesce(speaker, '') AS who FROM words),
j AS (SELECT i.*, f.who AS who, CASE WHEN f.who IS NULL OR l.who IS NULL THEN 'outside' WHEN last < first THEN 'inverted' WHEN f.who <> l.who THEN 'two_speakers' END AS broken
  FROM i LEFT JOIN w f ON f.track_id = i.track_id AND f.ordinal = first LEFT JOIN w l ON l.track_id = i.track_id AND l.ordinal = last),
c AS (SELECT j.*, w.ordinal, w.start_ms, w.end_ms FROM j JOIN w ON w.track_id = j.track_id AND w.who = j.who AND w.ordinal BETWEEN first AND last WHERE broken IS NULL),
t AS (SELECT track_id, position, any_value(ws) AS ws, any_value(wt) AS wt, greatest(0, max(end_ms) - arg_min(start_ms, ordinal)) AS ms FROM c GROUP BY 1, 2),
s AS (SELECT w.track_id, w.ordinal, n, count(n) OVER (PARTITION BY w.track_id, who) AS heard, row_number() OVER (PARTITION BY w.track_id, who ORDER BY w.ordinal) AS place
  FROM w LEFT JOIN (SELECT track_id, ordinal, count(*) AS n FROM c GROUP BY 1, 2) k ON k.track_id = w.track_id AND k.ordinal = w.ordinal)
SELECT track_id, position, CAST(NULL AS BIGINT) AS ordinal, broken AS kind FROM j WHERE broken IS NOT NULL
UNION ALL SELECT track_id, position, NULL, 'no_source' FROM t WHERE ws = 0 UNION ALL SELECT track_id, position, NULL, 'no_translation' FROM t WHERE wt = 0
UNION ALL SELECT track_id, position, NULL, 'too_long' FROM t WHERE ms > 8000 AND 2 * greatest(ws, wt) >= 84
UNION ALL SELECT track_id, position, NULL, 'too_wide_source' FROM t WHERE ws > 84 AND 2 * ms >= 8000
UNION ALL SELECT track_id, NULL, ordinal, CASE WHEN n > 1 THEN 'doubled' WHEN heard > 0 THEN 'uncovered' ELSE 'silent' END FROM s WHERE n > 1 OR (n IS NULL AND heard > 0) OR (heard = 0 AND place = 1)""",
    ),
    "batch_journal": (
        lambda s, d: jr.batch_journal(_attempts(s, d)),
        f"""WITH {TRACE}, a AS (SELECT operation_id AS batch_id, created_us AS t, event_id AS seq, CASE state WHEN 'completed' THEN 'complete' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status, model FROM trace),
l AS (SELECT batch_id, arg_max(status, (t, seq)) AS status, arg_max(model, (t, seq)) FILTER (status = 'complete' AND model IS NOT NULL) AS response, arg_max('e' || CAST(seq AS VARCHAR), (t, seq)) FILTER (status = 'failed') AS error,
  min(t) AS started_us, max(t) AS seen, count(*) FILTER (status = 'running') AS n_attempts FROM a GROUP BY 1)
SELECT batch_id, status, response, error, started_us, CASE WHEN status <> 'running' THEN seen END AS finished_us, n_attempts FROM l""",
    ),
    "rename_delete_cues": (
        lambda s, d: jr.delete_cues(jr.rename_cues(fx.cues(s, d), fx.cues(s, d).where("id % 4 = 0").select("track_id", "id", (-F.col("id") - 1).alias("new_id"))), fx.cues(s, d).where("id % 3 = 0")).select("track_id", "id", "ordinal"),
        f"WITH {CUES} SELECT track_id, CASE WHEN id % 4 = 0 THEN -id - 1 ELSE id END AS id, ordinal FROM cues WHERE id % 4 = 0 OR id % 3 <> 0",
    ),
    "hop_chunks": (
        lambda s, d: fd.hop_chunks(fx.cues(s, d).select("track_id", "id", "start_ms")).groupBy("track_id", "chunk_no", "from_ms", "to_ms").agg(F.count("*").alias("n")),
        f"""WITH {CUES}, e AS (SELECT track_id, max(start_ms) // 15000 AS complete FROM cues GROUP BY 1), k AS (SELECT track_id, unnest(range(complete)) AS chunk_no FROM e)
SELECT k.track_id, chunk_no, greatest(0, chunk_no * 15000 - 5000) AS from_ms, (chunk_no + 1) * 15000 AS to_ms, count(*) AS n FROM k JOIN cues c ON c.track_id = k.track_id
  AND c.start_ms >= chunk_no * 15000 - 5000 AND c.start_ms < (chunk_no + 1) * 15000 GROUP BY ALL""",
    ),
    "new_samples": (
        lambda s, d: fd.new_samples(fx.cues(s, d).withColumnRenamed("ordinal", "seq")),
        f"""WITH {CUES} SELECT track_id, ordinal AS seq, greatest(start_ms, coalesce(fed, start_ms)) AS from_ms, end_ms AS to_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY track_id ORDER BY ordinal
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fed FROM cues) WHERE end_ms > greatest(start_ms, coalesce(fed, start_ms))""",
    ),
    "append_only_words": (
        lambda s, d: fd.append_only_words(_feed(s, d)),
        f"""WITH RECURSIVE {WORDS}, f AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY ordinal) AS p, start_ms, text, lower(trim(text)) AS k FROM words),
fold AS (SELECT DISTINCT track_id, CAST(0 AS BIGINT) AS p, false AS keep, CAST(0 AS BIGINT) AS start_ms, '' AS text, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last_ms, CAST([] AS STRUCT(s BIGINT, k VARCHAR)[]) AS recent FROM f
  UNION ALL SELECT track_id, p, keep, start_ms, text, n + CAST(keep AS BIGINT), CASE WHEN keep THEN start_ms ELSE last_ms END, CASE WHEN keep THEN list_append(recent, {{'s': start_ms, 'k': k}})[-80:] ELSE recent END
  FROM (SELECT f.*, o.n, o.last_ms, o.recent, coalesce(f.start_ms >= o.last_ms, true) AND len(list_filter(o.recent, lambda x: abs(x.s - f.start_ms) <= 600 AND x.k = f.k)) = 0 AS keep FROM fold o JOIN f ON f.track_id = o.track_id AND f.p = o.p + 1))
SELECT track_id, n - 1 AS ordinal, start_ms, text FROM fold WHERE keep""",
    ),
    "document_defects": (
        lambda s, d: pb.document_defects(_damaged(s, d)),
        f"""WITH {CUES}, l AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS n, coalesce(speaker, '') AS name,
  CAST(round_even(start_ms / 10.0, 0) AS BIGINT) * 10 AS s, CAST(round_even(end_ms / 10.0, 0) AS BIGINT) * 10 AS e,
  CASE WHEN translated IS NULL AND source = 'signup' THEN 'empty_text' WHEN translated IS NULL AND source = 'click' THEN 'unparsable' END AS problem FROM cues),
m AS (SELECT *, max(s) OVER o AS latest, max(e) OVER o AS any_end, max(CASE WHEN name = '' THEN e END) OVER o AS blank_end,
  max(e) OVER (PARTITION BY track_id, name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_end
  FROM l WHERE problem IS NULL WINDOW o AS (PARTITION BY track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT track_id, n AS line_no, problem AS kind FROM l WHERE problem IS NOT NULL UNION ALL SELECT track_id, n, 'end_before_start' FROM m WHERE e < s
UNION ALL SELECT track_id, n, 'out_of_order' FROM m WHERE s < latest UNION ALL SELECT track_id, n, 'overlap' FROM m WHERE s < CASE WHEN name = '' THEN any_end ELSE greatest(own_end, blank_end) END""",
    ),
    "changed_tracks": (
        lambda s, d: fd.changed_tracks(fx.cues(s, d), fx.cues(s, d).withColumn("source", F.when(F.col("id") % 997 == 0, "x").otherwise(F.col("source")))),
        f"WITH {CUES} SELECT DISTINCT track_id FROM cues WHERE id % 997 = 0",
    ),
    "translate_missing": (
        lambda s, d: bk.translate_missing(fx.cues(s, d), _echo).select("track_id", "id", "translated"),
        f"WITH {CUES} SELECT track_id, id, coalesce(translated, 't:' || source) AS translated FROM cues",
    ),
    "publish_documents": (
        lambda s, d: _published(s, d)[0],
        f"""WITH {CUES}, m AS (SELECT unnest(['source', 'translated', 'bilingual']) AS mode, unnest(['.source.ass', '.translated.ass', '.en-xx.ass']) AS suffix), {HEADERS}
SELECT c.track_id, mode, CAST(c.track_id AS VARCHAR) || suffix AS file, any_value(header) || string_agg('Dialogue: 0,' || {STAMP_START} || ',' || {STAMP_END} || ',Default,' || coalesce(speaker, '') || ',0,0,0,,' ||
  CASE WHEN mode = 'source' OR translated IS NULL THEN source WHEN mode = 'translated' THEN translated ELSE translated || '\\N' || source END || chr(10), '' ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS document
FROM cues c CROSS JOIN m JOIN headers h ON h.kind = c.track_id % 3 GROUP BY c.track_id, mode, suffix""",
    ),
    "canonical_documents": (
        _canonical,
        f"""WITH {CUES}, {HEADERS} SELECT c.track_id, CASE WHEN c.track_id % 2 = 0 THEN any_value(header) || string_agg('Dialogue: 0,' || {STAMP_START} || ',' || {STAMP_END} || ',Default,' || coalesce(speaker, '') || ',0,0,0,,' ||
  CASE WHEN translated IS NULL THEN source ELSE translated || '\\N' || source END || chr(10), '' ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) END AS canonical
FROM cues c JOIN headers h ON h.kind = c.track_id % 3 GROUP BY c.track_id""",
    ),
    "publish_gate": (
        lambda s, d: pb.publish_gate(*_reviewed(s, d)),
        f"""WITH {CUES}, l AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_ms, end_ms, coalesce(speaker, ''), ordinal) AS n, coalesce(speaker, '') AS name,
  CAST(round_even(start_ms / 10.0, 0) AS BIGINT) * 10 AS s, CAST(round_even(end_ms / 10.0, 0) AS BIGINT) * 10 AS e FROM cues),
v AS (SELECT 'own' AS side, * FROM l WHERE track_id % 7 = 3 UNION ALL SELECT 'reviewed', track_id, n, name, CASE WHEN s < 3600000 THEN s + 3600000 ELSE s END, e FROM l WHERE track_id % 7 = 3),
m AS (SELECT *, max(s) OVER o AS latest, max(e) OVER o AS any_end, max(CASE WHEN name = '' THEN e END) OVER o AS blank_end,
  max(e) OVER (PARTITION BY side, track_id, name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own_end
  FROM v WINDOW o AS (PARTITION BY side, track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT side, track_id, 'end_before_start' AS kind FROM m WHERE e < s UNION SELECT side, track_id, 'out_of_order' FROM m WHERE s < latest
  UNION SELECT side, track_id, 'overlap' FROM m WHERE s < CASE WHEN name = '' THEN any_end ELSE greatest(own_end, blank_end) END),
t AS (SELECT DISTINCT track_id, track_id % 7 AS damage FROM l)
SELECT track_id, 'translated' AS mode, kind FROM (SELECT track_id, kind FROM k WHERE side = 'reviewed' EXCEPT SELECT track_id, kind FROM k WHERE side = 'own')
UNION ALL SELECT track_id, 'translated', 'unparsable' FROM t WHERE damage = 1 UNION ALL SELECT track_id, 'translated', 'empty' FROM t WHERE damage IN (1, 2)
UNION ALL SELECT track_id, 'translated', 'drift' FROM t WHERE damage IN (1, 2, 3)""",
    ),
    "monotone_progress": (
        lambda s, d: pg.monotone_progress(_progress(s, d)).select("plan", "seq", "stage", F.round("fraction", 9).alias("fraction")),
        """WITH p AS (SELECT user_id AS plan, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS stage, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 40)) AS f FROM events)
SELECT plan, seq, stage, round(max(f) OVER (PARTITION BY plan, stage ORDER BY seq ROWS UNBOUNDED PRECEDING), 9) AS fraction FROM p""",
    ),
    "eta": (
        lambda s, d: pg.remaining_seconds(_progress(s, d), _stages(s, d)),
        """WITH p AS (SELECT user_id AS plan, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS stage, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 40)) AS fraction, epoch_us(ts) / 1000000 AS at_s FROM events),
st(stage, start, span) AS (VALUES ('signup', 0.0::DOUBLE, 0.25::DOUBLE), ('click', 0.25, 0.25), ('view', 0.5, 0.25), ('purchase', 0.75, 0.25)),
c AS (SELECT *, coalesce(CAST(stage <> lag(stage) OVER (PARTITION BY plan ORDER BY seq) AS INT), 0) AS changed FROM p JOIN st USING (stage)),
d AS (SELECT *, sum(changed) OVER (PARTITION BY plan ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c),
e AS (SELECT *, max(fraction) OVER w AS f, greatest(0.0::DOUBLE, at_s - first_value(at_s) OVER w) AS elapsed FROM d WINDOW w AS (PARTITION BY plan, run ORDER BY seq ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, sum(CAST(f >= 1 AND elapsed >= 1 AS INT)) OVER (PARTITION BY plan, stage ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 AND f >= 1 AND elapsed >= 1 AS counts FROM e),
h AS (SELECT *, sum(CASE WHEN counts THEN span END) OVER o AS spans, sum(CASE WHEN counts THEN elapsed END) OVER o AS seconds FROM g WINDOW o AS (PARTITION BY plan ORDER BY seq ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, CASE WHEN spans > 0 THEN seconds / spans END AS usual, CASE WHEN elapsed >= 1 AND f > 0 THEN elapsed / (span * f) END AS own, least(1.0::DOUBLE, f / 0.25::DOUBLE) AS trust, greatest(0.0::DOUBLE, 1 - start - span) AS later FROM h)
SELECT plan, seq, stage, CAST(ceil(CASE WHEN f < 1 THEN CASE WHEN coalesce(own, usual) IS NOT NULL THEN greatest(1.0::DOUBLE, span * (1 - f) * coalesce(own, usual) + later * coalesce(usual * (1 - trust) + own * trust, own, usual)) END
  WHEN later <= 0.000000001::DOUBLE THEN 0.0::DOUBLE ELSE later * usual END) AS BIGINT) AS remaining_s FROM r""",
    ),
}
