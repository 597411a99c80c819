"""Queries over requests with context, checked replies and the names that records carry."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as tx
from ..operators import backends as bk
from ..operators import journal as jr
from ..operators import publish as pb
from ..operators import requests as rq
from ..sources import records as rc
from .sql import MISSING

CUES, WORDS = fx.CUES_SQL, fx.WORDS_SQL


def _fifties(spark, d):
    """Batches of fifty words."""
    return fx.words(spark, d).groupBy("track_id", F.floor(F.col("ordinal") / 50).cast("bigint").alias("batch_no")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def _nines(spark, d):
    """Cues of nine words."""
    n = F.floor(F.col("ordinal") / 9)
    return fx.words(spark, d).groupBy("track_id", F.concat(F.lit("c"), n).alias("id")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("speaker").alias("speaker")).withColumns({"source": F.lit("s"), "translated": F.lit("t")})


def _flawed(payload, error):
    """Stands for a service that leaves a cue out at first, then a translation, and names a cue nobody asked for, until it is told so."""
    cues = [{"id": c["id"], "source": c["source"], "translated": "t:" + c["source"]} for c in json.loads(payload)["cues"]]
    if error is None and len(cues) > 1:
        cues.pop()
    elif error is None or error.startswith("missing"):
        cues[0]["translated"] = " "
        cues.append({"id": "no such cue", "translated": "x"})
    return json.dumps({"cues": cues})


def _names(spark, d):
    docs = fx.read(spark, d, "documents")
    said = F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "_XX ").otherwise("-y"))
    inner, outer = F.to_json(F.struct(F.struct(said.alias("language")).alias("result"), F.lit("zz").alias("language"))), F.to_json(F.struct(said.alias("language")))
    auto = F.lit('{"language":"Auto"}')
    body = F.when(F.col("doc_id") % 5 == 0, auto).when(F.col("doc_id") % 3 == 0, inner).otherwise(outer)
    return docs.select("doc_id", rc.transcript_language(body).alias("language"), tx.language_component(F.concat(F.lit(" -"), "lang", F.lit(" / "), "source", F.lit("!"))).alias("component"))


def _ids(spark, d):
    e = fx.read(spark, d, "events")
    i = F.col("event_id")
    id = F.when(i % 3 == 0, tx.word_range_id(i, i + 4)).when(i % 3 == 1, F.concat(F.lit("preview-"), i.cast("string"))).otherwise(F.concat(F.lit("w"), i.cast("string"), F.lit("-x")))
    return e.select("event_id", tx.is_word_range_id(id).alias("of_words"), tx.preview_id(id).alias("preview"))


ITEM = "to_json({'id': CAST(id AS VARCHAR), 'source': source, 'translated': translated, 'speaker': speaker})"
WORD = """'{"i":' || ordinal || ',"t":' || CAST(start_ms / 1000 AS DOUBLE) || CASE WHEN speaker IS NULL THEN '' ELSE ',"s":"' || speaker || '"' END || ',"w":' || to_json(text) || '}'"""

QUERIES = {
    "cue_requests": (
        lambda s, d: rq.cue_requests(jr.missing_batches(fx.cues(s, d)), fx.cues(s, d)),
        f"""WITH {CUES}, {MISSING}, c AS (SELECT track_id, ordinal, {ITEM} AS j FROM cues)
SELECT b.track_id, b.batch_no, '{{"cues":[' || string_agg(j, ',' ORDER BY ordinal) FILTER (ordinal BETWEEN first AND last) || '],"preceding":[' || coalesce(string_agg(j, ',' ORDER BY ordinal) FILTER (ordinal < first), '')
  || '],"following":[' || coalesce(string_agg(j, ',' ORDER BY ordinal) FILTER (ordinal > last), '') || ']}}' AS payload
FROM batches b JOIN c ON b.track_id = c.track_id AND c.ordinal BETWEEN first - 10 AND last + 5 GROUP BY 1, 2""",
    ),
    "word_requests": (
        lambda s, d: rq.word_requests(_fifties(s, d), fx.words(s, d), _nines(s, d)),
        f"""WITH {WORDS}, b AS (SELECT track_id, ordinal // 50 AS batch_no, min(ordinal) AS first, max(ordinal) AS last, arg_min(start_ms, ordinal) AS start_ms FROM words GROUP BY 1, 2),
n AS (SELECT track_id, 'c' || ordinal // 9 AS id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, min(speaker) AS speaker FROM words GROUP BY 1, 2),
c AS (SELECT b.track_id, batch_no, string_agg('{{"id":"' || id || '","source":"s","translated":"t"' || CASE WHEN speaker IS NULL THEN '' ELSE ',"speaker":"' || speaker || '"' END || '}}', ',' ORDER BY n.start_ms, end_ms, id) AS j
  FROM (SELECT b.track_id, batch_no, n.start_ms, end_ms, id, speaker FROM b JOIN n ON b.track_id = n.track_id AND n.start_ms < b.start_ms QUALIFY row_number() OVER (PARTITION BY b.track_id, batch_no ORDER BY n.start_ms DESC, end_ms DESC, id DESC) <= 10) n
  JOIN b USING (track_id, batch_no) GROUP BY 1, 2),
w AS (SELECT track_id, ordinal, {WORD} AS j FROM words)
SELECT b.track_id, b.batch_no, '{{"words":[' || string_agg(w.j, ',' ORDER BY ordinal) FILTER (ordinal <= last) || '],"preceding":[' || coalesce(any_value(c.j), '') || '],"following":[' || coalesce(string_agg(w.j, ',' ORDER BY ordinal) FILTER (ordinal > last), '') || ']}}' AS payload
FROM b JOIN w ON b.track_id = w.track_id AND ordinal BETWEEN first AND last + 40 LEFT JOIN c ON c.track_id = b.track_id AND c.batch_no = b.batch_no GROUP BY 1, 2""",
    ),
    "translate_checked": (
        lambda s, d: bk.translate_missing(fx.cues(s, d), _flawed, context=(10, 5)).select("track_id", "id", "translated"),
        f"WITH {CUES} SELECT track_id, id, coalesce(translated, 't:' || source) AS translated FROM cues",
    ),
    "record_languages": (
        _names,
        """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS language, trim(regexp_replace(lower(trim(' -' || lang || ' / ' || source || '!')), '[^a-z0-9-]+', '-', 'g'), '-') AS component FROM documents""",
    ),
    "record_ids": (_ids, "SELECT event_id, event_id % 3 = 0 AS of_words, event_id % 3 = 1 AS preview FROM events"),
}
