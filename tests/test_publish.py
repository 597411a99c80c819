"""Published documents, the gate, backends and progress on small examples."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import backends as bk
from tempora.operators import journal as jr
from tempora.operators import progress as pg
from tempora.operators import publish as pb

CUE = "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string"


def cues(spark, *rows):
    return spark.createDataFrame([(t, i, i, i * 1000, i * 1000 + 900, None, s, x) for i, (t, s, x) in enumerate(rows)], CUE)


def test_header_follows_the_frame(spark):
    text = spark.range(1).select(pb.document_header(F.lit(1080), F.lit(1920))).first()[0]
    assert "PlayResX: 1080\nPlayResY: 1920\n" in text and ",36,&H00FFFFFF" in text and ",1,1.69,0.84,2,34,34,71,1\n" in text
    assert ",1,3,1.5,2,60,60,40,1\n" in spark.range(1).select(pb.document_header(F.lit(1920), F.lit(1080))).first()[0]


def test_publish_rewrite_and_gate(spark):
    frames = spark.createDataFrame([(1, 1280, 720)], "track_id long, width int, height int")
    own = pb.publish_documents(cues(spark, *[(t, "a{b}", "x") for t in (1, 2, 3, 4, 5) for _ in range(2)]), frames, ["all"], "en", "fr").cache()
    assert {r.file for r in own.where("track_id = 1").collect()} == {"1.source.ass", "1.translated.ass", "1.en-fr.ass"}
    with pytest.raises(ValueError, match="both languages"):
        pb.publish_documents(cues(spark, (1, "a", "b")), frames, ["bilingual"], "en")
    text = own.where("track_id = 2 AND mode = 'bilingual'").first().document
    assert "PlayResX: 1920\n" in text and text.count(",x\\Na｛b｝\n") == 2
    docs = own.where("mode = 'source'").select("track_id", F.when(F.col("track_id") == 2, F.concat("document", F.lit("junk\n"))).when(F.col("track_id") == 3, F.concat("document", F.lit("Dialogue: x\n"))).otherwise(F.col("document")).alias("document"))
    assert {r.track_id for r in pb.canonical_documents(docs, frames).where("canonical IS NOT NULL").collect()} == {2}
    hit = F.col("mode") == "translated"
    worse = (
        F.when(hit & (F.col("track_id") == 1), F.concat("document", F.lit("Dialogue: x\n"))).when(hit & (F.col("track_id") == 2), F.regexp_replace("document", "(?m)^Dialogue.*$", ""))
        .when(hit & (F.col("track_id") == 3), F.regexp_replace("document", "0:00:04.00", "0:00:04.10")).otherwise(F.col("document"))
    )
    got = {tuple(r) for r in pb.publish_gate(own, own.withColumn("document", worse)).collect()}
    assert got == {(1, "translated", "unparsable"), (2, "translated", "empty"), (2, "translated", "drift"), (3, "translated", "drift")}


def test_attempts_are_rows_and_replies_are_checked(spark):
    def service(payload, error):
        if error is None:
            raise RuntimeError("busy")
        items = [{"id": c["id"], "translated": c["source"].upper()} for c in json.loads(payload)]
        return "ok " + json.dumps({"cues": [*items, {"id": "77", "translated": "no"}]})

    rows = cues(spark, (1, "a", None), (1, "b", "kept"), (1, "c", ""))
    tries = bk.translate_batches(spark.createDataFrame([(1, 0, "[]")], "track_id long, batch_no long, payload string"), service)
    assert [(r.attempt, r.status, r.error) for r in tries.orderBy("attempt").collect()] == [(1, "failed", "busy"), (2, "complete", None)]
    assert {r.id: r.translated for r in bk.translate_missing(rows, service).collect()} == {0: "A", 1: "kept", 2: "C"}
    assert [bk.retry_delay(n, 1.5) for n in (1, 2, 3, 4)] == [1.5, 3.0, 6.0, 8.0] and bk.retry_delay(3, 20) == 20


def test_remaining_time_equals_a_fold(spark):
    rnd = random.Random(4)
    plan = {"a": (0.0, 0.5), "b": (0.5, 0.3), "c": (0.8, 0.2)}
    log, at = [], 0.0
    for stage in ("a", "b", "a", "c"):
        for _ in range(6):
            log.append((1, len(log), stage, rnd.choice([0.0, 0.1, 0.3, 0.9, 1.0, 1.4]), at))
            at += rnd.choice([0.4, 1.0, 7.0])
    want, state, seconds, spans, done = [], (None, 0.0, 0.0), 0.0, 0.0, set()
    for _, seq, stage, fraction, now in log:
        fraction = min(1.0, max(0.0, fraction))
        state = (stage, state[1], max(state[2], fraction)) if stage == state[0] else (stage, now, fraction)
        (start, span), f, elapsed = plan[stage], state[2], now - state[1]
        own = elapsed / (span * f) if elapsed >= 1 and f > 0 else None
        if f >= 1 and elapsed >= 1 and stage not in done:
            done.add(stage)
            seconds, spans = seconds + elapsed, spans + span
        usual, later = seconds / spans if spans else None, max(0.0, 1 - start - span)
        if f >= 1:
            want.append((seq, 0 if later <= 1e-9 else None if usual is None else math.ceil(later * usual)))
        elif own is None and usual is None:
            want.append((seq, None))
        else:
            trust = min(1.0, f / 0.25)
            then = usual if own is None else own if usual is None else usual * (1 - trust) + own * trust
            want.append((seq, math.ceil(max(1.0, span * (1 - f) * (usual if own is None else own) + later * then))))
    df = spark.createDataFrame(log, "plan long, seq long, stage string, fraction double, at_s double")
    stages = spark.createDataFrame([(1, n, *v) for n, v in plan.items()], "plan long, stage string, start double, span double")
    assert [(r.seq, r.remaining_s) for r in pg.remaining_seconds(df, stages).orderBy("seq").collect()] == want


def test_times_finer_than_shown_keep_the_order_of_a_document(spark):
    frames = spark.createDataFrame([(1, 1920, 1080)], "track_id long, width int, height int")
    rows = spark.createDataFrame([(1, 1, 0, 12, 900, "B", "a", None), (1, 2, 1, 14, 500, "A", "b", None)], CUE)
    own = pb.publish_documents(rows, frames, ["source"]).select("track_id", "document")
    assert own.first().document.index(",a\n") < own.first().document.index(",b\n")
    assert pb.canonical_documents(own, frames, finer=True).first().canonical is None
    again = pb.canonical_documents(own, frames).first().canonical  # by the hundredths alone
    assert again.index(",b\n") < again.index(",a\n")


def test_gate_reads_each_document_once(spark):
    own = spark.createDataFrame([(1, "source", "[Events]\nDialogue: 0,0:00:01.00,0:00:02.00,Default,A,0,0,0,,x\n")], "track_id long, mode string, document string")
    gate = pb.publish_gate(own, own)
    assert "posexplode" not in gate._jdf.queryExecution().optimizedPlan().toString() and not gate.collect()


def test_documents_are_folded_from_sorted_lines(spark):
    """Each task once gathered the lines of all its documents, and documents were joined with their frames."""
    rows = [(t, i, i, 5_000 - i * 10, 9_000, "B", f"s{i}", "x" if i % 2 else None) for t, n in ((1, 1), (2, 40), (4, 7)) for i in range(n)]
    frames = spark.createDataFrame([(1, 1280, 720), (3, 640, 360), (4, None, None)], "track_id long, width int, height int")
    docs = lambda: pb.publish_documents(spark.createDataFrame(rows, CUE), frames, ["all"], "en", "fr")
    plan = docs()._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
    whole = sorted(map(tuple, docs().collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, docs().collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [w[:2] for w in whole] == [(t, m) for t in (1, 2, 4) for m in ("bilingual", "source", "translated")]
    assert ["PlayResX: 1280\n" in w[3] for w in whole] == [True] * 3 + [False] * 6 and all("PlayResX: 1920\n" in w[3] for w in whole[3:])
    said = [x.rsplit(",", 1)[1] for x in whole[4][3].splitlines() if x.startswith("Dialogue")]
    assert said == [f"s{i}" for i in range(39, -1, -1)]


def test_lines_of_sections_and_marks_of_documents(spark):
    line = "Dialogue: 0,0:00:01.00, 0:00:02.5 ,Default, A ,0,0,0,,{}"
    text = "﻿" + "\r\n".join(["[Script Info]", line.format("no"), " [ EVENTS ] ", line.format("a, b\\Nc"), "[Fonts]", line.format("no"), "[Events]", " dialogue: 0,x", line.format(" ")])
    docs = spark.createDataFrame([(1, text), (2, "[Events]"), (3, None)], "track_id long, document string")
    got = sorted((r.track_id, r.line_no, r.start_ms, r.end_ms, r.name, r.lines, r.problem) for r in jr.parse_documents(docs).collect())
    assert got == [(1, 3, 1000, 2500, "A", ["a, b", "c"], None), (1, 7, None, None, "", [], "unparsable"), (1, 8, 1000, 2500, "A", [], "empty_text")]
    marked = jr.parse_documents(docs, True)
    assert sorted(r.track_id for r in marked.where("line_no = -1").collect()) == [1, 2, 3] and marked.where("line_no >= 0").count() == 3
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
