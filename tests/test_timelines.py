"""Timeline operators on small examples, at, just below and just above each threshold."""

import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import text as tx
from tempora.operators import intervals as iv
from tempora.operators import journal as jr
from tempora.operators import words as wd
from tempora.plans import registry

CUE = "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string"


def cues(spark, rows):
    return spark.createDataFrame([(1, i, i, *r) for i, r in enumerate(rows)], CUE)


def test_cue_ends_by_gap(spark):
    gaps = [690, 700, 710, 990, 1000]
    rows, at = [], 0
    for g in gaps:
        rows.append((at, at + 1000, "a"))
        at += 1000 + g
    rows.append((at, at + 1000, "a"))
    got = [r.end_ms for r in iv.extend_cue_ends(cues(spark, rows), duration_ms=at + 1200).orderBy("id").collect()]
    want = [r[1] + x for r, x in zip(rows, [690, 700, 355, 495, 500, 200], strict=True)]
    assert got == want


def test_crosstalk_needs_two_names_and_real_overlap(spark):
    rows = [(0, 100, "a"), (100, 200, "b"), (150, 160, "a"), (150, 150, "b"), (155, 300, None), (400, 500, "a"), (450, 460, "a")]
    got = {r.id for r in iv.crosstalk_ids(cues(spark, rows)).collect()}
    brute = {i for i, x in enumerate(rows) for y in rows if x[2] and y[2] and x[2] != y[2] and x[0] < y[1] and y[0] < x[1]}
    assert got == brute


def test_range_joins_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(s, s + rnd.randint(0, 9000), rnd.choice(["a", "b", None])) for s in (rnd.randint(0, 60_000) for _ in range(80))]
    got = {r.id for r in iv.crosstalk_ids(cues(spark, rows)).collect()}
    assert got == {i for i, x in enumerate(rows) for y in rows if x[2] and y[2] and x[2] != y[2] and x[0] < y[1] and y[0] < x[1]}


def test_merge_intervals_equals_a_fold(spark):
    rnd = random.Random(3)
    spans = [(s, s + rnd.randint(-5, 60)) for s in (rnd.randint(0, 2000) for _ in range(200))] + [(3000, 3010), (3020, 3030), (3041, 3050)]
    out = []
    for s, e in sorted(x for x in spans if x[1] >= x[0]):
        if out and s <= out[-1][1] + 10:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    df = spark.createDataFrame([(1, *x) for x in spans], "track_id long, start_ms long, end_ms long")
    assert sorted([r.start_ms, r.end_ms] for r in iv.merge_intervals(df).collect()) == out


@pytest.mark.parametrize(("ms", "stamp"), [(5, "0:00:00.00"), (15, "0:00:00.02"), (59995, "0:01:00.00"), (3599999, "1:00:00.00"), (-7, "0:00:00.00")])
def test_timestamps(spark, ms, stamp):
    r = spark.range(1).select(tx.format_timestamp(F.lit(ms)).alias("t"), tx.parse_timestamp_ms(F.lit(stamp)).alias("b")).first()
    assert r.t == stamp and r.b == round(max(ms, 0) / 10) * 10


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.text_weight(F.lit("a日本é")).alias("w"), tx.normalize_speaker(F.lit("speaker_ ")).alias("s"), tx.normalize_language(F.lit("EN_us")).alias("l"),
        tx.ends_sentence(F.lit('Yes.”')).alias("e"), tx.overlap_key(F.lit(" Straße\u00a0 A ")).alias("k"), tx.clock_ms(F.lit("01:02:03,250")).alias("c"),
        tx.event_lines(F.lit("a\\N \\Nb\\n c ")).alias("n"), tx.parse_timestamp_ms(F.lit("x")).alias("x"), tx.parse_timestamp_ms(F.lit("0:00:01.5")).alias("t"),
    ).first()
    assert tuple(row) == (6, None, "en", True, "strasse a", 3_723_250, ["a", "b", "c"], None, 1500)


def test_batches_lose_no_word(spark):
    rnd = random.Random(1)
    rows, at = [], 0
    for i in range(700):
        rows.append((1, i, "0", "w", at, at + 100))
        at += 100 + rnd.choice([0, 0, 0, 0, 0, 800, 1200])
    df = spark.createDataFrame(rows, "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long")
    got = sorted((r["first"], r["last"]) for r in wd.split_word_batches(df, 20).collect())
    assert got[0][0] == 0 and got[-1][1] == 699 and all(b[0] == a[1] + 1 for a, b in zip(got, got[1:], strict=False))
    assert all(b - a + 1 <= 40 for a, b in got)
    silent = df.withColumns({"start_ms": F.col("ordinal") * 100, "end_ms": F.col("ordinal") * 100 + 100})
    assert all(r.forced_end == (r["last"] != 699) for r in wd.split_word_batches(silent, 20).collect())
    covered = sum(r["last"] - r["first"] + 1 for r in wd.segment_words(df).collect())
    assert covered == 700


def test_upsert_keeps_translations_and_leaves_gaps(spark):
    kind = "track_id long, id long, ordinal long, start_ms long, end_ms long, translated string"
    old = spark.createDataFrame([(1, 7, 0, 0, 1, "t"), (1, 8, 1, 1, 2, None)], kind)
    new = spark.createDataFrame([(1, 7, 0, 5, 6, None), (1, 9, 1, 7, 8, "n"), (1, 8, 2, 1, 2, "u"), (1, 10, 3, 9, 9, None)], kind)
    got = {r.id: (r.ordinal, r.start_ms, r.translated) for r in jr.upsert_cues(old, new).collect()}
    assert got == {7: (0, 5, "t"), 8: (1, 1, "u"), 9: (3, 7, "n"), 10: (5, 9, None)}


def test_documents_round_trip_and_problems(spark):
    kind = "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string"
    df = spark.createDataFrame([(1, 1, 0, 10, 1010, "a,b", "hi {x}", "ho"), (1, 2, 1, 2000, 3000, None, "two", None)], kind)
    doc = jr.render_documents(df).first().document
    rows = jr.parse_documents(spark.createDataFrame([(1, "﻿[Events]\r\n" + doc.replace("\n", "\r\n") + "\r\nDialogue: 0,x\r\nDialogue: 0,0:00:00.00,0:00:01.00,D,,0,0,0,, ")], "track_id long, document string")).orderBy("line_no").collect()
    assert [(r.start_ms, r.end_ms, r.name, r.lines, r.problem) for r in rows[:2]] == [(10, 1010, "a b", ["ho", "hi ｛x｝"], None), (2000, 3000, "", ["two"], None)]
    assert [r.problem for r in rows[2:]] == ["unparsable", "empty_text"]


def test_plans_have_no_nested_loop(spark, sf_dir):
    for name in ("crosstalk_ids", "long_silence_start", "vad_start_candidates", "remaining_speech", "refined_end"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_word_batches_take_one_shuffle_whatever_the_arrow_batches(spark):
    """Silences were joined back, and every word's key was text, grouped and dealt out again."""
    rnd, rows = random.Random(7), []
    for track in range(4):
        at = 0
        for i in range((0, 3, 45, 400)[track]):
            rows.append((track, i, "0", "w", at, at + 100))
            at += rnd.choice([150, 150, 150, 1_100, 1_500] if i % 150 > 60 else [150])
    df = spark.createDataFrame(rows, "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long")
    plan = wd.split_word_batches(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    whole = sorted(map(tuple, wd.split_word_batches(df, 20).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, wd.split_word_batches(df, 20).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r[4] for r in whole} == {True, False} and sum(z - a + 1 for _, _, a, z, _ in whole) == len(rows)
