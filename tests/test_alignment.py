"""Alignment on small examples: silences, tokens, attempts, crosstalk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions import text as tx
from tempora.operators import alignment as al
from tempora.operators import intervals as iv
from tempora.operators import journal as jr
from tempora.operators import words as wd

CUE = "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string, confidence double"


def cues(spark, rows):
    return spark.createDataFrame([(1, i, i, int(s * 1000), int(e * 1000), *(x[0] if x else None,), "s", "t", 0.55) for i, (s, e, *x) in enumerate(rows)], CUE)


def spans(spark, rows):
    return spark.createDataFrame([(1, int(a * 1000), int(b * 1000)) for a, b in rows], "track_id long, start_ms long, end_ms long")


def starts(df):
    return [r.start_ms / 1000 for r in df.orderBy("ordinal").collect()]


@pytest.mark.parametrize(
    ("rows", "heard", "want"),
    [
        ([(1, 50)], [(0, 2), (13, 15), (30, 32), (40, 45)], [37]),
        ([(0, 20), (20, 50)], [(0, 2), (8, 14), (20, 22)], [0, 20]),
        ([(0, 20)], [(10, 12)], [7]),  # the silence before the first span counts
        ([(1, 50, "1"), (40, 60, "2"), (61, 110, "1")], [(0, 2), (30, 32), (40, 45), (90, 105)], [1, 40, 87]),
        ([(0, 20)], [], [0]),
    ],
)
def test_long_silences(spark, rows, heard, want):
    assert starts(iv.long_silence_starts(cues(spark, rows), iv.merge_intervals(spans(spark, heard)))) == want


def tokens(spark, first, second=None, text="hello"):
    listed = [{"text": "[_BEG_]"}, {"text": text, "offsets": {"from": first[0], "to": first[1]}}]
    listed += [{"text": "next", "timestamps": {"from": f"00:00:0{second[0] / 1000}".replace(".", ","), "to": second[1] / 1000}}] if second else []
    return al.leading_tokens(spark.createDataFrame([(1, 0, json.dumps(listed))], "track_id long, id long, tokens string"))


@pytest.mark.parametrize(
    ("cue", "token", "text", "heard", "want"),
    [
        ((0.5, 2.5), (1050, 1250), "hello", [(0, 1), (2, 3)], 2),
        ((0.5, 4.5), (1000, 2500), "hello", [(0, 1), (2, 3), (4, 5)], 4),
        ((0.5, 2.5), (1050, 1250), "hello", [(0, 1), (1.319, 3)], 0.5),
        ((0.5, 2.5), (1050, 1250), "hello", [(0, 1), (1.32, 3)], 1.32),
        ((0.5, 2.5), (1050, 1250), "私", [(0, 1), (1.16, 3)], 1.16),
        ((0.5, 2.5), (1100, 1200), "hello", [(0, 1), (2, 3)], 2),
        ((0.5, 2.5), (1110, 1200), "hello", [(0, 1), (2, 3)], 0.5),  # not across all of the silence
    ],
)
def test_first_token_across_a_silence(spark, cue, token, text, heard, want):
    found = iv.align_to_speech(cues(spark, [cue]), spans(spark, heard), tokens(spark, token, text=text))
    assert starts(found) == [want]
    across = al.token_starts(cues(spark, [cue]), spans(spark, heard), tokens(spark, token, text=text)).count()
    assert across == (want != 0.5)


def test_second_token_needs_confirmation(spark):
    c, heard = cues(spark, [(0.1, 3.5)]), spans(spark, [(0, 1), (2, 3)])
    t = tokens(spark, (900, 1050), (1050, 1300))
    assert [(r.text, [(x.start_ms, x.end_ms) for x in r.ranges]) for r in t.collect()] == [("hello", [(900.0, 1050.0), (1050.0, 1300.0)])]
    go = lambda voiced: [r.token_ms for r in al.token_starts(c, heard, t, voiced).collect()]
    assert go(None) == [] and go(spans(spark, [])) == [2000] and go(spans(spark, [(0.5, 0.85)])) == [2000] and go(spans(spark, [(0.5, 0.86)])) == []


def test_tokens_end_at_the_first_without_times(spark):
    listed = [[{"text": "<|en|>"}, {"text": "a", "offsets": {"from": 5, "to": 1}}, {"text": "b", "offsets": {"from": 1, "to": 2}}], [{"text": "a", "offsets": {"from": True, "to": 2}, "timestamps": {"from": 0.5, "to": "1,5"}}, {"text": "b"}], [{"text": ""}], []]
    df = spark.createDataFrame([(1, i, json.dumps(t)) for i, t in enumerate(listed)] + [(1, 9, None)], "track_id long, id long, tokens string")
    assert {r.id: (r.text, [tuple(x) for x in r.ranges]) for r in al.leading_tokens(df).collect()} == {0: ("a", []), 1: ("a", [(500.0, 1500.0)])}


def test_alignment_to_speech(spark):
    rows = [(0.0, 1.0), (1.2, 1.9, "1"), (1.5, 2.5, "2"), (3.0, 4.0), (6.0, 7.0), (9.0, 9.4)]
    got = iv.align_to_speech(cues(spark, rows), spans(spark, [(0.0, 0.9), (3.4, 3.9), (6.01, 7.3)])).orderBy("ordinal").collect()
    assert [(r.start_ms, r.end_ms, r.confidence) for r in got] == [(0, 900, 0.75), (1200, 1900, 0.55), (1500, 2500, 0.55), (3400, 3900, 0.9), (6000, 7300, 0.75), (9000, 9400, 0.35)]
    voiced = spans(spark, [(3.4, 3.9)])
    assert [r.confidence for r in iv.align_to_speech(cues(spark, [(3.0, 4.0)]), spans(spark, []), None, voiced).collect()] == [0.9]


def test_normalizing_leaves_crosstalk_and_orders_first(spark):
    c = cues(spark, [(0.5, 1.2, "1"), (0.7, 1.5, "2"), (0.75, 0.9), (-1.0, 0.1), (2.0, 1.9)])
    got = [(r.id, r.parent_id, r.start_ms, r.end_ms) for r in iv.normalize_timeline(c, 800).orderBy("id").collect()]
    assert got == [(1, 3, 0, 100), (2, 0, 500, 1200), (3, 1, 700, 1500), (4, 2, 750, 800), (5, 4, 800, 800)]


def test_crosstalk_equals_all_pairs(spark):
    rnd = random.Random(4)
    rows = [(s / 10, (s + rnd.randint(-2, 60)) / 10, rnd.choice("abcd") if rnd.random() < 0.9 else "") for s in (rnd.randint(0, 900) for _ in range(300))]
    ms = [(int(s * 1000), int(e * 1000), x) for s, e, x in rows]
    want = {i for i, x in enumerate(ms) for y in ms if x[2] and y[2] and x[2] != y[2] and x[0] < y[1] and y[0] < x[1]}
    assert {r.id for r in iv.crosstalk_ids(cues(spark, rows)).collect()} == want and 0 < len(want) < len(rows)


def test_voiced_spans_reach_the_threshold(spark):
    level = [0.0] * 10 + [8.0] * 3 + [0.0] + [9.0] * 4 + [7.9] * 5 + [8.0] * 2 + [0.0] * 10
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(level)] + [(2, i, 0.0) for i in range(5)], "track_id long, window_idx long, level double")
    assert [(r.track_id, r.start_ms, r.end_ms) for r in jr.voiced_spans(df).collect()] == [(1, 200, 360)]


def body(*segments, words=None):
    return json.dumps({"segments": [{"text": t, "words": w} for t, w in segments], **({"word_segments": words} if words else {})})


def word(s, e, score=0.8, text="w"):
    return {"word": text, **({"start": s} if s is not None else {}), **({"end": e} if e is not None else {}), "score": score}


def test_attempts(spark):
    c = cues(spark, [(2, 3), (5, 6), (8, 9), (10, 12, "1"), (11, 13, "2"), (15, 16)])
    windows = {(r.id, r.attempt): (r.from_ms, r.to_ms) for r in al.attempt_windows(c, 20_000).collect()}
    assert windows[(0, 1)] == (1800, 3500) and windows[(0, 2)] == (0, 5000) and {i for i, _ in windows} == {0, 1, 2, 5}
    bodies = {
        (0, 1): body(("x", [word(0.01, 0.5)])), (0, 2): body(("a", [word(2.5, 2.9, 0.5), word(2.1, 2.4, 1.0)]), (" b ", [word(3.0, 3.2), word(None, None)])),
        (1, 1): body(("x", [word(0.1, 0.2, 0.0)])), (1, 2): None,
        (2, 1): body(words=[word(0.3, 1.0, None)]),
        (5, 1): body(("x", [word(0.3, None)])), (5, 2): body(("x", [])),
    }
    rows = [(1, i, n, *windows[(i, n)], b) for (i, n), b in bodies.items()]
    attempts = spark.createDataFrame(rows, "track_id long, id long, attempt int, from_ms long, to_ms long, body string")
    judged = al.judged_attempts(attempts, 20_000)
    assert {(r.id, r.attempt): r.outcome for r in judged.collect()} == {
        (0, 1): "boundary-clipped", (0, 2): "success", (1, 1): "zero-first-token-score", (1, 2): "failed", (2, 1): "success", (5, 1): "failed", (5, 2): "failed",
    }
    parts = sorted((r.id, r.start_ms, r.end_ms, r.source, r.translated, r.confidence) for r in al.aligned_cues(c, judged).collect())
    assert parts == [(0, 2100, 2900, "a", None, 0.75), (0, 3000, 3200, "b", None, 0.8), (2, 8100, 8800, "s", "t", None)]
    out = al.align(c, "external", 20_000, spans=spans(spark, [(5.1, 6.2)]), attempts=attempts).orderBy("id").collect()
    assert [(r.parent_id, r.start_ms, r.backend) for r in out] == [(0, 2100, "forced"), (0, 3000, "forced"), (1, 5100, "fallback"), (2, 8100, "forced"), (3, 10000, "kept"), (4, 11000, "kept"), (5, 15000, "fallback")]
    told = {r.parent_id: (r.attempts and [a.outcome for a in r.attempts], r.words and [tuple(w) for w in r.words]) for r in out[2:]}
    assert told == {1: (["zero-first-token-score", "failed"], [("w", 4900, 5000, 0.0)]), 2: (["success"], [("w", 8100, 8800, None)]), 3: (None, None), 4: (None, None), 5: (["failed", "failed"], None)}
    lenient = {(r.id, r.attempt): [tuple(w) for w in r.words or []] for r in al.lenient_words(attempts, 20_000).collect()}
    assert lenient[(1, 1)] == [("w", 4900, 5000, 0.0)] and lenient[(5, 1)] == [("w", 15100, None, 0.8)]
    with pytest.raises(ValueError):
        al.align(c, "other", 1)


def test_extended_ends_inside_the_duration(spark):
    c = cues(spark, [(0, 1), (1.5, 3), (2.9, 9, "a"), (4, 9.5, "b"), (9.2, 9.1)])
    got = [(r.start_ms, r.end_ms) for r in iv.extend_cue_ends(c, 9_000).orderBy("ordinal").collect()]
    assert got == [(0, 1500), (1500, 2900), (2900, 9000), (4000, 9500), (9000, 9000)]


def test_event_text_and_times(spark):
    row = spark.range(1).select(
        tx.event_lines(F.lit("a\\N \\nb\\Nc")).alias("l"), *[tx.parse_timestamp_ms(F.lit(f"0:00:01.{x}")).alias(f"t{x}") for x in ("5", "25", "125", "135", "999")],
        tx.ends_sentence(F.lit("Oui.› ")).alias("q"), tx.word_key(F.lit("　ΣΟΦΟΣ ")).alias("k"), tx.word_key(F.lit("σοφος")).alias("m"),
        tx.special_token(F.lit("<|x|>")).alias("s"), tx.is_url(F.lit("https:///x")).alias("u"), tx.is_word_range_id(tx.word_range_id(F.lit(3), F.lit(9))).alias("w"),
    ).first()
    assert tuple(row)[:7] == (["a", "b", "c"], 1500, 1250, 1120, 1140, 2000, True) and row.k == row.m and (row.s, row.u, row.w) == (True, False, True)


def test_token_times(spark):
    values = {"1050": 1050.0, "1.5": 1500.0, '"00:00:01,250"': 1250.0, '"2.5"': 2500.0, "true": None, '"x"': None, "null": None, "1e3": 1_000_000.0, '"1:2"': None}
    df = spark.createDataFrame([(k,) for k in values], "v string")
    assert {r.v: r.t for r in df.select("v", tx.token_ms(F.col("v")).alias("t")).collect()} == values


def test_documents_only_count_events(spark):
    line = "Dialogue: 0,0:00:01.00,0:00:02.00,Default,,0,0,0,,x"
    doc = f"﻿[Script Info]\n{line}\n [Events] \n  {line.lower()} \n{line}\n[Other]\n{line}\nDialogue: 0,1"
    got = jr.parse_documents(spark.createDataFrame([(1, doc)], "track_id long, document string")).orderBy("line_no").collect()
    assert [(r.line_no, r.problem, r.lines) for r in got] == [(3, None, ["x"]), (4, None, ["x"])]


def test_sources_are_corrected(spark):
    c = cues(spark, [(0, 1), (1, 2), (2, 3)])
    replies = spark.createDataFrame([(1, "0", " new ", " ok "), (1, "1", " ", "x"), (1, "2", "y", "")], "track_id long, id string, source string, translated string")
    get = lambda **k: [(r.source, r.translated) for r in jr.apply_replies(c, replies, **k).orderBy("id").collect()]
    assert get() == [("new", "ok"), ("s", "x"), ("y", "t")] and get(source_edits=False) == [("s", "ok"), ("s", "x"), ("s", "t")]


WORD = "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long"


def test_segments_join_texts_as_they_are(spark):
    rows = [("Hi ", 0, 100), ("you. ", 100, 200), ("“No.” ", 250, 300), ("so ", 310, 9_000), ("x" * 42, 9_001, 9_100), ("y", 9_950, 9_960)]
    df = spark.createDataFrame([(1, i, "0", *r) for i, r in enumerate(rows)] + [(1, 9, None, "  ", 0, 1)], WORD)
    got = [(r.first, r.last, r.text, r.id) for r in wd.segment_words(df).orderBy("first").collect()]
    assert got == [(0, 1, "Hi you.", "preview-1"), (2, 2, "“No.”", "preview-2"), (3, 3, "so", "preview-3"), (4, 4, "x" * 42, "preview-4"), (5, 5, "y", "preview-5")]


def squeezed(rows, least=50, longest=5000):
    """The rule, change by change over a whole track."""
    weight = [max(1, len(t.strip())) for _, t, _, _ in rows]
    pace = {}
    for who in {r[0] for r in rows}:
        for scope in ([i for i, r in enumerate(rows) if r[0] == who], range(len(rows))):
            own = sorted((rows[i][3] - rows[i][2]) / weight[i] for i in scope if rows[i][3] - rows[i][2] >= least)
            if len(own) >= 3:
                pace[who] = (own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2
                break
        pace.setdefault(who, 60.0)
    t = [[r[2], r[3]] for r in rows]
    for i in range(len(rows) - 1):
        who = rows[i][0]
        if who is None or rows[i + 1][0] == who:
            continue
        run = []
        for j in range(i, -1, -1):
            if rows[j][0] == who:
                if t[j][1] - t[j][0] >= least:
                    break
                run.insert(0, j)
        if run:
            begin = t[run[0]][0]
            end = min([begin + sum(weight[j] for j in run) * pace[who], begin + longest, *[t[j][0] for j in range(i + 1, len(rows)) if rows[j][0] == who][:1]])
            if end > max(begin, t[run[-1]][1]):
                done, total = 0, sum(weight[j] for j in run)
                for j in run:
                    t[j][0] = round(begin + (end - begin) * done / total)
                    done += weight[j]
                    t[j][1] = round(begin + (end - begin) * done / total)
    return t


def test_squeezed_words_equal_the_rule(spark):
    rnd = random.Random(6)
    rows, at = [], 0
    for i in range(400):
        size = rnd.choice([10, 10, 10, 49, 50, 200])
        rows.append((rnd.choice(["0", "0", "1", "1", None, ""]) if i % 3 == 0 or not rows else rows[-1][0], "w" * rnd.randint(1, 9), at, at + size))
        at += size + rnd.choice([0, 5, 300])
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], WORD)
    got = [[r.start_ms, r.end_ms] for r in wd.repair_squeezed_words(df).orderBy("ordinal").collect()]
    assert got == squeezed(rows) and got != [list(r[2:]) for r in rows]


def test_touched_ranges_equal_the_pairs_and_make_none(spark):
    rnd = random.Random(4)
    span = lambda wide: (lambda a: (a, a + rnd.randrange(wide)))(rnd.randrange(5_000))
    ranges = [(i % 2, i, *span(200)) for i in range(200)]
    voiced = [(rnd.randrange(3), *span(120)) for _ in range(60)]
    got = al.touched(spark.createDataFrame(ranges, "track_id long, id long, from_ms long, to_ms long"), spark.createDataFrame(voiced, "track_id long, start_ms long, end_ms long"), 40)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {r for r in ranges if any(t == r[0] and b >= r[2] - 40 and a <= r[3] + 40 for t, a, b in voiced)}
