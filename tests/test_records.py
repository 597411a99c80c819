"""Readers of text records on small hand-made inputs."""

import json

from pyspark.sql import functions as F

from tempora.sources import records as rc


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_transcript_times_by_form(spark):
    body = {"transcription": [
        {"text": " a ", "timestamps": {"from": "00:00:01,500", "to": "00:00:02,000"}, "offsets": {"from": 9, "to": 9}},
        {"text": "  "}, {"text": "b", "start": 3, "end": 2}, {"text": "c", "offsets": {"from": 4000, "to": 4500}}, {"text": "d"},
    ]}
    df = spark.createDataFrame([(1, json.dumps(body)), (2, '{"segments":[{"text":"x","start":1.5}]}'), (3, "{}"), (4, "not json"), (5, None)], "track_id long, body string")
    got = rows(rc.cues_from_transcripts(df, offset_ms=100).drop("metadata"), "track_id", "ordinal")
    assert got == [(1, 0, 1600, 2100, "a"), (1, 1, 3100, 3100, "b"), (1, 2, 4100, 4600, "c"), (1, 3, 100, 100, "d"), (2, 0, 1600, 1600, "x")]


def test_word_items_fold_spacing(spark):
    items = [
        {"type": "spacing", "text": " "}, {"text": "Hi", "start": 0.1, "end": 0.3, "speaker_id": "speaker_0", "logprob": -0.5}, {"type": "spacing", "text": " "},
        {"type": "audio_event", "text": "(x)"}, {"type": "spacing", "text": " "}, {"type": "word", "text": "you", "start": 0.5, "end": 0.4},
    ]
    df = spark.createDataFrame([(1, json.dumps(items)), (2, "[]"), (3, None)], "track_id long, items string")
    assert rows(rc.words_from_items(df), "ordinal") == [(1, 0, "0", "Hi  ", 100, 300, -0.5), (1, 1, None, "you", 500, 500, None)]


def test_json_objects_of_replies(spark):
    texts = ['{"a":1}', 'x ```json\n{"a":2}\n``` y', 'so {"a":3} ok', '[1]', "none", json.dumps({"result": json.dumps({"result": '{"a":4}'})}), '{"result":5}', None, "{broken"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in rows(df.select("i", F.get_json_object(rc.json_object(F.col("t")), "$.a")), "i")]
    assert got == ["1", "2", "3", None, None, "4", None, None, None]
    flags = [r[1] for r in rows(spark.createDataFrame([(0, '{"cues":[]}'), (1, '{"cues":1}'), (2, "hi"), (3, None)], "i int, t string").select("i", rc.structured_message(F.col("t"))), "i")]
    assert flags == [True, False, False, False]


def test_last_item_of_an_id_counts(spark):
    text = '{"cues":[{"id":1,"source":"a","translated":"x"},{"source":"n"},{"id":"1","source":"b","translated":null}]}'
    df = spark.createDataFrame([(1, 0, text)], "track_id long, batch_no int, text string")
    assert rows(rc.reply_items(df), "id") == [(1, 0, "1", "b", None)]


def test_trace_lines(spark):
    lines = [
        {"type": "error"}, {"type": "turn.failed", "error": {"m": 1}}, {"type": "item.completed", "item": {"type": "agent_message", "id": "1", "text": '{"cues":[]}'}},
        {"type": "item.started", "item": {"type": "reasoning", "id": "2"}}, {"type": "item.completed", "item": {"type": "command_execution", "command": "ls", "exit_code": 0, "output": "o"}},
        {"type": "item.started", "item": {"type": "web_search"}}, {"type": "item.updated", "item": {"type": "file_change"}}, {"type": "other"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(lines)] + [(99, "junk"), (100, None)], "n int, line string")
    assert rows(rc.item_trace_events(df), "n") == [
        (0, "error", "Agent error", None, None), (1, "error", '{"m":1}', None, None), (3, "thinking", "Thinking…", "2", None),
        (4, "tool_result", "Run ls · exit 0", None, "o"), (5, "tool_start", "Search web: web search", None, None),
    ]


def test_log_lines(spark):
    lines = ["[00:00:01.000 --> 00:00:00.500]  hi", "VAD segment 3: start = 1.2345, end = 2.5", "VAD segment 4: start = 3.0, end = 2.5", "progress = 130%", "[download] 50%", "x", None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "track_id long, line_no int, line string")
    assert rows(rc.log_cues(df), "line_no") == [(1, 0, 1000, 1000, "hi")]
    assert rows(rc.log_spans(df), "line_no") == [(1, 1, 1234, 2500)]
    assert rows(rc.log_progress(df), "line_no") == [(1, 3, 1.0), (1, 4, 0.425)]


def test_levels_and_sizes(spark):
    samples = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 4, 0, 0, 6])], "track_id long, i long, value double")
    assert [(r[1], round(r[2], 4)) for r in rows(rc.rms_levels(samples, 100), "window_idx")] == [(0, 3.5355), (1, 0.0), (2, 6.0)]
    probes = [(1, '{"streams":[{"codec_type":"audio"},{"width":10,"height":0},{"width":8,"height":6,"disposition":{"attached_pic":1}},{"width":4,"height":3}]}'), (2, "{}"), (3, None)]
    assert rows(rc.frame_sizes(spark.createDataFrame(probes, "track_id long, body string")), "track_id") == [(1, 4, 3), (2, 1920, 1080), (3, 1920, 1080)]
