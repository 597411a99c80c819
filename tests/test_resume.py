"""Batches over what is left, repairs of torn joints, sinks and streams against their table forms."""

import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tempora.operators import backends as bk
from tempora.operators import resume as rs
from tempora.operators import words as wd
from tempora.sources import sinks
from tempora.streaming import feeds as fd

WORD = "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long"


def split(words, target):
    """(first, last, forced) of a run of (ordinal, start, end) words, cut at silences."""
    reach, gaps = -1, {}
    for i in range(len(words) - 1):
        reach = max(reach, words[i][2])
        if words[i + 1][1] - reach >= 800:
            gaps[i] = words[i + 1][1] - reach
    at, out = 0, []
    while at < len(words):
        if len(words) - at <= 2 * target:
            out.append((words[at][0], words[-1][0], False))
            break
        near = [i for i in range(at + target // 2 - 1, at + target) if i in gaps]
        later = [i for i in range(at + target, at + 2 * target - 1) if i in gaps]
        cut = max(near, key=lambda i: (gaps[i], -i)) if near else later[0] if later else at + 2 * target - 1
        out.append((words[at][0], words[cut][0], not near and not later))
        at = cut + 1
    return out


def talk(n, seed):
    rnd, rows, at = random.Random(seed), [], 0
    for i in range(n):
        rows.append((1, i, rnd.choice("01"), f"w{i} ", at, at + 100))
        at += 100 + rnd.choice([0, 0, 0, 0, 900, 1500] if i % 90 > 40 else [0])
    return rows


def test_missing_batches_are_those_of_each_uncovered_run(spark):
    rows = talk(400, 3)
    df = spark.createDataFrame(rows, WORD)
    ranges = spark.createDataFrame([(1, 50, 59), (1, 60, 61), (1, 300, 320)], "track_id long, first long, last long")
    runs = [rows[:50], rows[62:300], rows[321:]]
    want = [b for r in runs for b in split([(x[1], x[4], x[5]) for x in r], 20)]
    got = sorted((r["first"], r["last"], r["forced_end"]) for r in wd.missing_word_batches(df, ranges, 20).collect())
    assert got == want
    prefix = next(n for n in range(399, 0, -1) if rows[n][4] - max(x[5] for x in rows[:n]) >= 800)
    usable = [b for r in (rows[:50], rows[62 : min(300, prefix)], rows[321:prefix]) if r for b in split([(x[1], x[4], x[5]) for x in r], 20)]
    full = [(a, z) for a, z, _ in usable if z - a + 1 >= 20]
    dispatched = spark.createDataFrame([(1, *full[0])], "track_id long, first long, last long")
    assert sorted((r["first"], r["last"]) for r in wd.ready_word_batches(df, ranges, dispatched, 20).collect()) == full[1:]


def cutter(payload, error):
    """A cue for each stretch of a speaker, of at most 7 words."""
    out = []
    for w in json.loads(payload):
        if out and out[-1]["s"] == w.get("s") and w["i"] - out[-1]["first_word"] < 7:
            out[-1]["last_word"] = w["i"]
        else:
            out.append({"s": w.get("s"), "first_word": w["i"], "last_word": w["i"], "source": f"c{w['i']}", "translated": "t"})
    return json.dumps({"cues": [{k: v for k, v in c.items() if k != "s"} for c in out]})


def test_segments_cover_all_words_and_torn_joints_are_cut_anew(spark, tmp_path):
    rows = [(1, i, "0", f"w{i}", i * 100, i * 100 + 100) for i in range(100)] + [(2, i, "01"[i % 20 > 9], "x", i * 100 + (i // 10) * 2_000, i * 100 + (i // 10) * 2_000 + 50) for i in range(60)]
    df = spark.createDataFrame(rows, WORD)
    timeline, left = bk.segment_and_translate(df, cutter, str(tmp_path / "a"), target=20)
    got = timeline.orderBy("track_id", "id").collect()
    assert left.count() == 0
    for t, n in ((1, 100), (2, 60)):
        own = [r for r in got if r.track_id == t]
        assert sorted(i for r in own for i in range(r["first"], r["last"] + 1)) == list(range(n)) and [r.id for r in own] == list(range(1, len(own) + 1))
    # words without a pause are cut by force at 40 and 80: the cues on both sides of such a cut are one request again
    redone = spark.read.parquet(str(tmp_path / "a" / "repairs")).where("track_id = 1").count()
    assert redone == 2
    again, none = bk.segment_and_translate(df, lambda p, e: (_ for _ in ()).throw(ValueError("no")), str(tmp_path / "b"), target=20, attempts=2)
    assert again.count() == 0 and none.count() == 160
    assert {(r.attempt, r.status) for r in spark.read.parquet(str(tmp_path / "b" / "batches")).collect()} == {(1, "failed"), (2, "failed")}
    known = spark.read.parquet(str(tmp_path / "a" / "drafts")).where("track_id = 2")
    more, left = bk.segment_and_translate(df.where("track_id = 2"), cutter, str(tmp_path / "c"), known, target=20)
    assert left.count() == 0 and spark.read.parquet(str(tmp_path / "c" / "batches")).count() == 0 and more.count() > 0


def test_service_is_asked_once_and_done_cues_are_left_out(spark, tmp_path):
    kind = "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string"
    cues = spark.createDataFrame([(1, i, i, i, i + 1, None, f"s{i}", None) for i in range(45)], kind)

    def echo(payload, error):
        return json.dumps({"cues": [{"id": c["id"], "source": "new", "translated": "t"} for c in json.loads(payload)]})

    folder = str(tmp_path / "tries")
    out = bk.translate_missing(cues, echo, folder=folder, source_edits=False, done=cues.where("id = 44"))
    assert out.where("translated = 't'").count() == 44 and out.where("source = 'new'").count() == 0 and out.count() == 45
    assert spark.read.parquet(folder).count() == 3
    assert [(r.n, r.ids) for r in rs.leftover_failures(out).collect()] == [(1, [44])]


def test_slow_attempts_have_failed(spark):
    import time

    payloads = spark.createDataFrame([(1, 0, "x")], "track_id long, batch_no long, payload string")
    slow = lambda payload, error: time.sleep(0 if error else 5) or "ok"
    got = [(r.attempt, r.status, r.text) for r in bk.translate_batches(payloads, slow, timeout_s=0.2).collect()]
    assert got == [(1, "failed", None), (2, "complete", "ok")]


def test_transcriber_backend(spark):
    rows = spark.createDataFrame([(1, bytearray(b"ok"), 5), (2, bytearray(b""), 6)], "track_id long, content binary, at long")
    got = bk.transcribe_audio(rows, lambda content: json.dumps({"transcription": [{"text": content.decode("ascii")}]}) if content else 1 / 0, offset="at").orderBy("track_id").collect()
    assert [(r.track_id, r["at"], r.body) for r in got] == [(1, 5, '{"transcription": [{"text": "ok"}]}'), (2, 6, None)]


def test_sinks(spark, tmp_path):
    lines = spark.createDataFrame([(1, "p", "err", "x  \n"), (1, "p", "out", None)], "track_id long, process string, stream string, line string")
    for _ in range(2):
        sinks.append_log(lines, str(tmp_path / "log"))
    assert sorted(str(r.line) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == ["None", "None", "x", "x"]
    sinks.archive_responses(spark.createDataFrame([(1, 0.5, "{}")], "track_id long, session_s double, body string"), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).first().body == "{}"
    cues = spark.createDataFrame([(t, i, i, i, i + 1, None, "s", "t") for t in (1, 2) for i in range(3)], "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string")
    path, marks = str(tmp_path / "timeline"), str(tmp_path / "marks")
    sinks.install_timeline(cues, path, marks)
    sinks.install_timeline(cues.where("track_id = 2 AND id = 0"), path, marks)
    assert sorted((r.track_id, r.id) for r in spark.read.parquet(path).collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert {(r.job_id, r.value) for r in rs.checkpoint(spark.read.parquet(marks), "alignment_complete").collect()} == {("1", "true"), ("2", "true")}
    docs = str(tmp_path / "docs")
    show = sinks.live_snapshots(lambda s: s.read.parquet(path).withColumn("track_id", F.col("track_id").cast("long")), docs, "all")
    show(cues.where("track_id = 1"), 0)
    show(cues.where("track_id = 2"), 1)
    assert sorted((r.track_id, r.document.count("Dialogue:")) for r in spark.read.parquet(docs).collect()) == [(1, 3), (2, 1)]


def test_chunk_timeline_stream_equals_the_table_form(spark, tmp_path):
    rnd = random.Random(8)
    kind = "track_id long, ordinal long, start_ms long, end_ms long, source string"
    rows = [(rnd.randint(1, 2), i, s, s + 500, rnd.choice(["Yes", "yes ", "no", "a b", "A  b"])) for i, s in enumerate(sorted(rnd.randint(0, 60_000) + rnd.choice([0, 3_000]) for _ in range(200)))]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(0, 200, 50):
        spark.createDataFrame(rows[k : k + 50], kind).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(folder))
    out, stop = str(tmp_path / "out"), str(tmp_path / "ck")
    q = fd.stream_chunk_timeline(stream).writeStream.option("checkpointLocation", stop).format("parquet").option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("track_id", "ordinal", "start_ms", "end_ms", "source").collect())
    df = spark.createDataFrame(rows, kind)
    assert got == sorted(tuple(r) for r in wd.overlap_merge(df.limit(0), df).collect())


def test_merged_timeline_numbers_by_arrival(spark):
    kind = "track_id long, id long, ordinal long, start_ms long, end_ms long, source string"
    old = spark.createDataFrame([(1, 5, 0, 0, 9, "a"), (1, 6, 1, 9_000, 9_500, "b")], kind)
    new = spark.createDataFrame([(1, 0, 0, 2_000, 2_100, "A "), (1, 0, 1, 4_000, 4_100, "c"), (1, 0, 2, 1_000, 1_100, "d"), (2, 0, 0, 0, 1, "a")], kind)
    got = sorted((r.track_id, r.start_ms, r.id, r.source) for r in wd.merged_timeline(old, new).collect())
    assert got == [(1, 0, "5", "a"), (1, 1_000, "4", "d"), (1, 4_000, "3", "c"), (1, 9_000, "6", "b"), (2, 0, "1", "a")]


def test_settled_and_ready_batches_are_given_once(spark):
    rows = talk(120, 5)
    words = spark.createDataFrame(rows, WORD)
    cues = words.groupBy("track_id", F.floor(F.col("ordinal") / 6).alias("id")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.lit(None).cast("string").alias("speaker"))
    seen, given = [], []
    none = spark.createDataFrame([], "track_id long, ordinal long")
    known = lambda: spark.createDataFrame(seen, "track_id long, final_id long")
    act = lambda df: (given.append(len(r := [(x.track_id, x.final_id) for x in df.collect()])), seen.extend(r))
    step = fd.on_settled(lambda: words, lambda: none, known, act)
    for n in (4, 10, 10, 20):
        step(cues.where(F.col("id") < n), n)
    assert given == [3, 6, 0, 10] and len(set(seen)) == 19
    sent, runs = [], []
    ready = fd.on_ready(lambda: spark.createDataFrame([], "track_id long, first long, last long"), lambda: spark.createDataFrame(sent, "track_id long, first long, last long"), lambda df: (runs.append(len(r := [tuple(x) for x in df.collect()])), sent.extend(r)), 20)
    for n in (60, 60, 120):
        ready(words.where(F.col("ordinal") < n), n)
    assert runs[1] == 0 and sum(runs) == len(set(sent))


def test_a_null_word_is_empty(spark):
    df = spark.createDataFrame([(1, 0, 0, None), (1, 1, 100, " "), (1, 2, 900, "Σοφός"), (1, 3, 1_000, "ΣΟΦΌΣ ")], "track_id long, seq long, start_ms long, text string")
    assert [(r.ordinal, r.start_ms, r.text) for r in fd.append_only_words(df).orderBy("ordinal").collect()] == [(0, 0, ""), (1, 900, "Σοφός")]


def test_shared_folder_on_a_cluster_must_be_named():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        sinks.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context))
    assert sinks.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: "s3a://x/y/"), sparkContext=context)) == "s3a://x/y"
