"""Feeds against folds over lists, and streams against their forms for tables."""

import random

from pyspark.sql import functions as F

from tempora.operators import words as wd
from tempora.streaming import feeds as fd

WORD = "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long"


def heard(n, seed=5):
    rnd = random.Random(seed)
    at, out = 0, []
    for i in range(n):
        at = max(0, at + rnd.choice([0, 100, 300, 601, -250]))
        out.append((i % 2, i, at, rnd.choice(["a", "B ", "b", "c"])))
    return out


def fold(rows):
    kept = []
    for _, _, start, text in rows:
        key = text.strip().casefold()
        if any(abs(s - start) <= 600 and t.strip().casefold() == key for s, t in kept[-80:]) or (kept and start < kept[-1][0]):
            continue
        kept.append((start, text))
    return kept


def test_append_only_words_and_their_stream(spark, tmp_path):
    rows = heard(400)
    df = spark.createDataFrame(rows, "track_id long, seq long, start_ms long, text string")
    want = {(t, i, *w) for t in (0, 1) for i, w in enumerate(fold([r for r in rows if r[0] == t]))}
    assert {tuple(r) for r in fd.append_only_words(df).collect()} == want
    source = str(tmp_path / "in")
    for k in range(4):
        df.where(F.floor(F.col("seq") / 100) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = fd.stream_append_only_words(stream).writeStream.format("memory").queryName("appended").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("appended").collect()} == want


def test_chunks_and_their_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, i, i * 1000) for i in range(48)], "track_id long, id long, start_ms long")
    chunks = fd.hop_chunks(df).groupBy("track_id", "from_ms", "to_ms").agg(F.count("*").alias("n"))
    want = {(1, 0, 15000, 15), (1, 10000, 30000, 20), (1, 25000, 45000, 20)}
    assert {tuple(r) for r in chunks.collect()} == want
    source = str(tmp_path / "in")
    timed = df.select("track_id", "id", F.timestamp_millis("start_ms").alias("at"))
    for k in range(3):
        timed.where(F.floor(F.col("id") / 16) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = fd.stream_hop_chunks(stream).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("chunks").collect()} == want


def test_overlap_merge_equals_a_fold(spark):
    rnd = random.Random(9)
    cue = lambda i: (1, i, rnd.randint(0, 60_000), 0, rnd.choice(["Hello  you", "hello you", "x", None]))
    old, new = [cue(i) for i in range(40)], [cue(i) for i in range(150)]
    norm = lambda t: " ".join((t or "").casefold().split())
    kept, want = list(old), set()
    for c in new:
        if not any(abs(k[2] - c[2]) <= 2500 and norm(k[4]) == norm(c[4]) for k in kept):
            kept.append(c)
            want.add(c)
    schema = "track_id long, ordinal long, start_ms long, end_ms long, source string"
    assert {tuple(r) for r in wd.overlap_merge(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()} == want


def test_squeezed_words_are_spread(spark):
    words = [(1, 0, "0", "aaaa", 0, 400), (1, 1, "0", "bbbb", 400, 800), (1, 2, "0", "cccc", 800, 1200), (1, 3, "0", "dd", 1200, 1210), (1, 4, "0", "dd", 1210, 1220), (1, 5, "1", "x", 1220, 1320), (1, 6, "0", "zz", 1500, 1700)]
    got = {r.ordinal: (r.start_ms, r.end_ms) for r in wd.repair_squeezed_words(spark.createDataFrame(words, WORD)).collect()}
    # four units at 100 ms would end at 1600; the speaker's next word cuts that to 1500
    assert got == {**{w[1]: (w[4], w[5]) for w in words}, 3: (1200, 1350), 4: (1350, 1500)}
    assert wd.repair_squeezed_words(spark.createDataFrame(words[:5], WORD)).where("ordinal = 4").first().end_ms == 1220


def test_word_context(spark):
    words = [(1, i, "0", "w", i * 100, i * 100 + 50) for i in range(60)]
    cues = [(1, f"c{i}", i * 200, i * 200 + 10) for i in range(20)]
    batches = spark.createDataFrame([(1, 0, 0, 9), (1, 1, 30, 55)], "track_id long, batch_no int, first long, last long")
    got = {r.batch_no: (r.preceding, r.following) for r in wd.word_context(batches, spark.createDataFrame(words, WORD), spark.createDataFrame(cues, "track_id long, id string, start_ms long, end_ms long")).collect()}
    assert got == {0: (None, list(range(10, 50))), 1: ([f"c{i}" for i in range(5, 15)], [56, 57, 58, 59])}


def test_changed_tracks_and_new_samples(spark):
    cue = "track_id long, id long, start_ms long, end_ms long, source string"
    old = spark.createDataFrame([(1, 1, 0, 5, "a"), (2, 1, 0, 5, "a")], cue)
    new = spark.createDataFrame([(1, 1, 0, 5, "a"), (2, 1, 0, 6, "a"), (3, 1, 0, 5, "a")], cue)
    assert sorted(r.track_id for r in fd.changed_tracks(old, new).collect()) == [2, 3]
    fed = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 50, 120), (1, 2, 10, 90), (1, 3, 200, 210)], "track_id long, seq long, start_ms long, end_ms long")
    assert sorted(tuple(r) for r in fd.new_samples(fed).collect()) == [(1, 0, 0, 100), (1, 1, 100, 120), (1, 3, 200, 210)]


def test_new_ids_changes_events_and_rows(spark, tmp_path):
    from tempora.operators import journal as jr

    kind = "track_id long, id long, at timestamp, source string, start_ms long, end_ms long"
    stamp = lambda s: __import__("datetime").datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, 1, stamp(0), "a", 0, 1), (1, 1, stamp(1), "a", 0, 1), (1, 2, stamp(2), "b", 1, 2), (2, 1, stamp(2), "c", 0, 1)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    q = fd.stream_new_ids(stream, "10 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.track_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (1, 2), (2, 1)]

    seen, memory = [], [spark.createDataFrame([], kind)]
    step = fd.on_changes(lambda df: seen.append(sorted({r.track_id for r in df.collect()})), lambda: memory[-1], memory.append)
    now = spark.createDataFrame(rows, kind)
    for k, df in enumerate([now, now, now.withColumn("source", F.when(F.col("track_id") == 2, "x").otherwise(F.col("source")))]):
        step(df, k)
    assert seen == [[1, 2], [], [2]]

    events = spark.createDataFrame([("words",), ("closed",), ("error",), ("hello",), (None,)], "kind string")
    assert [r.route for r in fd.session_events(events).collect()] == ["words", "end", "fatal", "other", "other"]
    kind = "track_id long, id long, number long, value string"
    old = spark.createDataFrame([(1, 1, 7, "a"), (1, 2, 9, "b")], kind)
    new = spark.createDataFrame([(1, 2, None, "c"), (1, 3, None, "d"), (1, 3, None, "e"), (2, 1, None, "f")], kind)
    assert {(r.id, r.value) for r in jr.add_rows(old, new.where("track_id = 1 AND id = 2"), ["track_id", "id"]).collect()} == {(1, "a"), (2, "b")}
    assert sorted((r.track_id, r.id, r.number, r.value) for r in jr.add_rows(old, new, ["track_id", "id"], "number", ["value"]).collect()) == [(1, 1, 7, "a"), (1, 2, 10, "c"), (1, 3, 11, "e"), (2, 1, 1, "f")]
    gone = jr.discard_provisional(spark.createDataFrame([(1, "t", True)], "id long, translated string, stable boolean")).first()
    assert (gone.translated, gone.stable) == (None, False)


def test_payloads_of_words(spark):
    from tempora.sources.records import word_payloads

    words = spark.createDataFrame([(1, 0, 1234, "0", 'a"'), (1, 1, 2000, None, "b ")], "track_id long, ordinal long, start_ms long, speaker string, text string")
    batches = spark.createDataFrame([(1, 0, 0, 1)], "track_id long, batch_no int, first long, last long")
    import json

    assert json.loads(word_payloads(batches, words).first().payload) == [{"i": 0, "t": 1.234, "s": "0", "w": 'a"'}, {"i": 1, "t": 2.0, "w": "b "}]
