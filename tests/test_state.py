import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import intervals as iv
from tempora.operators import words as wd
from tempora.streaming import feeds as fd
from tempora.streaming import state as st

WORD = "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long"


def run(spark, df, step, tmp_path, order, size):
    """The rows of ``step`` over a stream that has ``size`` rows of ``df``, in the order of a column, in each micro-batch."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = df.orderBy(order).collect()
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], df.schema).coalesce(1).write.mode("append").parquet(source)
    stream = step(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(stream.schema).parquet(out), query


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_chunks_come_with_their_rows(spark, tmp_path):
    rnd, rows, at = random.Random(4), [], {1: 0, 2: 0}
    for i in range(90):
        track = rnd.choice([1, 1, 2])
        at[track] += rnd.choice([0, 700, 3_000, 40_000 if i % 30 == 7 else 900])
        rows.append((track, i, at[track], f"x{i}"))
    df = spark.createDataFrame(rows, "track_id long, id long, start_ms long, value string")
    got, _ = run(spark, df, st.stream_chunks, tmp_path, "id", 20)
    want = fd.hop_chunks(df).select(got.columns)
    assert want.count() > 60 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_intervals_in_any_order(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2]), i, (s := rnd.randint(0, 3000)), s + rnd.randint(-5, 60)) for i in range(160)]
    df = spark.createDataFrame(rows, "track_id long, id long, start_ms long, end_ms long")
    got, _ = run(spark, df, st.stream_intervals, tmp_path, "id", 40)
    net = got.groupBy("track_id", "start_ms", "end_ms").agg(F.sum("change").alias("n")).where("n <> 0")
    assert {(*r[:3],) for r in net.collect() if r.n == 1} == {tuple(r) for r in iv.merge_intervals(df).select("track_id", "start_ms", "end_ms").collect()} and net.where("n <> 1").isEmpty()
    # one span closes the gap between two, and one lies inside another
    starts, ends = [], []
    for s, e in ((0, 5), (20, 30), (40, 50), (22, 25), (36, 36)):
        st.inserted(starts, ends, s, e, 5)
    assert list(zip(starts, ends, strict=True)) == [(0, 5), (20, 30), (36, 50)]


def settling(rnd):
    """Words, cues over them that land in any order, joints between some that become clean."""
    events, at, i = [], 0, 0
    words = []
    for o in range(70):
        words.append((o, at, at + 80, rnd.choice("01") if rnd.random() < 0.1 or not words else words[-1][3]))
        at += rnd.choice([90, 90, 900])
    cues = []
    while i < 70:
        z = min(69, i + rnd.randint(0, 5))
        cues.append((f"c{i}", i, z, words[i][1], max(w[2] for w in words[i : z + 1]), words[i][3]))
        i = z + 1
    heard = iter(words)
    late = sorted(cues, key=lambda c: c[1] + rnd.randint(0, 25))
    joints = {c[2] for c in rnd.sample(cues[:-1], 5)}
    events += [("joint", None, j, None, None, None, None) for j in joints]
    for c in late:
        for o, s, e, by in heard:
            events.append(("word", None, o, o, s, e, by))
            if o >= c[2] + 3:
                break
        events.append(("cue", *c))
    events += [("clean", None, j, None, None, None, None) for j in sorted(joints)[:4]]
    return events


def test_cues_settle_as_the_table_operator_says(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(track, seq, *e) for track in (1, 2) for seq, e in enumerate(settling(rnd))]
    kind = "track_id long, seq long, kind string, id string, first long, last long, start_ms long, end_ms long, speaker string"
    df = spark.createDataFrame(rows, kind).cache()
    n = max(r[1] for r in rows) + 1
    got = []
    step = st.Settlement
    for track in (1, 2):  # plain steps of 1 to 5 events, against the table operator at four moments
        own, state, k, seen = [r for r in rows if r[0] == track], None, 0, []
        marks = [len(own) // 3, 2 * len(own) // 3, len(own)]
        while k < len(own):
            size = min([rnd.randint(1, 5), *[m - k for m in marks if m > k]])
            t = step(state)
            for r in own[k : k + size]:
                t.take(*r[2:])
            seen += t.step()
            state, k = t.dump(), k + size
            if k in marks:
                past = spark.createDataFrame(own[:k], kind)
                open_ = past.where("kind = 'joint'").join(past.where("kind = 'clean'"), ["track_id", "first"], "left_anti").select("track_id", F.col("first").alias("ordinal"))
                want = wd.settled_prefix(past.where("kind = 'word'").withColumnRenamed("first", "ordinal"), past.where("kind = 'cue'"), open_, complete=False)
                assert sorted(seen) == sorted((r.id, r.final_id) for r in want.collect())
        got += [(track, *s) for s in seen]
        assert len(seen) > 5
    streamed, _ = run(spark, df, st.stream_settled, tmp_path, "seq", n)
    assert sorted(map(tuple, streamed.collect())) == sorted(got)


def test_state_of_tracks_that_end_goes(spark, tmp_path):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("track_id") * 10)
    rows = spark.range(600).select((F.col("id") / 2).cast("long").alias("track_id"), (F.col("id") % 2).alias("seq"), (F.col("id") % 2 * 1000).alias("start_ms"), F.lit("w").alias("text"))
    df = rows.withColumn("at", at)
    got, query = run(spark, df, lambda s: fd.stream_append_only_words(s, idle="100 seconds"), tmp_path / "a", "at", 200)
    assert got.count() == 600
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 120  # of 300 tracks
    cues = df.select("track_id", F.col("seq").alias("ordinal"), "start_ms", (F.col("start_ms") + 1).alias("end_ms"), F.lit("words").alias("source"), "at")
    got, query = run(spark, cues, lambda s: fd.stream_chunk_timeline(s, within_ms=10, idle="100 seconds"), tmp_path / "b", "at", 200)
    assert got.count() == 600 and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 120


def test_batches_are_dispatched_once(spark, tmp_path):
    rows = [(t, i, "0", "w", i * 300 + i // 10 * 2_000 + i // 20 * 500, i * 300 + i // 10 * 2_000 + i // 20 * 500 + 250) for t in (1, 2) for i in range(100)]
    none, asked = spark.createDataFrame([], "track_id long, first long, last long"), []
    part = lambda a, z: spark.createDataFrame([r for r in rows if a <= r[1] < z], WORD)
    step = st.on_ready_once(lambda: none, str(tmp_path), lambda df, n: asked.append((n, sorted(map(tuple, df.collect())))), target=20)
    step(part(0, 45), 0)
    first = asked[-1]
    assert first[0] == 0 and {r[0] for r in first[1]} == {1, 2}
    step(part(0, 45), 0)  # it had ended: nothing is handed out again
    assert len(asked) == 1

    def breaks(df, n):
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        st.on_ready_once(lambda: none, str(tmp_path), breaks, target=20)(part(45, 100), 1)
    step(part(45, 100), 1)  # the plan of the run that broke
    step(part(0, 0), 2)
    assert asked[2] == (2, [])
    kind = "track_id long, first long, last long"
    want = sorted(map(tuple, wd.ready_word_batches(part(0, 45), none, none, 20).collect()))
    assert asked[0] == (0, want) and want
    more = wd.ready_word_batches(part(0, 100), none, spark.createDataFrame(want, kind), 20)
    assert asked[1] == (1, sorted(map(tuple, more.collect()))) and asked[1][1]
