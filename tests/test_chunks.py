import json
import random
from array import array

import pytest

from tempora.streaming import chunks as ch

RATE, FRAME = 1_000, 2


class Listener:
    """Hears runs of equal samples as words: a word is certain once other audio follows. Fails once, where ``fails`` has (ms of the track, a file that tells it did)."""

    def __init__(self, track, start_ms, fails=(None, None)):
        self.start, self.fails, self.audio, self.told = start_ms, fails, array("h"), 0

    def heard(self, until):
        words, at = [], self.told
        while at < until:
            end = at + 1
            while end < until and self.audio[end] == self.audio[at]:
                end += 1
            if self.audio[at]:
                words.append({"text": f"w{self.audio[at]}", "start": at / RATE, "end": end / RATE})
            at = end
        self.told = until
        return json.dumps({"segments": words}) if words else None

    def submit(self, pcm):
        self.audio.frombytes(pcm)
        at, told = self.fails
        if at == self.start + len(self.audio) and not told.exists():
            told.touch()
            raise ConnectionError("gone")
        sure = len(self.audio)
        while sure > self.told and self.audio[sure - 1] == self.audio[-1]:
            sure -= 1
        return self.heard(sure), sure * FRAME

    def finish(self):
        return self.heard(len(self.audio))

    def close(self):
        self.audio = None


def recording(rnd, seconds):
    samples, word = array("h"), 0
    while len(samples) < seconds * RATE:
        samples.extend([0] * rnd.randint(1, 900))
        word += 1
        samples.extend([word] * rnd.randint(80, 900))
    return samples[: seconds * RATE]


def whole(track, samples, start_ms=0):
    one = Listener(track, start_ms)
    body = one.submit(samples.tobytes())[0], one.finish()
    return [(track, round(w["start"] * 1000) + start_ms, round(w["end"] * 1000) + start_ms, w["text"]) for b in body if b for w in json.loads(b)["segments"]]


def fed(spark, tmp_path, rows, session, size, **more):
    """The answers of a stream that gets ``size`` rows in each micro-batch."""
    kind, source, out = "track_id long, offset_ms long, content binary, at timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], kind).coalesce(1).write.mode("append").parquet(source)
    stream = ch.stream_fed_chunks(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source), session, RATE, FRAME, **more)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.schema(ch.ANSWER).parquet(out), query


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def cues(answers):
    return sorted((r.track_id, r.start_ms, r.end_ms, r.source) for r in ch.answered_cues(answers).collect())


@pytest.mark.parametrize("most_sessions", [16, 1])
def test_chunks_with_overlap_give_the_words_of_one_pass(spark, tmp_path, most_sessions):
    rnd = random.Random(most_sessions)
    tracks = {t: recording(rnd, 40) for t in (1, 2, 3, 4)}
    rows = []
    for at in range(0, 40, 3):
        for t, samples in tracks.items():
            begin = max(0, at * RATE - rnd.randint(0, 1500))
            rows.append((t, begin, samples[begin : (at + 3) * RATE].tobytes(), None))
    rows += [(1, 5_000, tracks[1][5_000:6_000].tobytes(), None), (2, None, b"11", None), (None, 0, b"11", None)]
    rows += [(t, 40_000, None, None) for t in tracks]
    answers, _ = fed(spark, tmp_path, rows, Listener, 13, most_sessions=most_sessions)
    assert answers.where("error IS NOT NULL").isEmpty()
    assert cues(answers) == sorted(w for t, samples in tracks.items() for w in whole(t, samples))


def test_a_session_that_fails_is_opened_again_with_what_it_did_not_answer(spark, tmp_path):
    samples = recording(random.Random(9), 30)
    rows = [(1, at * RATE, samples[at * RATE : (at + 3) * RATE].tobytes(), None) for at in range(0, 30, 3)] + [(1, 30_000, None, None)]
    answers, _ = fed(spark, tmp_path, rows, lambda t, at: Listener(t, at, (9_000, tmp_path / "failed")), 2)
    assert [r.error for r in answers.where("error IS NOT NULL").collect()] == ["ConnectionError: gone"]
    assert cues(answers) == whole(1, samples)


def test_a_service_that_never_answers_keeps_its_bound(spark, tmp_path):
    def dead(track, at):
        raise OSError("no service")

    silence = bytes(2 * RATE * FRAME)
    answers, _ = fed(spark, tmp_path, [(1, at * 2_000, silence, None) for at in range(6)], dead, 3, most_s=5)
    errors = [r.error for r in answers.orderBy("fed_ms").collect()]
    assert errors.count("OSError: no service") == 6
    assert [e for e in errors if "given up" in e] == ["audio from 0 to 1000 ms given up", "audio from 1000 to 3000 ms given up", "audio from 3000 to 5000 ms given up", "audio from 5000 to 7000 ms given up"]


def test_gaps_and_idle_tracks_end_their_sessions(spark, tmp_path):
    import datetime as dt

    one, two = array("h", [1] * 1000 + [0] * 500 + [2] * 500), array("h", [3] * 700)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 0, one.tobytes(), at(0)), (1, 9_000, two.tobytes(), at(9)), (2, 0, two.tobytes(), at(10)), (9, 0, bytes(2_000), at(500)), (9, 1_000, bytes(2_000), at(501)), (9, 2_000, bytes(2_000), at(502))]
    answers, query = fed(spark, tmp_path, rows, Listener, 1, idle="60 seconds")
    assert cues(answers) == [(1, 0, 1000, "w1"), (1, 1500, 2000, "w2"), (1, 9000, 9700, "w3"), (2, 0, 700, "w3")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
