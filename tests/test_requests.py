import json
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import backends as bk
from tempora.operators import requests as rq
from tempora.sources import sinks

WORD = "track_id long, ordinal long, speaker string, text string, start_ms long, end_ms long"
CUE = "track_id long, id string, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string"
BATCH = "track_id long, batch_no long, first long, last long"


def cutter(payload, error, size=7):
    """A cue for each stretch of a speaker, of at most ``size`` words."""
    out, given = [], json.loads(payload)
    for w in given["words"] if isinstance(given, dict) else given:
        if out and out[-1]["s"] == w.get("s") and w["i"] - out[-1]["first_word"] < size:
            out[-1]["last_word"] = w["i"]
        else:
            out.append({"s": w.get("s"), "first_word": w["i"], "last_word": w["i"], "source": f"c{w['i']}", "translated": "t"})
    return json.dumps({"cues": [{k: v for k, v in c.items() if k != "s"} for c in out]})


def words(n, pause=5, track=1):
    """One speaker's words with a pause of two seconds after every ``pause`` of them."""
    return [(track, i, "0", f"w{i}", i * 300 + i // pause * 2_000, i * 300 + i // pause * 2_000 + 250) for i in range(n)]


def cues(n, **translated):
    return [(1, str(i), i, i * 1000, i * 1000 + 900, "A" if i % 2 else None, f"s{i}", translated.get(f"c{i}")) for i in range(n)]


def test_a_wrong_reply_is_asked_again_with_its_error(spark, tmp_path):
    def service(payload, error):
        ids = [c["id"] for c in json.loads(payload)]
        say = lambda some: json.dumps({"cues": [{"id": i, "translated": t} for i, t in some]})
        good = [(i, "t" + i) for i in ids]
        if error is None:
            return say([*good, ("77", "x")])
        if error == "unknown cue ids: 77":
            return say(good[1:])
        if error.startswith("missing cue ids: "):
            return say([(good[0][0], "  "), *good[1:]])
        if error.startswith("empty translations: "):
            return "well: " + say(good)
        raise ValueError(error)

    folder = str(tmp_path / "ledger")
    out = bk.translate_missing(spark.createDataFrame(cues(7), CUE), service, size=3, attempts=4, folder=folder)
    assert {r.id: r.translated for r in out.collect()} == {str(i): f"t{i}" for i in range(7)}
    rows = spark.read.parquet(folder).orderBy("batch_no", "attempt").collect()
    assert [(r.batch_no, r.attempt, r.status) for r in rows] == [(b, a, "failed" if a < 4 else "complete") for b in range(3) for a in (1, 2, 3, 4)]
    assert [r.error for r in rows[:4]] == ["unknown cue ids: 77", "missing cue ids: 0", "empty translations: 0", None]


def test_errors_of_replies_over_words(spark):
    rows = [(1, 0, "A", "a", 0, 900), (1, 1, "A", "b", 1000, 1900), (1, 2, "B", "c", 2000, 2900), (1, 3, "A", "d", 3000, 30_000), (2, 0, None, "x", 0, 10)]
    df, batches = spark.createDataFrame(rows, WORD), spark.createDataFrame([(1, 0, 0, 3), (1, 1, 0, 1), (2, 0, 0, 0)], BATCH)
    item = lambda a, z, s="s", t="t": {"first_word": a, "last_word": z, "source": s, "translated": t}
    said = lambda *items: json.dumps({"cues": list(items)})

    def errors(*replies):
        given = spark.createDataFrame(list(replies), "track_id long, batch_no long, text string")
        return {(r.track_id, r.batch_no): r.error for r in rq.word_reply_errors(batches, df)(given).collect()}

    assert errors((1, 0, said(item(0, 1), item(2, 2), item(3, 3))), (2, 0, said(item(0, 0)))) == {}
    assert errors((1, 0, "no idea"), (1, 1, said())) == {(1, 0): "the response carries no cues", (1, 1): "the response carries no cues"}
    found = errors((1, 0, said(item(0, 2), item(3, 1), item(3, 9), item(0, 0, " ", ""))), (1, 1, said(item(0, 1), item(1, 1))))
    assert found[1, 1] == "words claimed by two cues of a speaker: 1"
    assert found[1, 0].split("; ") == [
        "cues end before they start: 3–1", "cues name words outside this batch: 3–9", "cues start and end with different speakers: 0–2",
        "cues without a source: 0–0", "cues without a translation: 0–0", "words of speakers that no cue covers: 2", "words that no cue covers: 1, 3",
    ]
    long = errors((1, 0, said(item(0, 0), item(1, 3, "s" * 100, "t" * 50), item(2, 2))))[1, 0]
    assert long == "cue sources above the width limit; split them: 1–3; cues above the time limit; split them: 1–3"


def test_a_second_run_in_the_folder_keeps_the_timeline(spark, tmp_path):
    df = spark.createDataFrame(words(200), WORD)
    first, left = bk.segment_and_translate(df, cutter, str(tmp_path), target=20)
    first = first.collect()
    assert left.count() == 0 and len(first) >= 29
    drafts = spark.createDataFrame([(1, f"words-{r['first']}-{r['last']}", r["first"], r["last"], r.start_ms, r.end_ms, r.speaker, r.source, r.translated) for r in first if r.id <= 10], "track_id long, id string, first long, last long, start_ms long, end_ms long, speaker string, source string, translated string")
    again, left = bk.segment_and_translate(df, cutter, str(tmp_path), known=drafts, target=20)
    assert left.count() == 0 and sorted(i for r in again.collect() for i in range(r["first"], r["last"] + 1)) == list(range(200))
    # nothing is asked that a run before got: a service that fails gives the same timeline
    fails = lambda payload, error: (_ for _ in ()).throw(ValueError("down"))
    third, left = bk.segment_and_translate(df, fails, str(tmp_path), target=20)
    assert left.count() == 0 and sorted(map(str, third.drop("id", "ordinal").collect())) == sorted(str(r) for r in third.sparkSession.createDataFrame(first, third.schema).drop("id", "ordinal").collect())


def test_a_stopped_run_asks_only_for_what_is_open(spark, tmp_path):
    payloads = spark.createDataFrame([(t, b, f"p{b}") for t in (1, 2) for b in range(6)], "track_id long, batch_no long, payload string").repartition(3)
    folder = str(tmp_path / "ledger")
    half = lambda payload, error: payload.upper() if payload < "p3" else (_ for _ in ()).throw(ValueError("stopped"))
    assert rq.settled_replies(payloads, half, folder, attempts=1, wave=2).count() == 6
    ledger = spark.read.parquet(folder)
    assert ledger.count() == 6  # equal payloads are asked once
    # replies that no run judged are judged by the next one and not asked for again
    digest = {r.text or "": r.digest for r in ledger.collect()}
    spark.createDataFrame([(r.digest, 2, "RAW", None) for r in ledger.where("status = 'failed'").limit(1).collect()], rq.RAW).write.mode("append").parquet(folder + "-raw")
    quoted = lambda payload, error: f"{payload}:{error}"
    got = sorted((r.track_id, r.batch_no, r.text) for r in rq.settled_replies(payloads, quoted, folder, attempts=1).collect())
    assert [g[2] for g in got[:3]] == ["P0", "P1", "P2"] and sorted(g[2] for g in got[3:6])[0] == "RAW" and sum(g[2].endswith(":stopped") for g in got) == 4
    assert got[:6] == [(1, b, x) for (_, b, x) in got[6:]] and len(digest) == 4 and spark.read.parquet(folder).count() == 9


def test_slow_and_failing_requests_of_a_composition(spark, tmp_path):
    import time

    def slow(payload, error):
        time.sleep(0 if error else 3)
        return json.dumps({"cues": [{"id": c["id"], "translated": str(error)} for c in json.loads(payload)]})

    out = bk.translate_missing(spark.createDataFrame(cues(2), CUE), slow, folder=str(tmp_path / "a"), timeout_s=0.5)
    assert {r.translated for r in out.collect()} == {"timed out after 0.5 s"}


def test_checks_inside_plain_attempts(spark):
    payloads = spark.createDataFrame([(1, b, str(b)) for b in range(5)], "track_id long, batch_no long, payload string").coalesce(1)
    got = bk.translate_batches(payloads, lambda p, e: e or p, check=lambda p, t: None if t.startswith("no") else f"no {p}", in_flight=3).collect()
    assert [(r.batch_no, r.attempt, r.status, r.text) for r in got] == [x for b in range(5) for x in ((b, 1, "failed", None), (b, 2, "complete", f"no {b}"))]


def test_contexts_of_requests(spark):
    df = spark.createDataFrame(cues(9, c0="t0", c8="t8"), CUE)
    batches = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 7, 7)], BATCH)
    got = {r.batch_no: json.loads(r.payload) for r in rq.cue_requests(batches, df, 2, 3).collect()}
    cue = lambda i, t=None: {"id": str(i), "source": f"s{i}", "translated": t, "speaker": "A" if i % 2 else None}
    assert got[0] == {"cues": [cue(1), cue(2)], "preceding": [cue(0, "t0")], "following": [cue(3), cue(4), cue(5)]}
    assert got[1] == {"cues": [cue(7)], "preceding": [cue(5), cue(6)], "following": [cue(8, "t8")]}
    own = spark.createDataFrame(words(12), WORD)
    got = {r.batch_no: json.loads(r.payload) for r in rq.word_requests(spark.createDataFrame([(1, 0, 0, 3), (1, 1, 8, 9)], BATCH), own, df.where("start_ms < 4000"), 2, 3).collect()}
    word = lambda i: {"i": i, "t": words(12)[i][4] / 1000, "s": "0", "w": f"w{i}"}
    assert got[0]["words"] == [word(i) for i in range(4)] and got[0]["following"] == [word(i) for i in (4, 5, 6)] and [c["id"] for c in got[0]["preceding"]] in ([], ["0"])
    assert got[1]["words"] == [word(8), word(9)] and got[1]["following"] == [word(10), word(11)] and [c["id"] for c in got[1]["preceding"]] == ["2", "3"]


def sequential(rows, made, joints, size):
    """The rule joint by joint: cues as (first, last), rows as words."""
    made = dict(made)
    for at, forced in sorted(joints):
        owner = {i: f for f, z in made.items() for i in range(f, z + 1)}
        left, right = owner.get(at), owner.get(at + 1)
        if left is None or right is None or left == right:
            continue
        near = rows[right][2] == rows[left][2] and rows[right][4] - max(r[5] for r in rows[left : made[left] + 1]) < 800
        if not (near or forced):
            continue
        low, high = left, made[right]
        made = {f: z for f, z in made.items() if not (low <= f and z <= high)}
        at_ = low
        while at_ <= high:
            z = at_
            while z < high and rows[z + 1][2] == rows[at_][2] and z + 1 - at_ < size:
                z += 1
            made[at_] = z
            at_ = z + 1
    return sorted(made.items())


@pytest.mark.parametrize("seed", [1])
def test_repairs_in_rounds_equal_one_after_the_other(spark, seed, tmp_path):
    rnd = random.Random(seed)
    all_rows, all_cues, all_joints, want = [], [], [], {}
    for track in range(3):
        rows, at, by = [], 0, "0"
        for i in range(60):
            by = rnd.choice("01") if rnd.random() < 0.15 else by
            rows.append((track, i, by, "w", at, at + 100))
            at += rnd.choice([150, 150, 1_500])
        made, i = {}, 0
        while i < 60:
            z = i
            while z < 59 and rows[z + 1][2] == rows[i][2] and rnd.random() < 0.6:
                z += 1
            made[i] = z
            i = z + 1
        for f in rnd.sample(sorted(made), 2):
            made.pop(f)
        joints = [(j, rnd.random() < 0.3) for j in rnd.sample(range(59), 14)]
        want[track] = sequential(rows, made, joints, 3)
        all_rows += rows
        all_cues += [(track, f"words-{f}-{z}", f, z, rows[f][4], max(r[5] for r in rows[f : z + 1]), rows[f][2], "s", "t") for f, z in made.items()]
        all_joints += [(track, j, forced) for j, forced in joints]
    df = spark.createDataFrame(all_rows, WORD).cache()
    kind = "track_id long, id string, first long, last long, start_ms long, end_ms long, speaker string, source string, translated string"
    rounds = []

    def recut(batches, now):
        rounds.append(batches.count())
        return bk.word_cues(df, batches, lambda p, e: cutter(p, e, 3), str(folder), attempts=1)

    folder = tmp_path / "ledger"
    got = bk.repair_in_rounds(df, spark.createDataFrame(all_cues, kind), spark.createDataFrame(all_joints, "track_id long, ordinal long, forced boolean"), recut)
    found = {}
    for r in got.collect():
        found.setdefault(r.track_id, []).append((r["first"], r["last"]))
    assert {t: sorted(v) for t, v in found.items()} == want
    assert len(rounds) < 14 and got.agg(F.countDistinct("track_id")).first()[0] == 3


def test_lists_and_exploded_ranges_are_never_broadcast(spark):
    """Their size is nothing Spark can tell: estimated as small, they once filled the driver's memory."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    batches = spark.createDataFrame([(1, 0, 0, 3), (1, 1, 4, 9)], BATCH)
    df = spark.createDataFrame(words(10), WORD)
    own = rq._members(batches, df, "text")
    listed = rq._listed(own, "words", "ordinal", lambda w: w.text, "text")
    for joined in (own, rq._object({"words": listed, "following": listed.withColumnRenamed("words", "following")}, False), df.join(sinks.cut(df.select("ordinal"), "small"), "ordinal")):
        assert "SortMergeJoin" in plan(joined) and "Broadcast" not in plan(joined)


def test_a_wave_reads_its_own_requests_only(spark):
    df = sinks.cut(spark.range(40).selectExpr("id", "CAST(id % 4 AS INT) AS wave"), "open", "wave")
    one = df.where("wave = 1")
    assert "PartitionFilters: [isnotnull(wave" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 10


def test_quick_waves_grow(spark, tmp_path, monkeypatch):
    """Once every wave was of the same few requests, so that quick services waited for the many small tables."""
    payloads = spark.createDataFrame([(1, b, f"p{b}") for b in range(120)], "track_id long, batch_no long, payload string")
    waves = lambda at: len({p.name.split("-", 2)[2] for p in (tmp_path / f"{at}-raw").glob("part-*")})
    assert rq.settled_replies(payloads, lambda p, e: p, str(tmp_path / "a"), attempts=1, wave=2).count() == 120
    assert waves("a") < 12
    monkeypatch.setattr(rq, "QUICK_S", 0.0)
    assert rq.settled_replies(payloads.where("batch_no < 20"), lambda p, e: p, str(tmp_path / "b"), attempts=1, wave=2).count() == 20
    assert waves("b") >= 10
