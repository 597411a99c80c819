import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tempora.operators import journal as jr
from tempora.operators import publish as pb
from tempora.sources import documents as dc

DOC = "track_id long, mode string, file string, document string"


@pytest.fixture
def docs(spark):
    cues = [(t, i, i, i * 2_000, i * 2_000 + 1_500, f"ann{t % 2}", f"ä {t} {i}, x", f"b {i}") for t in range(1, 41) for i in range(5)]
    df = spark.createDataFrame(cues, "track_id long, id long, ordinal long, start_ms long, end_ms long, speaker string, source string, translated string")
    frames = df.select("track_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")).distinct()
    return df, pb.publish_documents(df, frames, ["all"], "de", "en")


def rows(df):
    return sorted((r.track_id, r.mode, r.file, r.document) for r in df.collect())


def test_publish_read_back_and_drift(spark, tmp_path, docs):
    folder, (cues, files) = str(tmp_path / "out"), docs
    dc.publish_files(files, folder, buckets=8)
    back = dc.published_files(spark, folder)
    assert rows(back) == rows(files) and len(rows(back)) == 120 and back.where("drift IS NOT NULL").isEmpty()
    assert back.rdd.getNumPartitions() == 8
    assert (1, "bilingual", "1.de-en.ass") in {tuple(r) for r in back.select("track_id", "mode", "file").collect()}
    events = jr.parse_documents(back.where("mode = 'bilingual'").select("track_id", "document"))
    assert sorted((r.track_id, r.start_ms, r.end_ms, r.name, *r.lines) for r in events.collect()) == sorted((r.track_id, r.start_ms, r.end_ms, r.speaker, r.translated, r.source) for r in cues.collect())
    at = {(r.track_id, r.mode): r.at for r in back.collect()}
    (tmp_path / "out" / at[3, "source"]).write_text("edited")
    (tmp_path / "out" / at[4, "source"]).unlink()
    drift = {(r.track_id, r.mode, r.drift, r.document) for r in back.where("drift IS NOT NULL").collect()}
    assert drift == {(3, "source", "edited", "edited"), (4, "source", "missing", None)}


def test_releases_replace_files_of_tracks_and_modes(spark, tmp_path):
    folder = str(tmp_path / "out")
    first = [(1, "source", "1.source.ass", "a"), (1, "translated", "1.translated.ass", "b"), (-2, "source", "2.source.ass", "c\n")]
    dc.publish_files(spark.createDataFrame(first, DOC), folder, buckets=4)
    dc.publish_files(spark.createDataFrame([(1, "source", "new.ass", "A"), (3, "source", "3.ass", "d")], DOC), folder, buckets=4)
    assert rows(dc.published_files(spark, folder)) == sorted([(1, "source", "new.ass", "A"), *first[1:], (3, "source", "3.ass", "d")])
    assert rows(dc.published_files(spark, folder, release=1)) == sorted(first)
    dc.publish_files(spark.createDataFrame([(9, "source", "9.ass", "z")], DOC), folder, anew=True, expected=2, buckets=4)
    assert rows(dc.published_files(spark, folder)) == [(9, "source", "9.ass", "z")]
    dc.publish_files(spark.createDataFrame([], DOC), folder, buckets=4)
    assert rows(dc.published_files(spark, folder)) == [(9, "source", "9.ass", "z")]
    dc.publish_files(spark.createDataFrame([], DOC), folder, anew=True, buckets=4)
    assert rows(dc.published_files(spark, folder)) == [] == rows(dc.published_files(spark, str(tmp_path / "nowhere")))


@pytest.mark.parametrize("bad", [(5, "source", "5.ass", None), (5, "source", "5.ass", ""), (None, "source", "x.ass", "t"), (5, None, "x.ass", "t"), (5, "source", "../x.ass", "t"), (1, "source", "again.ass", "t")])
def test_a_write_that_fails_is_not_seen(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    dc.publish_files(spark.createDataFrame([(1, "source", "1.ass", "old")], DOC), folder)
    with pytest.raises(PySparkException):
        dc.publish_files(spark.createDataFrame([(1, "source", "1.ass", "new"), (2, "source", "2.ass", "new"), bad], DOC), folder)
    assert rows(dc.published_files(spark, folder)) == [(1, "source", "1.ass", "old")]


def test_a_writer_that_comes_late_changes_nothing(spark, tmp_path, monkeypatch):
    folder, one = str(tmp_path / "out"), [(1, "source", "1.ass", "old")]
    dc.publish_files(spark.createDataFrame(one, DOC), folder)
    with pytest.raises(PySparkException, match="release 1 instead of 0"):
        dc.publish_files(spark.createDataFrame([(1, "source", "1.ass", "late")], DOC), folder, expected=0)
    late = dc.DocumentWriter({"path": folder}, False)
    (tmp_path / "out" / "releases" / "000000000002.json").write_text('{"anew": false, "parts": []}')
    monkeypatch.setattr(dc, "_releases", lambda fs, base: [f"{base}/releases/000000000001.json"])
    with pytest.raises(dc.LostUpdate, match="release 2 was written meanwhile"):
        late.commit([])
    monkeypatch.undo()
    assert rows(dc.published_files(spark, folder)) == one
