import pytest
from pyspark.sql import functions as F

from tempora.sources import sinks as sk

CUE = "track_id long, id long, source string"


def cues(spark, *rows):
    return spark.createDataFrame(list(rows), CUE)


def test_commits_replace_tracks_and_markers_together(spark, tmp_path):
    folder = str(tmp_path / "t")
    read = lambda **k: sorted(map(tuple, sk.read_timeline(spark, folder, CUE, **k).collect()))
    assert read() == [] and sk.latest_version(spark, folder)[0] == 0 and sk.read_markers(spark, folder).count() == 0
    assert sk.commit_timeline(cues(spark, (1, 1, "a"), (2, 1, "b"), (3, 1, "c")), folder, {"alignment_complete": "no"}, parts=2) == 1
    assert sk.commit_timeline(cues(spark, (2, 5, "new"), (4, 1, "d")), folder, {"alignment_complete": "true"}, expected=1, parts=2) == 2
    assert read() == [(1, 1, "a"), (2, 5, "new"), (3, 1, "c"), (4, 1, "d")] and read(version=1) == [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]
    assert {(r.job_id, r.value) for r in sk.read_markers(spark, folder).collect()} == {("1", "no"), ("2", "true"), ("3", "no"), ("4", "true")}


def test_a_writer_that_comes_late_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    sk.commit_timeline(cues(spark, (1, 1, "a")), folder)
    with pytest.raises(sk.LostUpdate):
        sk.commit_timeline(cues(spark, (1, 1, "b")), folder, expected=0)
    # another writer commits after this one has read the version
    latest = sk.latest_version

    def late(spark, folder):
        found = latest(spark, folder)
        monkeypatch.setattr(sk, "latest_version", latest)
        sk.commit_timeline(cues(spark, (1, 1, "other")), folder)
        return found

    monkeypatch.setattr(sk, "latest_version", late)
    with pytest.raises(sk.LostUpdate):
        sk.commit_timeline(cues(spark, (1, 1, "mine")), folder)
    assert [r.source for r in sk.read_timeline(spark, folder, CUE).collect()] == ["other"] and sk.latest_version(spark, folder)[0] == 2


def test_a_failure_between_rows_and_pointer_is_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    sk.commit_timeline(cues(spark, (1, 1, "a")), folder, {"m": "1"})
    pointer = sk._pointer

    def broken(folder, version):
        if version == 2:
            raise OSError("disk")
        return pointer(folder, version)

    monkeypatch.setattr(sk, "_pointer", broken)
    with pytest.raises(OSError):
        sk.commit_timeline(cues(spark, (1, 1, "b"), (7, 1, "z")), folder, {"m": "2"})
    monkeypatch.undo()
    assert [tuple(r) for r in sk.read_timeline(spark, folder, CUE).collect()] == [(1, 1, "a")] and [r.value for r in sk.read_markers(spark, folder).collect()] == ["1"]


def test_documents_as_files_and_their_drift(spark, tmp_path):
    folder = str(tmp_path / "d")
    text = "[Script Info]\nTitle: ä\n\n[Events]\nDialogue: 1\n"
    docs = spark.createDataFrame([(1, "source", text), (1, "target", "x"), (2, "source", "")], "track_id long, mode string, document string")
    sk.write_documents(docs, folder)
    back = lambda: {(r.track_id, r.mode): r.document for r in sk.read_documents(spark, folder).collect()}
    assert back() == {(1, "source"): text, (1, "target"): "x", (2, "source"): ""} and sk.changed_files(spark, folder).count() == 0
    sk.write_documents(docs.where("mode = 'target'").withColumn("document", F.lit("y")), folder)
    assert back()[1, "target"] == "y" and back()[1, "source"] == text and sk.changed_files(spark, folder).count() == 0
    (file,) = (tmp_path / "d" / "files" / "track_id=2" / "mode=source").glob("part-*")
    file.write_text("edited\n")
    (file.parent / f".{file.name}.crc").unlink()  # of the local file system, which would call the edit a broken disk
    (gone,) = (tmp_path / "d" / "files" / "track_id=1" / "mode=target").glob("part-*")
    gone.unlink()
    spark.catalog.clearCache()
    assert {tuple(r) for r in sk.changed_files(spark, folder).collect()} == {(2, "source", "edited"), (1, "target", "missing")}
