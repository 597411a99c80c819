"""Subtitle files as a data source: tasks write and read them, a release makes what was written visible.

A folder holds ``data`` (the files, under names that no later write touches), ``parts`` (what a task wrote, one list for each bucket of
tracks) and ``releases`` (numbered; each names its parts and whether those before it still count). Of a track and mode, the last release counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import LostUpdate

COLUMNS = ["track_id", "mode", "file", "document"]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":" in path else os.path.abspath(path))


def _read(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as source:
        return source.read()


def _write(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as sink:
        sink.write(content)


def _releases(fs: pafs.FileSystem, base: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(f"{base}/releases", allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.removesuffix(".json").isdigit())


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[int, str]]


@dataclass
class Bucket(InputPartition):
    parts: list[str]


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.buckets, self.overwrite = options["path"], int(options.get("buckets", 256)), overwrite
        self.expected = int(options["expected"]) if "expected" in options else None
        self.id = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _opened(self.path)
        attempt = f"{self.id}/{uuid.uuid4().hex}"
        lists: dict[int, dict[tuple, dict[str, Any]]] = defaultdict(dict)
        for batch in batches:
            for row in batch.select(COLUMNS).to_pylist():
                track, mode, file, document = (row[c] for c in COLUMNS)
                if track is None or not mode or not file or not document:
                    raise ValueError(f"track {track} in mode {mode}: a file needs a name and a text")
                if file != os.path.basename(file) or file in (".", ".."):
                    raise ValueError(f"{file!r} is no file name")
                bucket = track % self.buckets
                if (track, mode) in lists[bucket]:
                    raise ValueError(f"track {track} comes twice in mode {mode}")
                content = document.encode()
                at = f"data/{attempt}/{bucket}/{track}/{mode}/{file}"
                _write(fs, f"{base}/{at}", content)
                lists[bucket][track, mode] = {"track_id": track, "mode": mode, "file": file, "at": at, "digest": hashlib.sha256(content).hexdigest()}
        parts = []
        for bucket, entries in lists.items():
            parts.append((bucket, f"parts/{attempt}/{bucket}.jsonl"))
            _write(fs, f"{base}/{parts[-1][1]}", "".join(f"{json.dumps(e)}\n" for e in entries.values()).encode())
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = _opened(self.path)
        past = _releases(fs, base)
        number = int(os.path.basename(past[-1]).removesuffix(".json")) if past else 0
        if self.expected is not None and self.expected != number:
            self.abort(messages)
            raise LostUpdate(f"release {number} instead of {self.expected}")
        at, draft = f"{base}/releases/{number + 1:012d}.json", f"{base}/drafts/{self.id}.json"
        parts = [p for m in messages if m for p in m.parts]
        _write(fs, draft, json.dumps({"anew": self.overwrite, "parts": parts}).encode())
        fs.create_dir(os.path.dirname(at), recursive=True)
        try:
            if isinstance(fs, pafs.LocalFileSystem):
                os.link(draft, at)  # fails if another writer was first, as a rename would not
                fs.delete_file(draft)
            elif fs.get_file_info(at).type != pafs.FileType.NotFound:
                raise FileExistsError(at)
            else:
                fs.move(draft, at)
        except FileExistsError as taken:
            self.abort(messages)
            raise LostUpdate(f"release {number + 1} was written meanwhile") from taken

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = _opened(self.path)
        for kind in ("data", "parts"):
            fs.delete_dir_contents(f"{base}/{kind}/{self.id}", missing_dir_ok=True)


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.release = int(options["release"]) if "release" in options else None

    def partitions(self) -> list[Bucket]:
        fs, base = _opened(self.path)
        lists: dict[int, list[str]] = defaultdict(list)
        for release in _releases(fs, base):
            if self.release is not None and int(os.path.basename(release).removesuffix(".json")) > self.release:
                break
            told = json.loads(_read(fs, release))
            if told["anew"]:
                lists.clear()
            for bucket, part in told["parts"]:
                lists[bucket].append(part)
        return [Bucket(parts) for parts in lists.values()] or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        fs, base = _opened(self.path)
        last = {}
        for part in partition.parts:
            for line in _read(fs, f"{base}/{part}").splitlines():
                entry = json.loads(line)
                last[entry["track_id"], entry["mode"]] = entry
        for e in last.values():
            try:
                content = _read(fs, f"{base}/{e['at']}")
            except FileNotFoundError:
                yield e["track_id"], e["mode"], e["file"], e["at"], None, "missing"
                continue
            drift = None if hashlib.sha256(content).hexdigest() == e["digest"] else "edited"
            yield e["track_id"], e["mode"], e["file"], e["at"], content.decode(errors="replace"), drift


class DocumentFiles(DataSource):
    """``subtitle_files``: (track_id, mode, file, at, document, drift). ``drift`` says that a file is missing or was edited; ``at`` is where it is in the folder.

    Writing takes (track_id, mode, file, document) in any order, other columns are ignored. Appending replaces the files of the tracks and modes that are
    written and leaves others, overwriting leaves none; readers see all of a write or nothing. A null or empty value and a (track, mode) that comes twice are
    errors, and a write that fails leaves no release. With ``expected``, a write fails if another release is the last; without, the later writer wins.
    Reading a release by its number takes ``release``. ``buckets`` (256) is the number of partitions that readers get; a folder keeps the
    number it began with. Local disks refuse a second writer of a release; on other file systems two writers in the same instant may both win.
    """

    @classmethod
    def name(cls) -> str:
        return "subtitle_files"

    def schema(self) -> str:
        return "track_id long, mode string, file string, at string, document string, drift string"

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def publish_files(documents: DataFrame, folder: str, anew: bool = False, expected: int | None = None, buckets: int = 256) -> None:
    """Write (track_id, mode, file, document) as one release. Buckets meet in one task each, so a release has at most ``buckets`` lists."""
    documents.sparkSession.dataSource.register(DocumentFiles)
    rows = documents.select("track_id", "mode", "file", F.lit(None).cast("string").alias("at"), "document", F.lit(None).cast("string").alias("drift"))
    out = rows.repartition(F.pmod("track_id", F.lit(buckets))).write.format("subtitle_files").mode("overwrite" if anew else "append").option("buckets", buckets)
    (out if expected is None else out.option("expected", expected)).save(folder)


def published_files(spark: SparkSession, folder: str, release: int | None = None) -> DataFrame:
    """The files of the last release, or of ``release``."""
    spark.dataSource.register(DocumentFiles)
    source = spark.read.format("subtitle_files")
    return (source if release is None else source.option("release", release)).load(folder)
