"""What is written: process logs, raw responses, installed timelines, live snapshots."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tempora-')}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: what is built on it several times computes it once. It goes when the application ends.

    Spark takes the size of the files for that of the rows, which repetitive texts and lists exceed many times over: joins with it are merged, not broadcast.
    Each value of the columns ``folders`` has a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def append_log(lines: DataFrame, path: str) -> None:
    """Append process lines (track_id, process, stream, line); white space at their ends goes."""
    lines.select("track_id", "process", "stream", F.regexp_replace("line", r"(?U)\s+$", "").alias("line"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def archive_responses(responses: DataFrame, path: str) -> None:
    """Append raw responses (track_id, body) as JSON lines; where they are parts of a session, ``session_s`` says when it began."""
    kept = ["track_id", *(["session_s"] if "session_s" in responses.columns else []), "body"]
    responses.select(*kept).write.mode("append").json(path)


def install_timeline(cues: DataFrame, path: str, markers: str) -> None:
    """Replace the stored cues of the tracks in ``cues`` by them, and mark these tracks as aligned once they are written.

    The table is partitioned by track; only the partitions of these tracks are overwritten.
    """
    cues.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track_id").parquet(path)
    marks = cues.select("track_id").distinct().select(F.col("track_id").cast("string").alias("job_id"), F.lit("alignment_complete").alias("name"), F.lit("true").alias("value"))
    marks.withColumn("at_us", F.unix_micros(F.current_timestamp())).withColumn("seq", F.lit(0).cast("bigint")).write.mode("append").parquet(markers)


class LostUpdate(RuntimeError):
    """Another commit came between reading a version and writing the next one."""


def _pointer(folder: str, version: int) -> str:
    return f"{folder}/_versions/{version:012d}.json"


def latest_version(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """The number of the last commit in ``folder``, 0 if there is none, and its manifest."""
    fs, at = _at(spark, f"{folder}/_versions")
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
    if not numbers:
        return 0, {"parts": {}, "markers": {}}
    text = spark.read.text(_pointer(folder, max(numbers)), wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def commit_timeline(cues: DataFrame, folder: str, markers: dict[str, str] | None = None, expected: int | None = None, parts: int = 64) -> int:
    """Replace the stored cues of the tracks in ``cues`` by them, with ``markers`` for these tracks, as one new version; returns its number.

    The rows of the parts of the key that hold these tracks, and the markers, are written beside the old ones; a manifest that names the
    files of every part is then created under the next number, which only one writer can do. Readers see the version before or this one and
    nothing between. ``expected`` is the version that the caller has read; if there is a newer one, or another writer comes first, ``LostUpdate``
    is raised and nothing has changed. A part without changes is never rewritten.
    """
    spark = cues.sparkSession
    version, manifest = latest_version(spark, folder)
    if expected is not None and expected != version:
        raise LostUpdate(f"version {version} instead of {expected}")
    cues = cut(cues.withColumn("_part", F.pmod(F.xxhash64("track_id"), F.lit(parts)).cast("int")), "commit")
    touched = sorted(r[0] for r in cues.select("_part").distinct().collect())
    new, fresh = f"{folder}/data/{uuid.uuid4().hex}", cues
    if old := sorted({manifest["parts"][str(p)] for p in touched if str(p) in manifest["parts"]}):
        rest = spark.read.schema(cues.drop("_part").schema).parquet(*[f"{folder}/{path}" for path in old])
        fresh = fresh.unionByName(rest.join(cues.select("track_id").distinct(), "track_id", "left_anti").withColumn("_part", F.pmod(F.xxhash64("track_id"), F.lit(parts)).cast("int")))
    fresh.repartition("_part").write.partitionBy("_part").parquet(new)
    kept = {**manifest["parts"], **{str(p): f"{new.removeprefix(folder + '/')}/_part={p}" for p in touched}}
    told = dict(manifest["markers"])
    if markers:
        path = f"{folder}/markers/{uuid.uuid4().hex}"
        named = F.explode(F.create_map(*[F.lit(x) for pair in markers.items() for x in pair])).alias("name", "value")
        cues.select("track_id").distinct().select(F.col("track_id").cast("string").alias("job_id"), named).withColumn("version", F.lit(version + 1).cast("bigint")).write.parquet(path)
        told[str(version + 1)] = path.removeprefix(folder + "/")
    fs, at = _at(spark, _pointer(folder, version + 1))
    _, draft = _at(spark, f"{folder}/_drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"parts": kept, "markers": told}).encode()))
    out.close()
    fs.mkdirs(at.getParent())
    # written whole under another name first: a rename to a name that is taken fails
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise LostUpdate(f"version {version + 1} was written meanwhile")
    return version + 1


def read_timeline(spark: SparkSession, folder: str, schema: str, version: int | None = None) -> DataFrame:
    """The cues of the last committed version, or of ``version``."""
    manifest = latest_version(spark, folder)[1] if version is None else json.loads(spark.read.text(_pointer(folder, version), wholetext=True).first()[0])
    paths = [f"{folder}/{p}" for p in manifest["parts"].values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, name, value): the last committed marker of each job and name."""
    paths = [f"{folder}/{p}" for p in latest_version(spark, folder)[1]["markers"].values()]
    kind = "job_id string, name string, value string, version long"
    rows = spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    return rows.groupBy("job_id", "name").agg(F.max_by("value", "version").alias("value"))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Documents (track_id, mode, document) as text files, in a folder for each track and mode, and a manifest of their digests beside them.

    Files of these tracks and modes are replaced, others stay; the manifest is appended once they are written, and its last row for a file counts.
    """
    rows = cut(documents.select("track_id", "mode", "document"), "documents")
    rows.repartition("track_id", "mode").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track_id", "mode").text(f"{folder}/files")
    listed = rows.select("track_id", "mode", F.sha2("document", 256).alias("digest"), F.octet_length("document").cast("bigint").alias("bytes"), F.unix_micros(F.current_timestamp()).alias("at_us"))
    listed.write.mode("append").parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(track_id, mode, document) of the files that ``write_documents`` wrote."""
    files = spark.read.schema("value string, track_id long, mode string").option("basePath", f"{folder}/files").text(f"{folder}/files", wholetext=True)
    return files.select("track_id", "mode", F.regexp_replace("value", r"\n\z", "").alias("document"))


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(track_id, mode, kind) of documents whose file is missing or not what the manifest says (edited), and of files without an entry (unknown)."""
    last = spark.read.parquet(f"{folder}/manifest").groupBy("track_id", "mode").agg(F.max_by("digest", "at_us").alias("digest"))
    now = read_documents(spark, folder).select("track_id", "mode", F.sha2("document", 256).alias("found"))
    both = last.join(now, ["track_id", "mode"], "full_outer")
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "unknown").when(F.col("found") != F.col("digest"), "edited")
    return both.select("track_id", "mode", kind.alias("kind")).where("kind IS NOT NULL")


def live_snapshots(cues: Callable[[SparkSession], DataFrame], path: str, mode: str = "bilingual") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rewrites the documents of the tracks that a micro-batch changes, from all their cues."""
    from ..operators.publish import publish_documents

    def batch(changed: DataFrame, _: int) -> None:
        spark = changed.sparkSession
        tracks = changed.select("track_id").distinct()
        own = cues(spark).join(tracks, "track_id", "left_semi")
        frames = tracks.select("track_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
        shown = "bilingual" if mode == "all" else mode
        docs = publish_documents(own, frames, [shown], "source", "target").select("track_id", "document")
        docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track_id").parquet(path)

    return batch
