"""Work of outside services over batches: a user's function translates, every attempt is a row; pipelines built on it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import word_range_id
from ..sources.records import cue_payloads, reply_items, word_lists
from ..sources.sinks import cut, shared_folder
from .alignment import align
from .intervals import extend_cue_ends, long_silence_starts, merge_intervals, normalize_timeline, onset_starts
from .journal import apply_replies, missing_batches, voiced_spans
from .requests import attempted, batch_words, cue_reply_errors, cue_requests, retry_delay, settled_replies, word_errors, word_reply_items, word_requests
from .words import batch_joints, junctions, missing_word_batches, repair_spans, uncovered_words

ATTEMPT = "track_id long, batch_no long, attempt int, status string, text string, error string"


def translate_batches(
    payloads: DataFrame, translate: Callable[[str, str | None], str], attempts: int = 3, delay: float = 0.0, timeout_s: float | None = None,
    check: Callable[[str, str], str | None] | None = None, in_flight: int = 1,
) -> DataFrame:
    """One row an attempt, of (track_id, batch_no, payload): ``translate`` gets the payload and the error of the attempt before.

    An attempt that takes longer than ``timeout_s`` has failed, as has one for whose payload and reply ``check`` gives an error. Each task has
    ``in_flight`` batches under way. ``requests.settled_replies`` is the way for work that must survive a stop.
    """

    def tried(batch: tuple) -> list[tuple]:
        track, number, payload = batch
        out, error = [], None
        for attempt in range(1, attempts + 1):
            text, error = attempted(translate, payload, error, timeout_s)
            error = error if error or check is None else check(payload, text)
            out.append((track, number, attempt, "failed" if error else "complete", None if error else text, error))
            if not error:
                break
            time.sleep(retry_delay(attempt, delay) if attempt < attempts else 0)
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                out = [row for rows in pool.map(tried, zip(batch["track_id"], batch["batch_no"], batch["payload"], strict=True)) for row in rows]
                yield pd.DataFrame(out, columns=["track_id", "batch_no", "attempt", "status", "text", "error"])

    return payloads.select("track_id", "batch_no", "payload").mapInPandas(work, ATTEMPT)


def translate_missing(
    cues: DataFrame, translate: Callable[[str, str | None], str], size: int = 20, attempts: int = 3, delay: float = 0.0, source_edits: bool = True, folder: str | None = None, done: DataFrame | None = None,
    timeout_s: float | None = None, context: tuple[int, int] | None = None, in_flight: int = 4,
) -> DataFrame:
    """The cues with translations for those without one, asked for in batches. A reply that names other cues than those of its batch,
    leaves some out or leaves a translation empty is a failed attempt; its error goes along with the next one. If no attempt is sound, the last
    reply counts for the cues it does translate.

    Replies may correct sources unless ``source_edits`` is false, as after alignment. Cues in ``done`` (track_id, id) are under way elsewhere
    and not asked for. With ``context``, so many cues before and behind go along with a batch. The attempts are a ledger in ``folder``, else in the
    shared folder: what it holds complete is not asked again.
    """
    folder = folder or f"{shared_folder(cues.sparkSession)}/attempts-{uuid.uuid4().hex}"
    cues = cut(cues, "cues")
    open_ = cues if done is None else cues.join(done.select("track_id", "id"), ["track_id", "id"], "left_anti")
    batches = cut(missing_batches(open_, size), "batches")
    payloads = cue_payloads(batches, cues) if context is None else cue_requests(batches, cues, *context)
    replies = settled_replies(payloads, translate, folder, cue_reply_errors(batches, cues), attempts, delay, timeout_s, in_flight, lenient=True)
    items = reply_items(replies)
    missing = open_.where("coalesce(translated, '') = ''").select("track_id", F.col("id").cast("string").alias("id"))
    last = F.max_by(F.struct("source", "translated"), "batch_no").alias("r")
    asked = items.join(missing, ["track_id", "id"], "left_semi").groupBy("track_id", "id").agg(last).select("track_id", "id", "r.*")
    return apply_replies(cues, asked, source_edits)


def word_cues(
    words: DataFrame, batches: DataFrame, segment: Callable[[str, str | None], str], folder: str, attempts: int = 3, delay: float = 0.0,
    timeout_s: float | None = None, cues: DataFrame | None = None, in_flight: int = 4,
) -> DataFrame:
    """(track_id, id, first, last, start_ms, end_ms, speaker, source, translated, batch_no): a service's cues over batches of words.

    Times and speakers are those of the words a cue names. A reply with a problem is a failed attempt, whose error goes along with the next one;
    a batch without a sound reply gives no cue. With ``cues``, the last of these before a batch and the words behind it go along.
    """
    batches = cut(batches, "batches")
    # the words that are asked for: all that payloads, checks and times need, however many others there are
    inside = cut(batch_words(batches, words), "asked")
    payloads = word_lists(inside) if cues is None else word_requests(batches, words, cues)
    sound = word_reply_items(settled_replies(payloads, segment, folder, word_errors(inside), attempts, delay, timeout_s, in_flight))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("batch_no", "n"))
    sound = sound.withColumn("position", place.cast("bigint"))
    owned = sound.select("track_id", "batch_no", "position", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge").join(inside.select("track_id", "batch_no", "ordinal", "start_ms", "end_ms", "speaker"), ["track_id", "batch_no", "ordinal"])
    lead = owned.groupBy("track_id", "position").agg(F.min_by(F.struct("start_ms", "speaker"), "ordinal").alias("lead"))
    own = owned.join(lead, ["track_id", "position"]).where(F.col("speaker").eqNullSafe(F.col("lead.speaker")))
    timed = own.groupBy("track_id", "position").agg(F.first("lead.start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("lead.speaker").alias("speaker"))
    rows = sound.join(timed, ["track_id", "position"])
    values = ["first", "last", "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), "speaker", F.trim("source").alias("source"), F.trim("translated").alias("translated")]
    return rows.select("track_id", word_range_id(F.col("first"), F.col("last")).alias("id"), *values, "batch_no")


def repair_in_rounds(words: DataFrame, cues: DataFrame, joints: DataFrame, recut: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The cues (track_id, id, first, last, ...) after their torn joints (track_id, ordinal, forced) were cut anew, from the first to the last one of
    each track, each seeing the cues that the ones before it left; a joint is judged once.

    A repair touches no word outside the two cues at its joint, so joints whose cues lie behind those of every joint before them that waits
    are taken in the same round: the rounds are as many as the longest chain of joints that share cues, whatever the number of joints.
    ``recut`` gets batches (track_id, batch_no, first, last) and the present cues and returns new cues with their batch_no; a batch without new ones keeps the old.
    """
    cues, waiting = cut(cues, "cues"), cut(joints.select("track_id", "ordinal", "forced"), "joints")
    columns = cues.columns
    order = Window.partitionBy("track_id").orderBy("ordinal")
    # what a joint sees is the two words at it and their cues
    places = lambda: waiting.select("track_id", F.explode(F.array(F.col("ordinal"), F.col("ordinal") + 1)).alias("ordinal")).hint("merge")
    sides = cut(words.select("track_id", "ordinal").join(places(), ["track_id", "ordinal"], "left_semi"), "sides")
    while not waiting.isEmpty():
        touching = cues.select("track_id", "first", "last", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge").join(places(), ["track_id", "ordinal"], "left_semi")
        beside = cut(cues.join(touching.select("track_id", "first", "last").hint("merge"), ["track_id", "first", "last"], "left_semi"), "beside")
        torn = junctions(sides, beside, waiting.where("forced").select("track_id", "ordinal")).select("track_id", "ordinal", F.lit(True).alias("torn"))
        spans = repair_spans(waiting, beside).groupBy("track_id", "ordinal").agg(F.min("low").alias("low"), F.max("high").alias("high")).join(torn, ["track_id", "ordinal"], "left")
        before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
        judged = cut(spans.withColumn("free", F.coalesce(F.col("low") > before, F.lit(True))), "spans")
        now = judged.where("free AND torn")
        number = F.row_number().over(order) - 1
        batches = cut(now.select("track_id", number.cast("bigint").alias("batch_no"), F.col("low").alias("first"), F.col("high").alias("last")), "torn")
        if not batches.isEmpty():
            new = cut(recut(batches, cues), "redone")
            done = batches.join(new.select("track_id", "batch_no").distinct(), ["track_id", "batch_no"]).select("track_id", F.col("last").alias("high"), F.explode(F.sequence("first", "last")).alias("first")).hint("merge")
            gone = cues.join(done, ["track_id", "first"]).where("last <= high").select("track_id", "first", "last")
            cues = cut(cues.join(gone, ["track_id", "first", "last"], "left_anti").unionByName(new.select(*columns)), "cues")
        # those without a cue on either side are settled as well
        waiting = cut(waiting.join(judged.where("NOT free").select("track_id", "ordinal"), ["track_id", "ordinal"], "left_semi"), "joints")
    return cues


def segment_and_translate(
    words: DataFrame, segment: Callable[[str, str | None], str], folder: str, known: DataFrame | None = None, target: int = 400, attempts: int = 3,
    delay: float = 0.0, timeout_s: float | None = None, context: bool = False, in_flight: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """The finished timeline of a transcript's words, and (track_id, ordinal) of words that no cue covers, which are a failure.

    Every word that the ``known`` cues don't cover is sent to the service in batches, with the cues before and the words behind where ``context`` is set. Joints
    between batches whose cues look torn are cut anew over the words of both cues, whose places the new ones take. The cues are
    numbered in the order of time. ``folder`` holds the ledgers of both kinds of requests: a run that was stopped, or one with more known cues, asks
    in the same folder only for what no run before got.
    """
    words = cut(words, "words")
    spark, shape = words.sparkSession, "track_id long, id string, first long, last long, start_ms long, end_ms long, speaker string, source string, translated string"
    columns = [c.split()[0] for c in shape.split(", ")]
    known = spark.createDataFrame([], shape) if known is None else known.select(*columns)
    batches = cut(missing_word_batches(words, known, target), "wanted")
    fresh = word_cues(words, batches, segment, f"{folder}/batches", attempts, delay, timeout_s, known if context else None, in_flight).select(*columns)
    fresh.write.mode("overwrite").parquet(f"{folder}/drafts")
    cues = known.unionByName(spark.read.schema(fresh.schema).parquet(f"{folder}/drafts"))
    recut = lambda torn, now: word_cues(words, torn, segment, f"{folder}/repairs", attempts, delay, timeout_s, now if context else None, in_flight)
    final = repair_in_rounds(words, cues, batch_joints(batches, words), recut)
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("start_ms", "end_ms", F.coalesce("speaker", F.lit("")), "first"))
    timeline = final.withColumn("id", place.cast("bigint")).withColumn("ordinal", place.cast("bigint") - 1)
    return timeline, uncovered_words(words, final).select("track_id", "ordinal")


def transcribe_audio(recordings: DataFrame, transcribe: Callable[[bytes], str], offset: str | None = None) -> DataFrame:
    """(track_id, body): a user's transcriber over recordings (track_id, content); its JSON is read by ``records.cues_from_transcripts``
    or ``words_from_items``. A failure is a null body. ``offset`` names a column that goes along, where chunks of a recording start."""
    kept = ["track_id", *([offset] if offset else [])]
    kind = T.StructType([recordings.schema[c] for c in kept]).add("body", "string")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = []
            for content in batch["content"]:
                try:
                    bodies.append(transcribe(bytes(content)))
                except Exception:  # a recording that can't be read is a row without a body
                    bodies.append(None)
            yield batch[kept].assign(body=bodies)

    return recordings.select(*kept, "content").mapInPandas(work, kind)


def align_timeline(cues: DataFrame, spans: DataFrame, levels: DataFrame | None, duration_ms: int, backend: str = "vad", tokens: DataFrame | None = None, attempts: DataFrame | None = None, tol_ms: int = 40) -> DataFrame:
    """Cues aligned to speech: silences cut, starts and ends on spans or a forced aligner's words, starts on sound where levels are given,
    ends extended, renumbered. Tracks without spans take those of their levels."""
    merged = cut(merge_intervals(spans, tol_ms), "spans")
    voiced = None if levels is None else voiced_spans(levels)
    # every step reads its input several times, so each is a table
    cues = cut(cues, "cues")
    aligned = cut(align(cut(long_silence_starts(cues, merged), "silences"), backend, duration_ms, merged, attempts, tokens, voiced), "aligned")
    started = aligned if levels is None else cut(onset_starts(aligned, levels), "onsets")
    return normalize_timeline(cut(extend_cue_ends(started, duration_ms), "ends"), duration_ms)
