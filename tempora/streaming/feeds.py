"""Feeds of tracks: chunks with leading context, append-only words, ids seen once, tracks that changed.

The functions named ``stream_*`` take streams; the others give the same rows for stored tables.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import overlap_key, word_key

WORD = "track_id long, ordinal long, start_ms long, text string"
STATE = "n long, last_ms long, starts array<long>, texts array<string>"


def hop_chunks(rows: DataFrame, chunk_ms: int = 15_000, context_ms: int = 5_000) -> DataFrame:
    """(track_id, chunk_no, from_ms, to_ms) and the rows of each complete chunk.

    Chunk k covers ``context_ms`` before k * ``chunk_ms`` (the first from 0) to its end; chunks that the track's last start does not reach don't appear.
    """
    ends = rows.groupBy("track_id").agg(F.floor(F.max("start_ms") / chunk_ms).alias("complete"))
    begin, last = F.floor(F.col("start_ms") / chunk_ms), F.floor((F.col("start_ms") + context_ms) / chunk_ms)
    each = rows.withColumn("chunk_no", F.explode(F.sequence(begin, last))).join(ends, "track_id").where("chunk_no < complete").drop("complete")
    return each.withColumn("from_ms", F.greatest(F.lit(0), F.col("chunk_no") * chunk_ms - context_ms)).withColumn("to_ms", (F.col("chunk_no") + 1) * chunk_ms)


def stream_hop_chunks(rows: DataFrame, chunk_s: int = 15, context_s: int = 5, delay: str = "0 seconds") -> DataFrame:
    """(track_id, from_ms, to_ms, n) of the complete chunks of a stream with an ``at`` time stamp: hopping windows behind a watermark."""
    hop = F.window("at", f"{chunk_s + context_s} seconds", f"{chunk_s} seconds", f"{chunk_s - context_s} seconds")
    counted = rows.withWatermark("at", delay).groupBy("track_id", hop.alias("w")).agg(F.count("*").alias("n"))
    return counted.select("track_id", F.greatest(F.lit(0), F.unix_millis("w.start")).alias("from_ms"), F.unix_millis("w.end").alias("to_ms"), "n")


def _append(rows: pd.DataFrame, n: int, last_ms: int | None, recent: deque, within_ms: int) -> tuple[list[tuple[int, int, str]], int, int | None]:
    out = []
    for start, text, key in zip(rows["start_ms"], rows["text"], rows["key"], strict=True):
        if (last_ms is not None and start < last_ms) or any(abs(s - start) <= within_ms and k == key for s, k in recent):
            continue
        out.append((n, int(start), text))
        n, last_ms = n + 1, int(start)
        recent.append((int(start), key))
    return out, n, last_ms


def _keyed(words: DataFrame, *more: str) -> DataFrame:
    """Words with the key by which they are compared; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    return words.select("track_id", "seq", "start_ms", text.alias("text"), word_key(text).alias("key"), *more)


def append_only_words(words: DataFrame, within_ms: int = 600, window: int = 80) -> DataFrame:
    """(track_id, ordinal, start_ms, text) of words heard in the order of (seq): a word is left out if one of the last ``window`` kept ones
    has its text and starts within ``within_ms``, or if it starts before the last kept one. Ordinals have no gaps."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over sorted rows; only the state of the track at hand is held."""
        at, n, last_ms, recent = None, 0, None, deque(maxlen=window)
        for batch in batches:
            out = [pd.DataFrame([], columns=["track_id", "ordinal", "start_ms", "text"])]
            for track, rows in batch.groupby("track_id", sort=False):
                if track != at:
                    at, n, last_ms, recent = track, 0, None, deque(maxlen=window)
                kept, n, last_ms = _append(rows, n, last_ms, recent, within_ms)
                out.append(pd.DataFrame([(track, *k) for k in kept], columns=["track_id", "ordinal", "start_ms", "text"]))
            yield pd.concat(out)

    return _keyed(words).repartition("track_id").sortWithinPartitions("track_id", "seq").mapInPandas(fold, WORD)


def _timed(rows: DataFrame, idle: str | None, delay: str) -> tuple[DataFrame, str]:
    """Rows with ``at_ms``, null without ``idle``, behind a watermark on their time stamp ``at`` with it; and the kind of timeout of a state."""
    if idle is None:
        return rows.withColumn("at_ms", F.lit(None).cast("bigint")), GroupStateTimeout.NoTimeout
    return rows.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at")), GroupStateTimeout.EventTimeTimeout


def _until(state: GroupState, rows: pd.DataFrame, idle: str | None) -> None:
    """Let the state end once the watermark is ``idle`` behind its last row."""
    if idle is not None:
        state.setTimeoutTimestamp(max(int(rows["at_ms"].max() + pd.Timedelta(idle).total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))


def stream_append_only_words(words: DataFrame, within_ms: int = 600, window: int = 80, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """As ``append_only_words``, over a stream whose micro-batches come in the order of ``seq``. The state of a track is bounded by ``window``.

    With ``idle``, rows have a time stamp ``at``, and the state of a track without rows for so long of event time goes: such a track has ended, and one that
    begins anew counts from 0 again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last_ms, starts, texts = state.get if state.exists else (0, None, [], [])
        recent = deque(zip(starts, texts, strict=True), maxlen=window)
        rows = pd.concat(list(batches)).sort_values("seq")
        kept, n, last_ms = _append(rows, n, last_ms, recent, within_ms)
        state.update((n, last_ms, [s for s, _ in recent], [t for _, t in recent]))
        _until(state, rows, idle)
        yield pd.DataFrame(kept, columns=["ordinal", "start_ms", "text"]).assign(track_id=key[0])[["track_id", "ordinal", "start_ms", "text"]]

    timed, timeout = _timed(words, idle, delay)
    return _keyed(timed, "at_ms", *([] if idle is None else ["at"])).groupBy("track_id").applyInPandasWithState(step, WORD, STATE, "append", timeout)


def new_samples(deliveries: DataFrame) -> DataFrame:
    """(track_id, seq, from_ms, to_ms): what each delivery (seq, start_ms, end_ms) of a track adds beyond all earlier ones."""
    fed = F.max("end_ms").over(Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    begin = F.greatest(F.col("start_ms"), F.coalesce(fed, F.col("start_ms")))
    return deliveries.select("track_id", "seq", begin.alias("from_ms"), F.col("end_ms").alias("to_ms")).where("to_ms > from_ms")


def stream_new_ids(rows: DataFrame, delay: str) -> DataFrame:
    """Rows of a stream with an ``at`` time stamp, the first of each (track_id, id) inside the delay."""
    return rows.withWatermark("at", delay).dropDuplicatesWithinWatermark(["track_id", "id"])


def track_digests(cues: DataFrame) -> DataFrame:
    """(track_id, digest) over a track's ids, times and sources, whatever their order.

    The digest is the number of rows and the sums of both halves of their hashes, so every task adds up its part and no track meets in one row.
    """
    row = F.sha2(F.to_json(F.struct("start_ms", "end_ms", "id", "source"), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)"))
    return cues.groupBy("track_id").agg(F.concat_ws("-", F.count("*"), half(1), half(16)).alias("digest"))


def changed_tracks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tracks of ``new`` that ``old`` lacks or has otherwise."""
    return track_digests(new).join(track_digests(old), ["track_id", "digest"], "left_anti").select("track_id")


def session_events(events: DataFrame) -> DataFrame:
    """Session events (kind, payload) with ``route``: words, end (the session is over, a new one may go on), fatal, else other."""
    # Kinds of session events.
    over = ["session_limit", "closed", "insufficient_audio_activity", "commit_throttled"]
    kind = F.col("kind")
    return events.withColumn("route", F.when(kind == "words", "words").when(kind.isin(over), "end").when(kind == "error", "fatal").otherwise("other"))


def on_changes(act: Callable[[DataFrame], None], known: Callable[[], DataFrame], remember: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: ``act`` gets the cues of those tracks only whose cues differ from the ``known`` ones."""

    def batch(cues: DataFrame, _: int) -> None:
        act(cues.join(changed_tracks(known(), cues), "track_id", "left_semi"))
        remember(cues)

    return batch


def stream_chunk_timeline(cues: DataFrame, within_ms: int = 2_500, horizon_ms: int = 60_000, idle: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(track_id, ordinal, start_ms, end_ms, source) of a stream of chunks' cues that are new: no cue of the same text that came before
    starts within ``within_ms``. Its table twin is ``words.overlap_merge`` over no existing cues.

    The state is kept by track and text; starts more than ``horizon_ms`` before the text's latest one are forgotten, as chunks overlap by far less.
    With ``idle``, cues have a time stamp ``at``, and the state of a text that was not heard for so long of event time goes.
    """
    shape = "track_id long, ordinal long, start_ms long, end_ms long, source string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        starts = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ordinal", "start_ms"])
        keep = []
        for start in rows["start_ms"]:
            new = all(abs(s - start) > within_ms for s in starts)
            keep.append(new)
            if new:
                starts.append(int(start))
        state.update(([s for s in starts if s >= max(starts) - horizon_ms],))
        _until(state, rows, idle)
        yield rows.loc[keep, ["track_id", "ordinal", "start_ms", "end_ms", "source"]]

    timed, timeout = _timed(cues, idle, delay)
    keyed = timed.select("track_id", "ordinal", "start_ms", "end_ms", "source", "at_ms", *([] if idle is None else ["at"]), F.coalesce(overlap_key(F.col("source")), F.lit("")).alias("text_key"))
    return keyed.groupBy("track_id", "text_key").applyInPandasWithState(step, shape, "starts array<long>", "append", timeout)


def on_settled(words: Callable[[], DataFrame], pending: Callable[[], DataFrame], known: Callable[[], DataFrame], act: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over the cues that have landed so far: ``act`` gets the (track_id, id, final_id) that have settled and are
    not among the ``known`` ones. What is settled follows from the tables alone, so a batch that runs again finds the same."""

    def batch(cues: DataFrame, _: int) -> None:
        from ..operators.words import settled_prefix

        settled = settled_prefix(words(), cues, pending(), complete=False)
        act(settled.join(known().select("track_id", "final_id"), ["track_id", "final_id"], "left_anti"))

    return batch


def on_ready(ranges: Callable[[], DataFrame], dispatched: Callable[[], DataFrame], act: Callable[[DataFrame], None], target: int = 400) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over the words so far: ``act`` gets the batches (track_id, first, last) that are ready and were not ``dispatched``."""

    def batch(words: DataFrame, _: int) -> None:
        from ..operators.words import ready_word_batches

        act(ready_word_batches(words, ranges(), dispatched(), target))

    return batch


def final_over_live(live: DataFrame, final: DataFrame) -> DataFrame:
    """Cues of the authoritative pass, with ``final``; tracks that it has not reached keep their live ones."""
    rest = live.join(final.select("track_id").distinct(), "track_id", "left_anti")
    return final.withColumn("final", F.lit(True)).unionByName(rest.withColumn("final", F.lit(False)))
