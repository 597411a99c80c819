"""Operators with state by track over streams: chunks with their rows, interval sets, settled cues, batches dispatched once.

Each is the incremental form of a table operator, which its docstring names; what a stream has given so far equals that operator over
the rows so far. State holds what later rows can still change, not what came before.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import path_exists


def stream_chunks(rows: DataFrame, chunk_ms: int = 15_000, context_ms: int = 5_000) -> DataFrame:
    """The rows (track_id, start_ms, ...) of every complete chunk with chunk_no, from_ms and to_ms, as ``feeds.hop_chunks`` has them.

    A chunk is complete once a row of its track starts at its end or later. The state is the rows that a later chunk still needs. A
    row that comes after its chunk was given out is in those later chunks only whose context reaches back to it.
    """
    kind = T.StructType([*rows.schema.fields, T.StructField("chunk_no", T.LongType()), T.StructField("from_ms", T.LongType()), T.StructField("to_ms", T.LongType())])
    columns = rows.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, tail = state.get if state.exists else (0, None)
        before = [pa.ipc.open_stream(tail).read_pandas()] if tail is not None else []
        held = pd.concat([*before, *batches], ignore_index=True)[columns]
        start = held["start_ms"].to_numpy()
        complete = max(given, int(start.max()) // chunk_ms)
        first, last = start // chunk_ms, (start + context_ms) // chunk_ms
        row = np.repeat(np.arange(len(held)), last - first + 1)
        chunk = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
        some = (chunk >= given) & (chunk < complete)
        out = held.iloc[row[some]].assign(chunk_no=chunk[some])
        out = out.assign(from_ms=np.maximum(0, out["chunk_no"] * chunk_ms - context_ms), to_ms=(out["chunk_no"] + 1) * chunk_ms)
        rest = pa.Table.from_pandas(held[start >= complete * chunk_ms - context_ms], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rest.schema) as writer:
            writer.write_table(rest)
        state.update((complete, sink.getvalue().to_pybytes()))
        yield out

    return rows.groupBy("track_id").applyInPandasWithState(step, kind, "given long, tail binary", "append", GroupStateTimeout.NoTimeout)


def inserted(starts: list[int], ends: list[int], start: int, end: int, tolerance: int) -> None:
    """Put [start, end] into a sorted set of intervals, as one with those it comes within ``tolerance`` of."""
    lo, hi = bisect_left(ends, start - tolerance), bisect_right(starts, end + tolerance)
    if lo < hi:
        start, end = min(start, starts[lo]), max(end, ends[hi - 1])
    starts[lo:hi], ends[lo:hi] = [start], [end]


def stream_intervals(spans: DataFrame, tolerance_ms: int = 10) -> DataFrame:
    """(track_id, start_ms, end_ms, change): how the merged intervals of a track change with every micro-batch, 1 for one that comes, -1 for one
    that goes. Spans may come in any order; the changes so far add up to ``intervals.merge_intervals``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends = (list(x) for x in state.get) if state.exists else ([], [])
        before = set(zip(starts, ends, strict=True))
        for b in batches:
            for s, e in zip(b["start_ms"].tolist(), b["end_ms"].tolist(), strict=True):
                inserted(starts, ends, s, e, tolerance_ms)
        state.update((starts, ends))
        now = set(zip(starts, ends, strict=True))
        changes = [(key[0], s, e, n) for n, some in ((-1, before - now), (1, now - before)) for s, e in sorted(some)]
        yield pd.DataFrame(changes, columns=["track_id", "start_ms", "end_ms", "change"])

    sound = spans.where("end_ms >= start_ms").select("track_id", "start_ms", "end_ms")
    return sound.groupBy("track_id").applyInPandasWithState(step, "track_id long, start_ms long, end_ms long, change int", "starts array<long>, ends array<long>", "append", GroupStateTimeout.NoTimeout)


class Settlement:
    """One track's open words, cues and joints, and how many cues have settled."""

    def __init__(self, held: str | None):
        state = json.loads(held) if held else {"words": [], "cues": [], "joints": [], "settled": 0, "top": -1}
        self.words, self.cues = dict(state["words"]), {c[0]: tuple(c[1:]) for c in state["cues"]}
        self.joints, self.settled, self.top = set(state["joints"]), state["settled"], state["top"]

    def dump(self) -> str:
        return json.dumps({"words": [*self.words.items()], "cues": [[i, *c] for i, c in self.cues.items()], "joints": sorted(self.joints), "settled": self.settled, "top": self.top})

    def take(self, kind: str, id: str, first: int, last: int, start: int, end: int, speaker: str | None) -> None:
        if kind == "word":
            self.words[first], self.top = start, max(self.top, first)
        elif kind == "cue":
            self.cues[id] = (first, last, start, end, speaker or "")
        elif kind == "gone":
            self.cues.pop(id, None)
        elif kind == "joint":
            self.joints.add(first)
        elif kind == "clean":
            self.joints.discard(first)

    def step(self) -> list[tuple[str, int]]:
        """(id, final_id) of the cues that settle now."""
        owners: dict[int, int] = {}
        for first, last, *_ in self.cues.values():
            for ordinal in range(first, last + 1):
                owners[ordinal] = min(first, owners.get(ordinal, first))
        gap = min((w for w in self.words if w not in owners), default=None)
        if gap == 0:
            return []
        touched = [owners[b] for b in (self.top if gap is None else gap - 1, *self.joints) if b in owners]
        mutable = min(touched, default=self.top + 1)
        frontier = min((start for w, start in self.words.items() if w >= mutable), default=None)
        out = []
        for id, (first, last, start, _, _) in sorted(self.cues.items(), key=lambda c: (c[1][2], c[1][3], c[1][4], c[1][0])):
            if last >= mutable or (frontier is not None and start >= frontier):
                break
            self.settled += 1
            out.append((id, self.settled))
            for ordinal in range(first, last + 1):
                self.words.pop(ordinal, None)
        for id, _ in out:
            self.cues.pop(id)
        return out


def stream_settled(events: DataFrame) -> DataFrame:
    """(track_id, id, final_id) of cues as they settle, from events (track_id, seq, kind, id, first, last, start_ms, end_ms, speaker).

    Kinds: word (first: its ordinal), cue, gone (a cue that a repair took away), joint (one that is pending, first: its ordinal) and clean (one that
    no longer is). The state is the words no settled cue covers, the cues that have not settled and the pending joints; what has come out
    so far equals ``words.settled_prefix`` with ``complete`` unset.
    """
    columns = ["kind", "id", "first", "last", "start_ms", "end_ms", "speaker"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = Settlement(state.get[0] if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, id, *numbers, speaker in zip(*[rows[c] for c in columns], strict=True):
            track.take(kind, id, *(None if n != n else int(n) for n in numbers), speaker)
        out = track.step()
        state.update((track.dump(),))
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["track_id", "id", "final_id"])

    return events.select("track_id", "seq", *columns).groupBy("track_id").applyInPandasWithState(step, "track_id long, id string, final_id long", "held string", "append", GroupStateTimeout.NoTimeout)


def on_ready_once(ranges: Callable[[], DataFrame], folder: str, act: Callable[[DataFrame, int], None], target: int = 400) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over new words: ``act`` gets the batches (track_id, first, last) of ``words.ready_word_batches`` that no
    micro-batch before dispatched.

    ``folder`` keeps the words and the plan of each micro-batch by its id. A micro-batch that runs again finds its plan and hands the same
    batches to ``act``, or nothing if ``act`` had ended; only the tracks that got new words are looked at.
    """

    def batch(words: DataFrame, batch_id: int) -> None:
        from ..operators.words import ready_word_batches

        spark = words.sparkSession
        own, plan, done = (f"{folder}/{name}/batch={batch_id}" for name in ("words", "plans", "done"))
        if path_exists(spark, f"{done}/_SUCCESS"):
            return
        if not path_exists(spark, f"{plan}/_SUCCESS"):
            words.write.mode("overwrite").parquet(own)
            kept = spark.read.schema(T.StructType([*words.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/words").where(F.col("batch") <= batch_id)
            tracks = spark.read.schema(words.schema).parquet(own).select("track_id").distinct()
            heard = kept.drop("batch").join(tracks, "track_id", "left_semi")
            shape = "track_id long, first long, last long"
            before = spark.createDataFrame([], shape)
            if path_exists(spark, f"{folder}/plans"):
                before = spark.read.schema(f"{shape}, batch long").parquet(f"{folder}/plans").where(F.col("batch") < batch_id).drop("batch")
            ready_word_batches(heard, ranges(), before, target).select(*[F.col(c.split()[0]).cast("bigint") for c in shape.split(", ")]).write.mode("overwrite").parquet(plan)
        act(spark.read.parquet(plan), batch_id)
        spark.createDataFrame([], "done int").write.mode("overwrite").parquet(done)

    return batch
