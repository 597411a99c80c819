"""A feed of audio chunks to a transcriber that holds one open session a track.

The session lives in a Python worker; all that must outlast the worker is in Spark's state: how far the track has been fed, and
the audio that no answer covers yet. A session that is gone, or stands elsewhere, is opened anew where the answers end and gets that audio again.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import suppress
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..sources.records import transcript_entries
from .feeds import _timed, _until

ANSWER = "track_id long, session_ms long, fed_ms long, body string, error string"


class Session(Protocol):
    """A transcriber's session. Times in its bodies count from the place where it was opened."""

    def submit(self, pcm: bytes) -> tuple[str | None, int]:
        """Take the audio behind what came before: a transcript of what is certain now, and how many bytes in all it answers for."""

    def finish(self) -> str | None:
        """The transcript of the rest; no more audio comes."""

    def close(self) -> None: ...


class Sessions:
    """The open sessions of a worker, the longest unused of which are closed beyond ``most``."""

    def __init__(self, most: int):
        self.most, self.open = most, OrderedDict()

    def take(self, key: tuple, fed: int) -> tuple[Session, int, int] | None:
        """(session, its first byte, bytes it answered for) if it stands where the state says; one that does not is closed."""
        session, first, at, answered = self.open.pop(key, (None, 0, -1, 0))
        if session is not None and at != fed:
            with suppress(Exception):
                session.close()
        return (session, first, answered) if at == fed else None

    def put(self, key: tuple, session: Session, first: int, at: int, answered: int) -> None:
        self.open[key] = (session, first, at, answered)
        while len(self.open) > self.most:
            with suppress(Exception):
                self.open.popitem(last=False)[1][0].close()


#: The sessions of this worker by stream; tasks of one worker run one after the other.
HELD: dict[str, Sessions] = {}


def stream_fed_chunks(
    chunks: DataFrame, open_session: Callable[[int, int], Session], rate: int = 16_000, frame_bytes: int = 2, most_s: float = 60.0,
    idle: str | None = None, delay: str = "0 seconds", most_sessions: int = 16,
) -> DataFrame:
    """(track_id, session_ms, fed_ms, body, error): the answers to chunks (track_id, offset_ms, content) of PCM in the order of their offsets.

    ``open_session`` gets the track and the time where the session begins. Chunks may overlap: of each, only the audio behind what was fed is handed
    on, and one that brings nothing new is passed over. Audio that is missing between two chunks ends the session as the end of a track does, and the
    next one begins at the later chunk. A chunk with a null content ends its track, as ``idle`` of event time without one does; without offset
    or track it is left out. If a session fails, the answer has its error and no body, and the next chunk opens another one that gets the
    unanswered audio again, of which the state keeps the last ``most_s`` seconds; an error says what is given up beyond them.
    """
    stream = uuid.uuid4().hex

    def to_ms(place: int) -> int:
        return round(place / frame_bytes * 1000 / rate)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track, out = key[0], []
        held = HELD.setdefault(stream, Sessions(most_sessions))
        fed, tail = state.get if state.exists else (None, b"")

        def end() -> None:
            """Answer for what is left and begin anew."""
            nonlocal fed, tail
            have = held.take((track,), fed) if fed is not None else None
            first = fed - len(tail) if have is None and fed is not None else have[1] if have else 0
            if have is not None or tail:
                try:
                    session = have[0] if have else open_session(track, to_ms(first))
                    bodies = [] if have else [session.submit(tail)[0]]
                    bodies.append(session.finish())
                    session.close()
                    out.extend((track, to_ms(first), to_ms(fed), b, None) for b in bodies if b is not None)
                except Exception as error:
                    out.append((track, to_ms(first), to_ms(fed), None, f"{type(error).__name__}: {error}"))
            fed, tail = None, b""

        if state.hasTimedOut:
            end()
            state.remove()
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])
            return
        rows = pd.concat(list(batches)).assign(last=lambda r: r["content"].isna()).sort_values(["offset_ms", "last"], kind="stable")
        for offset, content in zip(rows["offset_ms"], rows["content"], strict=True):
            if content is None:
                end()
                continue
            place = round(offset * rate / 1000) * frame_bytes
            if fed is not None and place > fed:
                end()
            if fed is None:
                fed = place
            fresh = bytes(content)[max(0, fed - place) :]
            fresh = fresh[: len(fresh) // frame_bytes * frame_bytes]
            if not fresh:
                continue
            have = held.take((track,), fed)
            tail, fed = tail + fresh, fed + len(fresh)
            first = have[1] if have else fed - len(tail)
            session = have[0] if have else None
            try:
                session = session or open_session(track, to_ms(first))
                body, answered = session.submit(fresh if have else tail)
                if not (have[2] if have else 0) <= answered <= fed - first:
                    raise ValueError(f"{answered} bytes answered of {fed - first}")
                tail = tail[len(tail) - (fed - first - answered) :]
                held.put((track,), session, first, fed, answered)
                if body is not None:
                    out.append((track, to_ms(first), to_ms(fed), body, None))
            except Exception as error:
                if session is not None:
                    with suppress(Exception):
                        session.close()
                out.append((track, to_ms(first), to_ms(fed), None, f"{type(error).__name__}: {error}"))
            beyond = len(tail) - int(most_s * rate) * frame_bytes
            if beyond > 0:
                out.append((track, to_ms(first), to_ms(fed), None, f"audio from {to_ms(fed - len(tail))} to {to_ms(fed - len(tail) + beyond)} ms given up"))
                tail = tail[beyond:]
        if fed is None:
            state.remove()
        else:
            state.update((fed, tail))
            _until(state, rows, idle)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWER.split(", ")])

    timed, timeout = _timed(chunks, idle, delay)
    wanted = timed.where("track_id IS NOT NULL AND offset_ms IS NOT NULL").select("track_id", "offset_ms", "content", "at_ms", *([] if idle is None else ["at"]))
    return wanted.groupBy("track_id").applyInPandasWithState(step, ANSWER, "fed long, tail binary", "append", timeout)


def answered_cues(answers: DataFrame) -> DataFrame:
    """(track_id, ordinal, start_ms, end_ms, source, metadata) of ``stream_fed_chunks``' answers, as a stream or a table, with times of the track.

    Bodies are read as ``records.cues_from_transcripts`` does. Ordinals follow the order in which a track was fed and may leave gaps.
    """
    each = transcript_entries(answers.where("body IS NOT NULL"), "session_ms", "fed_ms")
    return each.select("track_id", (F.col("fed_ms") * 1_000_000 + F.col("position")).alias("ordinal"), *[(F.col(c) + F.col("session_ms")).alias(c) for c in ("start_ms", "end_ms")], "source", "metadata")
