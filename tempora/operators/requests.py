"""Requests to a service and what came of them: payloads with context, a ledger of attempts by content, replies checked between attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.records import json_object, reply_items
from ..sources.sinks import cut
from .journal import reply_problems, word_reply_problems
from .words import word_context

LEDGER = "digest string, track_id long, batch_no long, attempt int, status string, text string, error string"
RAW = "digest string, attempt int, text string, error string"
BATCH = ["track_id", "batch_no"]
SHOWN = 10  # so many ids or ordinals an error names
QUICK_S = 30.0  # a wave of requests that takes less is followed by a larger one


def retry_delay(attempt: int, delay: float, most: float = 8.0) -> float:
    """Seconds before the next attempt: doubled each time, up to ``most`` or the first delay if that is longer."""
    return min(delay * 2 ** (attempt - 1), max(most, delay))


def attempted(service: Callable[[str, str | None], str], payload: str, error: str | None, timeout_s: float | None) -> tuple[str | None, str | None]:
    """(text, error) of one request; one that takes longer than ``timeout_s`` has failed."""
    pool = None
    try:
        if timeout_s is None:
            return service(payload, error), None
        # a thread of its own, which can be left behind
        pool = ThreadPoolExecutor(1)
        return pool.submit(service, payload, error).result(timeout_s), None
    except TimeoutError as failure:
        return None, str(failure) or ("timed out" if timeout_s is None else f"timed out after {timeout_s:g} s")
    except Exception as failure:  # any failure of a user's service is an attempt's outcome
        return None, str(failure) or type(failure).__name__
    finally:
        if pool:
            pool.shutdown(wait=False, cancel_futures=True)


def _key() -> Column:
    """A batch in the place of a track, for checks that go by track."""
    return F.struct(F.col("track_id").cast("bigint").alias("track_id"), F.col("batch_no").cast("bigint").alias("batch_no")).alias("track_id")


def _members(batches: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    each = batches.select(*BATCH, F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge")
    return each.join(rows.select("track_id", "ordinal", *columns), ["track_id", "ordinal"])


def _listed(rows: DataFrame, name: str, order: str, item: Callable[[Column], Column], *columns: str) -> DataFrame:
    sorted_ = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return rows.groupBy(*BATCH).agg(F.transform(sorted_, item).alias(name))


def _object(parts: dict[str, DataFrame], keep_nulls: bool) -> DataFrame:
    """(track_id, batch_no, payload): a JSON object of the lists that ``parts`` have for each batch, empty where one has none; the first part has all batches.

    How long lists are is nothing Spark can tell, so no part is broadcast.
    """
    out = None
    for part in parts.values():
        out = part if out is None else out.join(part.hint("merge"), BATCH, "left")
    fields = [F.coalesce(F.col(c), F.array().cast(dict(parts[c].dtypes)[c])).alias(c) for c in parts]
    return out.select(*BATCH, F.to_json(F.struct(*fields), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("payload"))


def cue_requests(batches: DataFrame, cues: DataFrame, before: int = 10, after: int = 5) -> DataFrame:
    """(track_id, batch_no, payload): each batch as a JSON object with its ``cues`` and the cues ``preceding`` and ``following`` it; null fields are kept."""
    values = ["id", "source", "translated", "speaker"]
    # a cue is rendered once, for its own batch and for those around it
    item = F.to_json(F.struct(F.col("id").cast("string").alias("id"), *values[1:]), {"ignoreNullFields": "false"})
    rendered = cut(cues.select("track_id", "ordinal", item.alias("item")), "rendered")
    none = F.lit(None)
    mark = lambda at, side: batches.select("track_id", F.col(at).alias("ordinal"), none.cast("string").alias("item"), "batch_no", F.lit(side).alias("side"))
    placed = rendered.withColumns({"batch_no": none.cast(batches.schema["batch_no"].dataType), "side": none.cast("string")}).unionByName(mark("first", "preceding")).unionByName(mark("last", "following"))
    near = Window.partitionBy("track_id").orderBy("ordinal")
    listed = F.when(F.col("side") == "preceding", F.array_join(F.collect_list("item").over(near.rangeBetween(-before, -1)), ",")).when(F.col("side") == "following", F.array_join(F.collect_list("item").over(near.rangeBetween(1, after)), ","))
    around = placed.select(*BATCH, "side", "ordinal", listed.alias("item")).where("side IS NOT NULL")
    own = _members(batches, rendered, "item").select(*BATCH, F.lit("cues").alias("side"), "ordinal", "item")
    text = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("item"))), F.lit(""))
    inside = F.sort_array(F.collect_list(F.when(F.col("side") == "cues", F.struct("ordinal", "item"))))
    lists = around.unionByName(own).groupBy(*BATCH).agg(F.array_join(F.transform(inside, lambda x: x["item"]), ",").alias("cues"), text("preceding").alias("preceding"), text("following").alias("following"))
    return lists.select(*BATCH, F.concat(F.lit('{"cues":['), "cues", F.lit('],"preceding":['), "preceding", F.lit('],"following":['), "following", F.lit("]}")).alias("payload"))


def word_requests(batches: DataFrame, words: DataFrame, cues: DataFrame, before: int = 10, after: int = 40) -> DataFrame:
    """(track_id, batch_no, payload): each batch as a JSON object with its ``words`` (i, t in seconds, s left out if null, w), the last cues that
    start before it and the words that come next."""
    word = lambda w: F.struct(w.ordinal.alias("i"), (w.start_ms / 1000).alias("t"), w.speaker.alias("s"), w.text.alias("w"))
    values = ["start_ms", "speaker", "text"]
    around = cut(word_context(batches, words, cues, before, after), "context")
    cue = lambda c: F.struct(c.id.alias("id"), c.source.alias("source"), c.translated.alias("translated"), c.speaker.alias("speaker"))
    known = around.select(*BATCH, F.posexplode("preceding").alias("place", "id")).join(cues.select("track_id", "id", "source", "translated", "speaker"), ["track_id", "id"])
    coming = around.select(*BATCH, F.explode("following").alias("ordinal")).join(words.select("track_id", "ordinal", *values), ["track_id", "ordinal"])
    own = _listed(_members(batches, words, *values), "words", "ordinal", word, *values)
    return _object({"words": own, "preceding": _listed(known, "preceding", "place", cue, "id", "source", "translated", "speaker"), "following": _listed(coming, "following", "ordinal", word, *values)}, False)


def _errors(problems: DataFrame, said: dict[str, str]) -> DataFrame:
    """(track_id, batch_no, error) of problems (track_id: the struct of a batch, kind, what): a sentence for each kind, with the first of what it names."""
    kinds = F.create_map(*[F.lit(x) for pair in said.items() for x in pair])
    named = F.slice(F.array_sort(F.collect_list("what")), 1, SHOWN)
    each = problems.groupBy("track_id", "kind").agg(F.concat_ws(": ", F.coalesce(kinds[F.col("kind")], F.col("kind")), F.nullif(F.array_join(F.transform(named, lambda x: x.cast("string")), ", "), F.lit(""))).alias("line"))
    return each.groupBy("track_id").agg(F.array_join(F.array_sort(F.collect_list("line")), "; ").alias("error")).select("track_id.*", "error")


def cue_reply_errors(batches: DataFrame, cues: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A check of replies (track_id, batch_no, text) to requests for cues: (track_id, batch_no, error) of those that name cues nobody asked for,
    leave some out or leave translations empty."""
    asked = cut(_members(batches, cues, "id"), "asked")

    def check(replies: DataFrame) -> DataFrame:
        answered = replies.select(*BATCH)
        own = asked.join(answered, BATCH, "left_semi").select(_key(), "id")
        # a table, so that the replies are read once for all kinds of errors
        items = cut(reply_items(replies).select(_key(), "id", "translated"), "reply-items")
        return _errors(reply_problems(own, items).select("track_id", "kind", F.col("id").alias("what")), CUE_ERRORS)

    return check


CUE_ERRORS = {"unknown": "unknown cue ids", "missing": "missing cue ids", "blank": "empty translations"}
WORD_ERRORS = {
    "nothing": "the response carries no cues", "outside": "cues name words outside this batch", "inverted": "cues end before they start", "two_speakers": "cues start and end with different speakers",
    "no_source": "cues without a source", "no_translation": "cues without a translation", "too_long": "cues above the time limit; split them", "too_wide_source": "cue sources above the width limit; split them",
    "too_wide_translation": "cue translations above the width limit; split them", "doubled": "words claimed by two cues of a speaker", "uncovered": "words that no cue covers", "silent": "words of speakers that no cue covers",
}


def word_reply_items(replies: DataFrame) -> DataFrame:
    """(track_id, batch_no, n, first, last, source, translated) of replies (track_id, batch_no, text) that cut words into cues."""
    parsed = F.from_json(json_object(F.col("text")), "cues array<struct<first_word:bigint,last_word:bigint,source:string,translated:string>>")["cues"]
    return replies.select(*BATCH, F.posexplode(parsed).alias("n", "c")).select(*BATCH, "n", F.col("c.first_word").alias("first"), F.col("c.last_word").alias("last"), "c.source", "c.translated")


def word_reply_errors(batches: DataFrame, words: DataFrame, max_ms: int = 8_000, max_weight: int = 84) -> Callable[[DataFrame], DataFrame]:
    """A check of replies (track_id, batch_no, text) to requests for words, as ``word_reply_problems`` finds them: (track_id, batch_no, error)."""
    return word_errors(cut(batch_words(batches, words), "asked"), max_ms, max_weight)


def batch_words(batches: DataFrame, words: DataFrame) -> DataFrame:
    """(track_id, batch_no, ordinal, speaker, text, start_ms, end_ms): the words of batches."""
    return _members(batches, words, "speaker", "text", "start_ms", "end_ms")


def word_errors(inside: DataFrame, max_ms: int = 8_000, max_weight: int = 84) -> Callable[[DataFrame], DataFrame]:
    """``word_reply_errors`` for batches whose words are ``inside``, as ``batch_words`` has them."""

    def check(replies: DataFrame) -> DataFrame:
        items = cut(word_reply_items(replies).withColumn("position", F.col("n").cast("bigint")), "reply-items")
        own = inside.join(items.select(*BATCH), BATCH, "left_semi").withColumn("track_id", _key())
        found = word_reply_problems(items.withColumn("track_id", _key()), own, max_ms, max_weight)
        at = items.select(_key(), "position", F.concat_ws("–", "first", "last").alias("range"))
        found = found.join(at, ["track_id", "position"], "left").select("track_id", "kind", F.coalesce("range", F.col("ordinal").cast("string")).alias("what"))
        none = replies.join(items, BATCH, "left_anti").select(_key(), F.lit("nothing").alias("kind"), F.lit(None).cast("string").alias("what"))
        return _errors(found.unionByName(none), WORD_ERRORS)

    return check


def settled_replies(
    payloads: DataFrame, service: Callable[[str, str | None], str], folder: str, check: Callable[[DataFrame], DataFrame] | None = None,
    attempts: int = 3, delay: float = 0.0, timeout_s: float | None = None, in_flight: int = 4, wave: int = 10_000, lenient: bool = False,
) -> DataFrame:
    """(track_id, batch_no, text) of the payloads (track_id, batch_no, payload) that the service answered soundly.

    The table in ``folder`` is a ledger of attempts by the digest of their payload: what it holds complete is never asked again, whichever run, track or
    batch number asked; equal payloads are asked once.  Each round asks what is open, with the error of the attempt before, in waves of about ``wave``
    requests, ``in_flight`` of a task at a time; behind a wave that took less than ``QUICK_S`` comes one of four times as many, behind a slower one
    half as many, never fewer than ``wave``. Every wave is a table of its own before its replies are judged, so a run that is killed
    loses one wave, and replies it left unjudged are judged by the next one.  ``check`` turns replies into (track_id, batch_no, error);
    a reply with an error is a failed attempt.  There are at most ``attempts`` rounds.  With ``lenient``, a payload that no
    reply answered soundly has its last one.
    """
    spark, raw_folder = payloads.sparkSession, f"{folder.rstrip('/')}-raw"
    for path, kind in ((folder, LEDGER), (raw_folder, RAW)):
        spark.createDataFrame([], kind).write.mode("ignore").parquet(path)
    keyed = cut(payloads.select(*BATCH, F.col("payload"), F.sha2("payload", 256).alias("digest")), "requests")
    once = keyed.groupBy("digest").agg(F.min(F.struct(*[F.col(c).cast("bigint").alias(c) for c in BATCH])).alias("b"))
    # tables: what is open is found without the payloads, which are read for the open ones only
    one = cut(once.select("digest", "b.*"), "asked-once")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def request(row: tuple) -> tuple:
            digest, payload, made, error = row
            time.sleep(retry_delay(made, delay) if made else 0)
            return (digest, made + 1, *attempted(service, payload, error, timeout_s))

        def taken(rows: list, out: list, place: Callable[[], int]) -> None:
            while (i := place()) < len(rows):
                out[i] = request(rows[i])

        with ThreadPoolExecutor(in_flight) as pool:
            for b in batches:
                errors = [e if isinstance(e, str) else None for e in b["error"]]
                rows = list(zip(b["digest"], b["payload"], b["made"].tolist(), errors, strict=True))
                out, place = [None] * len(rows), count().__next__
                # each thread takes the next request there is
                for done in [pool.submit(taken, rows, out, place) for _ in range(in_flight)]:
                    done.result()
                yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object) for i, c in enumerate(("digest", "attempt", "text", "error"))})

    for last in (False,) * attempts + (True,):
        ledger, raw = spark.read.schema(LEDGER).parquet(folder), spark.read.schema(RAW).parquet(raw_folder)
        if not raw.isEmpty():
            rows = cut(raw.join(ledger.select("digest", "attempt").hint("merge"), ["digest", "attempt"], "left_anti").join(one, "digest"), "replies")
            if not rows.isEmpty():
                _judge(rows, check).write.mode("append").parquet(folder)
        ledger = spark.read.schema(LEDGER).parquet(folder)
        state = ledger.groupBy("digest").agg(F.max("attempt").alias("made"), F.max_by("error", "attempt").alias("error"), F.bool_or(F.col("status") == "complete").alias("done"))
        left = one.join(state.hint("merge"), "digest", "left").where("coalesce(done, false) = false").select("digest", *BATCH, F.coalesce("made", F.lit(0)).alias("made"), "error")
        if last or (left := cut(left, "left")).isEmpty():
            break
        tasks = spark.sparkContext.defaultParallelism
        # a folder for each ``wave`` requests of a task, named by the first one, so that a wave reads its own requests only
        place = F.monotonically_increasing_id()
        asked = left.join(keyed.select(*BATCH, "payload"), BATCH).select("digest", "payload", "made", "error", place.alias("cell"))
        open_ = cut(asked.withColumn("cell", F.col("cell") - F.pmod(F.col("cell") % (1 << 33), F.lit(wave))), "open", "cell")
        sizes = open_.groupBy("cell").count().orderBy("cell").collect()
        at, most = 0, wave
        while at < len(sizes):
            end, n = at + 1, sizes[at]["count"]
            while end < len(sizes) and n + sizes[end]["count"] <= most:
                end, n = end + 1, n + sizes[end]["count"]
            began = time.monotonic()
            part = open_.where(F.col("cell").between(sizes[at]["cell"], sizes[end - 1]["cell"])).drop("cell")
            # many folders are tasks enough as they are
            part = part if end - at >= 4 * tasks and n >= wave * tasks else part.repartition(tasks)
            part.mapInPandas(ask, RAW).write.mode("append").parquet(raw_folder)
            at, most = end, most * 4 if time.monotonic() - began < QUICK_S else max(wave, most // 2)
    answered = spark.read.schema(LEDGER).parquet(folder).where("text IS NOT NULL" if lenient else "status = 'complete'")
    best = answered.groupBy("digest").agg(F.max_by("text", F.struct(F.col("status") == "complete", "attempt")).alias("text"))
    return keyed.select(*BATCH, "digest").join(best.hint("merge"), "digest").select(*BATCH, "text")


def _judge(rows: DataFrame, check: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Raw replies with their batches as rows of the ledger."""
    if check is not None:
        wrong = check(rows.where("text IS NOT NULL").select(*BATCH, "text")).withColumnRenamed("error", "wrong")
        rows = rows.join(wrong, BATCH, "left")
    else:
        rows = rows.withColumn("wrong", F.lit(None).cast("string"))
    failed = F.col("text").isNull() | F.col("wrong").isNotNull()
    return rows.select("digest", *BATCH, "attempt", F.when(failed, "failed").otherwise("complete").alias("status"), "text", F.coalesce("error", "wrong").alias("error"))
