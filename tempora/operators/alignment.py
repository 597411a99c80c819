"""Starts behind long silences by a cue's first tokens, and timelines from attempts of a forced aligner.

A transcriber works on audio without its silences.  Its axis is the spans one after the other, each followed by an overlap and a
short silence; a token that lies across such a silence began before it and was spoken after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, special_token, token_ms
from ..sources.sinks import cut
from .intervals import align_to_speech, crosstalk_ids, extend_cue_ends, normalize_timeline, range_join

KEY = ["track_id", "id"]
SPOKEN = ["word", "start_ms", "end_ms", "score"]
TOKEN = "array<struct<text:string,offsets:string,timestamps:string>>"
ALIGNED = "segments array<struct<text:string,words:array<struct<word:string,start:double,`end`:double,score:double>>>>, word_segments array<struct<word:string,start:double,`end`:double,score:double>>"


def leading_tokens(cues: DataFrame) -> DataFrame:
    """(track_id, id, text, ranges) of (track_id, id, tokens): the first token's text and the times of the first two, from a JSON list.

    Marks of the transcriber and empty tokens don't count. A token's times are its offsets, else its time stamps; where neither
    gives a start and an end that is not before it, the list ends.
    """
    words = F.filter(F.from_json("tokens", TOKEN), lambda t: t.text.isNotNull() & (t.text != "") & ~special_token(t.text))

    def times(text: Column) -> Column:
        side = lambda v, name: token_ms(F.to_json(F.try_variant_get(v, f"$.{name}", "variant")))
        return let(F.try_parse_json(text), lambda v: F.struct(side(v, "from").alias("start_ms"), side(v, "to").alias("end_ms")))

    # a lambda's terms are computed as often as they are named, so each is named once
    sound = lambda times: let(times, lambda r: F.when(r.end_ms >= r.start_ms, r))
    each = F.transform(F.slice("words", 1, 2), lambda t: F.coalesce(sound(times(t.offsets)), sound(times(t.timestamps))))
    # dealt out first: a small file may hold many lists, and reading them is the work
    found = cues.select(*KEY, "tokens").repartition(*KEY).select(*KEY, words.alias("words")).where(F.size("words") > 0).select(*KEY, F.get("words", F.lit(0)).text.alias("text"), each.alias("ranges"))
    known = F.when(F.get("ranges", F.lit(0)).isNull(), F.slice("ranges", 1, 0)).otherwise(F.array_compact("ranges"))
    return found.select(*KEY, "text", known.alias("ranges"))


def touched(ranges: DataFrame, voiced: DataFrame, tol_ms: int = 40) -> DataFrame:
    """Those of the rows (track_id, id, from_ms, to_ms) that a voiced span touches.

    One sweep: a range is judged at its end against the furthest end of the spans that have begun by then. No pair of a range and a span is made.
    """
    none = F.lit(None).cast("bigint")
    span = voiced.select("track_id", F.col("start_ms").alias("at"), F.lit(0).alias("asks"), F.col("end_ms").alias("reaches"), none.alias("from_ms"), none.alias("to_ms"))
    key = ranges.select(*KEY, F.col("from_ms").cast("bigint").alias("from_ms"), F.col("to_ms").cast("bigint").alias("to_ms"))
    asked = key.select("*", (F.col("to_ms") + tol_ms).alias("at"), F.lit(1).alias("asks"), none.alias("reaches"))
    # spans that begin where a range ends come before it
    order = Window.partitionBy("track_id").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    rows = asked.unionByName(span, allowMissingColumns=True).withColumn("reach", F.max("reaches").over(order))
    return rows.where((F.col("asks") == 1) & (F.col("reach") >= F.col("from_ms") - tol_ms)).select(*KEY, "from_ms", "to_ms").distinct()


def token_starts(cues: DataFrame, spans: DataFrame, tokens: DataFrame, voiced: DataFrame | None = None, overlap_ms: int = 100, silence_ms: int = 100, long_ms: int = 320, tol_ms: int = 40, width_ms: int = 2_000) -> DataFrame:
    """(track_id, id, token_ms): the end of the last long silence that the first token of a cue lies across.

    ``tokens`` is the result of ``leading_tokens``, ``spans`` are merged. A first token of one character makes any silence long. Where the first
    token ends just before a silence that the second one lies across, it counts if no voiced span touches it; without
    ``voiced`` that can't be told and it doesn't.
    """
    order = Window.partitionBy("track_id").orderBy("start_ms", "end_ms")
    size = F.col("end_ms") - F.col("start_ms")
    gone = F.coalesce(F.sum(size + overlap_ms + silence_ms).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = spans.select("track_id", F.col("start_ms").alias("left_ms"), F.col("end_ms").alias("right_ms"), gone.alias("axis_ms"), (gone + size + overlap_ms).alias("quiet_ms"), F.lead("start_ms").over(order).alias("speech_ms")).where("speech_ms IS NOT NULL")
    previous = F.lag("end_ms").over(Window.partitionBy("track_id").orderBy("ordinal"))
    first, second = F.get("ranges", F.lit(0)), F.get("ranges", F.lit(1))
    keyed = cues.select(*KEY, F.col("end_ms").alias("cue_end"), previous.alias("previous_ms")).join(cut(tokens, "tokens").where(F.size("ranges") > 0), KEY)
    # tables, so that the tokens' JSON is read once for all uses of their times
    keyed = cut(keyed.select(*KEY, "cue_end", "previous_ms", F.when(F.length(F.trim("text")) == 1, 0).otherwise(long_ms).alias("least_ms"), first.start_ms.alias("a"), first.end_ms.alias("b"), second.start_ms.alias("c"), second.end_ms.alias("d")), "token-times")
    quiet, ends = F.col("quiet_ms"), F.col("quiet_ms") + silence_ms
    wide = (F.col("speech_ms") - F.col("right_ms") >= F.col("least_ms")) & (F.col("speech_ms") <= F.col("cue_end")) & (F.col("previous_ms").isNull() | (F.col("speech_ms") >= F.col("previous_ms") + tol_ms))
    across = (F.col("a") <= quiet) & (F.col("b") >= ends)
    beside = (F.col("b") <= quiet) & (quiet - F.col("b") <= silence_ms) & (F.col("c") <= quiet) & (F.col("d") >= ends) & (F.col("a") >= F.col("axis_ms"))
    hits = range_join(keyed, gaps, width_ms, F.least("a", "c"), F.greatest("b", "d"), quiet, quiet, wide & (across | F.coalesce(beside, F.lit(False))))
    hits = hits.select(*KEY, F.col("speech_ms").alias("token_ms"), across.alias("across"), (F.col("left_ms") + F.col("a") - F.col("axis_ms")).alias("from_ms"), (F.col("left_ms") + F.col("b") - F.col("axis_ms")).alias("to_ms"))
    sure = hits.where("across").select(*KEY, "token_ms")
    if voiced is not None:
        unsure = hits.where("NOT across")
        sure = sure.unionByName(unsure.join(touched(unsure, voiced, tol_ms), [*KEY, "from_ms", "to_ms"], "left_anti").select(*KEY, "token_ms"))
    return sure.groupBy(*KEY).agg(F.max("token_ms").alias("token_ms"))


def attempt_windows(cues: DataFrame, duration_ms: int, windows: tuple[tuple[int, int], ...] = ((200, 500), (2_000, 2_000))) -> DataFrame:
    """(track_id, id, attempt, from_ms, to_ms): the stretches of audio to align each cue in, one after the other; crosstalk cues have none."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(a).alias("before"), F.lit(b).alias("after")) for i, (a, b) in enumerate(windows, 1)]))
    free = cues.join(crosstalk_ids(cues), KEY, "left_anti").select(*KEY, "start_ms", "end_ms", each.alias("w"))
    return free.select(*KEY, "w.attempt", F.greatest(F.lit(0), F.col("start_ms") - F.col("w.before")).alias("from_ms"), F.least(F.lit(duration_ms), F.col("end_ms") + F.col("w.after")).alias("to_ms"))


def judged_attempts(attempts: DataFrame, duration_ms: int, edge_ms: int = 50) -> DataFrame:
    """Attempts (track_id, id, attempt, from_ms, to_ms, body) with ``segments`` and ``outcome``.

    A body is the aligner's JSON, null if it failed. Words without times are left out; the times of the others are shifted by the window's start.
    Outcomes: zero-first-token-score; failed (no segments, a segment without timed words, a half or illegal time); boundary-clipped (the first or last word
    is at an edge of the window that could be moved); success.
    """
    parsed = F.from_json("body", ALIGNED)
    whole = F.array(F.struct(F.lit(None).cast("string").alias("text"), F.col("b.word_segments").alias("words")))
    rows = attempts.withColumn("b", parsed)
    rows = rows.withColumn("raw", F.when(F.size("b.segments") > 0, F.col("b.segments")).when(F.size("b.word_segments") > 0, whole))
    ms = lambda c: F.rint(c * 1000).cast("bigint") + F.col("from_ms")

    def words(segment: Column) -> Column:
        timed = F.filter(segment.words, lambda w: w.start.isNotNull() | w["end"].isNotNull())
        placed = F.transform(timed, lambda w: F.struct(ms(w.start).alias("start_ms"), ms(w["end"]).alias("end_ms"), w.word.alias("word"), F.when(~F.isnan(w.score), w.score).alias("score")))
        return F.array_sort(placed)

    segments = F.transform("raw", lambda s: F.struct(F.nullif(F.trim(s.text), F.lit("")).alias("text"), words(s).alias("words")))
    rows = rows.withColumn("segments", segments)
    every = F.flatten(F.transform("segments", lambda s: s.words))
    wrong = F.exists(every, lambda w: w.start_ms.isNull() | w.end_ms.isNull() | (w.end_ms < w.start_ms) | (w.start_ms < 0) | (w.end_ms > duration_ms))
    empty = F.exists("segments", lambda s: s.words.isNull() | (F.size(s.words) == 0))
    first, last = F.array_min(F.transform(every, lambda w: w.start_ms)), F.element_at(F.array_sort(every), -1).end_ms
    clipped = ((F.col("from_ms") > edge_ms) & (first <= F.col("from_ms") + edge_ms)) | ((F.col("to_ms") < duration_ms - edge_ms) & (last >= F.col("to_ms") - edge_ms))
    zero = F.get(F.get("raw", F.lit(0)).words, F.lit(0)).score == 0
    outcome = F.when(zero, "zero-first-token-score").when(F.col("segments").isNull() | wrong | empty | F.coalesce(F.size(every) < 1, F.lit(True)), "failed").when(clipped, "boundary-clipped").otherwise("success")
    return rows.withColumn("outcome", outcome).drop("b", "raw")


def lenient_words(attempts: DataFrame, duration_ms: int) -> DataFrame:
    """(track_id, id, attempt, words): all words of a body, with those of their times and scores that can be used."""
    ms = lambda c: F.rint(c * 1000).cast("bigint") + F.col("from_ms")
    usable = lambda c: F.when(ms(c).between(0, duration_ms), ms(c))
    every = F.flatten(F.transform(F.from_json("body", ALIGNED).segments, lambda s: F.coalesce(s.words, F.array().cast("array<struct<word:string,start:double,end:double,score:double>>"))))
    kept = F.transform(every, lambda w: F.struct(F.coalesce(w.word, F.lit("")).alias("word"), usable(w.start).alias("start_ms"), usable(w["end"]).alias("end_ms"), F.when(~F.isnan(w.score), w.score).alias("score")))
    return attempts.select(*KEY, "attempt", kept.alias("words"))


def aligned_cues(cues: DataFrame, judged: DataFrame, words: bool = False) -> DataFrame:
    """The cues that each parent's first successful attempt gives, one a segment, with ``confidence``, the mean of the words' scores.

    A parent that stays whole keeps its text and translation; parts have the segments' texts and no translation. ``words`` adds each one's words.
    """
    ok = judged.where("outcome = 'success'").groupBy(*KEY).agg(F.min_by("segments", "attempt").alias("segments"))
    each = ok.select(*KEY, F.size("segments").alias("n"), F.posexplode("segments").alias("part", "s"))
    score = F.aggregate(F.filter("s.words", lambda w: w.score.isNotNull()), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, w: F.struct((a["sum"] + w.score).alias("sum"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]))
    timed = each.select(*KEY, "n", "part", F.get("s.words", F.lit(0)).start_ms.alias("s_ms"), F.element_at("s.words", -1).end_ms.alias("e_ms"), F.col("s.text").alias("part_text"), score.alias("score"), F.transform("s.words", lambda w: F.struct(*[w[c].alias(c) for c in SPOKEN])).alias("words"))
    whole = F.col("n") == 1
    rows = cues.join(timed, KEY)
    new = {
        "start_ms": F.col("s_ms"), "end_ms": F.col("e_ms"), "confidence": F.col("score"), "source": F.when(whole, F.col("source")).otherwise(F.coalesce("part_text", "source")),
        "translated": F.when(whole, F.col("translated")),
    }
    return rows.withColumns(new).select(*[c for c in cues.columns if c != "confidence"], "confidence", "part", *(["words"] if words else []))


def align_external(cues: DataFrame, spans: DataFrame, attempts: DataFrame, duration_ms: int, tokens: DataFrame | None = None, voiced: DataFrame | None = None) -> DataFrame:
    """Cues from a forced aligner's attempts: for each parent its aligned cues, else itself if it is crosstalk, else its alignment to speech; renumbered.

    ``backend`` says which: forced, kept or fallback. ``attempts`` (attempt, from_ms, to_ms, outcome) tells what was tried for a forced or fallback cue, and
    ``words`` (word, start_ms, end_ms, score) holds a forced cue's words, or what a first token without score left of a fallback cue's.
    """
    judged = cut(judged_attempts(attempts, duration_ms), "judged")
    tried = judged.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("attempt", "from_ms", "to_ms", "outcome"))).alias("attempts"))
    unsure = lenient_words(judged.where("outcome = 'zero-first-token-score'"), duration_ms).groupBy(*KEY).agg(F.max_by("words", "attempt").alias("words"))
    forced = aligned_cues(cues, judged, words=True).join(tried, KEY).withColumn("backend", F.lit("forced"))
    rest = align_to_speech(cues, spans, tokens, voiced).join(forced.select(*KEY).distinct(), KEY, "left_anti").withColumn("part", F.lit(0))
    frozen = crosstalk_ids(cues).withColumn("kept", F.lit(True))
    rest = rest.join(frozen, KEY, "left").withColumn("backend", F.when(F.col("kept"), "kept").otherwise("fallback")).drop("kept")
    rest = rest.join(tried, KEY, "left").join(unsure, KEY, "left").withColumns({c: F.when(F.col("backend") == "fallback", F.col(c)) for c in ("attempts", "words")})
    both = forced.unionByName(rest)
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("ordinal", "part")) - 1
    # parts of one parent share its id until they are numbered: they are told apart by their place
    numbered = both.withColumn("parent_id", F.col("id")).withColumn("ordinal", place.cast("bigint")).drop("part").withColumn("id", F.col("ordinal").cast(cues.schema["id"].dataType))
    return normalize_timeline(numbered, duration_ms)


def align(cues: DataFrame, backend: str, duration_ms: int, spans: DataFrame | None = None, attempts: DataFrame | None = None, tokens: DataFrame | None = None, voiced: DataFrame | None = None) -> DataFrame:
    """Cues aligned by ``vad`` (to speech), ``external`` (a forced aligner's attempts) or ``none`` (ends extended only)."""
    if backend == "vad":
        return align_to_speech(cues, spans, tokens, voiced)
    if backend == "external":
        return align_external(cues, spans, attempts, duration_ms, tokens, voiced)
    if backend == "none":
        return extend_cue_ends(cues, duration_ms)
    raise ValueError(f"unknown alignment backend {backend!r}")
