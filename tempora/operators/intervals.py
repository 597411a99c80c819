"""Operators over time intervals of tracks: (track_id, start_ms, end_ms, ...).

Joins on overlap put both sides into time buckets and join on (track, bucket), so Spark plans an equi-join
instead of a nested loop; each pair is kept in the first bucket both sides share, so none is seen twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def buckets(df: DataFrame, lo: Column, hi: Column, width: int, name: str = "bucket") -> DataFrame:
    """One row for each time bucket that [lo, hi] touches. How many these are Spark can't tell, so joins on them are merged."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, hi) / width)))).hint("merge")


def range_join(left: DataFrame, right: DataFrame, width: int, left_lo: Column, left_hi: Column, right_lo: Column, right_hi: Column, condition: Column) -> DataFrame:
    """Pairs of one track whose (closed) ranges meet and that fulfil ``condition``.

    Both sides have track_id; other column names must differ.
    """
    a = buckets(left.withColumn("__first", F.floor(left_lo / width)), left_lo, left_hi, width)
    b = buckets(right.withColumn("__begin", F.floor(right_lo / width)), right_lo, right_hi, width)
    once = F.col("bucket") == F.greatest("__first", "__begin")
    return a.join(b, ["track_id", "bucket"]).where(once & condition).drop("bucket", "__first", "__begin")


def merge_intervals(spans: DataFrame, tolerance_ms: int = 10) -> DataFrame:
    """Spans whose gap is at most the tolerance become one; inverted spans go."""
    order = Window.partitionBy("track_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(*BEFORE))
    island = F.sum(F.when(F.col("start_ms") > F.col("reach") + tolerance_ms, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    valid = spans.where("end_ms >= start_ms").withColumn("reach", reach)
    return valid.withColumn("island", island).groupBy("track_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def crosstalk_ids(cues: DataFrame) -> DataFrame:
    """(track_id, id) of cues that overlap a cue of another named speaker; touching ends don't count.

    One sweep: every cue comes in at its start and is judged at its end, against the furthest end among the cues of other speakers that have
    come in.  That is the furthest end of all, or, if it is the cue's own speaker's, the furthest that was overtaken by or fell short of
    another speaker's.  No pair of cues is made.
    """
    named = cues.where("speaker IS NOT NULL AND speaker <> ''").select("track_id", "id", "start_ms", "end_ms", "speaker")
    come = named.select("*", F.col("start_ms").alias("at"), F.lit(1).alias("comes"))
    order = Window.partitionBy("track_id").orderBy("at", "comes", "id", "start_ms", "end_ms")
    lead = F.max(F.when(F.col("comes") == 1, F.struct("end_ms", "speaker"))).over(order.rowsBetween(*BEFORE))
    other = F.col("lead.speaker") != F.col("speaker")
    rows = come.unionByName(named.select("*", F.col("end_ms").alias("at"), F.lit(0).alias("comes"))).withColumn("lead", lead)
    second = F.max(F.when((F.col("comes") == 1) & other, F.least("end_ms", "lead.end_ms"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    reach = F.when(other, F.col("lead.end_ms")).otherwise(F.col("second"))
    return rows.withColumn("second", second).where((F.col("comes") == 0) & (reach > F.col("start_ms"))).select("track_id", "id").distinct()


def extend_cue_ends(cues: DataFrame, duration_ms: int | None = None, crosstalk: DataFrame | None = None) -> DataFrame:
    """Cue ends moved towards the next start: gaps up to 0.7 s close, gaps under 1 s end in their middle, others get 0.5 s.

    Crosstalk cues stay; other overlaps are pulled back; the last cue gets 0.5 s; ends stay inside the duration.
    """
    flags = (crosstalk if crosstalk is not None else crosstalk_ids(cues)).select("track_id", "id", F.lit(True).alias("frozen"))
    following = F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("start_ms", "end_ms", "ordinal"))
    limit = lambda c: c if duration_ms is None else F.least(c, F.lit(max(0, duration_ms)))
    rows = cues.join(flags, ["track_id", "id"], "left").withColumn("next_ms", following)
    rows = rows.withColumn("next_ms", F.when(F.col("next_ms").isNotNull(), limit(F.greatest("next_ms", F.lit(0)))))
    start = limit(F.col("start_ms"))
    end = limit(F.greatest(start, F.col("end_ms")))
    gap, longer = F.col("next_ms") - end, limit(end + 500)
    moved = F.when(F.col("next_ms").isNull(), longer).when(gap <= 700, F.col("next_ms")).when(gap < 1000, F.floor((end + F.col("next_ms")) / 2)).otherwise(longer)
    free = F.col("frozen").isNull()
    out = rows.withColumn("new_end", F.when(free, F.greatest(start, moved)).otherwise(F.col("end_ms")).cast("bigint")).withColumn("start_ms", F.when(free, start).otherwise(F.col("start_ms")).cast("bigint"))
    return out.withColumn("end_ms", F.col("new_end")).drop("frozen", "next_ms", "new_end")


def normalize_timeline(cues: DataFrame, duration_ms: int, crosstalk: DataFrame | None = None) -> DataFrame:
    """Times inside [0, duration], ends not before starts, and new numbers from 1 in the order of time and speaker; parent_id keeps the old id.

    Crosstalk cues keep their times, and cues are put in order before any of them is moved.
    """
    flags = (crosstalk if crosstalk is not None else crosstalk_ids(cues)).select("track_id", "id", F.lit(True).alias("frozen"))
    order = Window.partitionBy("track_id").orderBy("start_ms", "end_ms", F.coalesce("speaker", F.lit("")), "ordinal")
    placed = cues.join(flags, ["track_id", "id"], "left").withColumn("place", F.row_number().over(order).cast("bigint"))
    start = F.least(F.greatest(F.col("start_ms"), F.lit(0)), F.lit(duration_ms))
    end = F.least(F.greatest(start, F.col("end_ms")), F.lit(duration_ms))
    free = F.col("frozen").isNull()
    times = {"start_ms": F.when(free, start).otherwise(F.col("start_ms")).cast("bigint"), "end_ms": F.when(free, F.greatest(start, end)).otherwise(F.col("end_ms")).cast("bigint")}
    parent = F.coalesce(F.col("parent_id").cast("string"), F.col("id").cast("string")).cast(cues.schema["id"].dataType) if "parent_id" in cues.columns else F.col("id")
    return placed.withColumns({**times, "parent_id": parent, "id": F.col("place")}).drop("frozen", "place")


def event_defects(events: DataFrame) -> DataFrame:
    """(track_id, id, kind) of rows in list order: ends before its start, starts before an earlier start, overlaps.

    An overlap is with an earlier row of the same name, with an unnamed one, or of an unnamed row with any.
    """
    order = Window.partitionBy("track_id").orderBy("ordinal").rowsBetween(*BEFORE)
    by_name = Window.partitionBy("track_id", "name").orderBy("ordinal").rowsBetween(*BEFORE)
    rows = events.withColumn("name", F.coalesce("speaker", F.lit("")))
    rows = (
        rows.withColumn("latest", F.max("start_ms").over(order)).withColumn("any_end", F.max("end_ms").over(order))
        .withColumn("unnamed_end", F.max(F.when(F.col("name") == "", F.col("end_ms"))).over(order)).withColumn("own_end", F.max("end_ms").over(by_name))
    )
    limit = F.when(F.col("name") == "", F.col("any_end")).otherwise(F.greatest("own_end", "unnamed_end"))
    kinds = F.array(
        F.when(F.col("end_ms") < F.col("start_ms"), "end_before_start"), F.when(F.col("start_ms") < F.col("latest"), "out_of_order"), F.when(F.col("start_ms") < limit, "overlap")
    )
    return rows.select("track_id", "id", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def long_silence_starts(cues: DataFrame, merged: DataFrame, silence_ms: int = 6_000, pre_roll_ms: int = 3_000, width_ms: int = 60_000, crosstalk: DataFrame | None = None) -> DataFrame:
    """Cues with a silence over ``silence_ms`` inside start ``pre_roll_ms`` before its end, the last such silence counting.

    The stretch from a cue's start to its first span is a silence as well; what follows its last span is none. Crosstalk cues stay.
    """
    before = F.lag("end_ms").over(Window.partitionBy("track_id").orderBy("start_ms"))
    gaps = merged.select("track_id", before.alias("from_ms"), F.col("start_ms").alias("to_ms")).where(F.col("from_ms").isNull() | (F.col("to_ms") - F.col("from_ms") > silence_ms))
    inside = (F.col("to_ms") > F.col("start_ms")) & (F.col("to_ms") < F.col("end_ms")) & (F.col("to_ms") - F.greatest("start_ms", "from_ms") > silence_ms)
    frozen = crosstalk if crosstalk is not None else crosstalk_ids(cues)
    key = cues.join(frozen, ["track_id", "id"], "left_anti").select("track_id", "id", "start_ms", "end_ms")
    hits = range_join(key, gaps, width_ms, F.col("start_ms"), F.col("end_ms"), F.col("to_ms"), F.col("to_ms"), inside)
    last = hits.groupBy("track_id", "id").agg(F.max("to_ms").alias("speech_ms"))
    moved = F.greatest("start_ms", F.col("speech_ms") - pre_roll_ms)
    return cues.join(last, ["track_id", "id"], "left").withColumn("start_ms", F.coalesce(moved, "start_ms")).drop("speech_ms")


def start_candidates(cues: DataFrame, spans: DataFrame, tol_ms: int = 40, ahead_ms: int = 2_000, width_ms: int = 20_000) -> DataFrame:
    """(track_id, id, candidate_ms): the first span that a cue may start at, not before the previous cue's end."""
    previous = F.lag("end_ms").over(Window.partitionBy("track_id").orderBy("ordinal"))
    keyed = cues.select("track_id", "id", "start_ms", "end_ms", previous.alias("previous_ms"))
    span = spans.select("track_id", F.col("start_ms").alias("left_ms"), F.col("end_ms").alias("right_ms"))
    limit = F.least(F.col("end_ms"), F.col("start_ms") + ahead_ms)
    fits = (F.col("right_ms") >= F.col("start_ms") - tol_ms) & (F.col("left_ms") <= limit) & (F.col("previous_ms").isNull() | (F.col("left_ms") >= F.col("previous_ms") + tol_ms))
    hits = range_join(keyed, span, width_ms, F.greatest(F.lit(0), F.col("start_ms") - tol_ms), F.greatest(F.col("start_ms"), limit), F.col("left_ms"), F.col("right_ms"), fits)
    return hits.groupBy("track_id", "id").agg(F.min("left_ms").alias("candidate_ms"))


def remaining_speech(cues: DataFrame, spans: DataFrame, tol_ms: int = 40, least_ms: int = 800, width_ms: int = 20_000) -> DataFrame:
    """(track_id, id) of cues whose start lies in a span with more than ``least_ms`` left."""
    span = spans.select("track_id", F.col("start_ms").alias("left_ms"), F.col("end_ms").alias("right_ms"))
    s = F.col("start_ms")
    fits = (F.col("left_ms") <= s + tol_ms) & (F.col("right_ms") >= s - tol_ms) & (F.col("right_ms") - s > least_ms)
    hits = range_join(cues.select("track_id", "id", "start_ms"), span, width_ms, F.greatest(F.lit(0), s - tol_ms), s + tol_ms, F.col("left_ms"), F.col("right_ms"), fits)
    return hits.select("track_id", "id").distinct()


def refined_ends(cues: DataFrame, spans: DataFrame, tol_ms: int = 40, within_ms: int = 1_000, width_ms: int = 20_000) -> DataFrame:
    """(track_id, id, refined_ms): the span end nearest to a cue's end, the later of equally near ones."""
    following = F.lead("start_ms").over(Window.partitionBy("track_id").orderBy("ordinal"))
    keyed = cues.select("track_id", "id", "start_ms", "end_ms", following.alias("next_ms"))
    span = spans.select("track_id", F.col("start_ms").alias("left_ms"), F.col("end_ms").alias("right_ms"))
    e, r = F.col("end_ms"), F.col("right_ms")
    fits = (F.abs(r - e) <= within_ms) & (F.col("left_ms") <= e + tol_ms) & (r >= F.col("start_ms")) & (F.col("next_ms").isNull() | (r <= F.col("next_ms")))
    hits = range_join(keyed, span, width_ms, F.greatest(F.lit(0), e - within_ms), e + within_ms, r, r, fits)
    return hits.groupBy("track_id", "id").agg(F.min_by("right_ms", F.struct(F.abs(r - e), -r)).alias("refined_ms"))


def align_to_speech(cues: DataFrame, spans: DataFrame, tokens: DataFrame | None = None, voiced: DataFrame | None = None, moved_ms: int = 20) -> DataFrame:
    """Cue starts and ends on speech: confidence 0.9 if the start moved by more than ``moved_ms``, 0.75 if it stayed on speech, 0.35 without any.

    The start is that behind a long silence its first tokens lie across (``tokens``, see ``alignment.token_starts``), else its own with enough
    speech left, else the first span's that it may have. Tracks without spans take those of ``voiced``. Crosstalk cues keep times and confidence.
    """
    from .alignment import token_starts

    key = ["track_id", "id"]
    given = spans.select("track_id", "start_ms", "end_ms")
    heard = given if voiced is None else given.unionByName(voiced.join(given.select("track_id").distinct(), "track_id", "left_anti").select("track_id", "start_ms", "end_ms"))
    frozen = crosstalk_ids(cues).withColumn("frozen", F.lit(True))
    keeps = remaining_speech(cues, heard).withColumn("speaking", F.lit(True))
    rows = cues.join(frozen, key, "left").join(keeps, key, "left").join(start_candidates(cues, heard), key, "left")
    behind = F.lit(None).cast("bigint")
    if tokens is not None:
        rows, behind = rows.join(token_starts(cues, given, tokens, voiced).select(*key, "token_ms"), key, "left"), F.col("token_ms")
    found = F.coalesce(behind, F.when(F.col("speaking"), F.col("start_ms")), F.when(F.col("candidate_ms").isNotNull(), F.greatest("candidate_ms", "start_ms")))
    own = F.col("confidence") if "confidence" in cues.columns else F.lit(None).cast("double")
    confidence = F.when(F.col("frozen"), own).when(found.isNull(), 0.35).when(found > F.col("start_ms") + moved_ms, 0.9).otherwise(0.75)
    start = F.when(F.col("frozen"), F.col("start_ms")).otherwise(F.coalesce(F.least(F.greatest("start_ms", found), "end_ms"), "start_ms"))
    started = rows.withColumn("__confidence", confidence).withColumn("start_ms", start).withColumn("confidence", F.col("__confidence"))
    started = started.select(*[c for c in cues.columns if c != "confidence"], "confidence", "frozen")
    ended = started.join(refined_ends(started, heard), key, "left")
    return ended.withColumn("end_ms", F.when(F.col("frozen"), F.col("end_ms")).otherwise(F.greatest("start_ms", F.coalesce("refined_ms", "end_ms")))).drop("refined_ms", "frozen")


def onset_starts(cues: DataFrame, levels: DataFrame, step_ms: int = 20, lookback: int = 20, pre_roll_ms: int = 60, least_ms: int = 5) -> DataFrame:
    """Cues whose start moves to the first sound inside them, ``pre_roll_ms`` before it.

    The noise is the nearest-rank 0.2 quantile of the track, or that of the ``lookback`` windows before the cue if louder, up to
    1.5 times the track's plus 3. Sound is a strong window with two weak ones among three, or four weak windows in a row. Crosstalk cues stay.
    """
    track = Window.partitionBy("track_id")
    ranked = levels.withColumn("rank", F.row_number().over(track.orderBy("level", "window_idx"))).withColumn("n", F.count("*").over(track))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.2)) + 1
    floors = ranked.groupBy("track_id").agg(F.max(F.when(F.col("rank") == at, F.col("level"))).alias("whole"), F.max("level").alias("top")).where("top > 0")
    key = ["track_id", "id"]
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("start_ms") / step_ms)), F.ceil(F.col("end_ms") / step_ms)
    free = cues.join(crosstalk_ids(cues), key, "left_anti").select(*key, F.col("start_ms").alias("at_ms"), lo.alias("lo"), hi.alias("hi")).where("hi > lo")
    heard = free.withColumn("window_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("lo") - lookback), F.col("hi") - 1))).hint("merge").join(levels, ["track_id", "window_idx"])
    inside = F.col("window_idx") >= F.col("lo")
    before = F.array_sort(F.collect_list(F.when(~inside, F.col("level"))))
    own = heard.groupBy(*key).agg(before.alias("before"), F.max(F.when(inside, F.col("level"))).alias("peak")).join(floors, "track_id")
    local = F.coalesce(F.try_element_at("before", F.greatest(F.lit(1), F.least(F.size("before") - 1, F.floor(F.size("before") * 0.2)) + 1).cast("int")), F.col("whole"))
    noise = F.greatest(F.col("whole"), F.least(local, F.col("whole") * 1.5 + 3))
    limits = own.where("peak IS NOT NULL").withColumn("noise", noise).select(
        *key, F.greatest(F.col("noise") * 1.3, F.col("peak") * 0.0005, F.lit(4.0)).alias("weak"), F.greatest(F.col("noise") * 2.0, F.col("peak") * 0.003, F.lit(8.0)).alias("strong")
    )
    order = Window.partitionBy(*key).orderBy("window_idx")
    rows = heard.where(inside).join(limits, key).withColumn("over", (F.col("level") > F.col("weak")).cast("int"))
    loud = (F.col("level") > F.col("strong")) & (F.sum("over").over(order.rowsBetween(0, 2)) >= 2)
    long = F.sum("over").over(order.rowsBetween(-3, 0)) == 4
    hits = rows.withColumn("loud", loud).withColumn("long", long).where("loud OR long").withColumn("onset", F.col("window_idx") - F.when(F.col("loud"), 0).otherwise(3))
    first = hits.groupBy(*key, "at_ms").agg(F.min_by("onset", "window_idx").alias("onset"))
    moved = first.select(*key, (F.greatest("at_ms", F.col("onset") * step_ms) - pre_roll_ms).alias("refined_ms"), "at_ms").where(F.col("refined_ms") > F.col("at_ms") + least_ms)
    return cues.join(moved.drop("at_ms"), key, "left").withColumn("start_ms", F.coalesce("refined_ms", "start_ms").cast("bigint")).drop("refined_ms")
