"""What is done, what is left and what went wrong: coverage, resume points, leftovers, late results, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["track_id", "id"]


def stable_cues(cues: DataFrame) -> DataFrame:
    return cues.where("stable")


def scan_cues(cues: DataFrame, stable_only: bool = False) -> DataFrame:
    """A journal's cues in the order of their places in their tracks."""
    return (stable_cues(cues) if stable_only else cues).orderBy("track_id", "ordinal")


def scan_words(words: DataFrame) -> DataFrame:
    return words.orderBy("track_id", "ordinal")


def cues_by_id(cues: DataFrame, ids: DataFrame, stable_only: bool = False) -> DataFrame:
    """The cues that ``ids`` (track_id, id) names."""
    return (stable_cues(cues) if stable_only else cues).join(ids.select(*KEY), KEY, "left_semi")


def broken_cues(cues: DataFrame) -> DataFrame:
    """Cues that start before 0 or end before they start."""
    return cues.where("start_ms < 0 OR end_ms < start_ms OR start_ms IS NULL OR end_ms IS NULL")


def with_timing(cues: DataFrame, times: DataFrame) -> DataFrame:
    """Cues with the start, end and confidence of ``times`` (track_id, id, start_ms, end_ms, confidence) where it has them."""
    new = times.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("start_ms", "end_ms", "confidence")], F.lit(True).alias("given"))
    picked = {c: F.when(F.col("given"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("start_ms", "end_ms", "confidence")}
    return cues.join(new, KEY, "left").withColumns(picked).select(*cues.columns)


def merged_metadata(rows: DataFrame, changes: DataFrame, defaults: bool = False) -> DataFrame:
    """Rows with ``metadata`` (a map of texts) and the keys of ``changes`` (track_id, id, metadata) over it, or, as ``defaults``, under it."""
    new = changes.select(*KEY, F.col("metadata").alias("changed"))
    none = F.create_map().cast("map<string,string>")
    own, other = F.coalesce("metadata", none), F.coalesce("changed", none)
    weak, strong = (other, own) if defaults else (own, other)
    kept = F.map_filter(weak, lambda k, _: ~F.map_contains_key(strong, k))
    return rows.join(new, KEY, "left").withColumn("metadata", F.map_concat(kept, strong)).drop("changed")


def resume_points(cues: DataFrame, durations: DataFrame, overlap_ms: int = 5_000) -> DataFrame:
    """(track_id, durable_ms, resume_ms, remaining): the furthest end that is stored, where to go on, and the part of the track that is left, at least 0.01."""
    last = cues.groupBy("track_id").agg(F.max("end_ms").alias("durable_ms"))
    rows = durations.select("track_id", "duration_ms").join(last, "track_id", "left").withColumn("durable_ms", F.coalesce("durable_ms", F.lit(0)))
    left = F.when(F.col("duration_ms") > 0, F.greatest(F.lit(0.01), F.least(F.lit(1.0), (F.col("duration_ms") - F.col("durable_ms")) / F.col("duration_ms")))).otherwise(1.0)
    return rows.select("track_id", "durable_ms", F.greatest(F.lit(0), F.col("durable_ms") - overlap_ms).alias("resume_ms"), left.alias("remaining"))


def word_coverage(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """(track_id, n_words, n_covered, complete): how many words lie in a range (track_id, first, last)."""
    covered = ranges.select("track_id", F.explode(F.sequence("first", "last")).alias("ordinal")).distinct().withColumn("hit", F.lit(1)).hint("merge")
    counted = words.select("track_id", "ordinal").join(covered, ["track_id", "ordinal"], "left").groupBy("track_id").agg(F.count("*").alias("n_words"), F.count("hit").alias("n_covered"))
    return counted.withColumn("complete", F.col("n_words") == F.col("n_covered"))


def unfinished(cues: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The cues without a translation that are not ``done`` (track_id, id) or under way."""
    left = cues.where("coalesce(translated, '') = ''")
    return left if done is None else left.join(done.select(*KEY), KEY, "left_anti")


def leftover_failures(cues: DataFrame, shown: int = 20) -> DataFrame:
    """(track_id, n, ids) of tracks with cues that a finished translation left untranslated: their number and the first ids."""
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("ordinal"))
    left = unfinished(cues).select("track_id", "id", place.alias("place"))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "id"))))
    return left.groupBy("track_id").agg(F.count("*").alias("n"), F.transform(first, lambda x: x.id).alias("ids"))


def uncovered_failures(words: DataFrame, ranges: DataFrame, shown: int = 20) -> DataFrame:
    """(track_id, n, ordinals) of tracks with words that no cue covers: their number and the first ones."""
    from .words import uncovered_words

    left = uncovered_words(words, ranges).select("track_id", "ordinal", F.row_number().over(Window.partitionBy("track_id").orderBy("ordinal")).alias("place"))
    return left.groupBy("track_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.col("ordinal")))).alias("ordinals"))


def late_results(replies: DataFrame, cues: DataFrame) -> DataFrame:
    """(track_id, batch_no, n): how many results of a batch came for cues that are gone."""
    known = cues.select("track_id", F.col("id").cast("string").alias("id"))
    return replies.join(known, KEY, "left_anti").groupBy("track_id", "batch_no").agg(F.count("*").alias("n"))


def batch_summaries(batches: DataFrame, cues: DataFrame, replies: DataFrame, shown: int = 20) -> DataFrame:
    """(track_id, batch_no, processed, corrected, updated, pairs) of batches (track_id, batch_no, first, last): answered cues, sources that
    the replies change, translations that they change, and the first answers as ``source → translation``."""
    inside = batches.select("track_id", "batch_no", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge").join(cues, ["track_id", "ordinal"])
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    answers = replies.select("track_id", F.col("id").alias("reply_id"), filled("source").alias("r_source"), filled("translated").alias("r_translated"))
    rows = inside.withColumn("reply_id", F.col("id").cast("string")).join(answers, ["track_id", "reply_id"])
    source, translated = F.coalesce("r_source", "source"), F.coalesce("r_translated", "translated")
    place = F.row_number().over(Window.partitionBy("track_id", "batch_no").orderBy("ordinal"))
    rows = rows.select("track_id", "batch_no", place.alias("place"), (source != F.col("source")).alias("corrected"), (~translated.eqNullSafe(F.col("translated"))).alias("updated"), F.concat(source, F.lit(" → "), F.coalesce(translated, F.lit(""))).alias("pair"))
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "pair"))))
    return rows.groupBy("track_id", "batch_no").agg(F.count("*").alias("processed"), F.count_if("corrected").alias("corrected"), F.count_if("updated").alias("updated"), F.transform(first, lambda x: x.pair).alias("pairs"))


def active_operations(trace: DataFrame, key: str) -> DataFrame:
    """(key, active): how many operations of ``trace`` (operation_id, event_id, state, created_us, and the key) have not ended, by their last state."""
    last = trace.groupBy(key, "operation_id").agg(F.max_by("state", F.struct("created_us", "event_id")).alias("state"))
    return last.groupBy(key).agg(F.count_if(~F.col("state").isin("completed", "failed")).alias("active"))


def elapsed_seconds(tasks: DataFrame, now_us: int) -> DataFrame:
    """Tasks with ``elapsed_s``: whole seconds from their start to their end, or to now, never below 0."""
    until = F.coalesce("finished_us", F.lit(now_us))
    return tasks.withColumn("elapsed_s", F.greatest(F.lit(0), F.rint((until - F.col("started_us")) / 1_000_000)).cast("bigint"))


def batch_progress(batches: DataFrame, transcribed: DataFrame | None = None) -> DataFrame:
    """(track_id, fraction) of batches (track_id, status): the completed part; 1 without any.

    While a track is still transcribed (``transcribed`` has its fraction), completed batches only fill what stands behind 0.85 of the stage.
    """
    done = batches.groupBy("track_id").agg((F.count_if(F.col("status") == "complete") / F.count("*")).alias("part"))
    if transcribed is None:
        return done.select("track_id", F.col("part").alias("fraction"))
    rows = transcribed.select("track_id", F.col("fraction").alias("heard")).join(done, "track_id", "full_outer")
    part = F.coalesce("part", F.lit(1.0))
    return rows.select("track_id", F.when(F.col("heard").isNull(), part).otherwise(0.85 * F.least(F.lit(1.0), F.col("heard")) + 0.15 * part).alias("fraction"))


def published_language(configured: str, detected: str) -> F.Column:
    """The configured language unless it is left to detection, else the detected one, else what was configured."""
    from ..functions.text import normalize_language

    return F.coalesce(normalize_language(F.col(configured)), normalize_language(F.col(detected)), F.col(configured))


def artifact(artifacts: DataFrame, kind: str) -> DataFrame:
    """(job_id, path) of the latest artifact (job_id, artifact_id, kind, path) of a kind."""
    return artifacts.where(F.col("kind") == kind).groupBy("job_id").agg(F.max_by("path", "artifact_id").alias("path"))


def checkpoint(checkpoints: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """(job_id, value): the last value of a checkpoint (job_id, name, value, at_us, seq) of every job, else the default."""
    own = checkpoints.where(F.col("name") == name).groupBy("job_id").agg(F.max_by("value", F.struct("at_us", "seq")).alias("value"))
    return checkpoints.select("job_id").distinct().join(own, "job_id", "left").select("job_id", F.coalesce("value", F.lit(default)).alias("value"))


def create_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Jobs with those of ``new`` that are not there yet."""
    return jobs.unionByName(new.join(jobs.select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"]))


def set_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs (job_id, status, error, ...) with the status and error of ``changes`` where it names them; a status without an error clears it."""
    new = changes.select("job_id", F.col("status").alias("n_status"), F.col("error").alias("n_error"), F.lit(True).alias("given"))
    picked = {c: F.when(F.col("given"), F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("status", "error")}
    return jobs.join(new, "job_id", "left").withColumns(picked).select(*jobs.columns)


def stage_weights(plans: DataFrame) -> DataFrame:
    """(plan, position, stage, weight) of plans (plan, needs_model, is_url, streaming, needs_acquire, needs_transcription, needs_translation,
    needs_post_translation, transcription_scale): what each stage is expected to cost."""
    on = lambda c, weight: F.when(F.col(c), weight).otherwise(0.0)
    live = F.col("streaming") & F.col("is_url")
    scale = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("transcription_scale")))
    # The stages in their order and their weights.
    stages = [
        ("model", on("needs_model", F.lit(14.0))), ("acquire", on("needs_acquire", F.when(live, 28.0).when(F.col("is_url"), 16.0).otherwise(6.0))),
        ("transcribe", on("needs_transcription", F.when(live, 28.0).otherwise(38.0) * scale)), ("translate", on("needs_translation", F.when(live, 14.0).otherwise(20.0))),
        ("align", F.lit(8.0)), ("post-align-translate", on("needs_post_translation", F.lit(10.0))), ("publish", F.lit(2.0)),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("stage"), w.alias("weight")) for i, (n, w) in enumerate(stages)]))
    return plans.select("plan", each.alias("s")).select("plan", "s.*")


def stage_value(observed: DataFrame, stages: DataFrame) -> DataFrame:
    """Observations (plan, stage, fraction) with ``value``: the stage's start plus the fraction, kept inside 0 and 1, of its span."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    return observed.join(stages.select("plan", "stage", "start", "span"), ["plan", "stage"]).withColumn("value", F.col("start") + inside * F.col("span")).drop("start", "span")


def outer_context(batches: DataFrame, cues: DataFrame, edges: DataFrame, before: int = 10, after: int = 5) -> DataFrame:
    """Batches of a list of cues with context that reaches over the list's ends: ``edges`` has the cues before (negative ordinals) and behind it."""
    from .journal import batch_context

    return batch_context(batches, cues.select("track_id", "ordinal", "id").unionByName(edges.select("track_id", "ordinal", "id")), before, after)


def preview_cues(documents: DataFrame) -> DataFrame:
    """(track_id, id, ordinal, start_ms, end_ms, speaker, source, translated) of documents' events: one line is a source; of several, the
    first is the translation and the others the source. Events that can't be read go; ends are not before starts."""
    from .journal import parse_documents

    rows = parse_documents(documents).where("problem IS NULL")
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("line_no")).cast("bigint")
    several = F.size("lines") > 1
    source = F.when(several, F.array_join(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), "\n")).otherwise(F.get("lines", F.lit(0)))
    return rows.select(
        "track_id", place.alias("id"), (place - 1).alias("ordinal"), "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), F.nullif("name", F.lit("")).alias("speaker"),
        source.alias("source"), F.when(several, F.get("lines", F.lit(0))).alias("translated"),
    )
