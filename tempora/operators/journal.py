"""Mutations of stored cues as functions of (old, change), batches with context, reply checks, event folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["track_id", "id"]


def upsert_cues(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` over ``old`` by (track, id). Known ids keep their ordinal; a new one gets the largest ordinal plus one plus its
    index in the incoming list, so gaps occur; a null translation never replaces one. ``new.ordinal`` is that index."""
    top = old.groupBy("track_id").agg((F.max("ordinal") + 1).alias("next_ordinal"))
    values = [c for c in old.columns if c not in (*KEY, "ordinal", "translated")]
    incoming = new.select(*KEY, F.lit(True).alias("given"), F.col("ordinal").alias("n_ordinal"), F.col("translated").alias("n_translated"), *[F.col(c).alias(f"n_{c}") for c in values])
    rows = old.join(incoming, KEY, "full_outer").join(top, "track_id", "left")
    ordinal = F.coalesce("ordinal", F.coalesce("next_ordinal", F.lit(0)) + F.col("n_ordinal"))
    picked = [F.when(F.col("given"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return rows.select(*KEY, ordinal.alias("ordinal"), *picked, F.coalesce("n_translated", "translated").alias("translated"))


def latest_by_key(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*key, "row.*")


def missing_batches(cues: DataFrame, size: int = 20) -> DataFrame:
    """(track_id, batch_no, first, last, n): runs of neighbouring untranslated cues, cut into batches; no run shares a batch with another."""
    missing = cues.where("coalesce(translated, '') = ''")
    run = F.col("ordinal") - F.row_number().over(Window.partitionBy("track_id").orderBy("ordinal"))
    place = F.floor((F.row_number().over(Window.partitionBy("track_id", "run").orderBy("ordinal")) - 1) / size)
    runs = missing.select("track_id", "ordinal", run.alias("run")).withColumn("part", place)
    batches = runs.groupBy("track_id", "run", "part").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("first")) - 1
    return batches.select("track_id", number.cast("bigint").alias("batch_no"), "first", "last", "n")


def batch_context(batches: DataFrame, cues: DataFrame, before: int = 10, after: int = 5) -> DataFrame:
    """(track_id, batch_no, preceding, following): ids of the cues around each batch, in order."""
    wanted = batches.select("track_id", "batch_no", "first", "last", F.explode(F.concat(F.sequence(F.col("first") - before, F.col("first") - 1), F.sequence(F.col("last") + 1, F.col("last") + after))).alias("ordinal")).hint("merge")
    found = wanted.join(cues.select("track_id", "ordinal", "id"), ["track_id", "ordinal"])
    ids = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ordinal", "id")))), lambda x: x.id)
    sides = found.groupBy("track_id", "batch_no").agg(ids(F.col("ordinal") < F.col("first")).alias("preceding"), ids(F.col("ordinal") > F.col("last")).alias("following"))
    empty = F.array().cast(f"array<{cues.schema['id'].dataType.simpleString()}>")
    out = batches.select("track_id", "batch_no").join(sides.hint("merge"), ["track_id", "batch_no"], "left")
    return out.select("track_id", "batch_no", F.coalesce("preceding", empty).alias("preceding"), F.coalesce("following", empty).alias("following"))


def reply_problems(cues: DataFrame, replies: DataFrame) -> DataFrame:
    """(track_id, id, kind): ids a reply names but nobody asked for, asked ids without reply, blank translations."""
    asked = cues.select("track_id", F.col("id").cast("string").alias("id"))
    both = replies.select(*KEY, "translated", F.lit(True).alias("given")).join(asked.withColumn("asked", F.lit(True)), KEY, "full_outer")
    kind = F.when(F.col("asked").isNull(), "unknown").when(F.col("given").isNull(), "missing").when(F.coalesce(F.trim("translated"), F.lit("")) == "", "blank")
    return both.select(*KEY, kind.alias("kind")).where("kind IS NOT NULL")


def apply_replies(cues: DataFrame, replies: DataFrame, source_edits: bool = True) -> DataFrame:
    """Cues with the replies' translations and, with ``source_edits``, their corrected sources, where those are not blank."""
    corrected = F.col("source") if "source" in replies.columns and source_edits else F.lit(None).cast("string")
    filled = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))
    given = replies.select("track_id", F.col("id").alias("reply_id"), filled(F.col("translated")).alias("given"), filled(corrected).alias("corrected"))
    rows = cues.withColumn("reply_id", F.col("id").cast("string")).join(given, ["track_id", "reply_id"], "left")
    return rows.withColumns({"translated": F.coalesce("given", "translated"), **({"source": F.coalesce("corrected", "source")} if "source" in cues.columns else {})}).drop("given", "corrected", "reply_id")


def task_state(trace: DataFrame) -> DataFrame:
    """One row a task: latest state, model and attempt that were given, first and (if it ended last) final time."""
    order = F.struct("created_us", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    folded = trace.groupBy("operation_id").agg(last("state").alias("state"), last("model").alias("model"), last("attempt").alias("attempt"), F.min("created_us").alias("started_us"), F.max("created_us").alias("seen_us"), F.count("*").alias("n_events"))
    ended = F.col("state").isin("completed", "failed")
    return folded.select("operation_id", "state", "model", "attempt", "started_us", F.when(ended, F.col("seen_us")).alias("finished_us"), "n_events")


def render_documents(cues: DataFrame) -> DataFrame:
    """(track_id, document): the Dialogue lines of each track in time order, translation above source."""
    from ..functions.text import cue_lines, format_timestamp, sanitize_line, sanitize_name

    text = F.array_join(F.transform(cue_lines(F.col("source"), F.col("translated"), "bilingual"), sanitize_line), "\\N")
    name = sanitize_name(F.col("speaker"))
    line = F.concat(F.lit("Dialogue: 0,"), format_timestamp(F.col("start_ms")), F.lit(","), format_timestamp(F.col("end_ms")), F.lit(",Default,"), name, F.lit(",0,0,0,,"), text)
    rows = cues.select("track_id", F.struct("start_ms", "end_ms", name.alias("name"), "ordinal", line.alias("line")).alias("row"))
    return rows.groupBy("track_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r.line), "\n").alias("document"))


def parse_documents(documents: DataFrame, mark: bool = False) -> DataFrame:
    """(track_id, line_no, start_ms, end_ms, name, lines, problem) of every Dialogue line in an [Events] section; broken ones have a problem.

    With ``mark``, each document has a row of its number -1 besides. A document is cut inside its row, so lines need no shuffle and tasks hold one document each.
    """
    from ..functions.text import event_lines, let, parse_timestamp_ms, stripped

    text = F.replace(F.ltrim("document", F.lit("\uFEFF")), F.lit("\r\n"), F.lit("\n"))
    section = r"^\[([^\]]+)\]$"
    header = lambda x, i: F.when(x.startswith("[") & x.rlike(section), F.struct(i.alias("at"), F.lower(F.trim(F.regexp_extract(x, section, 1))).alias("name")))
    headers = lambda each: F.filter(F.transform(each, header), lambda h: h.isNotNull())
    # the lines behind an [Events] header, up to the next header
    end = lambda each, found, j: F.coalesce(F.get(found, j + 1)["at"], F.size(each))
    behind = lambda each, found: F.transform(found, lambda h, j: F.when(h["name"] == "events", F.struct((h["at"] + 1).alias("first"), F.slice(each, h["at"] + 2, end(each, found, j) - h["at"] - 1).alias("lines"))))
    events = let(F.transform(F.split(text, "\n"), stripped), lambda each: let(headers(each), lambda found: F.filter(behind(each, found), lambda e: e.isNotNull())))
    if mark:
        empty = F.array(F.struct(F.lit(-1).alias("first"), F.array(F.lit("")).alias("lines")))
        events = F.concat(empty, F.coalesce(events, F.filter(empty, lambda e: F.lit(False))))
    placed = documents.select("track_id", F.explode(events).alias("e")).select("track_id", F.col("e.first").alias("base"), F.posexplode("e.lines").alias("n", "line"))
    lines = placed.select("track_id", (F.col("base") + F.col("n")).alias("line_no"), "line").where((F.lower(F.substring("line", 1, 9)) == "dialogue:") | (F.col("line_no") < 0))
    # a line is cut into its fields once, and the last one is a single line
    cells = lines.select("track_id", "line_no", F.split(F.expr("substring(line, 10)"), ",", 10).alias("f"))
    whole = (F.size("f") == 10) & ~F.coalesce(F.get("f", F.lit(9)), F.lit("")).rlike(r"[\n\r\x85\u2028\u2029]")
    fields = cells.select("track_id", "line_no", F.when(whole, F.col("f")).alias("f"))
    field = lambda i: F.coalesce(F.get("f", F.lit(i - 1)), F.lit(""))
    read = fields.select("track_id", "line_no", F.col("f").isNull().alias("broken"), parse_timestamp_ms(field(2)).alias("start_ms"), parse_timestamp_ms(field(3)).alias("end_ms"), F.trim(field(5)).alias("name"), event_lines(field(10)).alias("lines"))
    problem = F.when(F.col("broken") | F.col("start_ms").isNull() | F.col("end_ms").isNull(), "unparsable").when(F.size("lines") == 0, "empty_text")
    return read.select("track_id", "line_no", "start_ms", "end_ms", "name", "lines", problem.alias("problem"))


def voiced_spans(levels: DataFrame, least: int = 3, step_ms: int = 20, tolerance_ms: int = 40) -> DataFrame:
    """(track_id, start_ms, end_ms): runs of at least ``least`` windows of max(3 * floor, 0.035 * peak, 8) or more, those near each other as one.

    The floor is the nearest-rank 0.15 quantile; a track without any sound has no spans.
    """
    from .intervals import merge_intervals

    track = Window.partitionBy("track_id")
    ranked = levels.withColumn("rank", F.row_number().over(track.orderBy("level", "window_idx"))).withColumn("n", F.count("*").over(track))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.15)) + 1
    limits = ranked.groupBy("track_id").agg(F.max(F.when(F.col("rank") == at, F.col("level"))).alias("floor"), F.max("level").alias("peak")).where("peak > 0")
    loud = levels.join(limits, "track_id").where(F.col("level") >= F.greatest(F.col("floor") * 3, F.col("peak") * 0.035, F.lit(8.0)))
    run = F.col("window_idx") - F.row_number().over(track.orderBy("window_idx"))
    runs = loud.withColumn("run", run).groupBy("track_id", "run").agg(F.min("window_idx").alias("first"), F.max("window_idx").alias("last"), F.count("*").alias("n"))
    spans = runs.where(F.col("n") >= least).select("track_id", (F.col("first") * step_ms).alias("start_ms"), ((F.col("last") + 1) * step_ms).alias("end_ms"))
    return merge_intervals(spans, tolerance_ms)


def progress_plan(weights: DataFrame) -> DataFrame:
    """(plan, stage, start, span): positive weights as parts of their plan's sum, and where each begins."""
    whole = Window.partitionBy("plan")
    before = whole.orderBy("position", "weight").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("weight").over(whole)
    return weights.where("weight > 0").select("plan", "stage", (F.coalesce(F.sum("weight").over(before), F.lit(0.0)) / total).alias("start"), (F.col("weight") / total).alias("span"))


def replace_transcript(old: DataFrame, new: DataFrame, retired: int = 1_000_000) -> DataFrame:
    """``new`` in place of ``old`` by (track, id), with ``stable``. A cue that was translated keeps its source and translation and takes
    the new times and speaker; new ordinals run from 0; cues that are gone stay, unstable, ``retired`` further back."""
    values = ["start_ms", "end_ms", "speaker", "source", "translated"]
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("ordinal")) - 1
    incoming = new.select(*KEY, F.lit(True).alias("given"), place.cast("bigint").alias("place"), *[F.col(c).alias(f"n_{c}") for c in values])
    given, kept = F.coalesce("given", F.lit(False)), F.col("translated").isNotNull()
    timed = [F.when(given, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in values[:3]]
    texts = [F.when(given & ~kept, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in values[3:]]
    return old.join(incoming, KEY, "full_outer").select(*KEY, F.coalesce("place", F.col("ordinal") + retired).alias("ordinal"), *timed, *texts, given.alias("stable"))


def overwrite_words(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words by (track, ordinal): those of ``new`` where it has the ordinal, else those of ``old``."""
    return new.unionByName(old.join(new, ["track_id", "ordinal"], "left_anti"))


def fill_actor_styles(events: DataFrame, default: str = "Default") -> DataFrame:
    """An actor's first style other than the default, in the order of the track, replaces the default in that actor's events."""
    own = events.where((F.col("style") != default) & (F.col("speaker") != "")).groupBy("track_id", "speaker").agg(F.min_by("style", "ordinal").alias("own_style"))
    style = F.when(F.col("style") == default, F.coalesce("own_style", "style")).otherwise(F.col("style"))
    return events.join(own, ["track_id", "speaker"], "left").withColumn("style", style).select(*events.columns)


def document_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """(track_id, kind, position) of tracks whose two documents differ: in their number of events (position null), else in the
    time or name of an event, the first one's position."""
    place = F.row_number().over(Window.partitionBy("track_id").orderBy("ordinal")) - 1
    event = lambda df, name: df.select("track_id", place.cast("bigint").alias("position"), F.struct("start_ms", "end_ms", F.coalesce("speaker", F.lit("")).alias("name")).alias(name))
    both = event(left, "a").join(event(right, "b"), ["track_id", "position"], "full_outer")
    found = both.groupBy("track_id").agg(F.count("a").alias("n"), F.count("b").alias("m"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("position"))).alias("first"))
    same = F.col("n") == F.col("m")
    return found.where(F.col("first").isNotNull()).select("track_id", F.when(same, "event").otherwise("count").alias("kind"), F.when(same, F.col("first")).alias("position"))


def discard_provisional(cues: DataFrame) -> DataFrame:
    """The cues as unstable ones without translations."""
    return cues.withColumns({"translated": F.lit(None).cast("string"), "stable": F.lit(False)})


def rename_cues(cues: DataFrame, mapping: DataFrame) -> DataFrame:
    """Cues with the ids of ``mapping`` (track_id, id, new_id); others keep theirs."""
    return cues.join(mapping.select(*KEY, "new_id"), KEY, "left").withColumn("id", F.coalesce("new_id", "id")).select(*cues.columns)


def delete_cues(cues: DataFrame, ids: DataFrame) -> DataFrame:
    return cues.join(ids.select(*KEY), KEY, "left_anti")


def batch_journal(attempts: DataFrame) -> DataFrame:
    """(batch_id, status, response, error, started_us, finished_us, n_attempts) of appended rows (batch_id, at_us, seq, status, response,
    error): the last status of a batch, the last response and error that were given, and its end once it no longer runs."""
    order = F.struct("at_us", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    runs = F.count_if(F.col("status") == "running").alias("n_attempts")
    folded = attempts.groupBy("batch_id").agg(F.max_by("status", order).alias("status"), last("response"), last("error"), F.min("at_us").alias("started_us"), F.max("at_us").alias("seen_us"), runs)
    return folded.select("batch_id", "status", "response", "error", "started_us", F.when(F.col("status") != "running", F.col("seen_us")).alias("finished_us"), "n_attempts")


def add_rows(old: DataFrame, new: DataFrame, key: list[str], number: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` beside those of ``old`` by key. Without ``number``, keys that exist keep their row; with it, the new row replaces the old one,
    the last by ``order`` of equal new keys counts, and new rows are numbered after the largest ``number`` of their track."""
    if number is None:
        return old.unionByName(new.join(old, key, "left_anti"))
    fresh = latest_by_key(new, key, order or key)
    top = old.groupBy("track_id").agg(F.max(number).alias("__top"))
    place = F.row_number().over(Window.partitionBy("track_id").orderBy(*(order or key)))
    numbered = fresh.withColumn("__place", place).join(top, "track_id", "left").withColumn(number, F.coalesce("__top", F.lit(0)) + F.col("__place"))
    return old.join(new, key, "left_anti").unionByName(numbered.select(*old.columns))


def word_reply_problems(items: DataFrame, words: DataFrame, max_ms: int = 8_000, max_weight: int = 84) -> DataFrame:
    """(track_id, position, ordinal, kind): what is wrong with items (track_id, position, first, last, source, translated) over a track's words.

    Of an item: outside (it names words that don't exist), inverted, two_speakers; else no_source, no_translation, too_long, and too_wide_source
    or too_wide_translation. A limit counts only with half of the other measure. Of a word: doubled (claimed by two items of its speaker), uncovered
    (its speaker has claims), and for speakers without any, silent at their first word. Items that are outside, inverted or of two speakers claim nothing.
    """
    from ..functions.text import text_weight

    ends = lambda side: words.select("track_id", F.col("ordinal").alias(side), F.coalesce("speaker", F.lit("")).alias(f"{side}_by"))
    placed = items.join(ends("first"), ["track_id", "first"], "left").join(ends("last"), ["track_id", "last"], "left")
    broken = F.when(F.col("first_by").isNull() | F.col("last_by").isNull(), "outside").when(F.col("last") < F.col("first"), "inverted").when(F.col("first_by") != F.col("last_by"), "two_speakers")
    judged = placed.withColumn("broken", broken)
    sound = judged.where("broken IS NULL").withColumn("by", F.col("first_by"))
    own = words.withColumn("by", F.coalesce("speaker", F.lit("")))
    claims = sound.select("track_id", "by", "position", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge").join(own.select("track_id", "by", "ordinal", "start_ms", "end_ms"), ["track_id", "by", "ordinal"])
    times = claims.groupBy("track_id", "position").agg(F.min_by("start_ms", "ordinal").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    source, translated = F.coalesce(F.trim("source"), F.lit("")), F.coalesce(F.trim("translated"), F.lit(""))
    rows = sound.join(times, ["track_id", "position"]).select("track_id", "position", F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).alias("ms"), text_weight(source).alias("ws"), text_weight(translated).alias("wt"))
    wide = lambda w: (F.col(w) > max_weight) & (2 * F.col("ms") >= max_ms)
    kinds = F.array(
        F.when(F.col("ws") == 0, "no_source"), F.when(F.col("wt") == 0, "no_translation"), F.when((F.col("ms") > max_ms) & (2 * F.greatest("ws", "wt") >= max_weight), "too_long"),
        F.when(wide("ws"), "too_wide_source"), F.when(wide("wt"), "too_wide_translation"),
    )
    none = F.lit(None).cast("bigint")
    of_items = judged.where("broken IS NOT NULL").select("track_id", "position", none.alias("ordinal"), F.col("broken").alias("kind")).unionAll(rows.select("track_id", "position", none, F.explode(F.array_compact(kinds))))
    counts = own.join(claims.groupBy("track_id", "ordinal").agg(F.count("*").alias("n")), ["track_id", "ordinal"], "left")
    seen = counts.withColumn("heard", F.count("n").over(Window.partitionBy("track_id", "by"))).withColumn("place", F.row_number().over(Window.partitionBy("track_id", "by").orderBy("ordinal")))
    kind = F.when(F.col("n") > 1, "doubled").when(F.col("n").isNull() & (F.col("heard") > 0), "uncovered").when((F.col("heard") == 0) & (F.col("place") == 1), "silent")
    of_words = seen.select("track_id", none.alias("position"), "ordinal", kind.alias("kind")).where("kind IS NOT NULL")
    return of_items.unionAll(of_words)
