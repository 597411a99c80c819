"""Operators over words of tracks: (track_id, ordinal, speaker, text, start_ms, end_ms)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ends_sentence, overlap_key, text_weight
from ..sources.sinks import cut


def track():
    return Window.partitionBy("track_id")


def speech_rates(words: DataFrame, least_ms: int = 50, few: int = 3, usual: float = 60.0) -> DataFrame:
    """(track_id, speaker, rate): median milliseconds per weight unit; speakers with few words take their track's rate, such tracks 60."""
    pace = (F.col("end_ms") - F.col("start_ms")) / F.greatest(F.lit(1), text_weight(F.trim("text")))
    timed = words.withColumn("pace", F.when(F.col("end_ms") - F.col("start_ms") >= least_ms, pace))
    own = timed.groupBy("track_id", "speaker").agg(F.median("pace").alias("own"), F.count("pace").alias("n"))
    whole = timed.groupBy("track_id").agg(F.median("pace").alias("whole"), F.count("pace").alias("m"))
    rate = F.when(F.col("n") >= few, F.col("own")).when(F.col("m") >= few, F.col("whole")).otherwise(F.lit(usual))
    return own.join(whole, "track_id").select("track_id", "speaker", rate.alias("rate"))


def qualified_silences(words: DataFrame, least_ms: int = 800) -> DataFrame:
    """(track_id, ordinal, gap_ms): pauses between the furthest end so far, of any speaker, and the next start."""
    order = track().orderBy("ordinal")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, 0))
    gaps = words.select("track_id", "ordinal", (F.lead("start_ms").over(order) - reach).alias("gap_ms"))
    return gaps.where(F.col("gap_ms") >= least_ms)


def dispatchable_prefix(words: DataFrame) -> DataFrame:
    """(track_id, n_words): words up to the last qualified silence, 0 without one."""
    last = qualified_silences(words).groupBy("track_id").agg((F.max("ordinal") + 1).alias("n"))
    return words.select("track_id").distinct().join(last, "track_id", "left").select("track_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_words"))


def split_word_batches(words: DataFrame, target: int = 400, least_ms: int = 800) -> DataFrame:
    """(track_id, batch_no, first, last, forced_end): batches of about ``target`` words cut at silences.

    A batch ends at the widest silence among the words target // 2 to target, the first of equals; else at the first later one
    inside the hard limit of twice the target; else at the hard limit, which is a forced end.  Silences are found by windows; the walk from cut
    to cut is a fold over sorted rows.
    """
    hard, least, none = 2 * target, max(target // 2 - 1, 0), -(1 << 62)
    order = track().orderBy("ordinal")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.lead("start_ms").over(order) - reach
    # one shuffle serves the windows and the fold; the key, of any kind, goes along with a track's first word and is read again behind the walk
    rows = words.select("track_id", "ordinal", "start_ms", "end_ms").repartition("track_id").withColumns({"gap": gap, "first": F.row_number().over(order) == 1})
    rows = rows.sortWithinPartitions("track_id", "ordinal").select(F.when(F.col("first"), F.to_json(F.struct("track_id"))).alias("name"), "first", "ordinal", F.when(F.col("gap") >= least_ms, F.col("gap")).otherwise(none).cast("bigint").alias("gap"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over sorted rows; the words behind the last cut are held, twice the target at most besides the batch at hand."""
        name, number, at, low, ordinal, gap = None, 0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def cuts(ended: bool) -> Iterator[tuple]:
            nonlocal number, at, low, ordinal, gap
            n = low + len(ordinal)
            while at < n and (ended or n - at > hard):
                i, rest = at - low, n - at <= hard
                near, far = gap[i + least : i + target], gap[i + target : i + hard - 1] > none
                forced = False
                if rest:
                    last = ordinal[-1]
                elif near.max() > none:
                    last = ordinal[i + least + near.argmax()]
                elif far.any():
                    last = ordinal[i + target + far.argmax()]
                else:
                    last, forced = ordinal[i] + hard - 1, True
                yield name, number, ordinal[i], last, forced
                at, number = n if rest else at + int(last - ordinal[i]) + 1, number + 1
            kept = min(max(at, low), n)
            low, ordinal, gap = kept, ordinal[kept - low :], gap[kept - low :]

        for batch in chain(batches, [None]):
            out = []
            if batch is None:
                out += cuts(True)
            else:
                firsts = np.flatnonzero(batch["first"].to_numpy()).tolist()
                given, new, wide = batch["name"], batch["ordinal"].to_numpy(), batch["gap"].to_numpy()
                for lo, hi in zip([0, *firsts], [*firsts, len(new)], strict=True):
                    if lo in firsts[:1] or lo > 0:
                        out += cuts(True)
                        name, number, at, low, ordinal, gap = given.iloc[lo], 0, 0, 0, ordinal[:0], gap[:0]
                    if hi > lo:
                        ordinal, gap = np.concatenate([ordinal, new[lo:hi]]), np.concatenate([gap, wide[lo:hi]])
                        out += cuts(False)
            yield pd.DataFrame(out, columns=["track_id", "batch_no", "first", "last", "forced_end"])

    walked = rows.mapInPandas(walk, "track_id string, batch_no int, first long, last long, forced_end boolean")
    return walked.withColumn("track_id", F.from_json("track_id", T.StructType([words.schema["track_id"]]))["track_id"])


def segment_words(words: DataFrame, max_ms: int = 8_000, max_weight: int = 84, silence_ms: int = 800) -> DataFrame:
    """(track_id, id, speaker, first, last, start_ms, end_ms, text): words to preview cues, speaker by speaker.

    A cue ends before a pause of the speaker, after a sentence, and where it grows too long in time (with half
    the weight or more) or too wide (with half the time or more).  Texts are joined as they are, their spacing is part of the words; a
    time reaches from the first word's start to the new word's end.  Pauses and sentences are found by windows; the two
    soft limits carry a state along one stretch between them.
    """
    own = Window.partitionBy("track_id", "speaker").orderBy("ordinal")
    breaks = F.lag(ends_sentence(F.col("text"))).over(own) | (F.col("start_ms") - F.lag("end_ms").over(own) >= silence_ms)
    blank = lambda pattern: text_weight(F.regexp_extract("text", pattern, 1))
    # one shuffle serves the windows and the fold
    rows = words.select("track_id", "speaker", "ordinal", "start_ms", "end_ms", "text").repartition("track_id", "speaker")
    rows = rows.withColumn("hard", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn("weight", text_weight(F.col("text"))).withColumn("lead", blank(r"(?U)^(\s*)")).withColumn("tail", blank(r"(?U)(\s*)$"))
    rows = rows.withColumn("stretch", F.sum("hard").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ["track_id", "speaker", "ordinal", "start_ms", "end_ms", "text", "stretch"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over sorted rows; only the cue at hand is held."""
        at, cue, start, full, before, after = None, -1, 0, 0, 0, 0
        for b in batches:
            out = []
            keys = zip(b["track_id"], b["speaker"], b["stretch"], strict=True)
            for key, s, e, w, lead, tail in zip(keys, b["start_ms"], b["end_ms"], b["weight"], b["lead"], b["tail"], strict=True):
                if key != at:
                    at, cue = key, -1
                # the width of all texts so far and this one, without blanks at either end
                wide = max(0, full + w - (before if before < full else full + lead) - (tail if tail < w else after + w))
                span = e - start
                if cue < 0 or (span > max_ms and 2 * wide >= max_weight) or (wide > max_weight and 2 * span >= max_ms):
                    cue, start, full, before, after = cue + 1, s, w, lead, tail
                else:
                    before = before if before < full else full + lead
                    after = tail if tail < w else after + w
                    full += w
                out.append(cue)
            yield b[kept].assign(cue=out)

    joined = rows.sortWithinPartitions("track_id", "speaker", "ordinal").mapInPandas(cut, "track_id long, speaker string, ordinal long, start_ms long, end_ms long, text string, stretch long, cue int")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    cues = joined.groupBy("track_id", "speaker", "stretch", "cue").agg(
        F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.min_by("start_ms", "ordinal").alias("start_ms"), F.max("end_ms").alias("end_ms"),
        F.regexp_replace(F.array_join(F.transform(parts, lambda x: x.text), ""), r"(?U)^\s+|\s+$", "").alias("text"),
    )
    place = F.row_number().over(track().orderBy("start_ms", "end_ms", F.coalesce("speaker", F.lit("")), "first"))
    kept = cues.where("text <> ''").withColumn("end_ms", F.greatest("start_ms", "end_ms"))
    return kept.select("track_id", F.concat(F.lit("preview-"), place.cast("string")).alias("id"), "speaker", "first", "last", "start_ms", "end_ms", "text")


def uncovered_words(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """Words in none of the (track_id, first, last) ranges."""
    covered = ranges.select("track_id", F.explode(F.sequence("first", "last")).alias("ordinal")).distinct().hint("merge")
    return words.join(covered, ["track_id", "ordinal"], "left_anti")


def uncovered_runs(words: DataFrame, ranges: DataFrame) -> DataFrame:
    """(track_id, first, last): runs of neighbouring words that no range covers."""
    left = uncovered_words(words, ranges).select("track_id", "ordinal")
    run = F.col("ordinal") - F.row_number().over(track().orderBy("ordinal"))
    return left.withColumn("run", run).groupBy("track_id", "run").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last")).drop("run")


def preview_overlay(stable: DataFrame, previews: DataFrame) -> DataFrame:
    """Stable cues and those previews whose words no stable cue covers; both have (track_id, id, first, last, ...)."""
    covered = stable.select("track_id", F.explode(F.sequence("first", "last")).alias("ordinal")).distinct().hint("merge")
    each = previews.select("track_id", "id", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge")
    hit = each.join(covered, ["track_id", "ordinal"], "left_semi").select("track_id", "id").distinct()
    return stable.unionByName(previews.join(hit, ["track_id", "id"], "left_anti"))


def junctions(words: DataFrame, cues: DataFrame, forced: DataFrame | None = None, silence_ms: int = 800) -> DataFrame:
    """(track_id, ordinal) of joints that need another look: the words there and behind belong to different cues, and the cut was ``forced``
    (track_id, ordinal), or the cues are one speaker's with less than ``silence_ms`` between them."""
    owner = cues.select("track_id", F.col("first").alias("cue"), F.coalesce("speaker", F.lit("")).alias("by"), F.col("start_ms").alias("cue_start"), F.col("end_ms").alias("cue_end"), F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge")
    owned = words.select("track_id", "ordinal").join(owner, ["track_id", "ordinal"])
    order = track().orderBy("ordinal")
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in ("ordinal", "cue", "by", "cue_start")]
    pairs = owned.select("track_id", "ordinal", "cue", "by", "cue_end", *following).where("next_ordinal = ordinal + 1 AND next_cue <> cue")
    near = (F.col("next_by") == F.col("by")) & (F.col("next_cue_start") - F.col("cue_end") < silence_ms)
    if forced is None:
        return pairs.where(near).select("track_id", "ordinal")
    return pairs.join(forced.select("track_id", "ordinal", F.lit(True).alias("forced")), ["track_id", "ordinal"], "left").where(F.coalesce("forced", F.lit(False)) | near).select("track_id", "ordinal")


def batch_joints(batches: DataFrame, words: DataFrame) -> DataFrame:
    """(track_id, ordinal, forced): the joints at both ends of batches of words, each once; ends of a track are none."""
    top = words.groupBy("track_id").agg(F.max("ordinal").alias("top"))
    left = batches.where("first > 0").select("track_id", (F.col("first") - 1).alias("ordinal"), F.lit(False).alias("forced"))
    right = batches.join(top, "track_id").where("last < top").select("track_id", F.col("last").alias("ordinal"), F.col("forced_end").alias("forced"))
    return left.unionByName(right).groupBy("track_id", "ordinal").agg(F.max("forced").alias("forced"))


def repair_spans(joints: DataFrame, cues: DataFrame) -> DataFrame:
    """(track_id, ordinal, low, high, replaced): around each joint, the words from the start of the cue before it to the end of the one behind it, and the
    ids of the cues that lie inside."""
    side = lambda name, at: cues.select("track_id", F.col(name), F.explode(F.sequence("first", "last")).alias(at)).hint("merge")
    spans = joints.join(side("first", "ordinal").withColumnRenamed("first", "low"), ["track_id", "ordinal"]).withColumn("behind", F.col("ordinal") + 1).join(side("last", "behind").withColumnRenamed("last", "high"), ["track_id", "behind"]).drop("behind")
    inside = spans.select("track_id", "ordinal", "high", F.explode(F.sequence("low", "high")).alias("first")).hint("merge").join(cues.select("track_id", "first", "last", "id"), ["track_id", "first"]).where("last <= high")
    ids = inside.groupBy("track_id", "ordinal").agg(F.array_sort(F.collect_set("id")).alias("replaced"))
    return spans.select("track_id", "ordinal", "low", "high").join(ids, ["track_id", "ordinal"], "left")


def missing_word_batches(words: DataFrame, ranges: DataFrame, target: int = 400) -> DataFrame:
    """(track_id, batch_no, first, last, forced_end): batches over every run of words that no range (track_id, first, last) covers; no batch reaches over two runs."""
    # a number that the words of a run share, and no other run of the track
    run = F.col("ordinal") - F.row_number().over(track().orderBy("ordinal"))
    left = uncovered_words(words, ranges).withColumn("track_id", F.struct("track_id", run.alias("run")))
    cut = split_word_batches(left, target)
    number = F.row_number().over(Window.partitionBy("track_id.track_id").orderBy("first")) - 1
    return cut.select(F.col("track_id.track_id").alias("track_id"), number.cast("int").alias("batch_no"), "first", "last", "forced_end")


def ready_word_batches(words: DataFrame, ranges: DataFrame, dispatched: DataFrame, target: int = 400) -> DataFrame:
    """(track_id, first, last) of batches that can go out while the words still come: inside the words before the last pause, of ``target`` words or more,
    and not among the ``dispatched`` ones."""
    usable = words.join(dispatchable_prefix(words), "track_id").where("ordinal < n_words").drop("n_words")
    full = missing_word_batches(usable, ranges, target).where(F.col("last") - F.col("first") + 1 >= target)
    return full.select("track_id", "first", "last").join(dispatched.select("track_id", "first", "last"), ["track_id", "first", "last"], "left_anti")


def overlap_merge(existing: DataFrame, incoming: DataFrame, within_ms: int = 2_500) -> DataFrame:
    """(track_id, ordinal, start_ms, end_ms, source) of the incoming cues that are kept.

    In the order of their ordinals, an incoming cue goes if a cue of the same text that exists or was kept starts within ``within_ms``.
    Only starts that near each other decide, so the starts of a text are cut where neighbours lie further apart; each such stretch is
    folded on its own, over sorted rows.
    """
    key = F.coalesce(overlap_key(F.col("source")), F.lit("")).alias("text_key")
    columns = ["track_id", "ordinal", "start_ms", "end_ms", "source"]
    both = existing.select(*columns, key, F.lit(False).alias("new")).unionByName(incoming.select(*columns, key, F.lit(True).alias("new")))
    by_text = Window.partitionBy("track_id", "text_key").orderBy("start_ms", "new", "ordinal")
    far = F.col("start_ms") - F.lag("start_ms").over(by_text) > within_ms
    runs = both.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("run", F.sum("far").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))

    stretch = ["track_id", "text_key", "run"]
    ordered = runs.select(*columns, "text_key", "new", "run").repartition(*stretch).sortWithinPartitions(*stretch, "new", "ordinal", "start_ms")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cells = None, {}
        for batch in batches:
            keep = []
            for key, start, new in zip(zip(*[batch[c] for c in stretch], strict=True), batch["start_ms"], batch["new"], strict=True):
                if key != at:
                    at, cells = key, {}
                cell = start // (within_ms + 1)
                near = any(abs(s - start) <= within_ms for c in (cell - 1, cell, cell + 1) for s in cells.get(c, ()))
                if not new or not near:
                    cells.setdefault(cell, []).append(start)
                keep.append(bool(new) and not near)
            yield batch.loc[keep, columns]

    return ordered.mapInPandas(fold, "track_id long, ordinal long, start_ms long, end_ms long, source string")


def merged_timeline(existing: DataFrame, incoming: DataFrame, within_ms: int = 2_500) -> DataFrame:
    """(track_id, id, start_ms, end_ms, source): the existing cues and the incoming ones that ``overlap_merge`` keeps.

    A kept cue's id is the number of cues that are there when it comes, itself included.
    """
    kept = overlap_merge(existing, incoming, within_ms)
    held = existing.groupBy("track_id").agg(F.count("*").alias("held"))
    place = F.row_number().over(track().orderBy("ordinal", "start_ms"))
    new = kept.join(held, "track_id", "left").select("track_id", (F.coalesce("held", F.lit(0)) + place).cast("string").alias("id"), "start_ms", "end_ms", "source")
    return existing.select("track_id", F.col("id").cast("string").alias("id"), "start_ms", "end_ms", "source").unionByName(new)


def repair_squeezed_words(words: DataFrame, least_ms: int = 50, longest_ms: int = 5_000, duration_ms: int | None = None) -> DataFrame:
    """Words with new times where a change of speaker squeezed them.

    At every change, the interrupted speaker's own last words that are shorter than ``least_ms`` are spread over the time their text takes at
    that speaker's rate: at most ``longest_ms``, not beyond the speaker's next word or the duration, and only if that makes them longer. A repair changes
    what a later one sees, but never beyond a word of ordinary length: windows cut each speaker's words into runs of squeezed ones, and the
    repairs of one run are one small group.
    """
    columns = ["track_id", "ordinal", "speaker", "text", "start_ms", "end_ms"]
    rates = speech_rates(words, least_ms).withColumnsRenamed({"track_id": "r_track", "speaker": "r_speaker", "rate": "pace"})
    all_order, own = track().orderBy("ordinal"), Window.partitionBy("track_id", "speaker").orderBy("ordinal")
    short = F.col("end_ms") - F.col("start_ms") < least_ms
    last = F.lead("ordinal").over(all_order).isNotNull() & F.col("speaker").isNotNull() & ~F.lead("speaker").over(all_order).eqNullSafe(F.col("speaker"))
    rows = words.select(*columns).withColumns({"short": short, "changes": last, "next_own": F.lead("start_ms").over(own), "run": F.sum((~short).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    whole = Window.partitionBy("track_id", "speaker", "run")
    squeezed = rows.where("short").withColumn("any", F.max("changes").over(whole)).where("any")
    rated = squeezed.join(rates, (F.col("track_id") == F.col("r_track")) & F.col("speaker").eqNullSafe(F.col("r_speaker"))).select("track_id", "speaker", "run", "ordinal", "start_ms", "end_ms", "changes", "next_own", "pace", F.greatest(F.lit(1), text_weight(F.trim("text"))).alias("weight"))

    def spread(start: list, end: list, weight: list, pace: list, bounds: list, changes: list) -> None:
        """Each change takes the words behind the last one that is long enough by now; shares of the weight give the new times."""
        for i in (i for i, change in enumerate(changes) if change):
            first = i + 1
            while first and end[first - 1] - start[first - 1] < least_ms:
                first -= 1
            if first > i:
                continue
            begin, total = start[first], sum(weight[first : i + 1])
            room = min([longest_ms, total * pace[i], *([bounds[i] - begin] if bounds[i] == bounds[i] else []), *([duration_ms - begin] if duration_ms is not None else [])])
            if begin + room > max(begin, end[i]):
                done = 0
                for j in range(first, i + 1):
                    done += weight[j]
                    start[j], end[j] = begin if j == first else end[j - 1], round(begin + room * done / total)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over sorted rows, whole runs at a time; the last run of a batch waits for the next one."""
        rest = None
        for b in chain(batches, [None]):
            g = rest if b is None else b if rest is None else pd.concat([rest, b], ignore_index=True)
            if g is None:
                return
            keys = list(zip(g["track_id"], g["speaker"], g["run"], strict=True))
            edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            last = len(keys) if b is None else edges[-1] if edges else 0
            rest = g.iloc[last:]
            cells = [g[c].tolist() for c in ("start_ms", "end_ms", "weight", "pace", "next_own", "changes")]
            for lo, hi in zip([0, *edges], [*edges, len(keys)], strict=True):
                if hi <= last:
                    run = [c[lo:hi] for c in cells]
                    spread(*run)
                    cells[0][lo:hi], cells[1][lo:hi] = run[0], run[1]
            yield g[["track_id", "ordinal"]].assign(new_start=cells[0], new_end=cells[1]).iloc[:last]

    order = ["track_id", "speaker", "run", "ordinal"]
    new = rated.repartition("track_id", "speaker").sortWithinPartitions(*order).mapInPandas(fold, "track_id long, ordinal long, new_start long, new_end long")
    return words.select(*columns).join(new, ["track_id", "ordinal"], "left").withColumns({"start_ms": F.coalesce("new_start", "start_ms"), "end_ms": F.coalesce("new_end", "end_ms")}).select(*columns)


def import_words(lists: DataFrame, max_ms: int = 8_000, max_weight: int = 84, duration_ms: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Word lists (track_id, items) to the words to store and the preview cues over them."""
    from ..sources.records import words_from_items

    # a table each, so that a list is read and its words are repaired once
    words = cut(repair_squeezed_words(cut(words_from_items(lists), "items"), duration_ms=duration_ms), "words")
    return words, segment_words(words, max_ms, max_weight)


def word_context(batches: DataFrame, words: DataFrame, cues: DataFrame, before: int = 10, after: int = 40) -> DataFrame:
    """(track_id, batch_no, preceding, following): ids of the last cues that start before a batch of words, and the ordinals of the next words.

    Cues are numbered in time order; a running count finds how many start before each batch, so both sides are equi-joins.
    """
    starts = batches.join(words.select("track_id", F.col("ordinal").alias("first"), "start_ms"), ["track_id", "first"])
    ranked = cues.select("track_id", "start_ms", "id", F.row_number().over(track().orderBy("start_ms", "end_ms", "id")).cast("bigint").alias("place"))
    marks = starts.select("track_id", "start_ms", F.lit(0).alias("is_cue"), "batch_no").unionAll(ranked.select("track_id", "start_ms", F.lit(1), F.lit(None).cast("int")))
    count = F.sum("is_cue").over(track().orderBy("start_ms", "is_cue").rowsBetween(Window.unboundedPreceding, 0))
    known = marks.withColumn("n", count).where("is_cue = 0")
    wanted = known.where("n > 0").select("track_id", "batch_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - before + 1), F.col("n"))).alias("place")).hint("merge")
    ids = wanted.join(ranked.select("track_id", "place", "id"), ["track_id", "place"]).groupBy("track_id", "batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x.id).alias("preceding"))
    coming = batches.select("track_id", "batch_no", F.explode(F.sequence(F.col("last") + 1, F.col("last") + after)).alias("ordinal")).hint("merge")
    following = coming.join(words.select("track_id", "ordinal"), ["track_id", "ordinal"]).groupBy("track_id", "batch_no").agg(F.array_sort(F.collect_list("ordinal")).alias("following"))
    return batches.select("track_id", "batch_no").join(ids.hint("merge"), ["track_id", "batch_no"], "left").join(following.hint("merge"), ["track_id", "batch_no"], "left")


def settled_prefix(words: DataFrame, cues: DataFrame, pending: DataFrame, complete: bool = True) -> DataFrame:
    """(track_id, id, final_id): cues (track_id, id, first, last, start_ms, end_ms, speaker) whose place in their timeline can't change any more.

    Words from the first cue on that touches a pending joint (track_id, ordinal), or the first word without a cue, may still change; cues settle
    in time order while they end before those words and start before all of them.
    """
    owner = cues.select("track_id", "first", F.explode(F.sequence("first", "last")).alias("ordinal")).hint("merge")
    total = words.groupBy("track_id").agg(F.max("ordinal").alias("top"))
    gap = words.select("track_id", "ordinal").join(owner, ["track_id", "ordinal"], "left_anti").groupBy("track_id").agg(F.min("ordinal").alias("gap"))
    ends = total.join(gap, "track_id", "left")
    cut = F.when(F.col("gap").isNotNull(), F.col("gap") - 1) if complete else F.coalesce(F.col("gap") - 1, F.col("top"))
    barriers = ends.select("track_id", cut.alias("ordinal")).where("ordinal >= 0").unionByName(pending.select("track_id", "ordinal"))
    mutable = barriers.join(owner, ["track_id", "ordinal"]).groupBy("track_id").agg(F.min("first").alias("mutable"))
    limits = ends.where("gap IS NULL OR gap > 0").join(mutable, "track_id", "left").select("track_id", F.coalesce("mutable", F.col("top") + 1).alias("mutable"))
    frontier = words.join(limits, "track_id").where("ordinal >= mutable").groupBy("track_id").agg(F.min("start_ms").alias("frontier"))
    placed = cues.join(limits, "track_id").join(frontier, "track_id", "left")
    order = track().orderBy("start_ms", "end_ms", F.coalesce("speaker", F.lit("")), "first")
    stays = (F.col("last") < F.col("mutable")) & (F.col("frontier").isNull() | (F.col("start_ms") < F.col("frontier")))
    walked = placed.withColumn("final_id", F.row_number().over(order).cast("bigint")).withColumn("open", F.max((~stays).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return walked.where("open = 0").select("track_id", "id", "final_id")
