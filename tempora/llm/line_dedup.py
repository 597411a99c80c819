"""Line dedup: runs of lines that an earlier document, or an earlier place, has already.

Winnowing over line hashes.  Lines are trimmed and hashed; blank lines don't count.  A gram is the
shortest run from a line on with at least ``gram_words`` words or ``gram_lines`` lines; a window is
the grams inside the shortest run with at least ``run_words`` words or ``run_lines`` lines.  From each
window the gram with the smallest hash is a fingerprint (the last of equals).  So every repeated run as long as
a window has a fingerprint in common with its earlier copy, and nothing shorter than a gram is found.

All places of a fingerprint are joined with its first place only, never with each other.  Each match is extended both ways
while the lines stay equal, and the later of the two runs is deleted with the blank lines inside it.  The lines of two rows
meet once for all their matches; hashes of every 2**k lines in a row make an extension of n lines take log n steps, so a text that
repeats itself in any period costs no more than another.  The first place need not be the copy that agrees for longest, so every window is keyed whole as
well and deleted if its first place is earlier: a repeated run as long as a window goes whole, whichever document
holds its earlier copy.  "Earlier" is by (id, hash of the text, line), null ids first.  A line is deleted only
because the same line stands earlier, so the first copy of any line in the corpus always stays.

Built from Spark expressions only: arrays of line hashes, explode, aggregation, joins on keys.  A row is known by its
id and a hash of its text, so every step that runs again finds the same rows.  The texts are shuffled once, to meet
the runs to be deleted from them.

Defined results: rows and other columns stay, whatever their names; null and empty texts stay;
a text all of whose lines go becomes empty; rows with equal ids and equal texts are one document and treated alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, stored, table

LEVELS = 17


def numbered_lines(text: Column) -> Column:
    """Structs (pos, h, w) of the lines that are not blank: place, hash, words."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("line")))
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    return F.transform(F.filter(lines, lambda x: x.line != ""), lambda x: F.struct(x.pos.alias("pos"), F.xxhash64(x.line).alias("h"), words(x.line).alias("w")))


def fingerprints(gram_words: int, gram_lines: int, run_words: int, run_lines: int) -> tuple[Column, Column, Column]:
    """The grams (end, gram, to: the window's end) of column ``lines``, and of column ``grams`` the selected ones (gram,
    back: minus the place) and the whole windows (window, check, from, to: two hashes and the places)."""
    lines, grams = F.col("lines"), F.col("grams")

    def last_of(i: Column, words: int, most: int, w=None) -> Column:
        """Index of the last line of the shortest run from line i on; null if the text ends before."""
        out, total = F.lit(None).cast("int"), F.lit(0)
        cases = []
        for k in range(most):
            total = total + F.coalesce(F.get(lines, i + k).w, F.lit(0))
            cases.append((total >= words if k < most - 1 else F.lit(True), i + k))
        expr = None
        for test, end in cases:
            found = test & (end < F.size(lines))
            expr = F.when(found, end) if expr is None else expr.when(found, end)
        return expr.otherwise(out)

    def hashes(i: Column, end: Column) -> Column:
        return F.transform(F.slice(lines, i + 1, end - i + 1), lambda x: x.h)

    def gram(i: Column) -> Column:
        end = last_of(i, gram_words, gram_lines)
        return F.struct(end.alias("end"), F.when(end.isNotNull(), F.xxhash64(hashes(i, end))).alias("gram"), last_of(i, run_words, run_lines).alias("to"))

    def least_of(i: Column) -> Column:
        end = F.get(grams, i).to
        options = [F.when(F.get(grams, i + k).end <= end, F.struct(F.get(grams, i + k).gram.alias("gram"), (-(i + k)).alias("back"))) for k in range(run_lines)]
        return F.array_min(F.array(*options))

    def window(g: Column, i: Column) -> Column:
        own = hashes(i, g.to)
        return F.when(g.to.isNotNull(), F.struct(F.xxhash64(own).alias("window"), F.hash(own).alias("check"), F.get(lines, i).pos.alias("from"), F.get(lines, g.to).pos.alias("to")))

    every = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    # the places of the least grams never go back from one window to the next, so equal ones are neighbours
    least = F.transform(every, lambda i: F.struct(least_of(i).alias("now"), F.when(i > 0, least_of(i - 1)).alias("before")))
    picked = F.transform(F.filter(least, lambda x: x.now.isNotNull() & (x.before.isNull() | (x.now.back != x.before.back))), lambda x: x.now)
    return F.transform(every, gram), picked, F.filter(F.transform(grams, window), lambda x: x.isNotNull())


def powers_of(hashes: Column | str) -> Column:
    """For each k the hashes of every 2**k lines in a row, by their first line, up to LEVELS - 1."""
    kind = "array<array<bigint>>"

    def longer(levels: Column, k: Column) -> Column:
        half, last = F.pow(F.lit(2.0), k - 1).cast("int"), F.get(levels, k - 1)
        starts = F.when(F.size(last) > half, F.sequence(F.lit(0), F.size(last) - 1 - half)).otherwise(F.array().cast("array<int>"))
        return F.concat(levels, F.array(F.transform(starts, lambda i: F.xxhash64(F.get(last, i), F.get(last, i + half))))).cast(kind)

    first = F.col(hashes) if isinstance(hashes, str) else hashes
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS - 1)), F.array(first).cast(kind), longer)


def equal_around(own: Column, theirs: Column, at: Column, there: Column) -> Column:
    """The lines [a, z] around ``at`` that equal those around ``there``, from the hashes of ``powers_of``: steps of 2**k, the longest first."""
    top = (F.size(F.get(own, F.lit(0))) / (1 << (LEVELS - 1))).cast("int") + 1
    steps = F.concat(F.array_repeat(F.lit(LEVELS - 1), top), F.sequence(F.lit(LEVELS - 2), F.lit(0), F.lit(-1)))

    def ahead(n: Column, k: Column) -> Column:
        return F.when(F.get(F.get(own, k), at + n) == F.get(F.get(theirs, k), there + n), n + F.pow(F.lit(2.0), k).cast("int")).otherwise(n)

    def back(n: Column, k: Column) -> Column:
        more = n + F.pow(F.lit(2.0), k).cast("int")
        return F.when(F.get(F.get(own, k), at - more) == F.get(F.get(theirs, k), there - more), more).otherwise(n)

    return F.struct((at - F.aggregate(steps, F.lit(0), back)).alias("a"), (at + F.aggregate(steps, F.lit(0), ahead) - 1).alias("z"))


def row_key(id: Column, text: Column) -> Column:
    """What a row is known by, in the order of ids."""
    return F.struct(id.alias("id"), F.xxhash64(text).alias("hash"), F.length(text).alias("size"))


def repeated_runs(docs: DataFrame, id: str, text: str, gram_words: int, gram_lines: int, run_words: int, run_lines: int) -> DataFrame:
    """(row, first, last): the lines [first, last] of the rows that are to be deleted."""
    base = docs.select(row_key(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("row"), numbered_lines(F.col(f"`{text}`")).alias("lines")).where(F.size("lines") > 0)
    grams, least, windows = fingerprints(gram_words, gram_lines, run_words, run_lines)
    picked = base.withColumn("grams", grams).withColumn("picked", least).withColumn("windows", windows)
    lined = stored(picked.select("row", F.transform("lines", lambda x: x.h).alias("hashes"), F.transform("lines", lambda x: x.pos).alias("places"), "picked", "windows"), "lines")

    place = lined.select("row", F.size("hashes").alias("n"), F.inline("picked")).select("gram", F.struct("row", (-F.col("back")).alias("at"), "n").alias("place"))
    first = place.groupBy("gram").agg(F.min("place").alias("first"), F.max("place").alias("final")).where("first <> final").select("gram", "first")
    hits = place.join(first, "gram").where("place <> first")
    # all hits of two rows are extended together, and only the lines that a hit can reach meet: from "low" to "high" in either row
    pairs = hits.groupBy(F.col("place.row").alias("row"), F.col("first.row").alias("first_row"), F.col("place.n").alias("n"), F.col("first.n").alias("first_n")).agg(
        F.collect_list(F.struct(F.col("place.at").alias("at"), F.col("first.at").alias("from"))).alias("hits")
    )
    shifts = F.transform("hits", lambda x: x["at"] - x["from"])
    least, most, zero = F.array_min(shifts), F.array_max(shifts), F.lit(0)
    pairs = pairs.select(
        "row", "first_row", "hits", F.greatest(least, zero).alias("low"), F.least(most + F.col("first_n"), "n").alias("high"),
        F.greatest(-most, zero).alias("first_low"), F.least(F.col("n") - least, "first_n").alias("first_high"),
    )
    # rows that are there several times are one; stored, so that both sides of the joins are shuffles of their own and a first row that very many
    # rows meet can be split
    met = pairs.select(F.explode(F.array("row", "first_row")).alias("row")).distinct()
    once = stored(lined.select("row", "hashes", "places").join(met, "row", "left_semi").groupBy("row").agg(F.first("hashes").alias("hashes"), F.first("places").alias("places")), "matched")
    reach = lambda c, low, high: F.slice(c, F.col(low) + 1, F.col(high) - F.col(low)).alias(c)
    own = pairs.join(once, "row").select("row", "first_row", "hits", "low", "first_low", "first_high", reach("hashes", "low", "high"), reach("places", "low", "high"))
    theirs = once.select(F.col("row").alias("first_row"), F.col("hashes").alias("first_hashes"))
    sides = own.join(theirs, "first_row").select("row", "places", "hits", "low", "first_low", powers_of("hashes").alias("own"), powers_of(F.slice("first_hashes", F.col("first_low") + 1, F.col("first_high") - F.col("first_low"))).alias("theirs"))
    # a span as one number, as equal structs are found by comparing each with each
    spans = F.transform("hits", lambda x: equal_around(F.col("own"), F.col("theirs"), x["at"] - F.col("low"), x["from"] - F.col("first_low")))
    coded = F.transform(F.filter(spans, lambda x: x["z"] >= x["a"]), lambda x: F.shiftleft(x["a"].cast("bigint"), 32) + x["z"])
    matched = sides.select("row", "places", F.explode(F.array_distinct(coded)).alias("span"))
    first, last = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    extended = matched.select("row", F.get("places", first).alias("first"), F.get("places", last).alias("last"))

    # whole windows, each joined with its first place only; the second hash is compared where the first one is equal
    window = lined.select("row", F.inline("windows")).select("window", "to", F.struct("row", "from", "check").alias("place"))
    origin = window.groupBy("window").agg(F.min("place").alias("origin"), F.max("place").alias("final")).where("origin <> final").select("window", "origin")
    again = window.join(origin, "window").where("place <> origin AND place.check = origin.check")
    return extended.unionByName(again.select(F.col("place.row").alias("row"), F.col("place.from").alias("first"), F.col("to").alias("last")))


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", gram_words: int = 25, gram_lines: int = 3, run_words: int = 50, run_lines: int = 4) -> DataFrame:
    """``docs`` with later repeats of runs of lines taken out of ``text``."""
    runs = repeated_runs(docs, id, text, gram_words, gram_lines, run_words, run_lines)
    cuts = runs.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))
    whole = docs.select(packed(docs, "data"), row_key(F.col(f"`{id}`"), F.col(f"`{text}`")).alias("row")).join(cuts, "row", "left")
    value = F.col(f"data.`{text}`")

    def merged(ranges: Column) -> Column:
        """Sorted, disjoint ranges."""
        kind = "array<struct<first:int,last:int>>"

        def step(acc, x):
            top = F.try_element_at(acc, F.lit(-1))
            joined = F.struct(top.first.alias("first"), F.greatest(top["last"], x["last"]).alias("last"))
            return F.when((F.size(acc) > 0) & (x["first"] <= top["last"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x))).cast(kind)

        return F.aggregate(F.array_sort(ranges), F.array().cast(kind), step)

    lines = F.split(value, "\n", -1)
    # the lines before, between and behind the ranges
    gaps = F.transform("ranges", lambda x, i: F.slice(F.col("lines"), F.when(i == 0, 1).otherwise(F.get("ranges", i - 1)["last"] + 2), x["first"] - F.when(i == 0, 0).otherwise(F.get("ranges", i - 1)["last"] + 1)))
    tail = F.slice(F.col("lines"), F.element_at("ranges", -1)["last"] + 2, F.size("lines"))
    kept = F.array_join(F.flatten(F.concat(gaps, F.array(tail))), "\n")
    cut = whole.withColumn("lines", F.when(F.col("cuts").isNotNull(), lines)).withColumn("ranges", F.when(F.col("cuts").isNotNull(), merged(F.col("cuts"))))
    new = F.when(F.col("cuts").isNull(), value).otherwise(kept)
    return cut.select(*[(new if c == text else F.col(f"data.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's text without its repeated runs of lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
