"""N-gram Jaccard join by rare-first prefix filtering, and the groups that its links make.

A document's set is its distinct word shingles (five words; A-Z lower-cased, words end at ASCII white
space; with fewer words the whole sequence; without words the set is empty and links with nothing).
Two sets link when ``100 * intersection >= percent * union``.

1. Counts: all shingles of all documents are counted in a table of fixed size (2**22 cells)
   that tasks fill and a tree of sums merges; of the sums, tasks are sent their logarithms (a byte each, 4 MB).  A cell's
   level orders its shingles, rarest first, ties by hash.  Any order gives right results; cells shared by chance only
   make it less sharp.
2. Prefixes: a set of n that reaches the threshold with another shares one of its n - ceil(t n) + 1
   first shingles with it.  Equal sets are one class; each task emits a class once.
3. Candidates: prefix shingles are grouped; those of one class only are dropped.  Length filter:
   the smaller set has t times the larger's size at least.  Positional filter: what stands behind a
   shared shingle must suffice for the overlap.  Suffix filter: sets are cut into 128 hash ranges, and
   the ranges' sizes may differ by no more than the overlap allows.
4. Star pass: in each group every class is compared with the group's first class only, that with the
   fewest rarer shingles, so the one most like the others; the links found make components.  Rest pass: pairs of a group in different components are all compared,
   except those compared before.  So a group of thousands of near copies costs a comparison
   each, and yet no link that joins two components is left out: the components are exact.
5. Verification: once per pair, on the whole sets.

Sets are held as 64-bit hashes of shingles and classes as 64-bit hashes of sets; results are exact
but for collisions of these.

Defined results: rows are kept, one result row each; null ids get the component's smallest id that
is not null; rows that share an id but not a text are separate members of the graph; an empty
or null text has its own id as component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import bloom_filter, passing
from .common import LOWER, UPPER, chunks, discard, give_back, stored, table
from .components import connected_components
from .tokens import distinct, shingle_lists

CELLS, BLOCKS, FAN_IN, RANGES = 1 << 22, 16, 32, 128
CHUNK_CHARS = 1_000_000


def _sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every text."""
    for lo, hi in chunks(np.array([len(t or "") for t in texts]), CHUNK_CHARS):
        grams, starts = shingle_lists(texts[lo:hi], size)
        for i in range(hi - lo):
            yield lo + i, distinct(grams[starts[i] : starts[i + 1]])


def cell_of(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(CELLS - 1)).astype(np.int64)


def set_class(grams: np.ndarray) -> int:
    """A 64-bit hash of a sorted set."""
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def range_sizes(grams: np.ndarray) -> bytes:
    return np.minimum(np.bincount((grams >> np.uint64(57)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def members_and_counts(docs: DataFrame, size: int) -> DataFrame:
    """In one pass: a row (doc_id, class, n, ranges) of each document, and each task's counts in BLOCKS rows (part, block, cells)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, part = np.zeros(CELLS, np.uint32), 0
        for b in batches:
            ids, rows = b["id"].tolist(), []
            for i, own in _sets(b["text"].tolist(), size):
                if len(own):
                    np.add.at(cells, cell_of(own), np.uint32(1))
                    part = int(own[0] >> np.uint64(1))
                rows.append((ids[i], set_class(own), len(own), range_sizes(own)))
            out = pd.DataFrame(rows, columns=["doc_id", "class", "n", "ranges"])
            yield out.assign(part=None, block=None, cells=None)
            give_back()
        counts = pd.DataFrame({"part": part, "block": np.arange(BLOCKS), "cells": [zlib.compress(x.tobytes(), 1) for x in np.split(cells, BLOCKS)]})
        yield counts.assign(doc_id=None, **{"class": None}, n=None, ranges=None)[["doc_id", "class", "n", "ranges", "part", "block", "cells"]]

    return docs.mapInPandas(of, "doc_id string, class long, n int, ranges binary, part long, block int, cells binary")


def count_levels(parts: DataFrame, tasks: int) -> np.ndarray:
    """The sum of all tasks' tables by a tree of sums in which about FAN_IN tables meet, as levels: 10 to each doubling up to 2**25."""

    def adder(last: bool):
        return lambda group: add(group, last)

    def add(group: pa.Table, last: bool) -> pa.Table:
        total = np.zeros(CELLS // BLOCKS, np.uint64)
        for x in group["cells"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        total = np.minimum(10 * np.log2(total + 1.0), 255).astype(np.uint8) if last else np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"part": group["part"][:1], "block": group["block"][:1], "cells": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    levels = max(1, ceil(log(tasks, FAN_IN)))
    for level in range(levels):
        last = level == levels - 1
        tasks = 1 if last else ceil(tasks / FAN_IN)
        meet = F.pmod(F.xxhash64("part", F.lit(level)), F.lit(tasks)).alias("meet")
        parts = parts.groupBy("block", meet).applyInArrow(adder(last), "part long, block int, cells binary")
    found, out = parts.toArrow(), np.zeros((BLOCKS, CELLS // BLOCKS), np.uint8)
    for block, data in zip(found["block"].to_pylist(), found["cells"], strict=True):
        out[block] = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
    return out.reshape(-1)


def postings(docs: DataFrame, counts, size: int, percent: int) -> DataFrame:
    """(gram, class, spot) of the prefix shingles of every class, each class once a task; spot holds the place, then n."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            grams, kinds, spots, held = [], [], [], 0
            for _, own in _sets(b["text"].tolist(), size):
                n, kind = len(own), set_class(own)
                if n and kind not in seen:
                    seen.add(kind)
                    k = n - -(-percent * n // 100) + 1
                    grams.append(own[np.lexsort((own, counts.value[cell_of(own)]))[:k]].view(np.int64))
                    kinds.append(np.full(k, kind, np.int64))
                    spots.append((np.arange(k, dtype=np.int64) << 32) + n)
                    held += k
                if held > 200_000:
                    yield pd.DataFrame({"gram": np.concatenate(grams), "class": np.concatenate(kinds), "spot": np.concatenate(spots)})
                    grams, kinds, spots, held = [], [], [], 0
            if held:
                yield pd.DataFrame({"gram": np.concatenate(grams), "class": np.concatenate(kinds), "spot": np.concatenate(spots)})
            give_back()

    return docs.mapInPandas(of, "gram long, class long, spot long")


def id_hash(ids: list[str | None]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(b"-" if i is None else b"+" + i.encode(), digest_size=8).digest(), "little") for i in ids], np.uint64)


def whole_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(class, grams) of ``classes``, stored, each from one of its documents, in one scan of the documents.

    A Bloom filter of fixed size over the chosen ids keeps other documents from being cut into shingles; those
    that pass by chance drop out when the sets are joined.
    """
    spark = docs.sparkSession

    @F.pandas_udf("long")
    def hashed(ids: pd.Series) -> pd.Series:
        return pd.Series(id_hash(ids.tolist()).view(np.int64))

    chosen = members.groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(classes, "class", "left_semi")
    bloom = spark.sparkContext.broadcast(bloom_filter(chosen.select(hashed("doc_id").alias("hash"))))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = passing(id_hash(b["id"].tolist()), bloom.value)
            if len(some):
                own = [g for _, g in _sets(b["text"].iloc[some].tolist(), size)]
                for lo in range(0, len(own), 500):
                    part = own[lo : lo + 500]
                    yield pd.DataFrame({"class": [set_class(g) for g in part], "grams": [g.view(np.int64) for g in part]})
            give_back()

    sets = stored(docs.mapInPandas(of, "class long, grams array<long>"), "sets")
    bloom.destroy()
    return sets


def needed(n: Column, m: Column, percent: int) -> Column:
    """The smallest overlap that suffices for sets of n and m."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def may_link(percent: int) -> Column:
    """Length and positional filter of a shared shingle at the spots x.spot and y.spot."""
    i, j = (F.shiftright(c, 32) for c in ("x.spot", "y.spot"))
    n, m = (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("x.spot", "y.spot"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= needed(n, m, percent))


def near_pairs(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: pairs (a, b) whose hash ranges differ no more than the overlap allows."""

    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([int(np.abs(np.frombuffer(p, np.uint8).astype(np.int16) - np.frombuffer(q, np.uint8)).sum()) for p, q in zip(x, y, strict=True)], dtype="int32")

    ranges = members.groupBy("class").agg(F.min("n").alias("n"), F.min("ranges").alias("ranges"))
    a = ranges.select(F.col("class").alias("a"), F.col("n").alias("n"), F.col("ranges").alias("ra"))
    b = ranges.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("ranges").alias("rb"))
    return pairs.join(a, "a").join(b, "b").where(apart("ra", "rb") <= F.col("n") + F.col("m") - 2 * needed(F.col("n"), F.col("m"), percent)).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, stored, each compared once on the whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = whole_sets(docs, wanted, members, size)
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b")
    shared, total = F.size(F.array_intersect("ga", "gb")), F.size("ga") + F.size("gb")
    linked = both.select("a", "b", shared.alias("shared"), total.alias("total")).where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b")
    links = stored(linked, "links")
    discard(sets)
    return links


def link_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    # ids pass through pandas as strings: a column with nulls would become double there
    rows = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    tasks = max(1, rows.rdd.getNumPartitions())
    scanned = stored(members_and_counts(rows, size), "members")
    members = scanned.where("block IS NULL").select("doc_id", "class", "n", "ranges")
    counts = spark.sparkContext.broadcast(count_levels(scanned.where("block IS NOT NULL").select("part", "block", "cells"), tasks))

    alike = Window.partitionBy("gram")
    lead = F.struct("spot", "class")
    shared = stored(
        postings(rows, counts, size, percent).withColumn("first", F.min(lead).over(alike)).withColumn("last", F.max(lead).over(alike))
        .where("first.class <> last.class").select("gram", F.struct("class", "spot").alias("x"), F.col("first").alias("y")),
        "postings",
    )
    counts.destroy()

    pair = [F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")]
    star = stored(near_pairs(shared.where((F.col("x.class") != F.col("y.class")) & may_link(percent)).select(*pair).distinct(), members, percent), "pairs")
    links = verify(star, rows, members, size, percent)
    # a class goes into the components under its smallest id, so that the smallest node of a component holds the result
    key = F.col("doc_id").cast(docs.schema[id].dataType)
    lows = stored(members.groupBy("class").agg(F.min(key).alias("low")), "classes")
    name = F.struct(F.col("low").isNull().alias("none"), "low", "class")

    def components(links: DataFrame) -> DataFrame:
        """(class, head, low): the class that heads each linked class's component, and its smallest id."""
        a, b = (lows.select(F.col("class").alias(c), name.alias(f"node_{c}")) for c in ("a", "b"))
        found = connected_components(links.join(a, "a").join(b, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        return found.select("node.class", F.col("component.class").alias("head"), "component.low")

    groups = components(links)

    # pairs in groups that hold several components after the star pass
    named = shared.select("gram", "x").join(groups, F.col("x.class") == F.col("class"), "left").select("gram", "x", F.coalesce("head", "x.class").alias("c"))
    mixed = stored(named.withColumn("low", F.min("c").over(alike)).withColumn("high", F.max("c").over(alike)).where("low <> high").select("gram", "x", "c"), "rest")
    other = mixed.select("gram", F.col("x").alias("y"), F.col("c").alias("d"))
    rest = mixed.join(other, "gram").where((F.col("c") != F.col("d")) & (F.col("x.class") < F.col("y.class")) & may_link(percent)).select(*pair).distinct()
    new = stored(near_pairs(rest.join(star, ["a", "b"], "left_anti"), members, percent), "pairs")
    if not new.isEmpty():
        more = verify(new, rows, members, size, percent)
        if not more.isEmpty():
            groups = components(links.unionAll(more))
        discard(more)
    discard(shared, star, links, mixed, new)

    # stored, so that both sides of the next join are shuffles of their own and a class with very many rows can be split
    known = stored(lows.join(groups.select("class", F.col("low").alias("least")), "class", "left").select("class", F.coalesce("least", "low").alias("component_id")), "classes")
    discard(lows)
    out = members.select("class", key.alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles")).join(known, "class", "left")
    return out.select(F.col("doc_id").alias(id), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id. Rows without an id stay, as do rows that share the kept id."""
    groups = link_groups(docs, id=id, **options).where(F.col(id).isNull() | (F.col("component_id") == F.col(id)))
    keep = groups.select(F.col(id).alias("__keep")).distinct()
    return docs.join(keep, docs[id].eqNullSafe(keep["__keep"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document."""
    return link_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id
"""
