"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of punctuation.  A seed is a fixed mask over a window of words:
only the words at its marked positions are hashed, so a substituted word at another position
leaves the hash equal.  Hashes of the benchmark (test) and of the documents (training) are joined,
and around each hit the two word sequences are laid over each other and compared word by word;
the whole overlay counts as an overlap if it is long and equal enough, else the best-scoring stretch of it if that is.

Plan: the items' words and seeds are two tables in the shared folder.  One scan of the documents keeps only seeds that a Bloom filter of the benchmark's hashes lets
through.  The filter has a fixed number of bits whatever the benchmark's size: a larger benchmark only
lets more seeds through to the join, which is exact and shuffled.  Per stretch of a document with
seeds, one row with its word hashes goes to a table in the shared folder; seeds of that table are
joined with the benchmark's hashes, and each (stretch, item) is verified once, along all the diagonals that hold a hit.

Bounds: an overlay counts if it has at least ``min_words`` words, or all words of a shorter item, of which
``min_equal`` are equal.  Wherever a quarter of 12 to 23 words is substituted, one of ``MASKS`` still has a window
without a substituted word, and longer overlays can be cut into pieces of such lengths of which one has no larger share
substituted.  Items under ``FULL`` words have masks of their own length with the same property.  So every overlay
of an item that is three quarters equal is found.  Part of an overlay that isn't equal enough as a whole is judged by
its best-scoring stretch only.  Items under ``min_item`` words take no part, as such a few words say nothing; with a smaller ``min_item`` they are
found as well, each by masks over the whole of it.

Defined results: null and empty texts have no overlap; null ids stay null ids; repeated rows are
reported once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import bloom_filter, passing
from .common import chunks, give_back, stored, table
from .tokens import inside, windows_hash, word_hashes

# The masks; 1 marks a word that is hashed.
MASKS = ("110111", "1101000011", "11001011", "110100011", "1111000001")
FULL = 12
REACH = 64
CHUNK_CHARS = 1_000_000


def strip_word(word: str) -> str:
    """Letters and digits of a word; a word without any goes."""
    return word if word.isalnum() else "".join(c for c in word if c.isalnum())


def offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def seeds(h: np.ndarray, starts: np.ndarray, masks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, text, hash) of every seed; the mask's number is part of the hash."""
    found = []
    for mask in masks:
        at, text = inside(starts, len(mask))
        if len(at):
            found.append((at, text, windows_hash(h, offsets(mask))[at] ^ np.uint64((int("1" + mask, 2) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def short_masks(n: int) -> list[str]:
    """Masks over the whole of an item of n < FULL words: whichever quarter of the words is substituted, one marks no such word."""
    drop, parts = n // 4, n if n < 6 else 3 if n < 8 else 4
    return ["".join("01"[i * parts // n not in gone] for i in range(n)) for gone in combinations(range(parts), drop)]


def item_words(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item_id, item_words): the word hashes of every benchmark item, each different pair once."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in chunks(b["text"].str.len().to_numpy(), CHUNK_CHARS):
                h, starts = word_hashes(b["text"].tolist()[lo:hi], strip_word)
                yield pd.DataFrame({"item_id": b["id"].iloc[lo:hi].to_numpy(), "item_words": np.split(h.view(np.int64), starts[1:-1])})

    kind = items.schema[id].dataType.simpleString()
    return items.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).dropna().mapInPandas(of, f"item_id {kind}, item_words array<long>").distinct()


def own_masks(words: DataFrame, min_item: int) -> list[str]:
    """The fixed masks, and those of each length of short items present (at most eleven lengths)."""
    n = F.size("item_words").alias("n")
    found = words.select(n).where((F.col("n") >= min_item) & (F.col("n") < FULL)).distinct().collect()
    return [*MASKS, *(m for n in sorted(r.n for r in found) for m in short_masks(n))]


def item_seeds(words: DataFrame, masks: list[str], min_item: int) -> DataFrame:
    """(hash, item_id, item_at): the seeds of every benchmark item."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["item_words"].str.len().to_numpy()
            for lo, hi in chunks(n, CHUNK_CHARS // 10):
                starts = np.concatenate([[0], np.cumsum(n[lo:hi])])
                h = np.concatenate([np.zeros(0, np.int64), *b["item_words"].iloc[lo:hi]]).view(np.uint64)
                for i, mask in enumerate(masks):
                    at, item, value = seeds(h, starts, [mask])
                    keep = n[lo:hi][item] == len(mask) if i >= len(MASKS) else n[lo:hi][item] >= min_item  # masks behind the fixed ones are for items of just that length
                    at, item, value = at[keep], item[keep], value[keep]
                    yield pd.DataFrame({"hash": value.view(np.int64), "item_id": b["item_id"].iloc[lo:hi].to_numpy()[item], "item_at": (at - starts[item]).astype("int32")})

    kind = words.schema["item_id"].dataType.simpleString()
    return words.mapInPandas(of, f"hash long, item_id {kind}, item_at int")


def best_stretch(equal: np.ndarray, min_equal: float = 0.75) -> tuple[int, int]:
    """All of the overlay if ``min_equal`` of it are equal, else the stretch [a, b) with the largest sum of +1 for equal and -3 for other words; the first on ties."""
    if np.count_nonzero(equal) >= min_equal * len(equal):
        return 0, len(equal)
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -3))])
    low = np.minimum.accumulate(total)
    b = int(np.argmax(total - low))
    return int(np.argmin(total[: b + 1])), b


def find_overlaps(docs: DataFrame, items: DataFrame, min_words: int = 12, min_equal: float = 0.75, min_item: int = 5, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: (id, item_id, n_words, n_equal, doc_at, item_at), the largest overlap."""
    spark = docs.sparkSession
    words = stored(item_words(items, item_id, item_text), "benchmark-words")
    masks = own_masks(words, min_item)
    tests = stored(item_seeds(words, masks, min_item), "benchmark-seeds")
    bloom = spark.sparkContext.broadcast(bloom_filter(tests.select("hash").distinct()))

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, ids = b["text"].tolist(), b["id"].to_numpy()
            for lo, hi in chunks(np.array([len(t or "") for t in texts]), CHUNK_CHARS):
                h, starts = word_hashes(texts[lo:hi], strip_word)
                at, doc, value = (np.concatenate(x) for x in zip(*[(a[k], d[k], v[k]) for m in masks for a, d, v in [seeds(h, starts, [m])] for k in [passing(v, bloom.value)]], strict=True))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, doc, value = at[order], doc[order], value[order]
                new = np.ones(len(at), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > REACH)
                edges = np.flatnonzero(new).tolist() + [len(at)]
                signed, rows = h.view(np.int64), []
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    begin, end = starts[doc[a]], starts[doc[a] + 1]
                    low, high = max(begin, at[a] - REACH), min(end, at[z - 1] + REACH)
                    rows.append((ids[lo + doc[a]], int(low - begin), signed[low:high], (at[a:z] - low).astype(np.int32), value[a:z].view(np.int64)))
                yield pd.DataFrame(rows, columns=["id", "begin", "words", "ats", "hashes"])
            give_back()

    scanned = docs.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").mapInPandas(stretches, "id string, begin int, words array<long>, ats array<int>, hashes array<long>")
    # ids pass through pandas as strings: a column with nulls would become double there
    kept = stored(scanned.withColumn("part", F.monotonically_increasing_id()), "decontaminate")
    bloom.destroy()
    hits = (
        kept.select("part", F.inline(F.arrays_zip("ats", "hashes"))).join(tests.select(F.col("hash").alias("hashes"), "item_id", "item_at"), "hashes")
        .groupBy("part", "item_id").agg(F.collect_set(F.col("ats") - F.col("item_at")).alias("diagonals"))
    )
    pairs = hits.join(words, "item_id").join(kept.select("part", "id", "begin", "words"), "part")
    item_kind = items.schema[item_id].dataType.simpleString()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                for diagonal in sorted(r.diagonals):
                    lo, hi = max(0, diagonal), min(len(r.words), diagonal + len(r.item_words))
                    equal = r.words[lo:hi] == r.item_words[lo - diagonal : hi - diagonal]
                    if np.count_nonzero(equal) < min_equal * min(min_words, len(r.item_words)):
                        continue
                    a, z = best_stretch(equal, min_equal)
                    if z - a >= min(min_words, len(r.item_words)) and equal[a:z].mean() >= min_equal:
                        rows.append((r.id, r.item_id, z - a, int(equal[a:z].sum()), int(r.begin + lo + a), int(lo + a - diagonal)))
            yield pd.DataFrame(rows, columns=["id", "item_id", "n_words", "n_equal", "doc_at", "item_at"])

    found = pairs.select("id", "item_id", "begin", "diagonals", "words", "item_words").mapInPandas(verify, f"id string, item_id {item_kind}, n_words int, n_equal int, doc_at int, item_at int")
    best = F.max(F.struct("n_equal", "n_words", (-F.col("doc_at")).alias("d"), (-F.col("item_at")).alias("i"))).alias("best")
    return found.groupBy("id", "item_id").agg(best).select(F.col("id").cast(docs.schema[id].dataType).alias(id), F.col("item_id").alias(item_id), "best.n_words", "best.n_equal", (-F.col("best.d")).alias("doc_at"), (-F.col("best.i")).alias("item_at"))


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose text overlaps a benchmark item (rows without an id are judged by their null id)."""
    bad = find_overlaps(docs, items, id=id, **options).select(F.col(id).alias("__bad")).distinct()
    return docs.join(bad, docs[id].eqNullSafe(bad["__bad"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document against every benchmark item."""
    return find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
