"""Phrase collocations: frequent phrases whose words stand together more often than their parts would.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?]`` and line ends, and these into words at blanks and tabs.  All counts are per
language.  f(phrase) counts all contiguous occurrences inside pieces.  Candidates are phrases of 2 to 3 words with f >= ``least``;
a cut after the first k words scores floor(1000000 f^2 / (f(first part) f(rest))), and the lowest-scoring cut counts.
A candidate goes if some longer one around it has ``covered`` percent of its occurrences at least.

Multikey three-way quicksort of suffix pointers, to a depth of three words:

1. Words are counted first; a Bloom filter of fixed size knows those with ``least`` occurrences.  No phrase of a rarer word can
   be frequent, so pieces are cut there as well.  A word is a 64-bit hash of language and word from then on.
2. Each task makes the suffixes of its pieces (up to three words), adds up equal ones in portions of ``portion`` and deals
   them by their two leading words into routes, packed as blocks with a dictionary of their own.  Many routes are reached in
   levels of ``fan``.  Pairs with a thousandth of a bounded sample's suffixes are dealt by the third word too.
3. In a route, all suffixes that share two leading words are together.  The pointers are split in three by a pivot word at the
   present depth: smaller, equal, larger.  The weight of an equal partition is the count of its prefix; the next word
   is looked at inside it only.  Any partition that weighs less than ``least`` is abandoned, sorted or not.
   All partitions of a round are split together, in numpy.
4. Counts meet in joins; of each language the first ``top`` are returned.

Results are exact but for collisions of the 64-bit hashes.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; ties go to the
larger f, then to the phrase that is first in UTF-8 byte order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bloom import bloom_filter, passing
from .common import LOWER, UPPER, discard, give_back, mixed, shuffle_partitions, stored, table
from .tokens import BASE, BYTES, hash_strings, powers

PIECE_END, WORD_END = re.compile(rb"[.,;:!?\x0A-\x0D]"), re.compile(rb"[ \t.,;:!?\x0A-\x0D]")
TWO_WORDS = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\x0A-\x0D]+){0,2}")
_KIND = np.zeros(256, np.uint8)  # 1: ends words, 2: ends pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
BLOCK, DEPTH = 1_000_000, 3


def blocks_of(texts: list[str | None], langs: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """(bytes, starts, languages' hashes, own) of about BLOCK bytes: several texts, or a part of a long one.

    A part ends with a piece, or, where a piece is longer than BLOCK, between words; the two words behind such a cut come along as context: words
    that begin at ``own`` or later belong to the next part.
    """
    salts = dict(zip(set(langs), hash_strings(list(set(langs))), strict=True))
    held, starts, own, size = [], [], [], 0

    def block():
        return b"\n".join(held) + b"\n", np.array(starts), np.array(own, np.uint64), size

    for text, lang in zip(texts, langs, strict=True):
        data = (text or "").encode().lower()
        at = 0
        while at < len(data):
            long = len(data) - at > BLOCK
            end = PIECE_END.search(data, at + BLOCK, at + 2 * BLOCK) if long else None
            word = WORD_END.search(data, at + BLOCK) if long and not end else None
            if word:
                part, ahead = data[at : word.start()], TWO_WORDS.match(data, word.start())[0]
                yield part + ahead + b"\n", np.zeros(1, np.int64), np.array([salts[lang]], np.uint64), len(part)
                at += len(part)
                continue
            part = data[at : end.end() if end else len(data)]
            at += len(part)
            held.append(part), starts.append(size), own.append(salts[lang])
            size += len(part) + 1
            if size >= BLOCK:
                yield block()
                held, starts, own, size = [], [], [], 0
    if held:
        yield block()


def words_of(data: bytes, starts: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, its hash with its language, and whether the next word follows in the same piece."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    edge = np.flatnonzero(np.diff(kind > 0, prepend=True))
    begin, end = edge[::2], edge[1::2]
    power, inverse = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTES[raw] * power[: len(raw)], out=total[1:])
    h = mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    h = mixed(h ^ salts[np.searchsorted(starts, begin, "right") - 1])
    ends = np.cumsum(kind == 2, dtype=np.int32)
    follows = np.zeros(len(begin), bool)
    follows[:-1] = ends[begin[1:]] == ends[end[:-1] - 1]
    return begin, end, np.where(h == 0, np.uint64(1), h), follows


def lists(batch: pa.RecordBatch) -> tuple[list[str | None], list[str]]:
    return batch["text"].to_pylist(), batch["lang"].to_pylist()


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """(word hash, lang, word, n) of the words with ``least`` occurrences in their language, and of the empty word, which has those of all words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = {int(h): name for name in b["lang"].unique().to_pylist() for h in hash_strings([name])}
            for data, starts, salts, own in blocks_of(*lists(b)):
                begin, end, h, _ = words_of(data, starts, salts)
                n = np.searchsorted(begin, own)
                begin, end, h = begin[:n], end[:n], h[:n]
                lang = salts[np.searchsorted(starts, begin, "right") - 1]
                value, first, n = np.unique(h, return_index=True, return_counts=True)
                owner = [names[x] for x in lang[first].tolist()]
                words = [data[lo:hi] for lo, hi in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
                all_langs, all_n = np.unique(lang, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "h": np.concatenate([value, all_langs]).view(np.int64), "lang": [*owner, *(names[x] for x in all_langs.tolist())],
                    "word": pa.array([*words, *[b""] * len(all_langs)], pa.binary()).cast(pa.string()), "n": np.concatenate([n, all_n]),
                })
            give_back()

    return docs.mapInArrow(of, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("word") == ""))


def suffixes(bloom, take: Callable):
    """A function for mapInArrow: ``take`` makes an object that is given, block by block, the suffixes of two or three frequent words (0: none)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = take()
        for b in batches:
            for *block, own in blocks_of(*lists(b)):
                begin, _, h, follows = words_of(*block)
                frequent = np.zeros(len(h) + 2, bool)
                frequent[passing(h, bloom.value)] = True
                two = follows & frequent[:-2] & frequent[1:-1]
                at = np.flatnonzero(two & (begin < own))
                h, two = np.append(h, np.zeros(2, np.uint64)), np.append(two, False)
                third = np.where(two[at + 1], h[at + 2], np.uint64(0))
                yield from taken.add(np.stack([h[at], h[at + 1], third]), np.ones(len(at), np.int64))
            give_back()
        yield from taken.rest()

    return of


def pair_hash(words: np.ndarray) -> np.ndarray:
    return mixed(words[0] * BASE + words[1])


class Routed:
    """Suffixes with weights, added up in portions and packed into a block for each of at most ``fan`` routes."""

    def __init__(self, portion: int, routes: int, fan: int, hot: np.ndarray):
        self.portion, self.routes, self.fan, self.hot = portion, routes, fan, hot
        self.held, self.size = [], 0

    def add(self, words: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((words, weight))
        self.size += len(weight)
        if self.size >= self.portion:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.size = self.held, [], 0
        if not sum(len(w) for _, w in held):
            return
        words, weight = (np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
        del held
        words, weight = added(words, weight)
        pair = pair_hash(words)
        deal = np.where(np.isin(pair, self.hot), mixed(pair * BASE + words[2]), pair) if len(self.hot) else pair
        route = (deal % np.uint64(self.routes)).astype(np.int64)
        near = route % self.fan
        order = np.argsort(near, kind="stable")
        words, weight, near = words[:, order], weight[order], near[order]
        starts = np.flatnonzero(np.diff(near, prepend=-1))
        packs = []
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(near)], strict=True):
            order = np.lexsort(words[::-1, lo:hi])  # suffixes in order pack better
            packs.append(pack(words[:, lo:hi][:, order], weight[lo:hi][order]))
        yield pa.RecordBatch.from_pydict({"route": near[starts], "block": pa.array(packs, pa.binary())})


def added(words: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal suffixes added up, in the order of one hash, which takes about half the memory of sorting by words.

    Neighbours are compared word by word; equal suffixes that others of the same hash part stay two, which are added up later.
    """
    order = np.argsort(mixed(pair_hash(words) * BASE + words[2]))
    words, weight = words[:, order], weight[order]
    del order
    first = np.append(True, words[0, 1:] != words[0, :-1])
    for row in words[1:]:
        first[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(first)
    return words[:, first], np.add.reduceat(weight, first)


def pack(words: np.ndarray, weight: np.ndarray) -> bytes:
    """Suffixes as bytes: their different words, then indices, then weights."""
    ids, at = np.unique(words, return_inverse=True)
    kind = np.uint16 if len(ids) < 1 << 16 else np.uint32
    small = weight.max(initial=0) < 1 << 8
    body = at.reshape(-1).astype(kind).tobytes() + weight.astype(np.uint8 if small else np.int64).tobytes()
    head = np.array([len(ids), len(weight), np.dtype(kind).itemsize, 1 if small else 8], np.int64)
    return head.tobytes() + ids.tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n_ids, n, width, weighs = np.frombuffer(block, np.int64, 4).tolist()
    ids = np.frombuffer(block, np.uint64, n_ids, 32)
    body = pa.decompress(block[32 + 8 * n_ids :], decompressed_size=n * (3 * width + weighs), codec="zstd", asbytes=True)
    at = np.frombuffer(body, np.uint16 if width == 2 else np.uint32, 3 * n).reshape(3, n)
    return ids[at], np.frombuffer(body, np.uint8 if weighs == 1 else np.int64, n, 3 * n * width).astype(np.int64)


def multikey_counts(words: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, counts): prefixes of depth + 1 words that weigh ``least`` or more, each shown by a pointer to one of its suffixes.

    Multikey three-way quicksort of the pointers, with all partitions of a round split at once.  A partition of less than
    ``least`` is abandoned.  A word of 0 ends a suffix.
    """
    pointer = np.arange(len(weight))
    begin, depth = np.zeros(min(1, len(weight)), np.int64), np.zeros(min(1, len(weight)), np.int64)
    while len(begin):
        size = np.diff(np.append(begin, len(pointer)))
        part = np.repeat(np.arange(len(begin)), size)
        own = words[depth[part], pointer]
        # the pivot is the middle one of three
        three = np.sort(own[np.stack([begin, begin + size // 2, begin + size - 1])], axis=0)
        pivot = three[1]
        side = (own > pivot[part]).astype(np.int64) + (own >= pivot[part])
        slot = 3 * part + side
        order = np.argsort(slot, kind="stable")
        pointer, slot = pointer[order], slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        heavy = np.add.reduceat(weight[pointer], first)
        kind = slot[first]
        level, equal = depth[kind // 3], kind % 3 == 1
        known = equal & (heavy >= least) & (pivot[kind // 3] != 0)
        for d in range(DEPTH):
            some = known & (level == d)
            if some.any():
                yield d, pointer[first[some]], heavy[some]
        on = np.where(equal, known & (level + 1 < DEPTH), heavy >= least)
        size = np.diff(np.append(first, len(pointer)))
        pointer = pointer[np.repeat(on, size)]
        begin = np.concatenate([[0], np.cumsum(size[on])])[:-1] if on.any() else np.zeros(0, np.int64)
        depth = (level + equal)[on]


def phrase_counts(docs: DataFrame, words: DataFrame, least: int, routes: int, portion: int, fan: int, sample: int) -> DataFrame:
    """(a, b, c, n), stored: the frequent phrases as hashes of words, c null for pairs; pairs may have several rows to be added up."""
    spark = docs.sparkSession
    bloom = spark.sparkContext.broadcast(bloom_filter(words.where("word <> ''").select(F.col("h").alias("hash"))))
    hot = frequent_pairs(docs, bloom, sample)

    def split(step: int):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            taken = Routed(portion, routes, step, hot)
            for b in batches:
                for block in b["block"]:
                    yield from taken.add(*unpack(block.as_py()))
            yield from taken.rest()

        return of

    step = min(fan, routes)
    blocks = docs.mapInArrow(suffixes(bloom, lambda n=step: Routed(portion, routes, n, hot)), "route long, block binary")
    while step < routes:
        step = min(step * fan, routes)
        blocks = blocks.repartition("route").mapInArrow(split(step), "route long, block binary")

    def counted(group: pa.Table) -> pa.Table:
        own, weight = (np.concatenate(c, axis=-1) for c in zip(*[unpack(x.as_py()) for x in group["block"]], strict=True))
        out = [np.zeros((4, 0), np.int64)]
        spread = np.isin(pair_hash(own), hot)
        if spread.any():  # pairs dealt by their third word: what this route has of them
            pair, first, at = np.unique(pair_hash(own[:, spread]), return_index=True, return_inverse=True)
            n = np.bincount(at, weight[spread]).astype(np.int64)
            out.append(np.stack([*own[:2, spread][:, first].view(np.int64), np.zeros(len(n), np.int64), n]))
        for depth, pointer, n in multikey_counts(own, weight, least):
            if depth:
                keep = np.ones(len(n), bool) if depth > 1 else ~spread[pointer]
                a, b, c = own[:, pointer[keep]].view(np.int64)
                out.append(np.stack([a, b, c if depth > 1 else np.zeros_like(c), n[keep]]))
        a, b, c, n = np.concatenate(out, axis=1)
        give_back()
        return pa.table({"a": a, "b": b, "c": pa.array(c, mask=c == 0), "n": n})

    found = stored(blocks.groupBy("route").applyInArrow(counted, "a long, b long, c long, n long"), "phrases")
    bloom.destroy()
    return found


def frequent_pairs(docs: DataFrame, bloom, sample: int) -> np.ndarray:
    """Hashes of the pairs that lead a thousandth of the suffixes in about ``sample`` documents: a thousand at most. It serves the dealing only."""
    part = max(1, docs.count() // sample)

    class Leading:
        def add(self, words, _):
            pair, n = np.unique(pair_hash(words), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pair.view(np.int64), "n": n})

        def rest(self):
            return iter(())

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    counts = some.mapInArrow(suffixes(bloom, Leading), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.array([r.pair for r in counts.where(F.col("n") * 1000 >= max(total, 1000)).collect()], np.int64).view(np.uint64)


def score(f: str, left: str, right: str) -> Column:
    """floor(1000000 f^2 / (left right)), exact."""
    wide = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    return F.expr(f"(CAST({wide(f)} * {wide(f)} AS DECIMAL(32, 0)) * 1000000BD) div CAST({wide(left)} * {wide(right)} AS DECIMAL(32, 0))")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, top: int = 2_000, routes: int | None = None, portion: int = BLOCK, fan: int = 1_024, sample: int = 2_000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first ``top`` candidates that stay."""
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang")).where("text <> ''")
    words = stored(word_counts(rows, least), "words")
    found = phrase_counts(rows, words, least, routes or 4 * shuffle_partitions(docs.sparkSession), portion, fan, sample)
    known = words.where("word <> ''").select("h", "lang", "word", "n")
    first, second = (known.select(F.col("h").alias(h), F.col("word").alias(f"word_{h}"), F.col("n").alias(f"n_{h}"), *(["lang"] if h == "a" else [])) for h in ("a", "b"))
    summed = stored(found.where("c IS NULL").groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "pairs")
    pairs = stored(summed.join(first, "a").join(second, "b"), "pairs")
    triples = found.where("c IS NOT NULL").select("a", "b", "c", F.col("n").alias("f"))

    around = triples.select(F.inline(F.array(F.struct("a", "b", "f"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), "f")))).groupBy("a", "b").agg(F.max("f").alias("longer"))
    alone = pairs.join(around, ["a", "b"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    two = alone.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r"), score("f", "n_a", "n_b").alias("score"))

    ahead = pairs.select("a", "b", "lang", "word_a", "word_b", F.col("f").alias("f_ab"), "n_a")
    behind = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("word_b").alias("word_c"), F.col("f").alias("f_bc"), F.col("n_b").alias("n_c"))
    whole = triples.join(ahead, ["a", "b"]).join(behind, ["b", "c"]).withColumn("one", score("f", "n_a", "f_bc")).withColumn("two", score("f", "f_ab", "n_c"))
    early = F.col("one") <= F.col("two")
    three = whole.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f").alias("a"),
        F.when(early, F.col("n_a")).otherwise(F.col("f_ab")).alias("l"), F.when(early, F.col("f_bc")).otherwise(F.col("n_c")).alias("r"), F.least("one", "two").alias("score"),
    )

    # the first of each part of a language, then the first of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    parted = two.unionByName(three).withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    out = stored(ranked.join(words.where("word = ''").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "ranked")
    discard(words, found, summed, pairs)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
phrases AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM places, range(1, 4) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, p, count(*) AS n FROM phrases GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, k, p, n AS a, string_split(p, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.p, c.a, x.k AS cut, x.n AS l, y.n AS r, CAST(1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n) AS BIGINT) AS score FROM candidates c
  JOIN f x ON x.lang = c.lang AND x.k < c.k AND x.p = array_to_string(c.w[:x.k], ' ') JOIN f y ON y.lang = c.lang AND y.k = c.k - x.k AND y.p = array_to_string(c.w[x.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
around AS (SELECT lang, p, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS p, a FROM candidates WHERE k = 3) GROUP BY lang, p),
kept AS (SELECT l.* FROM lowest l LEFT JOIN around o ON o.lang = l.lang AND o.p = l.p AND l.k = 2 WHERE o.longer IS NULL OR 100 * o.longer < 50 * l.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""
