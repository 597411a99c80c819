"""Spelling variants: words one edit apart, grouped under the form that is much more frequent.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of whole texts, A-Z lower-cased.  A fixed rule plants slips of
the pen, so that there are variants to find: if ``every`` divides the crc32 of ``<id>:<run>``, the run loses one code point.
Kept are words of ``least_length`` code points that occur ``least_count`` times.  Two of them are near if they differ by one
inserted, deleted or replaced code point.  A word's form is its most frequent near word if that occurs ``ratio`` times as often.

K-d trees over letter-count vectors: one edit changes the counts by an L1 distance of 2 at most (1 if the lengths differ).
For each length a tree is fitted to a bounded sample of the words (``sample``, all lengths together); its leaves are cells
of about ``cell`` words.  Each word lies in one cell of its length and is sent as a query to the cells of its own
length, the next shorter and the next longer one whose boxes it can reach; that is one range search for each pair of
lengths.  A cell is one group of a task, which builds a tree of its own over the cell's words, prunes by boxes again and
verifies the order of the letters of what is left.  Cells that hold far more words than planned (those of equal letter counts,
which no tree can split) are dealt into blocks of words times blocks of queries.  Tasks return a count and the best
near word of each query, so pairs are never written.

Counting runs in Spark expressions and is summed before its shuffle.  Counts of letters that are no a-z share six
dimensions, which makes distances smaller, so it prunes less and loses nothing.

Defined results: null and empty texts have no words; a null id counts as an empty one; rows that repeat an id or a text count
each; ties of equal counts go to the word that is first in code-point order; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded_sample, discard, lower_ascii, stored, table

RUN = "[A-Za-zÀ-ÿ]+"
DIMS, LEAF, PAIRS = 32, 24, 1 << 22
_LETTER = np.where((np.arange(256) >= 97) & (np.arange(256) <= 122), np.arange(256) - 97, 26 + np.arange(256) % (DIMS - 26))


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of DIMS counts for each word."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * DIMS + _LETTER[letters], minlength=len(words) * DIMS)
    return np.minimum(counts, 30_000).astype(np.int16).reshape(-1, DIMS)


class KdTree:
    """A k-d tree over count vectors: at an inner node the rows with ``x[dim] <= cut`` go left; node < 0 is leaf -node - 1."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.dim, self.cut, self.kids, self.rows = [], [], [], []
        self.root = self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        own = points[rows]
        wide = np.ptp(own, axis=0) if len(rows) > leaf else np.zeros(1)
        if not wide.any():
            self.rows.append(rows)
            return -len(self.rows)
        dim = int(np.argmax(own.var(axis=0)))
        cut = min(int(np.median(own[:, dim])), int(own[:, dim].max()) - 1)
        left, at = own[:, dim] <= cut, len(self.dim)
        self.dim.append(dim), self.cut.append(cut), self.kids.append(None)
        self.kids[at] = (self._grow(points, rows[left], leaf), self._grow(points, rows[~left], leaf))
        return at

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The leaf in which each row lies."""
        out = np.zeros(len(x), np.int64)
        for at, leaf in self.search(x, -1):
            out[at] = leaf
        return out

    def search(self, x: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """(rows of x, leaf) for every leaf whose box is at an L1 distance of ``radius`` at most; radius -1: the leaf that holds the row."""
        far = np.zeros(len(x), np.int64)
        open_box = (np.full(DIMS, -1 << 40, np.int64), np.full(DIMS, 1 << 40, np.int64))
        stack = [(self.root, np.arange(len(x)), far, *open_box)]
        while stack:
            node, rows, far, low, high = stack.pop()
            if node < 0:
                yield rows, -node - 1
                continue
            dim, cut = self.dim[node], self.cut[node]
            v = x[rows, dim].astype(np.int64)
            before = np.maximum(0, np.maximum(low[dim] - v, v - high[dim]))
            for kid, lo, hi in ((self.kids[node][0], low[dim], cut), (self.kids[node][1], cut + 1, high[dim])):
                gone = far - before + np.maximum(0, np.maximum(lo - v, v - hi))
                near = gone <= max(radius, 0)
                if near.any():
                    bounds = low.copy(), high.copy()
                    bounds[0][dim], bounds[1][dim] = lo, hi
                    stack.append((kid, rows[near], gone[near], *bounds))


def one_edit(long: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of letters differ by one replaced letter or, if ``long`` has one column more, by one inserted."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (long != short).sum(axis=1) == 1
    head = np.logical_and.accumulate(long[:, :n] == short, axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((long[:, 1:] == short)[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def letters(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def near_words(words: list[str], counts: np.ndarray, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each query the number of ``words`` (all of one length) near to it, and the index of the most frequent one (-1 if none)."""
    length = len(words[0])
    points = letter_counts(words)
    tree = KdTree(points, LEAF)
    own = letters(words, length)
    order = np.lexsort((np.array(words, dtype=object), -counts))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    found, best = np.zeros(len(queries), np.int64), np.full(len(queries), len(words), np.int64)
    for size in (length - 1, length, length + 1):
        asked = np.flatnonzero([len(q) == size for q in queries])
        if not len(asked):
            continue
        some = [queries[i] for i in asked]
        x, other, radius = letter_counts(some), letters(some, size), 2 if size == length else 1
        for rows, leaf in tree.search(x, radius):
            here = tree.rows[leaf]
            step = max(1, PAIRS // (len(here) * (length + DIMS)))
            for lo in range(0, len(rows), step):
                q = rows[lo : lo + step]
                apart = np.abs(x[q][:, None, :] - points[here][None, :, :]).sum(axis=2)
                i, j = np.nonzero(apart <= radius)
                i, j = q[i], here[j]
                a, b = other[i], own[j]
                ok = one_edit(a, b) if size >= length else one_edit(b, a)
                i, j = asked[i[ok]], j[ok]
                np.add.at(found, i, 1)
                np.minimum.at(best, i, rank[j])
    return found, np.where(found > 0, order[np.minimum(best, len(words) - 1)], -1)


def word_counts(docs: DataFrame, id: str, text: str, every: int, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of the words kept."""
    runs = docs.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(RUN), F.lit(0))).alias("run"))
    long = runs.where(F.length("run") >= least_length).select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = long.select(F.when(h % every == 0, slip).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def fitted(vocabulary: DataFrame, sample: int, cell: int) -> dict[int, KdTree]:
    """For each length in a bounded sample of the words a tree with leaves for about ``cell`` words of the vocabulary each."""
    total = vocabulary.count()
    drawn = bounded_sample(vocabulary.select("word"), sample)["word"].to_pylist()
    by: dict[int, list[str]] = {}
    for w in sorted(drawn):
        by.setdefault(len(w), []).append(w)
    out = {}
    for length, words in by.items():
        out[length] = KdTree(letter_counts(words), max(1, int(cell * len(drawn) / max(1, total))))
        out[length].rows = None  # only the cuts are sent to the tasks
    return out


def near_counts(vocabulary: DataFrame, sample: int = 32_768, cell: int = 2_000) -> DataFrame:
    """(word, n_near, best: struct of minus n and word) of every word of the stored table ``vocabulary`` that has near words."""
    spark = vocabulary.sparkSession
    trees = spark.sparkContext.broadcast(fitted(vocabulary, sample, cell))

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["word"].str.len()
            yield pd.DataFrame({"length": sizes, "cell": 0}) if not len(b) else pd.concat(
                [pd.DataFrame({"length": n, "cell": trees.value[n].cells(letter_counts(list(own)))} if n in trees.value else {"length": [n] * len(own), "cell": 0}) for n, own in b["word"].groupby(sizes)]
            )

    # cells far over the plan, as (length, cell) to blocks; there are no more cells than words in the sample, and lengths outside it
    full = vocabulary.mapInPandas(cells_of, "length int, cell int").groupBy("length", "cell").count().where(F.col("count") > 8 * cell)
    blocks = spark.sparkContext.broadcast({(r["length"], r["cell"]): -(-r["count"] // (8 * cell)) for r in full.collect()})

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every word once as a word of its cell (with its count) and once for each cell it searches (n = -1)."""
        for b in batches:
            for size, own in b.groupby(b["word"].str.len()):
                words, n = own["word"].to_numpy(dtype=object), own["n"].to_numpy()
                x, salt = letter_counts(list(words)), pd.util.hash_array(words, categorize=False)
                sent: list[tuple] = []
                for length, radius in ((size, -1), (size - 1, 1), (size, 2), (size + 1, 1)):
                    reached = trees.value[length].search(x, radius) if length in trees.value else [(np.arange(len(words)), 0)]
                    for rows, cell in reached:
                        many = blocks.value.get((length, cell), 1)
                        side = (salt[rows] % np.uint64(many)).astype(np.int64)
                        for k in range(many):  # words meet all blocks of queries and queries all blocks of words
                            part = side * many + k if radius < 0 else k * many + side
                            sent.append((rows, np.full(len(rows), length), np.full(len(rows), cell), part, np.where(radius < 0, n[rows], -1)))
                rows, length, cell, part, count = (np.concatenate(c) for c in zip(*sent, strict=True))
                yield pd.DataFrame({"length": length, "cell": cell, "part": part, "word": pd.Series(words[rows], dtype=object), "n": count})

    def searched(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        members, asked = group[group["n"] >= 0], group[group["n"] < 0]["word"].tolist()
        words, n = members["word"].tolist(), members["n"].to_numpy(np.int64)
        found, best = near_words(words, n, asked) if words else (np.zeros(len(asked), np.int64),) * 2
        some = np.flatnonzero(found)
        return pd.DataFrame({"word": pd.Series([asked[i] for i in some], dtype=object), "n_near": found[some], "best_n": n[best[some]], "best": pd.Series([words[i] for i in best[some]], dtype=object)})

    spread = vocabulary.mapInPandas(routed, "length int, cell int, part int, word string, n long")
    found = spread.groupBy("length", "cell", "part").applyInPandas(searched, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form on the way from each (word, form), by doubling the steps; counts grow by ``ratio`` with each step, so ways are short."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("moved")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(at)
        at = further
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", every: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word kept."""
    vocabulary = stored(word_counts(docs, id, text, every, least_length, least_count), "vocabulary")
    near = near_counts(vocabulary, **options)
    joined = vocabulary.join(near, "word", "left")
    form = -F.col("best.n") >= ratio * F.col("n")
    judged = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n")), "judged"
    )
    discard(vocabulary)
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every word of the documents."""
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
bytes AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, c, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i+1] AS BIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM runs, bytes),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
vocabulary AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
holes AS (SELECT word, n, i, word[:i - 1] AS head, word[i + 1:] AS tail FROM places),
shorter AS (SELECT DISTINCT word, n, head || tail AS less FROM holes),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON v.word = s.less
  UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON v.word = s.less),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, other)) AS form FROM near GROUP BY word),
judged AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
ways(word, here, step) AS (SELECT word, word, 0 FROM judged UNION ALL SELECT w.word, j.form, step + 1 FROM ways w JOIN judged j ON w.here = j.word WHERE j.form IS NOT NULL)
SELECT j.word, j.form, arg_max(w.here, w.step) AS root, j.n, j.n_near, j.form_n FROM judged j JOIN ways w USING (word) GROUP BY ALL
"""
