"""Language identification by Bayesian fusion of four kinds of evidence.

* text: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of labelled rows (about ``sample``
  rows, shared evenly among the ``languages`` most frequent labels of all rows; in each label those with the smallest
  hashes).  The likelihood is tempered, as trigrams overlap.  A background that finds all trigrams equally likely
  competes with the languages, with the prior ``UNKNOWN``: a text that no language explains better has none
* markup: the language the page or row declares, with the reliability that declarations show against
  the text model over all rows
* address suffix: what the host's last label says of the language, counted over all rows
* host: a prior for every host, smoothed towards its domain, that towards its suffix, that towards
  the whole table, counted over all rows by grouped aggregation

With log-likelihoods per language, the posterior is the softmax of text + markup + suffix and host prior.  The
counts behind the priors are sums of the text model's posteriors, grouped before they are shuffled, so a hot host costs
one row a task.  Trigrams are counted inside the tasks; the driver gets one array a language.

The text model reads every row once; rows and likelihoods go to a table in the shared folder.  The hosts' priors are joined to
it by broadcast if they are known to be small (their rows are counted), else by key after each host's rows are dealt over
``SALTS`` keys, so a host with a third of all rows is not one task's work.

A row is rejected (``keep`` false) if its text has no letter, if the background explains it better, if the fused posterior is under
``least``, or if another language than a declared one of the model's has ``firm`` or more.

Defined results: null, empty and letterless texts, and texts in none of the model's languages, have a null language and are
rejected (the first three with confidence 0); a null or unknown declaration and a null host are no evidence; repeated rows
are treated alike; rows and other columns stay, but a column named as a result is replaced by it; an empty table gives an
empty result; a sample without labels gives null languages throughout.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, give_back, lower_ascii, packed, stored, table
from .url_filter import url_host

CELLS, PSEUDO, TEMPER, STRENGTH, UNKNOWN = 1 << 18, 0.01, 60.0, 8.0, 0.001
SPARE = 16  # rows above its share that a label may give, so that a small one is not missed by chance
BLOCKS, SMALL_ROWS, SALTS = 16, 50_000, 64
CHUNK_CHARS = 1_000_000
OPENING, TAG = re.compile(r"(?i)<(script|style)\b"), re.compile(r"<[^>]*>")
CLOSING = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>")}


def without_tags(html: str) -> str:
    """Text of a page; in one sweep, as what is never closed is not looked for twice."""
    parts, at, open_ended = [], 0, set()
    for m in OPENING.finditer(html):
        kind = m[1].lower()
        if m.start() < at or kind in open_ended:
            continue
        end = CLOSING[kind].search(html, m.end())
        if not end:
            open_ended.add(kind)
            continue
        parts.append(html[at : m.start()])
        at = end.end()
    html = " ".join([*parts, html[at:]])
    last = html.rfind(">") + 1
    return TAG.sub(" ", html[:last]) + html[last:]


def trigram_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the byte trigrams of all texts (lower-cased, runs without letters as one blank), and where each text begins."""
    # each text stands between a blank and zeros, at which no trigram begins, so none depends on its neighbours
    coded = [(" " + t.lower() + " \0\0").encode() for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint32)
    data = np.where((data != 0) & ((data < 97) | ((data > 122) & (data < 128))), 32, data)
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    starts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum([len(c) for c in coded])])]
    data = data[keep]
    data = np.concatenate([data, np.full(2, 32, data.dtype)])
    n = starts[-1]
    key = (data[:n] * np.uint32(0x9E3779B1)) ^ (data[1 : n + 1] * np.uint32(0x85EBCA77)) ^ (data[2 : n + 2] * np.uint32(0xC2B2AE3D))
    cells = ((key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(14)).astype(np.int64)
    begins = data[:n] != 0
    return cells[begins], np.concatenate([[0], np.cumsum(begins)])[starts]


class TextModel:
    """Log-likelihoods of trigram cells by language; the last column of what it returns is the background's."""

    def __init__(self, languages: list[str], log: np.ndarray):
        self.languages, self.log = languages, log

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """A row of tempered log-likelihoods for each text."""
        out = np.zeros((len(texts), len(self.languages) + 1))
        for lo, hi in chunks(np.array([len(t) for t in texts]), CHUNK_CHARS):
            cells, starts = trigram_cells(texts[lo:hi])
            n = np.diff(starts)
            for j in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(self.log[j][cells], dtype=np.float64)])
                out[lo:hi, j] = (total[starts[1:]] - total[starts[:-1]]) / np.maximum(n, 1) * np.minimum(n, TEMPER)
            out[lo:hi, -1] = -np.log(CELLS) * np.minimum(n, TEMPER)
        return out - out.max(axis=1, keepdims=True)


def fit_text_model(labelled: DataFrame, text: str, label: str, sample: int = 4_000, languages: int = 256) -> TextModel:
    """From about ``sample`` different labelled rows, an even share and SPARE more for each of the ``languages`` most frequent labels of all rows.

    The cut by hashes is set by the number of different texts of a label, so one with few texts keeps them all.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label")).dropna().where("text <> '' AND label <> ''")
    sizes = rows.groupBy("label").agg(F.count("*").alias("count"), F.approx_count_distinct("text").alias("texts")).orderBy(F.desc("count"), "label").limit(languages).collect()
    if not sizes:
        return TextModel([], np.zeros((0, CELLS), np.float32))
    known, share = F.array(*[F.lit(r.label) for r in sizes]), sample // len(sizes) + SPARE
    cuts = F.array(*[F.lit(min(1 << 32, (1 << 32) * share // max(1, r["texts"]) + 1)) for r in sizes])
    number = F.array_position(known, F.col("label")).cast("int")
    drawn = rows.where(F.col("label").isin([r.label for r in sizes])).withColumn("label", number)
    drawn = drawn.where(F.pmod(F.xxhash64("text", "label"), F.lit(1 << 32)) < F.get(cuts, F.col("label") - 1)).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b["label"].to_numpy()
            for lo, hi in chunks(pc.utf8_length(b["text"]).to_numpy(), CHUNK_CHARS):
                cells, starts = trigram_cells(b["text"].slice(lo, hi - lo).to_pylist())
                of, found = np.repeat(labels[lo:hi], np.diff(starts)), []
                for k in np.unique(labels[lo:hi]):
                    blocks = np.split(np.bincount(cells[of == k], minlength=CELLS).astype(np.uint32), BLOCKS)
                    found += [(k, i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(blocks)]
                k, i, x = zip(*found, strict=True)
                yield pa.RecordBatch.from_pydict({"label": pa.array(k, pa.int32()), "block": pa.array(i, pa.int32()), "cells": pa.array(x, pa.binary())})
            give_back()

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c.as_py()), np.uint32).astype(np.uint64) for c in group["cells"])
        return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)], pa.binary())})

    kind = "label int, block int, cells binary"
    counted = drawn.mapInArrow(count, kind).groupBy("label", "block").applyInArrow(add, kind).toArrow()
    log = np.full((len(sizes), BLOCKS, CELLS // BLOCKS), PSEUDO, np.float32)
    for k, i, x in zip(counted["label"].to_pylist(), counted["block"].to_pylist(), counted["cells"], strict=True):
        log[k - 1, i] += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
    order = sorted({k - 1 for k in counted["label"].to_pylist()}, key=lambda k: sizes[k].label)
    log = log.reshape(len(sizes), CELLS)[order]
    return TextModel([sizes[k].label for k in order], np.log(log / log.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    return F.aggregate(F.array(raised), F.array().cast("array<double>"), lambda _, r: F.transform(r, lambda x: x / F.aggregate(r, F.lit(0.0), lambda a, b: a + b)))


def sums(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """By key, the sum of each component of the array ``p`` as an array ``s``."""
    return df.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)) for i in range(n)]).alias("s"))


def smoothed(own: Column, parent: Column) -> Column:
    """Counts over a parent's distribution: (count + STRENGTH parent) / (n + STRENGTH)."""
    total = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(own, parent, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))


def identify(
    rows: DataFrame, model: TextModel, text: str = "text", declared: str | None = None, host: str | None = None, markup: bool = False,
    least: float = 0.5, firm: float = 0.999, prefix: str = "",
) -> DataFrame:
    """``rows`` with language, confidence, declared_language and keep (names behind ``prefix``).

    ``declared`` and ``host`` name columns; with ``markup`` the text is HTML whose tags are left out.
    """
    languages, n = model.languages, len(model.languages)
    results = [f"{prefix}{c}" for c in ("language", "confidence", "declared_language", "keep")]
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("ll array<double>, letters boolean")
    def read(texts: pa.Array) -> pa.Array:
        found, letters = [np.zeros((0, n + 1))], []
        for lo, hi in chunks(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), CHUNK_CHARS):  # only a chunk's strings are held
            values = [without_tags(t) if markup and t else (t or "") for t in texts.slice(lo, hi - lo).to_pylist()]
            found.append(sent.value.likelihoods(values))
            letters.extend(any(map(str.isalpha, t)) for t in values)
        give_back()
        ends = pa.array(np.arange(len(texts) + 1) * (n + 1), pa.int32())
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, np.concatenate(found).ravel()), pa.array(letters, pa.bool_())], ["ll", "letters"])

    null = F.lit(None).cast("string")
    host_of = F.nullif(lower_ascii(F.col(f"`{host}`")), F.lit("")) if host else null
    saying = lower_ascii(F.regexp_extract(F.col(f"`{declared}`"), "^[A-Za-z]+", 0)) if declared else null
    evidence = rows.select(packed(rows), read(F.col(f"`{text}`")).alias("read"), host_of.alias("host"), saying.alias("declared"))
    evidence = evidence.select("row", F.col("read.ll").alias("ll"), F.col("read.letters").alias("letters"), "host", F.when(F.col("declared").isin(languages), F.col("declared")).alias("declared"))
    evidence = stored(evidence, "language-evidence")
    others = [F.col(f"row.`{c}`") for c in rows.columns if c not in results]
    if n == 0:
        return evidence.select(*others, null.alias(results[0]), F.lit(0.0).alias(results[1]), F.col("declared").alias(results[2]), F.lit(False).alias(results[3]))

    # one small row a row: what the counts need; the grouping keys nest (host in domain in suffix)
    labels = F.split("host", r"\.")
    slim = evidence.where("letters").select("host", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"), F.element_at(labels, -1).alias("suffix"), "declared", F.slice(softmax(F.col("ll")), 1, n).alias("p"))
    by_host = stored(sums(slim, ["suffix", "domain", "host", "declared"], n).withColumnRenamed("s", "p"), "language-counts")
    even = F.array(*[F.lit(1.0 / n)] * n)
    whole = sums(by_host, [], n).select(smoothed(F.col("s"), even).alias("base")).collect()[0].base  # one number a language
    base = F.array(*[F.lit(float(x)) for x in whole])
    by_suffix = sums(by_host, ["suffix"], n).where("suffix IS NOT NULL").select("suffix", smoothed(F.col("s"), base).alias("suffix_prior"))
    by_domain = sums(by_host, ["suffix", "domain"], n).join(by_suffix, "suffix").select("domain", "suffix_prior", smoothed(F.col("s"), F.col("suffix_prior")).alias("domain_prior"))
    priors = sums(by_host, ["domain", "host"], n).join(by_domain, "domain").select("host", smoothed(F.col("s"), F.col("domain_prior")).alias("prior"))
    # how often text of a language declares each one: at most one row for each pair of languages, plus none
    told = sums(by_host, ["declared"], n).where("declared IS NOT NULL").collect()
    table_ = {r.declared: r.s for r in told}
    trust = np.array([[table_.get(d, [0.0] * n)[j] for j in range(n)] for d in languages]) + 1.0
    trust = np.log(trust / trust.sum(axis=0, keepdims=True))
    markup_ll = F.array(*[F.lit(0.0)] * (n + 1))
    for i, d in enumerate(languages):
        markup_ll = F.when(F.col("declared") == d, F.array(*[F.lit(float(x)) for x in trust[i]], F.lit(float(-np.log(n))))).otherwise(markup_ll)

    if not host:
        joined = evidence.withColumn("prior", F.lit(None).cast("array<double>"))
    else:
        priors = stored(priors, "language-priors")
        if priors.count() * n <= SMALL_ROWS * 8:  # at most 4 MB of numbers
            joined = evidence.join(F.broadcast(priors), "host", "left")
        else:
            salt = F.pmod(F.xxhash64("row", "ll"), F.lit(SALTS)).cast("int")
            spread = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = evidence.withColumn("salt", salt).join(spread, ["host", "salt"], "left")
    # the suffix is evidence by what it adds to the whole table's distribution; the host's prior holds it already
    prior = F.concat(F.transform(F.coalesce("prior", base), lambda p: p * (1 - UNKNOWN)), F.array(F.lit(UNKNOWN)))
    score = F.zip_with(F.zip_with(F.col("ll"), markup_ll, lambda a, b: a + b), prior, lambda a, p: a + F.log(p))
    fused = joined.withColumn("posterior", F.when(F.col("letters"), softmax(score)))
    names = F.array(*[F.lit(x) for x in languages])
    best = F.array_max(F.slice("posterior", 1, n))
    fused = fused.withColumn("best", best).withColumn("confidence", F.coalesce("best", F.lit(0.0)))
    found = F.get(names, (F.array_position("posterior", F.col("best")) - 1).cast("int"))
    fused = fused.withColumn("language", F.when(F.col("best") > F.get("posterior", F.lit(n)), found))
    other = F.col("declared").isNotNull() & (F.col("declared") != F.col("language")) & (F.col("confidence") >= firm)
    keep = F.col("language").isNotNull() & (F.col("confidence") >= least) & ~other
    return fused.select(*others, F.col("language").alias(results[0]), F.col("confidence").alias(results[1]), F.col("declared").alias(results[2]), F.coalesce(keep, F.lit(False)).alias(results[3]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document (its source as host) and every page (its html tag's language and its url's host)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = fit_text_model(docs, "text", "lang")
    pages = table(spark, sf_dir, "pages").select("page_id", "html", url_host(F.col("url")).alias("host"), F.regexp_extract("html", r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]+)", 1).alias("lang"))
    some = ["language", "confidence", "declared_language", "keep"]
    a = identify(docs, model, declared="lang", host="source").select("doc_id", F.lit(None).cast("bigint").alias("page_id"), *some)
    b = identify(pages, model, text="html", declared="lang", host="host", markup=True).select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", *some)
    return a.unionByName(b)
