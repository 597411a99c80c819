import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tempora.llm import collocations as c
from tempora.llm.bloom import BLOOM_BITS


def brute(rows, least=10, covered=50, top=2000):
    """The rule of the docstring in plain Python."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = {}
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if len(w) == 2 and any(v[0] == lang and len(v) == 4 and b >= least and w in ([*v[1:3]], [*v[2:4]]) and 100 * b >= covered * a for v, b in f.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang in out for r, (s, a, p, x, y) in enumerate(sorted(out[lang])[:top])]


def texts(rnd, many=150):
    vocabulary = [rnd.choice("abcdéßЖ日") + str(i) for i in range(30)]
    rows = []
    for _ in range(many):
        words = [rnd.choice(vocabulary[: rnd.choice([4, 12, 30])]) for _ in range(rnd.randint(0, 80))]
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " \x0b"]) for w in words)
        if rnd.random() < 0.4:
            text += " Once upon a TIME " + rnd.choice(["there", "here"])
        rows.append((text, rnd.choice(["en", "en", "de", None])))
    return rows


def result(df, **options):
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"portion": 500, "routes": 50, "fan": 7}, {"top": 5}, {"covered": 90, "least": 12}])
def test_equals_brute_force(spark, options):
    rows = texts(random.Random(8))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    want = brute(rows, **{k: v for k, v in options.items() if k in ("least", "covered", "top")})
    assert {len(r[2].split()) for r in want} == {2, 3} and {r[0] for r in want} == {"en", "de", "und"}
    assert result(df, **options) == sorted(want)


def test_edges(spark):
    rows = [(None, "en"), ("", "en"), ("...", "en"), ("a b " * 6, None), ("a b " * 6, "und"), ("x y" + "." * 50, "de")] + [("same words here", "fr")] * 12
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "text string, lang string, n long, word string")
    assert result(df) == sorted(brute(rows))
    assert result(df.limit(0)) == [] and result(df.where("lang = 'de'")) == []


class Everything:
    """A filter that lets all words through."""

    value = np.full(BLOOM_BITS // 8, 255, np.uint8)


def found(rows):
    """Word counts and suffixes of texts, as the tasks see them."""
    import pyarrow as pa

    class Kept:
        def __init__(self):
            self.all = Counter()

        def add(self, words, _):
            self.all.update(map(tuple, words.T.tolist()))
            return iter(())

        def rest(self):
            yield self.all

    batch = pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "lang": [r[1] for r in rows]})
    counts = Counter()
    for data, starts, salts, own in c.blocks_of(*c.lists(batch)):
        begin, _, h, _ = c.words_of(data, starts, salts)
        counts.update(h[begin < own].tolist())
    (suffixes,) = c.suffixes(Everything, Kept)(iter([batch]))
    return counts, suffixes


def test_long_texts_are_cut_without_loss(monkeypatch):
    rnd = random.Random(2)
    text = " ".join(rnd.choice(["one", "two", "three.", "four", "\tfive "]) for _ in range(3_000))
    rows = [(text, "en"), (re.sub("[.]", "", text), "de"), ("one two", "en"), ("x" * 5_000 + " y z", "de"), ("z " * 900 + ", " * 400, "en"), (None, "en"), ("y" * 3_000, "fr")]
    whole = found(rows)
    assert sum(whole[0].values()) > 6_000 and sum(whole[1].values()) > 5_000
    for size in (7, 64, 1000):
        monkeypatch.setattr(c, "BLOCK", size)
        assert found(rows) == whole and len(list(c.blocks_of([r[0] for r in rows], [r[1] for r in rows]))) > 20


def test_long_text_equals_brute_force(spark):
    rnd = random.Random(2)
    text = " ".join(rnd.choice(["one", "two", "three.", "four"]) for _ in range(30_000))
    rows = [(text, "en"), (re.sub("[.]", "", text), "de"), ("one two", "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert result(df) == sorted(brute(rows))


def test_hot_pair_is_dealt_by_its_third_word(spark):
    rows = [(f"the same w{i % 40} the same v{i % 7}", "en") for i in range(600)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert result(df, routes=16) == sorted(brute(rows))


@pytest.mark.parametrize("least", [1, 7])
def test_quicksort_counts_prefixes(least):
    rnd = np.random.default_rng(least)
    words = rnd.integers(0, 6, (3, 3000)).astype(np.uint64)
    words[2, words[1] == 0] = 0
    weight = rnd.integers(1, 4, 3000)
    want = Counter()
    for (x, y, z), w in zip(words.T.tolist(), weight.tolist(), strict=True):
        for k, p in enumerate([(x,), (x, y), (x, y, z)]):
            if all(p):
                want[p] += w
    got = {}
    for depth, at, n in c.multikey_counts(words, weight, least):
        for i, m in zip(at.tolist(), n.tolist(), strict=True):
            key = tuple(words[: depth + 1, i].tolist())
            assert key not in got
            got[key] = m
    assert got == {p: n for p, n in want.items() if n >= least}
    assert list(c.multikey_counts(words[:, :0], weight[:0], 1)) == []


def test_blocks_keep_their_suffixes():
    rnd = np.random.default_rng(5)
    for top, heavy in ((50, 200), (1 << 60, 1 << 40)):
        words, weight = rnd.integers(0, top, (3, 40_000)).astype(np.uint64), rnd.integers(1, heavy, 40_000)
        back, n = c.unpack(c.pack(words, weight))
        assert np.array_equal(back, words) and np.array_equal(n, weight)
        once, total = c.added(words, weight)
        want = Counter()
        for p, w in zip(map(tuple, words.T.tolist()), weight.tolist(), strict=True):
            want[p] += w
        assert dict(zip(map(tuple, once.T.tolist()), total.tolist(), strict=True)) == want


def test_adding_up_a_portion_takes_little_memory():
    words = np.random.default_rng(6).integers(0, 50_000, (3, 300_000)).astype(np.uint64)
    tracemalloc.start()
    c.added(words, np.ones(300_000, np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * words.nbytes
