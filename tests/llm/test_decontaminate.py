import random
from collections import Counter
from itertools import combinations

import numpy as np

from tempora.llm import decontaminate as d
from tempora.llm.common import table

MIN_ITEM = 5


def words(text):
    return [w for w in (d.strip_word(w.lower()) for w in (text or "").split()) if w]


def brute(docs, items, min_words=12, min_equal=0.75):
    """Every diagonal of every pair; those with too few equal words for any overlap are not looked at closer."""
    cut = [(k, words(u)) for k, u in items]
    places = {k: {w: [j for j, x in enumerate(b) if x == w] for w in set(b)} for k, b in cut}
    found = set()
    for i, t in docs:
        a = words(t)
        for k, b in cut:
            if len(b) < MIN_ITEM:
                continue
            equals = Counter(p - j for p, w in enumerate(a) for j in places[k].get(w, ()))
            for g in (g for g, n in equals.items() if n >= min_equal * min(min_words, len(b))):
                lo, hi = max(0, g), min(len(a), g + len(b))
                equal = np.array([x == y for x, y in zip(a[lo:hi], b[lo - g : hi - g], strict=True)])
                x, y = d.best_stretch(equal)
                if y - x >= min(min_words, len(b)) and equal[x:y].mean() >= min_equal:
                    found.add((i, k))
    return found


def test_overlaps(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate([30, 20, 8, 4, 12, 50])] + [(6, None), (7, "")]
    docs = []
    for i in range(60):
        text, k = prose(rnd.randint(0, 80)), rnd.randrange(6)
        part = items[k][1].split()
        if i % 3:
            for _ in range(i % 4):
                part[rnd.randrange(len(part))] = "other"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in part]
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "x " * 40_000 + items[1][1]), (5, docs[5][1]), (103, items[2][1])]
    df = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, begin int")
    idf = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.find_overlaps(df, idf).collect()}
    want = brute([x for x in docs if len(x[1] or "") < 5000], items) | {(102, 1)}
    exact = {(i, k) for i, t in docs for k, u in items if u and len(words(u)) >= MIN_ITEM and f" {' '.join(words(u))} " in f" {' '.join(words(t))} "}
    whole = set()  # the item as a whole stands there, three quarters of it equal
    for i, t in docs:
        a = words(t) if len(t or "") < 5000 else []
        whole |= {(i, k) for k, u in items for b in [words(u)] if len(b) >= MIN_ITEM for g in range(len(a) - len(b) + 1) if sum(x == y for x, y in zip(a[g:], b)) >= 0.75 * len(b)}
    assert whole <= set(got)
    assert exact <= set(got) <= want and len(want - set(got)) <= 0.1 * len(want)
    assert (got[(None, 0)].n_equal, got[(None, 0)].n_words, got[(102, 1)].doc_at) == (30, 30, 40_000)
    kept = [r.doc_id for r in d.decontaminate(df, idf).collect()]
    assert sorted(map(str, kept)) == sorted(str(i) for i, _ in docs if i not in {g[0] for g in got})
    short = {(r.doc_id, r.item_id) for r in d.find_overlaps(df, idf, min_item=1).collect()}
    tiny = " ".join(words(items[3][1]))
    assert set(got) <= short and {(i, 3) for i, t in docs if f" {tiny} " in f" {' '.join(words(t))} "} <= short
    assert d.find_overlaps(df.limit(0), idf).count() == 0 and d.find_overlaps(df, idf.limit(0)).count() == 0


def test_query_finds_exact_passages(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    got = {(r.doc_id, r.item_id) for r in d.query(spark, sf_dir).collect()}
    assert {(i, k) for i, t in docs for k, u in items if u in (t or "")} <= got <= brute(docs, items)


def test_every_overlay_that_is_three_quarters_equal(spark):
    """Against a brute force that judges whole overlays by their equal words alone."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(n, prose(n)) for n in range(MIN_ITEM, 41)]
    docs = []
    for n, item in items:
        for _ in range(8):
            part, text = list(item), prose(rnd.randint(0, 30))
            for at in rnd.sample(range(n), rnd.randint(n // 8, n // 4)):
                part[at] = "other"
            cut = rnd.randint(0, len(text))
            docs.append((len(docs), text[:cut] + part + text[cut:]))
    must = set()
    for i, a in docs:
        for k, b in items:
            for g in range(-len(b) + 1, len(a)):
                lo, hi = max(0, g), min(len(a), g + len(b))
                if hi - lo >= min(12, len(b)) and 4 * sum(x == y for x, y in zip(a[lo:hi], b[lo - g : hi - g], strict=True)) >= 3 * (hi - lo):
                    must.add((i, k))
    assert len(must) >= len(docs)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    idf = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in d.find_overlaps(df, idf).collect()}
    assert must <= got and len(got) <= len(must) + 5


def test_masks_leave_a_window_free(spark):
    for n in range(MIN_ITEM, 24):
        masks = d.short_masks(n) if n < d.FULL else d.MASKS
        windows = [sum(1 << o + i for i in d.offsets(m)) for m in masks for o in range(n - len(m) + 1)]
        gone = np.array([sum(1 << i for i in c) for c in combinations(range(n), n // 4)])
        assert np.any([(gone & w) == 0 for w in windows], axis=0).all(), n
        assert min(len(d.offsets(m)) for m in masks) >= 4


def test_one_word_again_and_again_against_a_long_item(spark):
    docs = spark.createDataFrame([(1, "x " * 4_000), (2, "y " * 4_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c " + "x " * 3_000)], "item_id long, text string")
    assert [(r.doc_id, r.n_equal) for r in d.find_overlaps(docs, items).collect()] == [(1, 3_000)]
