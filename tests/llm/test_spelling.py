import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tempora.llm import spelling
from tempora.llm.common import stored


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, every=199, least_length=6, least_count=5, ratio=5):
    """The rule of the docstring in plain Python: every pair of words is compared."""
    n = Counter()
    for i, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "À" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                n[run] += len(run) >= least_length
                run = ""
    n = {w: c for w, c in n.items() if c >= least_count}
    out = {}
    for w in n:
        near = sorted((-n[v], v) for v in n if one_edit(v, w))
        form = near[0][1] if near and -near[0][0] >= ratio * n[w] else None
        out[w] = (form, n[w], len(near), n[form] if form else None)
    for w, row in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (row[0], root, *row[1:])
    return out


def words_like(rnd, many):
    letters = "abcdeéèçß"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 9))) for _ in range(many)]
    out = []
    for w in base:
        for _ in range(rnd.choice([1, 6, 40])):
            i, v = rnd.randrange(len(w)), w
            kind = rnd.random()
            if kind < 0.1:
                v = w[:i] + w[i + 1 :]
            elif kind < 0.2:
                v = w[:i] + rnd.choice(letters) + w[i:]
            elif kind < 0.3:
                v = w[:i] + rnd.choice(letters) + w[i + 1 :]
            out += [v] * rnd.choice([1, 6, 30])
    out += ["chainabc"] * 7 + ["chainabd"] * 60 + ["chainaed"] * 500
    rnd.shuffle(out)
    return out


def result(df, **options):
    got = spelling.spelling_variants(df, **options).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("options", [{}, {"cell": 8, "sample": 300}, {"cell": 4, "sample": 40}])
def test_equals_brute_force(spark, options):
    rnd = random.Random(5)
    words = words_like(rnd, 60)
    rows = [(i, " ".join(words[i::20]).upper() if i % 3 else "; ".join(words[i::20])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, every=7)
    assert sum(v[0] is not None for v in want.values()) > 20
    assert want["chainabc"][:2] == ("chainabd", "chainaed")
    assert result(df, every=7, **options) == want


def test_cells_that_no_tree_splits(spark):
    """Words of the same letters in another order are one point: the cell is dealt into blocks."""
    rnd = random.Random(3)
    words = list({"".join(rnd.sample("aaabbbcc", 8)) for _ in range(400)})
    words += [w[:3] + "x" + w[4:] for w in words[:50]]
    rows = [(i, " ".join(words)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, every=10**9, cell=2, sample=100) == brute(rows, every=10**9)


def test_edges(spark):
    word = "abcdefgh"
    long = "ab" * 30_000
    rows = [(1, f"{word} {word}"), (None, word), (1, f"{word} {word}"), (2, None), (3, ""), (4, f"{long} {long} {long} {long} {long} {long}x"), (5, f"{long}x " * 4), (6, "ÀÀÀÀÀÀ àààààà"), (7, "ÀÀÀÀÀÀ " * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, cell int")
    got = result(df, every=10**9)
    assert got == brute(rows, every=10**9)
    assert got[word][2:4] == (5, 0) and got[long][3] == 1 and "ÀÀÀÀÀÀ" in got
    assert result(df.limit(0)) == {}


def test_range_search_finds_every_box():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 3, (500, spelling.DIMS)).astype(np.int16)
    tree = spelling.KdTree(x, 5)
    assert sorted(np.concatenate(tree.rows).tolist()) == list(range(500))
    where = tree.cells(x)
    assert all((where[rows] == i).all() for i, rows in enumerate(tree.rows))
    q = x[:50].copy()
    q[np.arange(50), rnd.integers(0, spelling.DIMS, 50)] += 1
    met = {(int(i), int(j)) for rows, leaf in tree.search(q, 2) for i in rows for j in tree.rows[leaf]}
    close = np.argwhere(np.abs(q[:, None] - x[None]).sum(axis=2) <= 2)
    assert {tuple(p) for p in close.tolist()} <= met and len(met) < 25_000


def test_roots_follow_the_whole_way(spark):
    df = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "w3")], "word string, form string")
    got = {r.word: r.root for r in spelling.roots(stored(df, "test")).collect()}
    assert got == {**{f"w{i}": "w11" for i in range(11)}, "a": "w11"}
