import numpy as np
import pandas as pd
import pytest

from tempora.llm import ann
from tempora.llm.common import table


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in queries:
        for i, v in ok:
            if i == q:
                best = {}
                for j, w in ok:
                    if j != q:
                        s = float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())))
                        best[j] = max(s, best.get(j, -2))
                out[q] = sorted(((-s, j) for j, s in best.items()))[:k]
    return out


def test_small_table_is_exact(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.standard_normal(8).astype("float32").tolist(), "x") for i in range(300)]
    rows += [(i, rows[7][1], "x") for i in range(300, 420)] + [(500, None, "x"), (501, [0.0] * 8, "x"), (502, [float("nan")] + [1.0] * 7, "x"), (503, [float("inf")] * 8, "x"), (504, [None] + [1.0] * 7, "x"), (None, rows[3][1], "x"), (505, [1.0], "x"), (10, rows[10][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), recall=1.0).collect()
    want = brute([r[:2] for r in rows if r[0] != 505], [i for i in range(0, 420, 50)], 5)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by.keys() == want.keys()
    for q, near in want.items():
        assert np.allclose([s for _, s in by[q]], [-s for s, _ in near], atol=1e-12)
        assert [i for i, _ in by[q]] == [i for _, i in near]
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6


def recall(got, rows, k=5):
    """The share of (query_id, score) that reach the true k-th score."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    at, hit, want = {i: n for n, i in enumerate(ids.tolist())}, 0, 0
    for q, scores in got.items():
        s = x @ x[at[q]]
        s[at[q]] = -9
        kth = np.sort(s)[-k]
        hit, want = hit + sum(v >= kth - 1e-9 for v in scores), want + k
    return hit / want


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, d):
    d = f"/root/testdata/{d}"
    rows = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").collect()]
    got = {i: [] for i, _ in rows if i % 50 == 0}
    for r in ann.query(spark, d).collect():
        got[r.query_id].append(r.score)
    assert recall(got, rows) >= 0.95


def test_recall_over_many_vectors_and_leaves_that_are_split_again(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((400, 16))
    x = np.concatenate([centres[rnd.integers(0, 400, 20_000)] + 0.2 * rnd.standard_normal((20_000, 16)), rnd.standard_normal((10_000, 16))])
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    for options in ({"sample": 512}, {"sample": 512, "leaf": 64, "most": 300, "query_block": 40}):
        got = {i: [] for i, _ in rows if i % 50 == 0}
        for r in ann.nearest(df, df.where("vec_id % 50 = 0"), **options).collect():
            got[r.query_id].append(r.score)
        assert {len(s) for s in got.values()} == {5} and recall(got, rows) >= 0.95, options


def test_ties_go_to_the_smaller_ids(spark):
    rnd = np.random.default_rng(5)
    v = rnd.standard_normal(8)
    rows = [(i, (v * 2.0 ** (i % 11 - 5)).tolist()) for i in rnd.permutation(30).tolist()] + [(100 + i, rnd.standard_normal(8).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"sample": 64, "leaf": 4, "most": 8}):
        got = ann.nearest(df, df.where("vec_id = 0"), **options).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and {r.rank for r in got} == {1, 2, 3, 4, 5} and {r.score for r in got} == {got[0].score}, options


def test_few_distinct_vectors(spark):
    rnd = np.random.default_rng(6)
    kinds = rnd.standard_normal((7, 4)).tolist()
    df = spark.createDataFrame([(i, kinds[i % 7]) for i in range(5_000)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id % 1000 = 0"), sample=4).collect()
    assert len(got) == 25 and all(r.vec_id % 7 == r.query_id % 7 for r in got)
