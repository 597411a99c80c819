import numpy as np
import pytest

from tempora.llm import lattice
from tempora.llm.common import table


def brute(rows, least=0.95):
    """Every pair of rows compared: {row number: (id, links, component)}."""
    sound = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    near = {k: set() for k in range(len(rows))}
    for a, (i, v) in enumerate(rows):
        for b in range(a):
            if sound[a] and sound[b] and len(v) == len(rows[b][1]):
                x, y = np.array(v, float), np.array(rows[b][1], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    near[a].add(b), near[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        reached, todo = {k}, [k]
        while todo:
            more = near[todo.pop()] - reached
            reached |= more
            todo += more
        out.append((i, len(near[k]), i if i is None else min(rows[r][0] for r in reached)))
    return sorted(out, key=str)


def result(df, **options):
    got = lattice.near_duplicates(df, **options).collect()
    assert all(r.kept == (None if r.vec_id is None else r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def vectors(rnd, groups, dim=12):
    """Groups of near copies, most of them at a cosine of 0.99, and chains of such."""
    out = []
    for n in groups:
        v = rnd.standard_normal(dim)
        for _ in range(n):
            out.append((v + rnd.standard_normal(dim) * 0.05).tolist())
            v = v + rnd.standard_normal(dim) * 0.03
    return out


@pytest.mark.parametrize("options", [{}, {"most": 4}, {"blocks": 1, "width": 0.8}])
def test_equals_brute_force(spark, options):
    rnd = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(vectors(rnd, [1] * 60 + [2, 3, 5, 30]))]
    rows += [(900 + k, rows[80][1]) for k in range(7)] + [(950, [2 * x for x in rows[80][1]])]
    want = brute(rows)
    assert sum(r[1] > 0 for r in want) > 30
    order = rnd.permutation(len(rows)).tolist()
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>").repartition(3)
    assert result(df, tables=30, **options) == want


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (1, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, v)]
    rows += [(9, [1.0, 2.0]), (10, [2.0, 4.0]), (11, [1e300, 2e300, 3e300]), (12, [1e-300, 2e-300, 3e-300]), (13, [-1.0, -2.0, -3.0]), (0, [5.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, v string")
    want = {(1, 4, 1), (2, 4, 1), (11, 4, 1), (12, 4, 1), (9, 1, 9), (10, 1, 9), (13, 0, 13), (None, 0, None), (0, 0, 0), *((i, 0, i) for i in range(3, 9))}
    got = result(df)
    assert set(got) == want and len(got) == len(rows)
    assert result(df.limit(0)) == []


def test_links_at_the_threshold(spark):
    """Pairs between 0.95 and 0.97: almost all are found, and none below 0.95."""
    rnd = np.random.default_rng(4)
    a = rnd.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rnd.standard_normal((1500, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = rnd.uniform(0.93, 0.97, 1500)[:, None]
    both = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(both.tolist())], "vec_id long, embedding array<double>")
    got = {r[0]: r[1] for r in result(df)}
    true = (both[:1500] * both[1500:]).sum(axis=1) >= 0.95
    assert not any(got[i] for i in np.flatnonzero(~true))
    assert sum(got[i] == 1 for i in np.flatnonzero(true)) >= 0.99 * true.sum()


def test_whole_table(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    rows += [(10_000 + i, v + 0.01 * np.random.default_rng(i).standard_normal(64)) for i, v in rows[:300]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    u = np.array([v / np.linalg.norm(v) for _, v in rows])
    near = u @ u.T >= 0.95
    got = {r[0]: r[1] for r in result(df)}
    assert [got[i] for i, _ in rows] == (near.sum(axis=1) - 1).tolist()


def test_decoding_is_nearest():
    rnd = np.random.default_rng(0)
    assert len({tuple(v) for v in lattice.SHORTEST.tolist()}) == 240 and np.allclose((lattice.SHORTEST**2).sum(axis=1), 2)
    x = rnd.uniform(-4, 4, (300, 8))
    p = lattice.nearest_e8(x)
    assert np.array_equal(lattice.nearest_e8(p + rnd.uniform(-0.2, 0.2, p.shape)), p)
    # no point beside it is nearer, and it is a point: all whole or all halves, with an even sum
    assert all((((x - p) ** 2).sum(axis=1) <= ((x - p - v) ** 2).sum(axis=1) + 1e-12).all() for v in lattice.SHORTEST)
    assert all(len(set(np.mod(r, 1))) == 1 and r.sum() % 2 == 0 for r in p)


def test_cells_are_the_same_in_any_batch():
    y = np.random.default_rng(3).integers(-2000, 2000, (2500, 32)).astype(np.int16)
    whole = lattice.cells(y, 64, 2, 2, 16)
    assert np.array_equal(whole[1700:1710], lattice.cells(y[1700:1710], 64, 2, 2, 16))
    assert np.array_equal(whole[:, :, :1], lattice.cells(y, 64, 2, 2, 0))
    assert all(len(set(k)) == 17 for k in whole.reshape(-1, 17).tolist())
