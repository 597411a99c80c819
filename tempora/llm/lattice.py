"""Near duplicates among embeddings by cosine: lattice hashing with E8.

Each of ``tables`` tables projects the unit vectors by a random matrix to ``blocks`` times eight dimensions, in units of
``width``, and decodes every eight to the nearest point of the lattice E8: the points are the cell that holds the vector, its
home.  The cells beside it, those of the nearest of the 240 neighbours of each point, are probed in the order of their
distance, ``probes`` in each table.  Two vectors meet where one has its home in a cell that is the other's home or one of its
probes.  Vectors that meet are compared by exact cosine.  With the production parameters a pair at a cosine of 0.95
meets in 99 of 100 cases, one at 0.97 in all but a few of 100,000, and unrelated vectors of 64 dimensions in about one of
100,000 cases.

Equal vectors are one class; results carry its size, never its pairs.  Projections are computed once and stored as
integers, from which homes and probes follow exactly, so every task finds the same cells.  A Bloom filter of fixed size
over the homes keeps probes of empty cells out of the shuffle; ids travel first, vectors follow only where cells are shared.
A cell's rows are dealt into blocks of ``most`` and compared block by block, so no task holds more than two blocks.
Of the pairs found, a task returns counts for each vector and a star for each local component.  A pair
that meets several times counts where it meets first: in its first table, and there in the direction of the smaller node.

Defined results: one row for each row; vectors that are null, empty, zero or hold null or non-finite components link with
nothing, have no links and are their own component; vectors of different lengths never link; rows with a null id
link with nothing and have a null component; rows that repeat an id and a vector count each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import unit
from .bloom import bloom_filter, passing
from .common import discard, mixed, stored, table
from .components import connected_components
from .tokens import BASE

UNIT, BEAM, PAIRS = 1024, 8, 50_000
CLOSE = 1e-9  # cosines nearer to the threshold than this are computed again, each for itself


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one or minus one, or eight halves with an even number of minus signs."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    out = np.zeros((len(pairs), 8))
    for row, (i, j, s, t) in enumerate(pairs):
        out[row, i], out[row, j] = s, t
    halves = [x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0]
    return np.concatenate([out, np.array(halves)])


SHORTEST = shortest_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def point_hash(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each point, the last axis."""
    out = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        out = out * BASE + np.rint(2 * points[..., k]).astype(np.int64).astype(np.uint64)
    return mixed(out)


def cells(y: np.ndarray, dim: int, tables: int, blocks: int, probes: int) -> np.ndarray:
    """Keys (rows, tables, 1 + probes) of the home and the probed cells of projections ``y``; exact, so the same in every task."""
    out = np.empty((len(y), tables, 1 + probes), np.uint64)
    salt = mixed(np.arange(tables, dtype=np.uint64), dim)
    for lo in range(0, len(y), 1_000):
        x = y[lo : lo + 1_000].reshape(-1, 8) / UNIT
        home = nearest_e8(x)
        gain = (x - home) @ SHORTEST.T if probes else np.zeros((len(x), 1))
        best = np.argpartition(-gain, BEAM, axis=1)[:, :BEAM] if probes else np.zeros((len(x), 0), int)
        cost = np.concatenate([np.zeros((len(x), 1)), 2 - 2 * np.take_along_axis(gain, best, 1)], axis=1)
        points = np.concatenate([home[:, None], home[:, None] + SHORTEST[best]], axis=1)
        cost, key = (a.reshape(-1, tables, blocks, cost.shape[1]) for a in (cost, point_hash(points)))
        total, keys = np.zeros((*cost.shape[:2], 1)), np.broadcast_to(salt[None, :, None], (*cost.shape[:2], 1))
        for b in range(blocks):  # the cheapest ways to move in the blocks so far; the first is to stay
            total = (total[..., :, None] + cost[:, :, b, None, :]).reshape(*cost.shape[:2], -1)
            keys = mixed((keys[..., :, None] * BASE + key[:, :, b, None, :]).reshape(*cost.shape[:2], -1))
            order = np.argsort(total, axis=2, kind="stable")[..., : 1 + probes]
            total, keys = np.take_along_axis(total, order, 2), np.take_along_axis(keys, order, 2)
        out[lo : lo + 1_000, :, : keys.shape[2]] = keys
        out[lo : lo + 1_000, :, keys.shape[2] :] = keys[..., :1]
    return out


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def projected(classes: DataFrame, tables: int, blocks: int, width: float, seed: int) -> DataFrame:
    """``classes`` (node, size, low, v) with the vectors as bytes and their projections in units of 1 / UNIT as bytes ``y``."""
    columns = tables * blocks * 8

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["v"]
            sizes, flat, ends = lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), lists.offsets.to_numpy()
            ends = ends - ends[0]
            packed, y = [b""] * len(b), [b""] * len(b)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)]
                turned = unit(x) @ np.random.default_rng([seed, dim]).standard_normal((dim, columns))
                whole = np.clip(np.rint(turned * UNIT / width), -32_000, 32_000).astype(np.int16)
                for i, r in enumerate(rows.tolist()):
                    packed[r], y[r] = x[i].tobytes(), whole[i].tobytes()
            yield pa.RecordBatch.from_pydict({"node": b["node"], "size": b["size"], "low": b["low"], "v": pa.array(packed, pa.binary()), "y": pa.array(y, pa.binary())})

    kind = dict(classes.dtypes)["low"]
    return classes.mapInArrow(of, f"node long, size long, low {kind}, v binary, y binary")


def first_meetings(keys: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, direct: np.ndarray) -> np.ndarray:
    """Which pairs meet for the first time in their table ``t``, where i probes the home of j, or both are at home if ``direct``; rows are in the order of nodes."""
    new = np.ones(len(i), bool)
    for s in range(int(t.max(initial=-1)) + 1):
        some = np.flatnonzero(new & (t >= s))
        p, q = i[some], j[some]
        there, back = (keys[p, s] == keys[q, s, :1]).any(axis=1), (keys[q, s] == keys[p, s, :1]).any(axis=1)
        # in its own table a pair may meet in both directions: the smaller node's counts
        new[some] = np.where(t[some] > s, ~(there | back), direct[some] | ~back | (p < q))
    return new


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def pairs_of(group: np.ndarray, asks: np.ndarray, member: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every asking row with every member of its group, in blocks: one group that is large, or many that are small."""
    a, m = np.flatnonzero(asks), np.flatnonzero(member)
    first, last = np.searchsorted(group[m], group[a]), np.searchsorted(group[m], group[a], "right")
    total = np.concatenate([[0], np.cumsum(last - first)])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
        n = (last - first)[lo:hi]
        yield np.repeat(a[lo:hi], n), m[np.arange(n.sum()) - np.repeat(total[lo:hi] - total[lo] - first[lo:hi], n)]
        lo = hi


def close_pairs(u: np.ndarray, group: np.ndarray, asks: np.ndarray, member: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): asking rows and members of one group at a cosine of ``least`` or more."""
    found = []

    def keep(i: np.ndarray, j: np.ndarray, cosine: np.ndarray) -> None:
        near = np.flatnonzero((cosine >= least - CLOSE) & (i != j))
        i, j, cosine = i[near], j[near], cosine[near]
        ok = cosine >= least
        edge = np.abs(cosine - least) <= CLOSE
        a, b = u[i[edge]], u[j[edge]]
        ok[edge] = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))) >= least
        found.append((i[ok], j[ok]))

    # groups of many rows one by one as products of matrices, the others together
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    large = np.zeros(len(group), bool)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
        if hi - lo > 64:
            large[lo:hi] = True
            a, m = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(member[lo:hi])
            for k in range(0, len(a), 256):
                cosine = u[a[k : k + 256]] @ u[m].T
                i, j = np.nonzero(cosine >= least - CLOSE)
                keep(a[k : k + 256][i], m[j], cosine[i, j])
    for i, j in pairs_of(group, asks & ~large, member & ~large):
        keep(i, j, np.einsum("ij,ij->i", u[i], u[j]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def compared(rows: pa.Table, least: float, shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """(node, root, links) of the nodes that have links in whole groups of rows, sorted by group: ``member`` rows are met by those that ask."""
    group = np.cumsum(group_starts(rows)) - 1
    lengths = np.array([len(x.as_py()) for x in rows["v"]])
    for dim in np.unique(lengths // 8).tolist():
        at = np.flatnonzero(lengths == 8 * dim)
        node, local = np.unique(rows["node"].to_numpy()[at], return_inverse=True)
        one = np.empty(len(node), np.int64)
        one[local] = at
        u = unit(np.frombuffer(b"".join(x.as_py() for x in rows["v"].take(pa.array(one)))).reshape(len(one), dim))
        member, asks, home = (rows[c].to_numpy()[at] for c in ("member", "asks", "home"))
        i, j = close_pairs(u[local], group[at], asks, member, least)
        direct, t = home[i], rows["t"].to_numpy()[at][i]
        i, j = local[i], local[j]
        root = local_roots(len(node), i, j)
        once = ~direct | (i < j)  # two rows at home ask each other
        i, j, t, direct = i[once], j[once], t[once], direct[once]
        used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
        y = np.frombuffer(b"".join(x.as_py() for x in rows["y"].take(pa.array(one[used]))), np.int16).reshape(len(used), shape[0] * shape[1] * 8)
        keys, (a, b) = cells(y, dim, *shape), np.split(where, 2)
        new = np.zeros(len(i), bool)
        for lo in range(0, len(i), PAIRS):
            some = slice(lo, lo + PAIRS)
            new[some] = first_meetings(keys, a[some], b[some], t[some], direct[some])
        size, links = rows["size"].to_numpy()[one], np.zeros(len(node), np.int64)
        np.add.at(links, i[new], size[j[new]])
        np.add.at(links, j[new], size[i[new]])
        some = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        yield pa.RecordBatch.from_pydict({"node": node[some], "root": node[root[some]], "links": links[some]})


def group_starts(rows: pa.Table) -> np.ndarray:
    parts = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("key", "m", "q")])
    return np.concatenate([np.ones(min(1, len(rows)), bool), (parts[:, 1:] != parts[:, :-1]).any(axis=0)])


def compared_groups(batches: Iterator[pa.RecordBatch], least: float, shape: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """``compared`` over a sorted partition, whole groups at a time; the last group of a batch waits for the next one."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        rows = pa.Table.from_batches([*rest, b])
        starts = np.flatnonzero(group_starts(rows))
        last = int(starts[-1]) if len(starts) else 0
        if last:
            yield from compared(rows.slice(0, last), least, shape)
        rest = rows.slice(last).to_batches()
    if rest:
        yield from compared(pa.Table.from_batches(rest), least, shape)


def linked(classes: DataFrame, least: float, shape: tuple[int, int, int], most: int) -> DataFrame:
    """(node, root, links), several rows a node: links that were counted in one place, and a star to the local root."""
    spark = classes.sparkSession
    tables, blocks, probes = shape

    def keys_of(b: pa.RecordBatch, probes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        dims = np.array([len(x.as_py()) // 8 for x in b["v"]])
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            y = np.frombuffer(b"".join(b["y"][r].as_py() for r in rows.tolist()), np.int16).reshape(len(rows), -1)
            yield b["node"].to_numpy()[rows], cells(y, dim, tables, blocks, probes)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, keys in keys_of(b, 0):
                yield pa.RecordBatch.from_pydict({"hash": keys[:, :, 0].ravel().view(np.int64)})

    bloom = spark.sparkContext.broadcast(bloom_filter(classes.mapInArrow(homes, "hash long")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, keys in keys_of(b, probes):
                home = np.zeros(keys.shape, bool)
                home[:, :, 0] = True
                row, t = (np.broadcast_to(a, keys.shape) for a in (np.arange(len(node))[:, None, None], np.arange(tables)[None, :, None]))
                some = passing(np.ascontiguousarray(keys).ravel(), bloom.value)
                key, row, t, home = keys.ravel()[some].view(np.int64), row.ravel()[some], t.ravel()[some], home.ravel()[some]
                yield pa.RecordBatch.from_pydict({"key": key, "t": t.astype(np.int8), "node": node[row], "home": home})

    spots = stored(classes.mapInArrow(placed, "key long, t byte, node long, home boolean"), "cells")
    sizes = spots.groupBy("key").agg(F.count("*").alias("all"), F.count_if("home").alias("homes")).where("all > 1 AND homes > 0")
    shared = stored(spots.join(sizes, "key"), "shared")
    bloom.destroy()
    # members and queries of a cell are dealt into blocks; every block of queries meets every block of members
    parts = lambda c: F.ceil(F.col(c) / most).cast("int")
    block = lambda c: F.pmod(F.xxhash64("node"), parts(c)).cast("int")
    asking = shared.withColumn("m", F.explode(F.sequence(F.lit(0), parts("homes") - 1))).withColumn("q", block("all"))
    there = shared.where("home").withColumn("q", F.explode(F.sequence(F.lit(0), parts("all") - 1))).withColumn("m", block("homes"))
    columns = ["key", "t", "m", "q", "node", "home"]
    dealt = asking.select(*columns, F.lit(False).alias("member"), F.lit(True).alias("asks")).unionAll(there.select(*columns, F.lit(True).alias("member"), F.lit(False).alias("asks")))
    one = stored(dealt.groupBy("key", "t", "m", "q", "node").agg(F.bool_or("home").alias("home"), F.bool_or("member").alias("member"), F.bool_or("asks").alias("asks")), "dealt")
    whole = one.join(classes.select("node", "size", "v", "y"), "node").repartition("key", "m", "q").sortWithinPartitions("key", "m", "q", "node")
    out = stored(whole.mapInArrow(lambda batches: compared_groups(batches, least, shape), "node long, root long, links long"), "links")
    discard(spots, shared, one)
    return out


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.95, tables: int = 10, blocks: int = 2, width: float = 1.25, probes: int = 16, most: int = 2_048, seed: int = 11
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id}`").alias("id"), v.alias("v"), (usable(v) & F.col(f"`{id}`").isNotNull()).alias("sound"))
    named = rows.select("id", F.when(F.col("sound"), F.xxhash64("v")).alias("node"), "v")
    grouped = named.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.first("v").alias("v"))
    classes = stored(projected(grouped, tables, blocks, width, seed), "classes")
    found = linked(classes, least, (tables, blocks, probes), most)

    counts = found.groupBy("node").agg(F.sum("links").alias("others"))
    groups = stored(connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    lows = groups.join(classes.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least_id"))
    known = stored(
        classes.select("node", "size", "low").join(counts, "node", "left").join(groups, "node", "left").join(lows, "component", "left")
        .select("node", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("least_id", "low").alias("component_id")),
        "known",
    )
    discard(classes, found, groups)
    ids = stored(named.select("id", "node"), "ids")  # both sides are shuffles of their own, so that the rows of one vector can be split
    out = ids.join(known, "node", "left").select(F.col("id").alias(id), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(f"`{id}`") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE sound AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
known AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM known
"""
