"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees: a bounded sample of the vectors (``sample`` rows, those with the smallest hashes) is split again and
again by the hyperplane between two of its points until a leaf holds ``leaf`` of them.  Sample and trees have a
fixed size; they are made on the driver and sent to the tasks.  Every row of the table is indexed: each tree
sends it to one leaf.  Leaves that hold more than ``most`` rows of the table are split again by a tree of their
own, fitted to a bounded sample of their rows inside the tasks, until none does; so leaves stay small however many
rows there are.  A split that would leave almost all points on one side deals them out by a hash instead, and a
search goes to both sides of it.

Search: a query walks all trees through one priority queue, ordered by the distance to the cell behind the
hyperplanes it has to cross.  A first look takes the leaves of one tree until they hold ``first`` rows and gives the
distance of the k-th of them.  The search then takes leaves from the shared queue until its head is
farther than ``reach`` times that distance.  ``reach`` is measured once on the sample: so far do the cells of
``recall`` of its true neighbours lie.  So queries with close neighbours visit few leaves, those without
visit many, at any size.  Candidates are ranked by exact cosine, and each query keeps its best.

Equal vectors are one candidate that carries the k + 1 smallest ids, which are all that a result can
hold, so a vector that a third of the rows have costs no more than any other.

Defined results: vectors that are null, zero, of another length than most of the sample's, or
hold null or non-finite components take no part; a query with fewer candidates than k gets them all; ties
go to the smaller id, however many there are; rows with a null id take no part; rows that repeat an id count once, with
their nearest vector; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_sample, mixed, stored, table

CLOSE = 1e-9  # cosines that differ by less are compared exactly


class Forest:
    """Random-projection trees as arrays; node < 0 is leaf -node - 1; a normal of zeros deals rows by hash."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.trees = [self._tree(points, leaf, rnd) for _ in range(trees if len(points) else 0)]

    @staticmethod
    def _tree(points: np.ndarray, leaf: int, rnd: np.random.Generator) -> tuple:
        normals, offsets, kids, leaves = [], [], [], []

        def grow(rows: np.ndarray) -> int:
            if len(rows) <= leaf:
                leaves.append(len(rows))
                return -len(leaves)
            a, b = points[rnd.choice(rows, 2, replace=False)]
            normal = a - b
            norm = np.linalg.norm(normal)
            normal = normal / norm if norm > 0 else normal
            side = points[rows] @ normal
            offset = np.median(side)
            left = side < offset
            if not len(rows) <= 16 * np.count_nonzero(left) <= 15 * len(rows):
                normal, offset, left = np.zeros(points.shape[1]), 0.0, np.arange(len(rows)) < len(rows) // 2
            at = len(kids)
            normals.append(normal), offsets.append(offset), kids.append(None)
            kids[at] = (grow(rows[left]), grow(rows[~left]))
            return at

        root, n = grow(np.arange(len(points))), len(kids)
        normals = np.array(normals).reshape(n, points.shape[1])
        return root, normals, np.array(offsets), np.array(kids, np.int64).reshape(n, 2), ~normals.any(axis=1)

    def leaves(self, tree: int, x: np.ndarray, salt: np.ndarray, toward: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row of x, and the squared distance of the rows of ``toward`` to it."""
        root, normals, offsets, kids, blind = self.trees[tree]
        node, far = np.full(len(x), root), np.zeros(len(x))
        while (live := np.flatnonzero(node >= 0)).size:
            at = node[live]
            right = np.einsum("ij,ij->i", x[live], normals[at]) >= offsets[at]
            right = np.where(blind[at], (mixed(salt[live] + at.astype(np.uint64)) & np.uint64(1)).astype(bool), right)
            if toward is not None:
                side = np.einsum("ij,ij->i", toward[live], normals[at]) - offsets[at]
                far[live] += np.where((side >= 0) == right, 0.0, side * side)
            node[live] = kids[at, right.astype(int)]
        return -node - 1, far

    def search(self, x: np.ndarray, start: float = 0.0, trees: range | None = None) -> Iterator[tuple[float, int, int]]:
        """(squared distance, tree, leaf) in the order of the shared queue; each hyperplane that is crossed adds to the distance."""
        trees = range(len(self.trees)) if trees is None else trees
        sides = {t: (self.trees[t][1] @ x - self.trees[t][2]).tolist() for t in trees}
        kids = {t: self.trees[t][3].tolist() for t in trees}
        queue = [(start, t, self.trees[t][0]) for t in trees]
        while queue:
            gone, t, node = heapq.heappop(queue)
            while node >= 0:
                side = sides[t][node]
                left, right = kids[t][node]
                near, other = (right, left) if side >= 0 else (left, right)
                heapq.heappush(queue, (gone + side * side, t, other))
                node = near
            yield gone, t, -node - 1


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no digit, that brings their largest component near 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) if v.size else v


def measured_reach(points: np.ndarray, forest: Forest, k: int, recall: float, asked: int = 128) -> float:
    """So many times a query's k-th distance do the cells of ``recall`` of the k nearest lie at most, each in its nearest tree."""
    if len(points) < 2 or not forest.trees:
        return 1.0
    rows = np.linspace(0, len(points) - 1, min(asked, len(points))).astype(int)
    cosine = points[rows] @ points.T
    cosine[np.arange(len(rows)), rows] = -2
    k = min(k, len(points) - 1)
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    kth = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(cosine, near, 1).min(axis=1), 1e-12))
    x, toward = points[near.ravel()], np.repeat(points[rows], k, axis=0)
    gone = np.min([forest.leaves(t, x, near.ravel().astype(np.uint64), toward)[1] for t in range(len(forest.trees))], axis=0)
    return float(np.quantile(np.sqrt(gone) / np.repeat(kth, k), recall))


def usable(vectors: DataFrame, id: Column, vector: Column) -> DataFrame:
    parts = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(id.alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & parts)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, kind: type) -> np.ndarray:
    """A column of lists or of packed bytes as rows of float64."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.zeros((0, dim))]
    for p in parts:
        if pa.types.is_list(p.type):
            flat = p.flatten().to_numpy()
        else:
            ends = np.frombuffer(p.buffers()[1], np.int32)[p.offset : p.offset + len(p) + 1] if len(p) else np.zeros(1, np.int32)
            flat = np.frombuffer(p.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind) if len(p) else np.zeros(0, kind)
        out.append(flat.reshape(-1, dim).astype(np.float64))
    return np.concatenate(out)


def packed_rows(v: np.ndarray, kind: type) -> pa.Array:
    """Rows as a column of bytes."""
    data = np.ascontiguousarray(v.astype(kind))
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


def salts(v: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    bits = np.ascontiguousarray(v).view(np.uint64)
    return mixed((mixed(bits) * (2 * np.arange(bits.shape[1], dtype=np.uint64) + np.uint64(1))).sum(axis=1, dtype=np.uint64))


def in_parts(rows: DataFrame, keys: list[str], most: int, salt: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a column ``part`` that cuts each key's rows into parts of about ``most``, and the parts of each key."""
    sizes = stored(rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "parts")
    dealt = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(salt), "parts").cast("int")).drop("parts")
    return dealt, sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding",
    trees: int = 4, leaf: int = 32, sample: int = 8_192, first: int = 1_024, most: int = 4_096, recall: float = 0.985, query_block: int = 1_024,
) -> DataFrame:
    """(query_id, rank, id, score): for each query its k nearest rows of ``vectors``, its own id left out."""
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    kind, element = (np.float32, "float") if single else (np.float64, "double")
    points = usable(vectors, F.col(f"`{id}`"), F.col(f"`{vector}`").cast(f"array<{element}>"))
    drawn = bounded_sample(points.select("v"), sample).column("v").combine_chunks()
    lengths = drawn.value_lengths().to_numpy() if len(drawn) else np.ones(1, np.int64)
    dim = int(np.bincount(lengths).argmax())
    fit = matrix(drawn.filter(pa.array(lengths == dim)), dim, kind) if len(drawn) else np.zeros((0, dim))
    fit = np.unique(unit(fit), axis=0)
    grown = Forest(fit, trees, leaf)
    reach = measured_reach(fit, grown, k, recall)
    forest = spark.sparkContext.broadcast(grown)

    # equal vectors once, with the k + 1 smallest ids; the row limit is applied before the shuffle as well
    points = points.where(F.size("v") == dim).distinct()
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    once = stored(points.withColumn("place", order).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    asked = usable(queries, F.col(f"`{id}`"), F.col(f"`{vector}`").cast(f"array<{element}>")).where(F.size("v") == dim)
    id_kind = vectors.schema[id].dataType.simpleString()

    def placed(slim: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = forest.value
            for b in batches:
                v = matrix(b["v"], dim, kind)
                x, salt = unit(v), salts(v)
                for t in range(len(f.trees) if len(b) else 0):
                    key = {"tree": pa.array(np.full(len(b), t, np.int32)), "node": pa.array(f.leaves(t, x, salt)[0])}
                    yield pa.RecordBatch.from_pydict(key if slim else key | {"v": packed_rows(v, kind), "ids": b["ids"]})

        return place

    rows_kind = f"tree int, node long, v binary, ids array<{id_kind}>"
    index = once.mapInArrow(placed(False), rows_kind)
    sizes = stored(once.select("v").mapInArrow(placed(True), "tree int, node long").groupBy("tree", "node").count(), "sizes")
    held = {r.node: r["count"] for r in sizes.where("tree = 0").collect()}  # one row a leaf of the first tree at most

    def walk(limited: bool):
        """Visits (tree, node, query_id, q, gone, reach2, least): the leaves a query takes from the queue."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f = forest.value
            for b in batches:
                x = unit(matrix(b["v"], dim, kind))
                limits = b["reach2"].to_numpy() if limited else np.full(len(b), np.inf)
                found, row = [], []
                for i in range(len(b)):
                    rows = 0
                    for gone, t, n in f.search(x[i], trees=None if limited else range(min(1, len(f.trees)))):
                        if gone > limits[i] or rows >= first:
                            break
                        found.append((t, n, gone))
                        row.append(i)
                        rows += 0 if limited else held.get(n, 0)
                t, n, gone = zip(*found, strict=True) if found else ((), (), ())
                b = b.take(pa.array(row, pa.int64()))
                limit, least = (b["reach2"], b["least"]) if limited else (pa.array(np.zeros(len(b))), pa.array(np.full(len(b), -2.0)))
                yield pa.RecordBatch.from_pydict({"tree": pa.array(t, pa.int32()), "node": pa.array(n, pa.int64()), "id": b["id"], "v": packed_rows(matrix(b["v"], dim, kind), kind), "gone": pa.array(gone, pa.float64()), "reach2": limit, "least": least})

        return visit

    # leaves with too many rows get a tree of their own, again and again; it is fitted to about half a sample, so it has fewer than ``branch`` leaves
    splits, level, branch = [], 0, max(8_192, sample)
    large = sizes.where(F.col("count") > most)
    while not large.isEmpty():
        level += 1

        def graft(key: tuple, group: pa.Table) -> pa.Table:
            x = unit(matrix(group["v"], dim, kind))
            rows = group["count"][0].as_py()
            sub = Forest(x, 1, max(1, len(x) * most // (2 * rows)), seed=key[0].as_py())
            return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "forest": pa.array([pickle.dumps(sub)])})

        def descend(key: tuple, rows: pa.Table, split: pa.Table) -> pa.Table:
            if not len(split) or not len(rows):
                return rows.drop_columns("part")
            v = matrix(rows["v"], dim, kind)
            sub = pickle.loads(split["forest"][0].as_py()).leaves(0, unit(v), salts(v))[0]
            return pa.table({"tree": rows["tree"], "node": pa.array((rows["node"].to_numpy() + 1) * branch + sub), "v": rows["v"], "ids": rows["ids"]})

        keep = F.pmod(F.xxhash64("v", "tree"), F.lit(1 << 32)) < (F.lit(float(1 << 32)) * (sample // 2) / F.col("count")).cast("bigint")
        split = stored(index.join(large, ["tree", "node"]).where(keep).groupBy("tree", "node").applyInArrow(graft, "tree int, node long, forest binary"), "splits")
        splits.append(split)
        full, rest = index.join(split, ["tree", "node"], "left_semi"), index.join(split, ["tree", "node"], "left_anti")
        full, parts = in_parts(full, ["tree", "node"], 8_192, "v")
        keys = ["tree", "node", "part"]
        deeper = full.groupBy(*keys).cogroup(parts.join(split, ["tree", "node"]).groupBy(*keys)).applyInArrow(descend, rows_kind)
        index = stored(deeper.unionByName(rest), "index")
        large = stored(index.groupBy("tree", "node").count(), "sizes").where(F.col("count") > most)

    asks_kind = f"tree int, node long, id {id_kind}, v binary, gone double, reach2 double, least double"

    def through(depth: int, limited: bool):
        def deeper(key: tuple, asks: pa.Table, split: pa.Table) -> pa.Table:
            """Through the tree of an overfull leaf; as it adds hyperplanes, the limit grows with the depth."""
            if not len(split) or not len(asks):
                return asks.drop_columns("part")
            sub, x = pickle.loads(split["forest"][0].as_py()), unit(matrix(asks["v"], dim, kind))
            limits = asks["reach2"].to_numpy() * (depth + 1)
            found, row = [], []
            for i, begun in enumerate(asks["gone"].to_numpy()):
                for gone, _, n in sub.search(x[i], begun if limited else 0.0):
                    if row and row[-1] == i and gone > limits[i]:  # the nearest leaf in any case
                        break
                    found.append((n, gone))
                    row.append(i)
            n, gone = zip(*found, strict=True)
            asks = asks.take(pa.array(row))
            return pa.table({"tree": asks["tree"], "node": pa.array((asks["node"].to_numpy() + 1) * branch + np.array(n)), "id": asks["id"], "v": asks["v"], "gone": pa.array(gone), "reach2": asks["reach2"], "least": asks["least"]})

        return deeper

    def visits(asked: DataFrame, limited: bool) -> DataFrame:
        out = asked.mapInArrow(walk(limited), asks_kind)
        for depth, split in enumerate(splits, 1):
            full, rest = out.join(split, ["tree", "node"], "left_semi"), out.join(split, ["tree", "node"], "left_anti")
            full, parts = in_parts(full, ["tree", "node"], query_block, "id")
            keys = ["tree", "node", "part"]
            out = full.groupBy(*keys).cogroup(parts.join(split, ["tree", "node"]).groupBy(*keys)).applyInArrow(through(depth, limited), asks_kind).unionByName(rest)
        return out

    def rank(key: tuple, r: pa.Table, q: pa.Table) -> pa.Table:
        """The k best rows of a leaf for each of its queries, among those that may be better than what the query has."""
        v, x = matrix(r["v"], dim, kind), matrix(q["v"], dim, kind)
        if not len(v) or not len(x):
            return out_schema.empty_table()
        near = unit(x) @ unit(v).T
        n = near.shape[1]
        cut = np.partition(near, n - k - 1, axis=1)[:, n - k - 1] if n > k + 1 else np.full(len(x), -2.0)  # one more, for the query itself
        ask, row = np.nonzero(near >= np.maximum(cut, q["least"].to_numpy())[:, None] - CLOSE)
        a, b = scaled(x), scaled(v)
        score = np.concatenate([np.zeros(0), *[(a[i] * b[j]).sum(axis=1) / (np.sqrt((a[i] * a[i]).sum(axis=1)) * np.sqrt((b[j] * b[j]).sum(axis=1))) for i, j in ((ask[s : s + 8_192], row[s : s + 8_192]) for s in range(0, len(ask), 8_192))]])
        lists = r["ids"].combine_chunks()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ids, own = lists.flatten(), q["id"].combine_chunks()
        many = np.diff(ends)[row]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends[row], many)
        ask, score, found = np.repeat(ask, many), np.repeat(score, many), ids.take(pa.array(at))
        other = np.asarray(pc.not_equal(found, own.take(pa.array(ask))))
        ask, score, found = ask[other], score[other], found.filter(pa.array(other))
        place = pc.rank(found, tiebreaker="dense").to_numpy() if len(found) else np.zeros(0, np.int64)
        order = np.lexsort((place, -score, ask))
        ask, score = ask[order], score[order]
        new = np.ones(len(ask), bool)
        new[1:] = ask[1:] != ask[:-1]
        begun = np.flatnonzero(new)
        keep = np.arange(len(ask)) - begun[np.cumsum(new) - 1] < k if len(ask) else new
        return pa.Table.from_arrays([own.take(pa.array(ask[keep])), found.take(pa.array(order[keep])), pa.array(score[keep])], schema=out_schema)

    id_arrow = pa.field("id", _arrow_type(vectors, id)).type
    out_schema = pa.schema([("query_id", id_arrow), (id, id_arrow), ("score", pa.float64())])
    found_kind = f"query_id {id_kind}, `{id}` {id_kind}, score double"

    def best(asks: DataFrame, index: DataFrame) -> DataFrame:
        """(query_id, id, score), several times each perhaps."""
        asks, parts = in_parts(asks, ["tree", "node"], query_block, "id")
        rows = index.join(parts, ["tree", "node"])
        keys = ["tree", "node", "part"]
        return rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(rank, found_kind)

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", id).agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id))).where(F.col("rank") <= k)

    look = stored(ranked(best(visits(asked, False), index.where("tree = 0"))), "first-look")
    # a query that found fewer than k rows goes everywhere
    kth = look.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    limit = F.coalesce(F.greatest(2 - 2 * F.col("least"), F.lit(0.0)) * reach * reach, F.lit(float("inf")))
    asked = asked.join(kth.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", limit.alias("reach2"), F.coalesce("least", F.lit(-2.0)).alias("least"))
    found = best(stored(visits(asked, True), "visits"), index).unionByName(look.select("query_id", id, "score"))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), id, "score")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: rows whose vec_id is divisible by 50, against all rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
