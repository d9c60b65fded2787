"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample, every vector goes into a leaf of it, and a query opens nodes from a priority
queue, nearest centre first, until it has seen enough leaves. How many are enough is read off a set of calibration
queries whose neighbours are found by comparison with every vector: visits widen until the wanted recall is reached.
Inner products become distances by one more component, which brings every vector to the largest norm; a query's is 0.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import stored

#: Vectors that the tree is fitted on at most (those of the least hash of their id), children of a node, vectors of
#: the sample in a leaf, and rounds of k-means.
SAMPLE = 16_384
BRANCHES = 8
LEAF = 64
ROUNDS = 8
#: Calibration queries, the recall they must reach, and neighbours of each.
PROBES = 128
RECALL = 0.97
NEIGHBOURS = 20
#: Vectors and queries that one task compares at once, at most about: larger bins are dealt into parts.
PART = 4_096
QUERY_PART = 1_024


@dataclass
class Tree:
    """Nodes in the order of their making: centre, children (empty for a leaf), leaf number, and bin.

    A bin is the part of the tree that one task works on: all leaves below a node of the second level.
    """

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    bins: np.ndarray  # of each leaf

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down the nearest centres."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            c = self.centres[self.children[node]]
            near = np.argmin((c**2).sum(1) - 2 * (x[rows] @ c.T), 1)
            todo += [(child, rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves that a query opens, best bin first: ``most``, and on until they hold ``least`` vectors."""
        far = (((self.centres - q) ** 2).sum(1)).tolist()
        queue, out, seen = [(0.0, 0)], [], 0
        while queue and (len(out) < most or seen < least):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(int(self.leaf[node]))
                seen += int(held[self.leaf[node]]) if held is not None else 0
            for child in self.children[node]:
                heapq.heappush(queue, (far[child], child))
        return out


def _kmeans(x: np.ndarray, k: int, rng) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), 1)
        for j in range(k):
            if (near == j).any():
                centres[j] = x[near == j].mean(0)
    return centres, np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), 1)


def grown(x: np.ndarray, seed: int = 5) -> Tree:
    """A tree over a sample: nodes are split until they hold LEAF vectors or equal ones alone."""
    rng = np.random.default_rng(seed)
    centres, children, bins, n_bins, leaf = [x.mean(0)], [[]], [], 0, [-1]
    todo = [(0, np.arange(len(x)), 0, -1)]
    while todo:
        node, rows, depth, bin_ = todo.pop()
        if depth == 2:
            bin_, n_bins = n_bins, n_bins + 1
        split = None
        if len(rows) > LEAF and len(rows) >= BRANCHES and (x[rows] != x[rows[0]]).any():
            c, near = _kmeans(x[rows], BRANCHES, rng)
            split = [(c[j], rows[near == j]) for j in range(BRANCHES) if (near == j).any()]
        if not split or len(split) < 2:
            if bin_ < 0:
                bin_, n_bins = n_bins, n_bins + 1
            leaf[node] = len(bins)
            bins.append(bin_)
            continue
        for c, own in split:
            children[node].append(len(centres))
            centres.append(c)
            children.append([])
            leaf.append(-1)
            todo.append((children[node][-1], own, depth + 1, bin_))
    return Tree(np.array(centres), children, np.array(leaf), np.array(bins))


def usable(rows: DataFrame) -> DataFrame:
    """id and v (doubles) of the rows that take part: a vector of the usual length, finite, not zero; an id."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.where(fine).withColumn("_norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("_size", F.size("v")))
    sizes = rows.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("_size")).limit(1).collect()
    return rows.where(F.col("_size") == (sizes[0][0] if sizes else 0)).drop("_size")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _raised(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm - (x**2).sum(1, keepdims=True), 0))], 1)


def _asked(q: np.ndarray) -> np.ndarray:
    """Queries among raised vectors: the nearest of those have the largest inner product with them."""
    return np.concatenate([q, np.zeros((len(q), 1))], 1)


def best(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k rows of the largest inner product but its own: places, ids and scores, exactly ordered.

    The matrix product finds the rows within rounding of the k-th; their scores are summed anew, one way for all.
    """
    out = []
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    for i, s in enumerate(scores):
        edge = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
        near = np.flatnonzero((s >= edge - 1e-9 * (1 + abs(edge))) & (s > -np.inf)) if np.isfinite(edge) else np.flatnonzero(s > -np.inf)
        exact = (x[near] * q[i]).sum(1)
        order = np.lexsort((ids[near], -exact))[:k]
        out.append((near[order], ids[near][order], exact[order]))
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def calibrated(rows: DataFrame, tree: Tree, probes: tuple[np.ndarray, np.ndarray], norm: float, recall: float, k: int) -> tuple[int, float]:
    """Leaves to visit, and the recall that so many reach on the probes against every vector."""
    shared = rows.sparkSession.sparkContext.broadcast((tree, *probes))  # PROBES vectors, and a tree over SAMPLE

    def run(batches):
        tree, ids, q = shared.value
        for b in batches:
            if b.num_rows:
                x, own = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
                leaves = tree.assign(_raised(x, norm))
                for i, (at, near, score) in enumerate(best(q, ids, x, own, k)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(near), pa.array(score), pa.array(leaves[at])], ["query_id", "vec_id", "score", "leaf"])

    found = _top(rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").collect()
    visits = [{leaf: n for n, leaf in enumerate(tree.visits(v, len(tree.bins)), 1)} for v in _asked(probes[1])]
    needed = np.sort([visits[r[0]][r[1]] for r in found])
    if not len(needed):
        return len(tree.bins), 1.0
    most = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return most, float((needed <= most).mean())


def neighbours(rows: DataFrame, every: int = 20, k: int = NEIGHBOURS, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id ``every`` divides, among all others.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length
    than most, nor rows without an id. Rows that share a query's vec_id count as its own, and each row that repeats is a
    query or candidate of its own. A query opens leaves until they hold k rows besides one of its own. Ties go to the
    smaller vec_id; an empty table gives none; columns other than vec_id and embedding are not read.
    """
    spark = rows.sparkSession
    rows = stored(usable(rows).withColumn("_h", F.xxhash64("id")))
    picked = rows.orderBy("_h", "id").limit(sample).select("id", "v").toArrow()  # SAMPLE vectors
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = rows.agg(F.max("_norm")).first()[0]
    vectors = np.concatenate([_matrix(c) for c in picked.column("v").chunks])
    tree = grown(_raised(vectors, norm))
    probes = (picked.column("id").to_numpy()[:PROBES], vectors[:PROBES])
    most, _ = calibrated(rows, tree, probes, norm, recall, k)
    planted = spark.sparkContext.broadcast(tree)

    def leaves(batches):
        for b in batches:
            if b.num_rows:
                leaf = planted.value.assign(_raised(_matrix(b.column(1)), norm))
                yield pa.RecordBatch.from_arrays([pa.array(planted.value.bins[leaf]), pa.array(leaf), *b.columns], ["bin", "leaf", "id", "v"])

    def opened(batches):
        for b in batches:
            own, held = shared.value
            rows = [(int(i), at) for at, v in enumerate(_asked(_matrix(b.column(1)))) for i in own.visits(v, most, held, k + 1)] if b.num_rows else []
            by: dict[tuple[int, int], list[int]] = {}
            for leaf, at in rows:
                by.setdefault((int(own.bins[leaf]), at), []).append(leaf)
            if by:
                at = pa.array([a for _, a in by])
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in by], pa.int64()), pa.array(list(by.values()), pa.list_(pa.int64())), b.column(0).take(at), b.column(1).take(at)], ["bin", "leaves", "id", "v"])

    index = stored(rows.select("id", "v").mapInArrow(leaves, "bin long, leaf long, id long, v array<double>"))
    held = np.zeros(len(tree.bins), np.int64)
    for leaf, n in index.groupBy("leaf").count().collect():  # a row for each leaf of the tree
        held[leaf] = n
    shared = spark.sparkContext.broadcast((tree, held))
    asked = stored(rows.where(F.col("id") % every == 0).select("id", "v").mapInArrow(opened, "bin long, leaves array<long>, id long, v array<double>"))
    # Parts of each bin: as many as its rows and its queries need. The table has a row for each bin of the tree.
    sizes = index.groupBy("bin").agg(F.ceil(F.count("*") / PART).alias("_parts")).join(asked.groupBy("bin").agg(F.ceil(F.count("*") / QUERY_PART).alias("_sets")), "bin")
    sizes = F.broadcast(sizes.withColumn("_parts", F.col("_parts").cast("int")).withColumn("_sets", F.col("_sets").cast("int")))
    salt = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "bin").withColumn("set", salt("_sets")).withColumn("part", each("_parts")).select("bin", "part", "set", "leaves", "id", "v")
    right = index.join(sizes, "bin").withColumn("part", salt("_parts")).withColumn("set", each("_sets")).select("bin", "part", "set", "leaf", "id", "v")

    def compare(asked: pa.Table, index: pa.Table) -> pa.Table:
        asked, index = asked.combine_chunks(), index.combine_chunks()
        out = [[], [], []]
        if asked.num_rows and index.num_rows:
            column = lambda t, n: t.column(n).chunk(0)
            q, q_ids, x, ids = _matrix(column(asked, "v")), asked.column("id").to_numpy(), _matrix(column(index, "v")), index.column("id").to_numpy()
            leaf = index.column("leaf").to_numpy()
            by: dict[int, list[int]] = {}
            for at, ls in enumerate(asked.column("leaves").to_pylist()):
                for value in ls:
                    by.setdefault(value, []).append(at)
            found: dict[int, list] = {}
            for value, ats in by.items():
                own = np.flatnonzero(leaf == value)
                if len(own):
                    for at, (_, near, score) in zip(ats, best(q[ats], q_ids[ats], x[own], ids[own], k)):
                        found.setdefault(at, []).append((near, score))
            for at, parts in found.items():
                near, score = (np.concatenate(p) for p in zip(*parts))
                order = np.lexsort((near, -score))[:k]
                for o, c in zip(out, (np.full(len(order), q_ids[at]), near[order], score[order])):
                    o.append(c)
        arrays = [pa.array(np.concatenate(o) if o else np.empty(0), t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
        return pa.table(arrays, ["query_id", "vec_id", "score"])

    keys = ["bin", "part", "set"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query_id long, vec_id long, score double")
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
