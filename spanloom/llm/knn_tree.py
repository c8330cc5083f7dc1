"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then put into a leaf. A
query walks the tree best bin first: a priority queue holds the nodes not yet
opened, nearest centre first, and gives leaves in the order to visit. How many
are visited is calibrated: visits are widened until, for a sample of queries
searched by brute force too, the wanted share of true neighbours is found.

Leaves are dealt into chunks of bounded size, so a frequent vector is spread out.
Within the visited chunks, the cosine of the original vectors decides, in double
precision, with ties to the smaller id.

Nulls: a vector that is null, empty, zero, or holds a null or a non-finite
component takes no part, nor does a row without an id. Vectors of another length
than most count as filled up with zeros. Rows that repeat a query's id aren't its
candidates. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bitsliced import matrix

#: Rows that the tree is fitted on, at most; queries that calibrate it; the share of true neighbours to find.
FIT_ROWS, TRIAL_QUERIES, RECALL = 20_000, 128, 0.95
BRANCHES = 8
LEAF_ROWS = 512
CHUNK_ROWS = 4096


def usable(vectors: DataFrame) -> DataFrame:
    rows = K.with_columns(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Tree:
    """Nodes in one table: centres, and either children or a leaf number."""

    def __init__(self, sample: np.ndarray, leaf_rows: int):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        rng = np.random.default_rng(7)
        mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
        waiting = [(self._add(mean), sample)]
        while waiting:
            node, own = waiting.pop()
            parts = self._split(own, rng) if len(own) > leaf_rows else []
            if len(parts) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            for centre, rows in parts:
                child = self._add(centre)
                self.children[node].append(child)
                waiting.append((child, rows))
        self.table = np.array(self.centres)
        self.square = (self.table**2).sum(1)

    def _add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        return len(self.leaf) - 1

    @staticmethod
    def _split(x: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        centres = x[rng.choice(len(x), min(BRANCHES, len(x)), replace=False)]
        for _ in range(12):
            near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
            centres = np.array([x[near == j].mean(0) for j in range(len(centres)) if (near == j).any()])
        near = ((centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        return [(centres[j], x[near == j]) for j in range(len(centres)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going to the nearest child at each node."""
        d = self.square[None] - 2 * x @ self.table.T
        at, live = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(live):
            for node in np.unique(at[live]).tolist():
                own = live[at[live] == node]
                if self.children[node]:
                    at[own] = np.array(self.children[node])[d[np.ix_(own, self.children[node])].argmin(1)]
            live = live[[bool(self.children[n]) for n in at[live]]]
        return np.array(self.leaf)[at]

    def visits(self, x: np.ndarray, most: int) -> list[list[int]]:
        """For each row, the first `most` leaves in best-bin-first order."""
        d = self.square[None] - 2 * x @ self.table.T
        out = []
        for row in d:
            queue, found = [(0.0, 0)], []
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                if not self.children[node]:
                    found.append(self.leaf[node])
                for c in self.children[node]:
                    heapq.heappush(queue, (row[c], c))
            out.append(found)
        return out


def nearest(queries: np.ndarray, asking: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row, cosine) of each query's k rows of largest cosine, ties to smaller ids.

    A matrix product finds the rows that can be among them; those are scored pair by
    pair, so that equal vectors have equal scores, wherever they stand.
    """
    rough = unit(queries) @ unit(x).T
    rough[asking[:, None] == ids[None]] = -np.inf
    n = rough.shape[1]
    least = np.partition(rough, n - k, axis=1)[:, n - k, None] - 1e-9 if n > k else np.full((len(rough), 1), -2.0)
    q, r = np.nonzero((rough >= least) & (rough > -2))
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (queries, x))
    size_a, size_b = (np.sqrt((v * v).sum(axis=1)) for v in (a, b))
    score = np.concatenate([(a[q[i : i + 65536]] * b[r[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)] or [np.zeros(0)]) / (size_a[q] * size_b[r])
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    first = np.searchsorted(q, np.arange(len(queries)))
    good = np.arange(len(q)) - first[q] < k
    return q[good], r[good], score[good]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fit(vectors: DataFrame, rows: int, width: int) -> Tree:
    """A tree from at most FIT_ROWS rows, those of smallest hash; leaves are as many as the rows call for."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()
    x = matrix(sample["v"], width)
    leaves = min(1024, max(1, rows // LEAF_ROWS))
    return Tree(unit(x) if len(x) else np.zeros((0, max(1, width))), max(4, len(x) // leaves))


def calibrate(vectors: DataFrame, queries: DataFrame, tree: Tree, width: int, k: int) -> int:
    """How many leaves to visit: widened until RECALL of a query sample's true neighbours is reached."""
    trial = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(TRIAL_QUERIES).toArrow()
    ids, x = trial["vec_id"].to_pylist(), matrix(trial["v"], width)
    if not ids:
        return 1

    def brute(batches):
        for b in batches:
            if not b.num_rows:
                continue
            own, v = np.asarray(b.column(0)), matrix(b.column(1), width)
            q, r, score = nearest(x, np.array(ids), own, v, k)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[q]), pa.array(own[r]), pa.array(score), pa.array(tree.assign(unit(v[r])))], ["query_id", "vec_id", "score", "leaf"])

    # at most TRIAL_QUERIES * k rows come back
    true = _best(vectors.mapInArrow(brute, "query_id long, vec_id long, score double, leaf long"), k).select("query_id", "leaf").collect()
    order = {q: {leaf: i for i, leaf in enumerate(o)} for q, o in zip(ids, tree.visits(unit(x), tree.leaves), strict=True)}
    wanted = [order[r["query_id"]][r["leaf"]] for r in true]
    visits = 4
    while visits < tree.leaves and sum(w < visits for w in wanted) < RECALL * len(wanted):
        visits += max(1, visits // 4)
    return min(visits, tree.leaves)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found. Both frames are as usable() gives them.

    A query asks once: of query rows that share an id, that with the smallest vector (compared by
    components). Candidates that share an id are ranked each. Shorter vectors count as ending in zeros.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    counts = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).first()
    n, width = counts["n"], counts["w"]
    tree = fit(vectors, n, width)
    visits = calibrate(vectors, queries, tree, width, k)

    def leaves(batches):
        for b in batches:
            if b.num_rows:
                leaf = tree.assign(unit(matrix(b.column(1), width)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], ["vec_id", "v", "leaf"])

    placed = vectors.mapInArrow(leaves, "vec_id long, v array<double>, leaf long")
    # one number for each leaf, of which there are 1,024 at most
    held = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    chunk = min(CHUNK_ROWS, max(64, n // 256))
    chunks = {leaf: -(-c // chunk) for leaf, c in held.items()}

    def dealt(batches):
        for b in batches:
            if b.num_rows:
                leaf, ids = tree.assign(unit(matrix(b.column(1), width))), np.asarray(b.column(0))
                salt = K.shard_of(ids, 1 << 30) % np.array([chunks.get(x, 1) for x in leaf.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(salt), b.column(0), b.column(1)], ["leaf", "salt", "vec_id", "v"])

    def asked(batches):
        for b in batches:
            if b.num_rows:
                way = tree.visits(unit(matrix(b.column(1), width)), visits)
                leaf, row = np.array([x for w in way for x in w]), np.repeat(np.arange(len(way)), [len(w) for w in way])
                salts = np.array([chunks.get(x, 0) for x in leaf.tolist()], np.int64)
                take = pa.array(np.repeat(row, salts))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(leaf, salts)), pa.array(K.spread(np.zeros(len(salts), np.int64), salts)), b.column(0).take(take), b.column(1).take(take)], ["leaf", "salt", "vec_id", "v"])

    def run(own: pa.Table, wanted: pa.Table) -> pa.Table:
        z = np.zeros(0, np.int64)
        out = (z, z, np.zeros(0))
        if own.num_rows and wanted.num_rows:
            ids, x = np.asarray(own["vec_id"]), matrix(own["v"], width)
            asking, v = np.asarray(wanted["vec_id"]), matrix(wanted["v"], width)
            parts = [(asking[i : i + 256], *nearest(v[i : i + 256], asking[i : i + 256], ids, x, k)) for i in range(0, len(v), 256)]
            out = tuple(np.concatenate(c) for c in zip(*((a[q], ids[r], score) for a, q, r, score in parts), strict=True))
        return pa.table([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

    shape = "leaf long, salt long, vec_id long, v array<double>"
    rows, ask = vectors.mapInArrow(dealt, shape), queries.mapInArrow(asked, shape)
    found = rows.groupBy("leaf", "salt").cogroup(ask.groupBy("leaf", "salt")).applyInArrow(run, "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", "rank", "vec_id", "score")
