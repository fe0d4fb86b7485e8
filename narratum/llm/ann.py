"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on at most SAMPLE vectors (those with the smallest hash of their id; a documented bound) and every
vector is filed under the leaf that it reaches. A node keeps its centre and the largest distance of its sample members,
so q.centre + |q| * radius bounds what a leaf's members can reach; a priority queue opens nodes by that bound, and leaves
come out best bin first. How many leaves a query visits is calibrated: on the sample, visits widen until RECALL of the true
neighbours is found; a query goes on from there until its leaves hold TOP candidates besides itself, or all there are.

Of equal vectors the TOP + 1 smallest ids (TOP rows of each) are candidates, as no answer can hold others. A leaf's vectors are dealt to
blocks by hash, and so are the queries that visit it; each pair of blocks is a group of bounded size that gives its
queries their TOP best there, and the best of those are the answer.

Scores of candidates are computed on the original vectors in double precision, in one order of summation, so equal
vectors tie exactly.

Cases: null, empty or zero vectors, and vectors with null or non-finite components, take no part; vectors whose length
isn't that of most of the sample take no part either; repeated ids are separate candidates but a query's own id is none of
its candidates; equal query rows ask once, and different ones of one id share one answer; an empty table gives no rows; fewer candidates than TOP give them all; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE, BRANCH, LEAF, TOP, RECALL, PROBES, EVERY = 20_000, 8, 64, 20, 0.97, 300, 20
#: Vectors of a block, and queries of one.
BLOCK, ASKS = 4096, 16_384


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's assignment of the rows of x to k centres (some may end empty)."""
    centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        if (new == own).all() and _:
            break
        own = new
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return own


class Tree:
    """Nodes in arrays: centre, radius, children (none: a leaf, with its number)."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 5):
        self.centre, self.radius, self.children, self.leaf = [], [], [], []
        self.leaves, rng = 0, np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            node, centre = len(self.centre), x[rows].mean(axis=0)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((x[rows] - centre) ** 2).sum(axis=1).max())))
            self.children.append([])
            self.leaf.append(-1)
            own = kmeans(x[rows], branch, rng) if len(rows) > max(leaf, branch) else None
            if own is None or len(np.unique(own)) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
            else:
                self.children[node] = [grow(rows[own == c]) for c in np.unique(own)]
            return node

        grow(np.arange(len(x)))
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.visits = self.leaves

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest centre at each node."""
        out, front = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while front:
            node, rows = front.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            centres = self.centre[kids]
            own = ((centres**2).sum(axis=1) - 2 * x[rows] @ centres.T).argmin(axis=1)
            front += [(kid, rows[own == c]) for c, kid in enumerate(kids) if (own == c).any()]
        return out

    def search(self, q: np.ndarray, visits: int, held: np.ndarray | None = None, enough: int = 0) -> list[int]:
        """The first leaves that the priority queue gives, best bin first; more if those hold less than enough (held: by leaf)."""
        bound = -(self.centre @ q + np.sqrt(q @ q) * self.radius * SLACK)
        queue, out = [(bound[0], 0)], []
        while queue and (len(out) < visits or enough > 0):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
                enough -= 0 if held is None else int(held[self.leaf[node]])
            for kid in self.children[node]:
                heapq.heappush(queue, (bound[kid], kid))
        return out

    def calibrate(self, x: np.ndarray, top: int = TOP, recall: float = RECALL, probes: int = PROBES) -> float:
        """Widens visits until the probes' true neighbours in x are found to that share; returns what was reached."""
        leaf, step = self.file(x), max(1, len(x) // probes)
        rank = []
        for k in range(0, len(x), step):
            near = x @ x[k]
            near[k] = -np.inf
            best = np.argsort(-near)[: min(top, len(x) - 1)]
            order = np.empty(self.leaves, np.int64)
            order[self.search(x[k], self.leaves)] = np.arange(self.leaves)
            rank.append(order[leaf[best]])
        ranks = np.concatenate(rank) if rank else np.zeros(1)
        self.visits = 1
        while self.visits < self.leaves and (ranks < self.visits).mean() < recall:
            self.visits += max(1, self.visits // 10)
        return float((ranks < self.visits).mean())


#: Share of the radius in a node's bound. 1 would order by the safe bound, 0 by the centre; members seldom stand at the rim.
SLACK = 0.5


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, whatever the block."""
    return np.ascontiguousarray(x * q).sum(axis=1)


def best(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, rough: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The top ids by (score, smaller id). rough: scores up to rounding, for all but what surely isn't among them."""
    rough = np.where(ids == own, -np.inf, rough)
    if len(ids) > top:
        edge = np.partition(rough, len(ids) - top)[len(ids) - top]
        at = np.flatnonzero(rough >= edge - 1e-9 * (1 + abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(rough))
    else:
        at = np.flatnonzero(np.isfinite(rough))
    score = exact(x[at], q)
    order = np.lexsort((ids[at], -score))[:top]
    return ids[at][order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part."""
    v = F.col("v")
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall(v, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    return rows.where(finite & F.exists(v, lambda y: y != 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        column = batch.column(1)
        yield batch.column(0).to_numpy(), np.asarray(column.flatten()).reshape(len(column), -1)


def neighbours(vectors: DataFrame, top: int = TOP, every: int = EVERY, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the top candidates of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors)
    again = F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))
    copies = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("again", again).where(F.col("again") <= top).withColumn("copy", copies).where(F.col("copy") <= top + 1).drop("again", "copy")
    picked = few.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not picked:
        return empty
    width = int(np.bincount([len(r.v) for r in picked]).argmax())
    rows, few = rows.where(F.size("v") == width), few.where(F.size("v") == width)
    tree = Tree(x := np.array([r.v for r in picked if len(r.v) == width]))
    tree.calibrate(x, top, recall)
    shared = spark.sparkContext.broadcast(tree)  # bounded by SAMPLE

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), width).cast(pa.list_(pa.float64())), pa.array(shared.value.file(v), pa.int32())], ["vec_id", "v", "leaf"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _blocks(batches):
            own = shared.value
            for at in range(0, len(ids), 100):
                leaves = [own.search(q, own.visits, held, top + 1) for q in v[at : at + 100]]
                n = [len(x) for x in leaves]
                many = np.repeat(v[at : at + 100], n, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 100], n)), pa.FixedSizeListArray.from_arrays(pa.array(many.ravel()), width).cast(pa.list_(pa.float64())), pa.array(np.concatenate(leaves), pa.int32())], ["query_id", "q", "leaf"])

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias(name))  # a row for each leaf: bounded by SAMPLE

    def dealt(df: DataFrame, own: DataFrame, column: str, other: DataFrame, across: str) -> DataFrame:
        """Rows with their block by hash of a column, once for each block of the other side that their leaf has."""
        out = df.join(F.broadcast(own), "leaf").withColumn(column, F.pmod(F.xxhash64(df.columns[0]), F.col(column)).cast("int"))
        return out.join(F.broadcast(other), "leaf").withColumn(across, F.explode(F.sequence(F.lit(0), F.col(across) - 1)))

    filed = stored(few.mapInArrow(file, "vec_id long, v array<double>, leaf int"), "leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():  # a row for each leaf
        held[r.leaf] = r["count"]
    asked = stored(rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(visit, "query_id long, q array<double>, leaf int"), "asked")
    vectors_of, queries_of = blocks(filed, BLOCK, "block"), blocks(asked, ASKS, "asks")
    filed, asked = dealt(filed, vectors_of, "block", queries_of, "asks"), dealt(asked, queries_of, "asks", vectors_of, "block")

    def compare(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("vec_id").to_numpy()
        v = left.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out: tuple[list, list, list] = ([], [], [])
        if len(ids):
            for batch in right.to_batches(max_chunksize=256):
                asks = batch.column(0).to_numpy()
                q = batch.column(1).flatten().to_numpy().reshape(len(asks), -1)
                for own, one, rough in zip(asks, q, q @ v.T):
                    found, score = best(ids, v, own, one, rough, top)
                    out[0].append(np.full(len(found), own))
                    out[1].append(found)
                    out[2].append(score)
        join = lambda xs, t: pa.array(np.concatenate(xs) if xs else [], t)
        return pa.table({"query_id": join(out[0], pa.int64()), "vec_id": join(out[1], pa.int64()), "score": join(out[2], pa.float64())})

    keys = ("leaf", "block", "asks")
    found = filed.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(asked.select(*keys, "query_id", "q").groupBy(*keys)).applyInArrow(lambda k, a, b: compare(k, a.select(["vec_id", "v"]), b.select(["query_id", "q"])), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
