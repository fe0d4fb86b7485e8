"""Jaccard join of shingle sets by R-trees over count vectors.

The shingles of a text are hashed into GROUPS groups, and how many of them each group has is a point. Two sets share at most
the sum over the groups of the lesser counts; a box of points shares at most that sum with the box's upper corner. R-trees
are bulk-loaded from points and searched by that bound, node by node, and only pairs whose own bound allows the
similarity go on. These are verified on the exact sets.

Which texts meet in a tree is settled by equal groups too. Sets a and b with at least MOST / OF of their union in common
differ in no more than (OF - MOST) * (|a| + |b|) / (OF + MOST) shingles. Sizes are cut into intervals so that such sets lie in
the same or in neighbouring ones; an interval's shingles are dealt into more groups than its sets can have differences, so at
least two groups have the same shingles in both. Each group's shingles together are a key; texts with a key in common
form a bucket, and none is lost. (A tree of all texts could not do it: unrelated texts of one length have counts so alike that
boxes of more than a few points exclude nothing.) Groups without shingles are no keys, unless a set has over SPARE of them.

Buckets with the same members are one. First each meets its smallest member, which joins most copies; then members of
different components meet, in cells of bounded size, at first with PARTNERS of their next partners each and then with all.
So links between any two texts are kept as components, and a group of copies isn't squared.

Cases: a text is known by a 64-bit hash (two of N texts have the same by a chance of N * N / 2 ** 65, and shingles are
hashed likewise to be dealt out, which can't lose a pair); null texts and texts without words have no shingles and no links;
texts with fewer words than a shingle are one shingle; repeated rows and ids each get a row; a null doc_id is a
component's id only if it has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance as near
from .common import bucketed, checkpointed, slices, stored
from .components import components
from .substring import INVERSE, MIX, ODD

SHINGLE, MOST, OF = 3, 90, 100
#: Coordinates of a point, and empty groups that a set may have without these being keys.
GROUPS, SPARE = 64, 1
#: Points of a leaf, and children of a node.
LEAF, BRANCH = 16, 8
#: Pairs whose bounds are taken at a time.
PAIRS = 1 << 14


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Shingles that sets of these sizes must share at least."""
    return -(-MOST * (a + b) // (OF + MOST))


@cache
def intervals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sizes, numbers of groups) of the intervals up to a size. An interval spans three steps of the similarity."""
    first, groups, low = [], [], 1
    while not first or first[-1] <= most:
        high = max(low, low * OF**3 // MOST**3)
        differing = (OF - MOST) * 2 * high // (OF + MOST)
        first.append(low)
        groups.append(differing + 1 + SPARE if differing else 1)
        low = high + 1
    return np.array(first), np.array(groups)


def keys(h: np.ndarray) -> np.ndarray:
    """The keys of a set (distinct hashes): of its own interval, and of the next if a similar set can lie there."""
    first, groups = intervals(1 << int(len(h)).bit_length())
    own, out = int(np.searchsorted(first, len(h), "right")) - 1, []
    for k in (own, own + 1):
        if k > own and OF * len(h) < MOST * first[k]:
            break
        many, salt = int(groups[k]), np.array([k + 1], np.uint64) * ODD
        x = (h ^ salt) * MIX
        x ^= x >> np.uint64(32)
        group = (x % np.uint64(many)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        there, begin = np.unique(group[order], return_index=True)
        sums = np.add.reduceat((x * INVERSE ^ (x >> np.uint64(29)))[order] * ODD, begin)
        if many - len(there) > SPARE:
            sums = np.concatenate([sums, np.zeros(many - len(there), np.uint64)])
            there = np.concatenate([there, np.setdiff1d(np.arange(many), there)])
        x = (sums ^ (there.astype(np.uint64) * MIX)) * ODD + salt
        out.append((x ^ (x >> np.uint64(31))) * INVERSE)
    return np.unique(np.concatenate(out))


def point(h: np.ndarray) -> np.ndarray:
    """How many of the hashes each group has."""
    return np.bincount(((h * MIX) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)


class RTree:
    """Points in leaves of LEAF and nodes of BRANCH children, each with the upper corner of its box and its least size."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, branch: int = BRANCH):
        self.points, self.order = points, self._tiled(points, leaf)
        self.leaf, self.branch = leaf, branch
        begin = np.arange(0, len(points), leaf)
        sizes = points.sum(axis=1, dtype=np.int64)[self.order]
        self.high, self.least = [np.maximum.reduceat(points[self.order], begin)], [np.minimum.reduceat(sizes, begin)]
        while len(self.least[-1]) > 1:
            begin = np.arange(0, len(self.least[-1]), branch)
            self.high.append(np.maximum.reduceat(self.high[-1], begin))
            self.least.append(np.minimum.reduceat(self.least[-1], begin))

    @staticmethod
    def _tiled(points: np.ndarray, leaf: int) -> np.ndarray:
        """Rows in the order of the leaves: halves by the coordinate (or the size) that spreads most, cut at whole leaves."""
        wide = np.concatenate([points, points.sum(axis=1, keepdims=True)], axis=1)
        out, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                out.append(rows)
                continue
            own = wide[rows]
            rows = rows[np.argsort(own[:, int((own.max(axis=0) - own.min(axis=0)).argmax())], kind="stable")]
            middle = max(leaf, len(rows) // 2 // leaf * leaf)
            todo += [rows[middle:], rows[:middle]]
        return np.concatenate(out)

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(asked row, point) in batches, for all pairs whose bound allows the similarity."""
        size = asked.sum(axis=1, dtype=np.int64)
        for start in range(0, len(asked), max(1, PAIRS // self.branch)):
            q = np.arange(start, min(len(asked), start + max(1, PAIRS // self.branch)))
            node = np.zeros(len(q), np.int64)
            for level in range(len(self.high) - 1, -1, -1):
                if level < len(self.high) - 1:
                    q, node = self._children(q, node, self.branch, len(self.least[level]))
                q, node = self._allowed(asked, size, q, node, self.high[level], self.least[level])
            for at in range(0, len(q), max(1, PAIRS // self.leaf)):
                part = slice(at, at + max(1, PAIRS // self.leaf))
                a, place = self._children(q[part], node[part], self.leaf, len(self.order))
                b = self.order[place]
                yield self._allowed(asked, size, a, b, self.points, self.points.sum(axis=1, dtype=np.int64))

    @staticmethod
    def _children(q: np.ndarray, node: np.ndarray, many: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        child = (node[:, None] * many + np.arange(many)[None, :]).ravel()
        q = np.repeat(q, many)
        return q[child < end], child[child < end]

    @staticmethod
    def _allowed(asked: np.ndarray, size: np.ndarray, q: np.ndarray, node: np.ndarray, high: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.zeros(len(q), bool)
        for at in range(0, len(q), PAIRS):
            i, j = q[at : at + PAIRS], node[at : at + PAIRS]
            both = np.minimum(asked[i], high[j]).sum(axis=1, dtype=np.int64)
            good[at : at + PAIRS] = both >= needed(size[i], least[j])
        return q[good], node[good]


def described(texts: DataFrame) -> DataFrame:
    """(key, n, counts, hs) of each text (key, text; a key once) with words: the set's size, its point and its keys, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in slices(batches):
            keep, ns, points, hs, ends = [], [], [], [], [0]
            for k, text in enumerate(rows):
                if not text.encode("utf-8", "surrogatepass").split():
                    continue
                h = near.hashed(text, SHINGLE)
                keep.append(k)
                ns.append(len(h))
                points.append(point(h).astype("<u4").tobytes())
                hs.append(keys(h))
                ends.append(ends[-1] + len(hs[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *hs]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array(ns, pa.int32()), pa.array(points, pa.binary()), lists], ["key", "n", "counts", "hs"])

    return stored(texts.select("key", "text").mapInArrow(run, "key long, n int, counts binary, hs array<long>"), "points")


def points_of(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), "<u4").reshape(-1, GROUPS).astype(np.int64)


def _search(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of a cell's members in different components that its R-tree's bounds allow.

    most: of a member's partners in the tree's order, so many at most.
    """
    for _, kind, _, _, top, root, key, n, counts in near.runs(batches, 4):
        points = points_of(counts.tolist())
        rows, cols = (np.flatnonzero(~top), np.flatnonzero(top)) if kind[0] == 1 else (np.arange(len(key)), np.arange(len(key)))
        if not len(rows) or not len(cols):
            continue
        found = [np.zeros((2, 0), np.int64)]
        for i, j in RTree(points[cols]).search(points[rows]):
            i, j = rows[i], cols[j]
            good = (root[i] != root[j]) & ((kind[0] == 1) | (i < j))
            found.append(np.stack([i[good], j[good]]))
            if sum(x.shape[1] for x in found) > 16 * PAIRS:
                yield _first(found, key, most)
                found = [np.zeros((2, 0), np.int64)]
        yield _first(found, key, most)


def _first(found: list[np.ndarray], key: np.ndarray, most: int | None) -> pa.RecordBatch:
    i, j = np.concatenate(found, axis=1)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    first = near.leading(i, most)
    a, b = key[i[first]], key[j[first]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, their counts) those whose bound allows the similarity."""
    for batch in batches:
        if batch.num_rows:
            a, b = points_of(batch.column(2).to_pylist()), points_of(batch.column(3).to_pylist())
            good = np.minimum(a, b).sum(axis=1) >= needed(a.sum(axis=1), b.sum(axis=1))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns[:2], ["a", "b"])


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return OF * both >= MOST * (len(a) + len(b) - both)


def links(told: DataFrame, texts: DataFrame, block: int | None = None) -> DataFrame:
    """(node, root) of the keys that are linked to others; texts: in buckets by key, told: described(texts)."""
    members = near.buckets(told)
    stars = checkpointed(members.where("key <> lo").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct())
    check = lambda pairs: near.verified(pairs, texts, SHINGLE, similar)
    edges = check(stored(near.joined(stars, told, "counts").mapInArrow(_bounded, "a long, b long"), "possible"))
    roots, tried = components(edges), stars
    for most in (near.PARTNERS, None):
        placed = members.join(roots, F.col("key") == F.col("node"), "left").select("h", "key", F.coalesce("root", "key").alias("root"))
        pairs = near.cells(placed, told, block or near.BLOCK, ("n", "counts"), ()).mapInArrow(lambda batches, most=most: _search(batches, most), "a long, b long").distinct()
        new = stored(pairs.join(tried, ["a", "b"], "left_anti"), "possible")
        more = check(new)
        tried = tried.union(new)
        if more.limit(1).count():
            edges = edges.union(more)
            roots = components(edges)
    return roots


def groups(docs: DataFrame, block: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), near.key_of(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    with bucketed(near.unique(rows), "texts", "key") as texts:
        told = described(texts)
        linked = links(told, texts, block).withColumnRenamed("node", "key")
    classes = stored(told.select("key", "n").join(firsts, "key").join(linked, "key", "left").select("key", "n", "first", F.coalesce("root", "key").alias("root")), "classes")
    lowest = checkpointed(classes.groupBy("root").agg(F.min("first").alias("component_id")))
    owner = checkpointed(classes.join(lowest, "root").select("key", "n", "component_id"))
    out = stored(rows.select("doc_id", "key"), "rows").join(owner, "key", "left")
    return out.select("doc_id", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: The same by counting the shared shingles of all pairs that share any.
SQL = rf"""
with recursive d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct r, unnest(case when len(w) < {SHINGLE} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) end) as x from d where len(w) > 0),
n as (select r, count(*) as n from s group by 1),
i as (select a.r as a, b.r as b, count(*) as m from s a join s b on a.x = b.x and a.r <> b.r group by 1, 2),
e as (select i.a, i.b from i join n na on na.r = i.a join n nb on nb.r = i.b where {OF} * m >= {MOST} * (na.n + nb.n - m)),
c(r, o) as (select r, r from d union select c.r, e.b from c join e on e.a = c.o)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(o.doc_id) as component_id from d left join n using (r) join c on c.r = d.r join d o on o.r = c.o group by d.r, d.doc_id
"""
