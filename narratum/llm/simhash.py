"""SimHash near-duplicates, compared bit-sliced.

Fingerprints that differ in at most two of 64 bits agree in one of three bit ranges, so distinct fingerprints meet in
buckets by range. In a bucket they stand vertically: plane k holds bit k of every fingerprint, 64 to a machine word.
A fingerprint's differences from all others are then 64 exclusive-ors, added up by carry-save counters of two bits and
an overflow bit (bitslice.within); a block of rows is abandoned as soon as all its lanes have passed the radius. A bucket gives a
spanning forest of its links, not its pairs. Buckets over BUCKET fingerprints take an exact other way with linear
work: two fingerprints differ in at most two bits exactly if some value lies within one bit of both.

Cases: null and empty texts have fingerprint zero, which links like any other; texts with fewer words than a shingle
are one shingle; repeated rows each get a row; other columns are ignored; an empty table gives no rows; a null doc_id
is never a component's id unless the component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .bitslice import marked, planes, within
from .common import checkpointed, slices
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: (first bit, bits) of the ranges, one more than the radius.
RANGES = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a bucket that one task compares; pairs of buckets up to TINY are lanes of their own.
BUCKET, TINY = 4096, 8


def fingerprint(text: str, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in more than half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :].tolist())], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each row; the text column is read in bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            fp = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """(value, root) for the values of one bucket that have links: breadth first, each value compared once with all."""
    values = np.sort(values.astype(np.uint64))
    lanes, n = planes(values), len(values)
    left = np.zeros(lanes.shape[1] * 64, bool)
    left[:n] = True
    edges: list[tuple[int, int]] = []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = np.array([root])
        while len(front):
            reached = np.zeros(lanes.shape[1], np.uint64)
            for at in range(0, len(front), 256):
                reached |= np.bitwise_or.reduce(within(values[front[at : at + 256]], lanes, RADIUS), axis=0)
            front = np.flatnonzero(marked(reached, len(left)) & left)
            left[front] = False
            edges += [(int(values[i]), int(values[root])) for i in front]
    return edges


def tiny_links(buckets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links in small buckets: a lane for each pair, all buckets at once."""
    a, b = [], []
    for v in buckets:
        i, j = np.triu_indices(len(v), 1)
        a.append(v[i])
        b.append(v[j])
    if not a:
        return []
    first, second = np.concatenate(a), np.concatenate(b)
    mask = marked(within(None, planes(first ^ second), RADIUS)[0], len(first))
    return list(zip(first[mask].tolist(), second[mask].tolist()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        edges, tiny = [], []
        for s, e in zip(ends[:-1], ends[1:]):
            if e - s <= TINY:
                tiny.append(flat[s:e])
            else:
                edges += forest(flat[s:e])
            if len(tiny) >= 20_000:
                edges += tiny_links(tiny)
                tiny = []
        edges += tiny_links(tiny)
        both = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), with the connected components of all links."""
    ranges = F.array(*[F.struct(F.lit(k).alias("r"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("v")) for k, (s, w) in enumerate(RANGES)])
    keyed = distinct.select("fp", F.explode(ranges).alias("at")).select(F.col("at.r").alias("r"), F.col("at.v").alias("v"), "fp")
    sizes = keyed.groupBy("r", "v").agg(F.count("*").alias("n")).where("n > 1")
    grouped = keyed.join(sizes.where(F.col("n") <= bucket), ["r", "v"]).groupBy("r", "v").agg(F.collect_list("fp").alias("fps"))
    near = grouped.select("fps").mapInArrow(_compare, "a long, b long")
    crowded = keyed.join(sizes.where(F.col("n") > bucket), ["r", "v"]).select("fp").distinct()
    one_off = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0))) for k in range(64)])
    balls = crowded.select("fp", F.explode(one_off).alias("ball"))
    lowest = balls.groupBy("ball").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1")
    far = balls.join(lowest, "ball").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return near.union(far)


def groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint and component_id for each row of docs (doc_id, text)."""
    fps = checkpointed(fingerprints(docs))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(classes.select("fp"), bucket))
    members = checkpointed(classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = checkpointed(members.groupBy("root").agg(F.min("first").alias("component_id")))
    owner = members.join(lowest, "root").select("fp", "component_id")
    return fps.join(owner, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of texts linked by similar pairs (see resemblance).

    Rows are told apart by id and text: the one with the smallest doc_id stays, nulls last, then the smallest hash of the text.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), resemblance.key_of(F.col("text")).alias("__key"), F.col("doc_id").cast("long").alias("__id"))
    rows = keyed.groupBy("__key", "__id").agg(F.count("*").alias("n"))
    rows = rows.join(resemblance.groups(docs).withColumnRenamed("node", "__key"), "__key", "left").withColumn("root", F.coalesce("root", "__key"))
    place = F.struct(F.col("__id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    rows = checkpointed(rows.withColumn("place", place))
    best = checkpointed(rows.groupBy("root").agg(F.min("place").alias("best")))  # cut off, so that Spark can split a large group's join
    placed = checkpointed(rows.join(best, "root").select("__key", "__id", "n", (F.col("place") == F.col("best")).alias("kept")))
    same = lambda few: (keyed["__key"] == few["few_key"]) & keyed["__id"].eqNullSafe(few["few_id"])
    few = placed.where("not kept").select(F.col("__key").alias("few_key"), F.col("__id").alias("few_id"))
    out = keyed.join(few, same(few), "left_anti")
    few = placed.where("kept and n > 1").select(F.col("__key").alias("few_key"), F.col("__id").alias("few_id"))
    if few.limit(1).count():
        again = out.join(few, same(few), "left_semi").dropDuplicates(["__key", "__id"])
        out = out.join(few, same(few), "left_anti").union(again)
    return out.select("row.*")
