"""Groups of texts linked by a Jaccard similarity of word shingles of at least MOST / OF, all links found.

At that similarity 64-bit fingerprints lie ten bits apart on average, too far for bit ranges that lose nothing, so texts
meet by prefixes instead: two such sets share a shingle among the first n - ceil(n * MOST / OF) + 1 of each, in any
one order of all shingles. The order puts shingles that are common in a sample of the texts last and else goes by hash;
the sample decides the cost, never the result. Texts that share a prefix shingle form a bucket; of buckets with the same
members one stays. First each bucket's members meet its smallest one; the pairs that hold give components. Then only
members of different components meet, so a large group of copies isn't squared: at first each with its PARTNERS next possible
partners, which joins most of a dense group, then with all that are still apart. A large bucket is dealt in blocks of BLOCK
members over cells of two blocks: the largest component's blocks meet the other members' blocks, and those each other.
In a cell, 128-bit SimHash fingerprints are compared bit-sliced, and only pairs within WIDE bits go on: of a pair that is
similar enough a bit differs with a chance under 0.16, so more than WIDE of 128 differ with one of about 1e-8; sets of less than
FEW shingles aren't held to that. Every pair is verified by the exact sets.

Cases: a text is known by a 64-bit hash, null as the empty text; texts with fewer words than a shingle are one shingle;
texts without words have equal sets; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import marked, planes, within
from .common import bucketed, checkpointed, slices, stored
from .components import components
from .substring import INVERSE, MIX, ODD, hashes_of

SHINGLE, MOST, OF = 5, 4, 5
#: Texts whose shingles are counted, in how many a common one is, and how many of those are told apart (cost only).
SAMPLE, COMMON, LISTED = 5000, 5, 200_000
#: Pairs that a task hands on at a time; members of a block; members of a cell whose pairs are lanes of their own.
PAIRS, BLOCK, TINY = 1 << 14, 2048, 64
#: Possible partners of a member that are tried before all others.
PARTNERS = 8
#: Differing bits of fingerprints that are compared on, and shingles under which they say too little.
WIDE, FEW = 46, 10
#: Counts of a sketch, by which most pairs that can't be similar go before their texts are read (cost only).
WIDTH = 256
#: First shingles of a text's order that its rows carry: a pair that shares one of them goes on in that bucket, not in each later one too (cost only).
LEAD = 8

def key_of(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def unique(rows: DataFrame) -> DataFrame:
    """(key, text) of rows, one for each key. This is the only shuffle of all texts: stored in buckets by key they stay where they lie."""
    return rows.select("key", "text").dropDuplicates(["key"])


def shingles(text: str, size: int) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def hashed(text: str, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted; one zero for no words."""
    words = hashes_of(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return np.zeros(1, np.uint64)
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * ODD + words[k : len(words) - size + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique((out ^ (out >> np.uint64(29))) * INVERSE)


def alike(a: set, b: set) -> bool:
    both = len(a & b)
    return OF * both >= MOST * (len(a) + len(b) - both)


def common(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that are in COMMON of the sampled texts or more."""
    total = texts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashed(t, size) for t in part]).view(np.int64))], ["h"])

    picked = texts.where(F.pmod("key", F.lit(max(1, total // SAMPLE))) == 0).select("text")
    counts = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r.h for r in counts.limit(LISTED).collect()], np.int64).view(np.uint64))


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits in two signed numbers: a bit is set if it is set in more than half of the shingles' hashes."""
    out = []
    for salt in (ODD, MIX):
        x = (h ^ salt) * MIX
        x = (x ^ (x >> np.uint64(32))) * ODD
        bits = np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view("<i8")[0]))
    return out[0], out[1]


def described(texts: DataFrame, size: int) -> DataFrame:
    """(key, n, f1, f2, sketch, lead, hs) for each of texts (key, text; a key once), stored.

    n is the number of shingles, f1 and f2 the fingerprint, hs the prefix, lead its first LEAD hashes, and sketch how many shingles have each of WIDTH
    remainders (empty if one has over 255).
    """
    last = texts.sparkSession.sparkContext.broadcast(common(texts, size))  # bounded by LISTED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = last.value
        for part, rows in slices(batches):
            ns, prints, sketches, leads, hs, ends = [], [], [], [], [], [0]
            for text in rows:
                h = hashed(text, size)
                ns.append(len(h))
                prints.append(fingerprint(h))
                counts = np.bincount((h % np.uint64(WIDTH)).astype(np.int64), minlength=WIDTH)
                sketches.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"")
                if len(late):
                    there = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    h = np.concatenate([h[~there], h[there]])
                hs.append(h[: len(h) - -(-MOST * len(h) // OF) + 1])
                leads.append(hs[-1][:LEAD].astype("<u8").tobytes())
                ends.append(ends[-1] + len(hs[-1]))
            both = np.array(prints, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(hs).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ns, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sketches, pa.binary()), pa.array(leads, pa.binary()), lists], ["key", "n", "f1", "f2", "sketch", "lead", "hs"])

    return stored(texts.select("key", "text").mapInArrow(run, "key long, n int, f1 long, f2 long, sketch binary, lead binary, hs array<long>"), "described")


def buckets(told: DataFrame) -> DataFrame:
    """(h, key, lo, pos): the members of each bucket of two or more, the smallest of them and h's place in the member's order, stored.

    Of equal buckets the one whose shingle comes first in the order stays, so that places are the least ones. The places, many
    times the texts, are shuffled once: the buckets are counted where their rows lie, and those that stay meet the same rows.
    """
    places = told.select("key", F.posexplode("hs").alias("pos", "h")).where("h is not null").repartition("h")  # said here, as the join below infers it: both sides are one exchange
    marks = {"x": F.bit_xor(F.xxhash64("key")), "y": F.bit_xor(F.xxhash64(F.lit(1), "key"))}
    sets = places.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("many"), F.min_by("pos", "key").alias("at"), *[m.alias(k) for k, m in marks.items()]).where("lo < hi")
    once = sets.groupBy("lo", "hi", "many", "x", "y").agg(F.min_by("h", "at").alias("h")).select("h", "lo")
    return stored(places.join(once, "h").select("h", "key", "lo", "pos"), "members")


def cells(members: DataFrame, told: DataFrame, block: int, carry: tuple[str, ...] = ("n", "f1", "f2", "sketch", "lead"), own: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(h, kind, x, y, top, root, key, own columns, carried columns of told): members (h, key, root, own columns) of buckets with several roots, dealt over cells.

    kind 0 is a whole bucket; 1 has a block of the most frequent root (top) and one of other members; 2 two blocks of other members.
    """
    roots = members.groupBy("h", "root").agg(F.count("*").alias("own"))
    mixed = stored(roots.groupBy("h").agg(F.max_by("root", "own").alias("first"), F.max("own").alias("most"), F.sum("own").alias("total"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds"), "mixed")
    rows = members.join(mixed, "h").withColumn("top", F.col("root") == F.col("first"))
    major, rest = F.ceil(F.col("most") / block).cast("int"), F.ceil((F.col("total") - F.col("most")) / block).cast("int")
    rows = rows.withColumns({"major": major, "rest": rest, "own": F.pmod(F.xxhash64("key"), F.when(F.col("top"), major).otherwise(rest)).cast("int")})
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    each = lambda many, make: F.transform(F.sequence(F.lit(0), F.col(many) - 1), make)
    mine = F.col("own")
    others = F.concat(each("major", lambda k: cell(1, k, mine)), each("rest", lambda k: cell(2, F.least(k, mine), F.greatest(k, mine))))
    to = F.when(F.col("total") <= block, F.array(cell(0, F.lit(0), F.lit(0)))).when(F.col("top"), each("rest", lambda k: cell(1, mine, k))).otherwise(others)
    rows = rows.join(told.select("key", *carry), "key").select("h", F.explode(to).alias("to"), "top", "root", "key", *own, *carry)
    at = ["h", "kind", "x", "y"]
    return rows.select("h", "to.*", "top", "root", "key", *own, *carry).repartition(*at).sortWithinPartitions(*at)


def sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return OF * np.minimum(a, b) >= MOST * np.maximum(a, b)


def ahead(n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar enough if the first one in common has these places in their orders.

    None is shared before those places. A similar pair is let through in the bucket of its first common shingle.
    """
    both = np.minimum(n - pos, m - at)
    return OF * both >= MOST * (n + m - both)


def leads(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(8 * LEAD, b"\0") for x in rows), "<u8").reshape(-1, LEAD)


def met(a: np.ndarray, pos: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which pairs share one of their leads before these places, so that an earlier bucket has them too."""
    k = np.arange(LEAD)
    return ((a[:, :, None] == b[:, None, :]) & (k < pos[:, None])[:, :, None] & (k < at[:, None])[:, None, :]).any(axis=(1, 2))


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that are equal in the first `width` columns."""
    left: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.any([c[1:] != c[:-1] for c in columns[:width]], axis=0)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        if left and any(old[0] != now[0] for old, now in zip(left[0][:width], columns)):
            yield [np.concatenate(c) for c in zip(*left)]
            left = []
        for s, e in zip(edges[:-1], edges[1:]):
            left.append([c[s:e] for c in columns])
            if e < batch.num_rows:
                yield [np.concatenate(c) for c in zip(*left)] if len(left) > 1 else left[0]
                left = []
    if left:
        yield [np.concatenate(c) for c in zip(*left)]


def counted(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows; one that is empty has -1 first."""
    blank = np.full(WIDTH, -1, np.int16)
    return np.stack([np.frombuffer(x, np.uint8).astype(np.int16) if x else blank for x in sketches])


def room(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches leave room for a similar pair: no more shingles are shared than the sum of the lesser counts."""
    both, total = np.minimum(a, b).sum(axis=1, dtype=np.int64), a.sum(axis=1, dtype=np.int64) + b.sum(axis=1, dtype=np.int64)
    return (OF * both >= MOST * (total - both)) | (a[:, 0] < 0) | (b[:, 0] < 0)


def leading(rows: np.ndarray, most: int | None) -> np.ndarray:
    """The places of the first `most` of each run of equal numbers (none given: all)."""
    if most is None or not len(rows):
        return np.arange(len(rows))
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return np.flatnonzero(np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows)))) < most)


def _across(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of a cell's members in different components whose sizes, places, fingerprints and sketches allow a link.

    A pair is handed on in the bucket of its first common shingle, and of later ones only where its leads don't show that.

    most: of a member's partners further on in the cell, so many at most.
    """
    held: list[list[np.ndarray]] = []  # key, fingerprint, n and sketches of both sides of pairs that wait to be lanes, and the first's row
    waiting = before = 0

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def lanes() -> pa.RecordBatch:
        a, b, x, n, s, t, row = (np.concatenate(c) for c in zip(*held))
        held.clear()
        near = np.flatnonzero((n < FEW) | marked(within(None, planes(x), WIDE)[0], len(a)))
        near = near[room(s[near], t[near])]
        near = near[leading(row[near], most)]
        return pairs(a[near], b[near])

    for _, kind, _, _, top, root, key, pos, n, f1, f2, sketch, lead in runs(batches, 4):
        first = leads(lead.tolist())
        f, counts = np.stack([f1, f2], axis=1).view(np.uint64), counted(sketch.tolist())
        if len(key) <= TINY:
            i, j = np.triu_indices(len(key), 1)
            meet = (root[i] != root[j]) & sized(n[i], n[j]) & ahead(n[i], pos[i], n[j], pos[j])
            if kind[0] == 1:
                meet &= top[i] != top[j]
            i, j = i[meet], j[meet]
            fresh = ~met(first[i], pos[i], first[j], pos[j])
            i, j = i[fresh], j[fresh]
            if len(i):
                held.append([key[i], key[j], f[i] ^ f[j], np.minimum(n[i], n[j]), counts[i], counts[j], before + i])
            waiting, before = waiting + len(i), before + len(key)
            if waiting >= PAIRS:
                yield lanes()
                waiting = 0
            continue
        rows, cols = (np.flatnonzero(~top), np.flatnonzero(top)) if kind[0] == 1 else (np.arange(len(key)), np.arange(len(key)))
        across = planes(f[cols]) if len(cols) else None
        for s in range(0, len(rows) if len(cols) else 0, 256):
            r = rows[s : s + 256]
            near = marked(within(f[r], across, WIDE), len(cols)) | (n[r] < FEW)[:, None] | (n[cols] < FEW)[None, :]
            near &= (root[r][:, None] != root[cols][None, :]) & ahead(n[r][:, None], pos[r][:, None], n[cols][None, :], pos[cols][None, :])
            if kind[0] != 1:
                near &= r[:, None] < cols[None, :]
            i, j = np.nonzero(near)
            i, j = r[i], cols[j]
            parts = [(i[at : at + PAIRS], j[at : at + PAIRS]) for at in range(0, len(i), PAIRS)]
            good = np.concatenate([np.zeros(0, bool), *[~met(first[a], pos[a], first[b], pos[b]) & room(counts[a], counts[b]) for a, b in parts]])
            i, j = i[good], j[good]
            kept = leading(i, most)
            if len(kept):
                yield pairs(key[i[kept]], key[j[kept]])
    if held:
        yield lanes()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            good = room(counted(batch.column(2).to_pylist()), counted(batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good)).columns[:2], ["a", "b"])


def joined(pairs: DataFrame, frame: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): pairs with a column of frame (key, ...) for both."""
    both = pairs.join(frame.select(F.col("key").alias("b"), F.col(column).alias("y")), "b").join(frame.select(F.col("key").alias("a"), F.col(column).alias("x")), "a")
    return both.select("a", "b", "x", "y")


def verified(possible: DataFrame, texts: DataFrame, size: int, same: Callable[[set, set], bool] = alike) -> DataFrame:
    """The pairs (a, b) whose texts are similar, stored. texts (key, text; a key once): in buckets by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, set()
        for batch in batches:
            keep = []
            for k in range(len(batch)):
                if (a := batch.column(0)[k].as_py()) != last:
                    last, own = a, shingles(batch.column(2)[k].as_py(), size)
                keep.append(same(own, shingles(batch.column(3)[k].as_py(), size)))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns[:2], ["a", "b"])

    need = possible.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = stored(texts.join(need.hint("shuffle_hash"), "key", "left_semi"), "texts")  # the keys go to the texts, which aren't moved or sorted, however many there are
    return stored(joined(possible, texts, "text").mapInArrow(run, "a long, b long"), "similar")


def groups(docs: DataFrame, size: int = SHINGLE, block: int | None = None) -> DataFrame:
    """(node, root) for the keys (key_of) of texts that are linked to another by similar pairs; root is the smallest key."""
    keyed = docs.select(key_of(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    with bucketed(unique(keyed), "texts", "key") as texts:
        return _linked(texts, size, block or BLOCK)


def _linked(texts: DataFrame, size: int, block: int) -> DataFrame:
    """The same for texts (key, text; a key once) in buckets by key."""
    told = described(texts, size)
    members = buckets(told)
    stars = checkpointed(members.where("key <> lo").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct())
    edges = verified(stored(joined(stars, told, "sketch").mapInArrow(_possible, "a long, b long"), "possible"), texts, size)
    roots = components(edges)
    tried = stars
    for most in (PARTNERS, None):
        placed = members.join(roots, F.col("key") == F.col("node"), "left").select("h", "key", "pos", F.coalesce("root", "key").alias("root"))
        pairs = cells(placed, told, block).mapInArrow(lambda batches, most=most: _across(batches, most), "a long, b long").distinct()
        new = stored(pairs.join(tried, ["a", "b"], "left_anti"), "possible")
        more = verified(new, texts, size)
        tried = tried.union(new)
        if more.limit(1).count():
            edges = edges.union(more)
            roots = components(edges)
    return roots
