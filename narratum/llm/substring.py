"""Substring dedup: passages of WINDOW words that start in an earlier document too, by FM-indexes of shared text.

Only text that documents share needs an index. Each window of WINDOW words has a minimizer: the GRAM-word sequence in it
with the smallest hash (the first of equals). Equal windows have equal minimizers, so text is routed by minimizer: the
consecutive windows with one minimizer form a region, equal regions of all documents collapse to one row with the
smallest document, and minimizers seen in one document only are dropped. Regions with the same minimizer go to the same
shard, so all places of a window meet in one FM-index.

A shard's index is the Burrows-Wheeler transform of its regions in a wavelet matrix, and a bit for each suffix that
differs from the one before within WINDOW words. Regions are streamed through it by backward search, all in step: every
word extends the match to the left by two ranks, and a match that grows past WINDOW is cut back to WINDOW words, to the
whole interval between two bits. These capped matching statistics give each window's interval, and with it the smallest
document of all that hold it; intervals that reach the threshold and hold an earlier document are reported.

A minimizer with more than CROWD different regions takes an exact other way: its windows are reduced one by one to their
smallest document by an aggregation on their hash. Memory is bounded by SHARD_WORDS and CROWD at every size.

Cases: null and empty texts have no words; texts shorter than a window keep all words; rows with the same doc_id are
one document, which is never its own earlier one, and each row is cut by its own places (its texts are told apart by a 64-bit
hash); equal rows are searched once; rows with a null id remove and lose
nothing; other columns are passed through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembered, slices, stored

WINDOW, GRAM = 50, 8
#: Words of a shard, and different regions of a minimizer that one shard takes.
SHARD_WORDS, CROWD = 1_000_000, 10_000
#: Distinct words whose hashes a worker remembers (bounds memory, not results).
REMEMBERED = 500_000
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashes_of(words: list[bytes]) -> np.ndarray:
    """Hashes by a worker process's memory."""
    return remembered("hashes", Hashes).of(words)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return (h ^ (h >> np.uint64(29))) * ODD


def regions(hashes: np.ndarray, sizes: list[int], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of documents with these word hashes, joined: (document, first window in it, number of windows, minimizer, region hash)."""
    n, gram = len(hashes), min(GRAM, window)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    count = np.maximum(np.asarray(sizes) - window + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    grams = hashes[: n - gram + 1].copy()
    for k in range(1, gram):
        grams = grams * ODD + hashes[k : n - gram + 1 + k]
    grams = mixed(grams)
    place = np.uint64((1 << 30) - 1)
    low, wide, want = (grams & ~place) | np.arange(len(grams), dtype=np.uint64), 1, window - gram + 1
    while 2 * wide <= want:
        low, wide = np.minimum(low[:-wide], low[wide:]), 2 * wide
    if wide < want:
        low = np.minimum(low[: len(low) - (want - wide)], low[want - wide :])
    doc = np.repeat(np.arange(len(sizes)), count)
    start = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
    at = (low[start] & place).astype(np.int64)
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    first = np.flatnonzero(new)
    windows = np.diff(np.concatenate([first, [total]]))
    s, anchor = start[first], grams[at[first]]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, ODD)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * power[:-1])])
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
    width = windows + window - 1
    region = mixed((sums[s + width] - sums[s]) * down[s] + width.astype(np.uint64) * MIX)
    return doc[first], s - begins[doc[first]], windows, anchor.view(np.int64), region.view(np.int64)


class FMIndex:
    """Burrows-Wheeler transform of texts (arrays of numbers) in a wavelet matrix, searched backward for many patterns in step."""

    def __init__(self, texts: list[np.ndarray], depth: int = WINDOW):
        self.depth, width = depth, np.array([len(t) for t in texts])
        flat = np.concatenate([x for t in texts for x in (t, np.zeros(1, t.dtype))])
        real = np.ones(len(flat), bool)
        real[np.cumsum(width + 1) - 1] = False
        self.alphabet, codes = np.unique(flat[real], return_inverse=True)
        symbols = np.zeros(len(flat), np.int64)  # 0 ends a text
        symbols[real] = codes + 1
        self.symbols, self.n = symbols, len(symbols)
        # Ranks of suffixes by their first 1, 2, 4, ... words, until the depth is passed; ties stand in text order.
        rank, size, at_depth = symbols, 1, symbols
        order = np.argsort(symbols, kind="stable")
        while size < depth:
            step = min(size, depth - size)
            ahead = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            key = rank * (int(rank.max()) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])]) + 1
            size += step
        self.suffixes, at_depth = order, rank
        self.edge = np.concatenate([[True], at_depth[order][1:] != at_depth[order][:-1]])
        self.group = np.cumsum(self.edge) - 1
        self.group_start = np.concatenate([np.flatnonzero(self.edge), [self.n]])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))])
        # The wavelet matrix of the transform: bits of each level, with the ones before each machine word.
        level_of, self.planes = symbols[order - 1].astype(np.uint32), []  # order 0's predecessor is the last end
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        for level in range(self.levels - 1, -1, -1):
            one = (level_of >> np.uint32(level)) & np.uint32(1) == 1
            packed = np.packbits(one, bitorder="little").tobytes()
            words = np.frombuffer(packed.ljust(-(-len(packed) // 8) * 8 + 8, b"\0"), "<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = level_of[~one]
            self.planes.append((words, before, len(zeros)))
            level_of = np.concatenate([zeros, level_of[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low = np.zeros_like(at)
        for k, (words, before, zeros) in enumerate(self.planes):
            bit = (symbol >> (self.levels - 1 - k)) & 1 == 1
            ends = []
            for x in (low, at):
                w = x >> 6
                ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                ends.append(np.where(bit, zeros + ones, x - ones))
            low, at = ends
        return at - low

    def statistics(self, patterns: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The group (interval of equal first `depth` words) of every window of the patterns, -1 where none of the index is equal.

        patterns: their numbers, joined. A pattern's windows stand at its first size - depth + 1 places. Patterns whose
        match breaks off begin again with the next word to the left, from the end of each window there.
        """
        code = np.searchsorted(self.alphabet, patterns)
        known = (code < len(self.alphabet)) & (self.alphabet[np.minimum(code, len(self.alphabet) - 1)] == patterns)
        code = np.where(known, code + 1, -1)
        out = np.full(len(patterns), -1, np.int64)
        ends = np.cumsum(sizes)
        at, stop = ends - 1, ends - sizes
        low, high, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n), np.zeros(len(sizes), np.int64)
        live = np.flatnonzero(sizes >= self.depth)
        # `right` is one past the last word of the match; it moves left only when a match breaks off.
        right = ends.copy()
        while len(live):
            symbol = code[at[live]]
            c = np.maximum(symbol, 0)
            new_low = self.first[c] + self.rank(c, low[live])
            new_high = self.first[c] + self.rank(c, high[live])
            good = (symbol > 0) & (new_low < new_high)
            on = live[good]
            low[on], high[on] = new_low[good], new_high[good]
            length[on] += 1
            full = on[length[on] >= self.depth]
            if len(full):
                group = self.group[low[full]]
                out[at[full]] = group
                low[full], high[full] = self.group_start[group], self.group_start[group + 1]
                # The next word would make depth + 1: the match is the window without its last word from now on.
                right[full] = at[full] + self.depth
                length[full] = self.depth - 1
            at[on] -= 1
            # A window that ends at `right` isn't there: the next one to try ends one word earlier, searched anew.
            off = live[~good]
            right[off] -= 1
            at[off], low[off], high[off], length[off] = right[off] - 1, 0, self.n, 0
            live = live[(at[live] >= stop[live]) & (right[live] - stop[live] >= self.depth)]
        return out

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """The smallest value of each group; values: one for each text."""
        owner = np.cumsum(self.symbols == 0) - (self.symbols == 0)
        return np.minimum.reduceat(values[owner][self.suffixes], self.group_start[:-1])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) -> the regions of each row."""
    for part, texts in slices(batches):
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        doc, s, n, anchor, region = regions(hashes_of([w for ws in cut for w in ws]), [len(ws) for ws in cut])
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(anchor), pa.array(region)], ["doc_id", "th", "s", "n", "anchor", "region"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted) -> the words of wanted regions; of crowded minimizers, hashes of their windows instead."""
    names = ["anchor", "region", "lo", "hi", "words", "off", "w1", "w2"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    for part, texts in slices(batches):
        out: list[list] = [[] for _ in names]
        for text, wanted in zip(texts, part.column(1).to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()
            for x in wanted:
                head = [x["anchor"], x["region"], x["lo"], x["hi"]]
                if not x["crowded"]:
                    rows = [[*head, b" ".join(words[x["s"] : x["s"] + x["n"] + WINDOW - 1]), None, None, None]]
                else:
                    spans = [(k, b" ".join(words[x["s"] + k : x["s"] + k + WINDOW])) for k in range(x["n"])]
                    rows = [[*head, None, k, *[xxhash.xxh64_intdigest(b, seed) - (1 << 63) for seed in (0, 1)]] for k, b in spans]
                for row in rows:
                    for column, value in zip(out, row):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def _report(rows: list[tuple]) -> pa.RecordBatch:
    """One shard: rows (anchor, region, lo, hi, words) -> runs of windows with their smallest document, if that is before hi."""
    texts = [hashes_of(r[4].split(b" ")) for r in rows]
    low, sizes = np.array([r[2] for r in rows]), np.array([len(t) for t in texts])
    fm = FMIndex(texts)
    groups = fm.statistics(np.concatenate(texts), sizes)
    least, out, at = fm.smallest(low), [[] for _ in range(5)], 0
    for row, size in zip(rows, sizes.tolist()):
        found = least[groups[at : at + size - WINDOW + 1]]
        at += size
        if found.min() >= row[3]:
            continue
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        for column, value in zip(out, (row[0], row[1], first, np.diff(np.concatenate([first, [len(found)]])), found[first])):
            column.append(value)
    lists = lambda xs, t: pa.array(xs, pa.list_(t))
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), lists(out[2], pa.int32()), lists(out[3], pa.int32()), lists(out[4], pa.int64())], ["anchor", "region", "off", "len", "least"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimizer -> the reports of shards of whole minimizers."""
    rows, weight = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if weight >= SHARD_WORDS and row[0] != rows[-1][0]:
                yield _report(rows)
                rows, weight = [], 0
            if not rows or rows[-1][:2] != row[:2]:
                rows.append(row)
                weight += row[4].count(b" ") + 2
    if rows:
        yield _report(rows)


REPORT = "anchor long, region long, off array<int>, len array<int>, least array<long>"


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans) for rows of docs (doc_id long, th long, text) that lose words: spans are array<struct<s, e>> of words."""
    texts = docs.where("doc_id is not null").select("doc_id", "th", "text")
    # Equal rows are searched once; mostly there are none, and no text is shuffled.
    repeated = stored(texts.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if repeated.limit(1).count():
        once = texts.join(repeated, ["doc_id", "th"], "left_semi").groupBy("doc_id", "th").agg(F.min("text").alias("text"))
        texts = texts.join(repeated, ["doc_id", "th"], "left_anti").unionByName(once)
    found = stored(texts.mapInArrow(_find, "doc_id long, th long, s int, n int, anchor long, region long"), "regions")
    # Stored, so that the join below has plain exchanges on both sides, whose skewed partitions Spark can split.
    several = stored(found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("anchor"), "several")
    shared = stored(found.join(several, "anchor"), "shared")
    distinct = shared.groupBy("anchor", "region").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "th", "s", "n")).alias("x"))
    crowds = stored(shared.groupBy("anchor", "region").count().groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor"), "crowds").withColumn("crowded", F.lit(True))
    wanted = distinct.join(crowds, "anchor", "left").select("x.*", "anchor", "region", "lo", "hi", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "n", "anchor", "region", "lo", "hi", "crowded")).alias("wanted"))
    fetched = texts.join(wanted, ["doc_id", "th"]).select("text", "wanted").mapInArrow(_fetch, "anchor long, region long, lo long, hi long, words binary, off int, w1 long, w2 long")
    fetched = stored(fetched, "fetched")
    whole = fetched.where("words is not null").select("anchor", "region", "lo", "hi", "words").repartition("anchor").sortWithinPartitions("anchor", "region")
    reports = whole.mapInArrow(_shards, REPORT)
    single = fetched.where("words is null").select("anchor", "region", "lo", "hi", "off", "w1", "w2").distinct()
    least = single.groupBy("w1", "w2").agg(F.min("lo").alias("least"))
    single = single.join(least, ["w1", "w2"]).where("least < hi").groupBy("anchor", "region").agg(F.collect_list(F.struct("off", "least")).alias("x"))
    single = single.select("anchor", "region", F.col("x.off").alias("off"), F.transform("x", lambda x: F.lit(1)).alias("len"), F.col("x.least").alias("least"))
    reports = stored(reports.union(single), "reports")
    runs = shared.join(reports, ["anchor", "region"]).select("doc_id", "th", "s", F.explode(F.arrays_zip("off", "len", "least")).alias("x")).where("x.least < doc_id")
    begin = F.col("s") + F.col("x.off")
    return runs.select("doc_id", "th", F.struct(begin.alias("s"), (begin + F.col("x.len") + (WINDOW - 1)).alias("e")).alias("x")).groupBy("doc_id", "th").agg(F.collect_list("x").alias("spans"))


def cut(docs: DataFrame) -> DataFrame:
    """All columns of docs in a struct `row`, with n_words, n_removed and kept (the kept words, joined by one space)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row"))
    lost = spans(rows.select("doc_id", "th", "text")).withColumnRenamed("doc_id", "lost_id").withColumnRenamed("th", "lost_th")
    joined = rows.join(lost, (F.col("doc_id") == F.col("lost_id")) & (F.col("th") == F.col("lost_th")), "left").select("text", "spans", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            kept, total, removed = [], [], []
            for text, gone in zip(texts, part.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                total.append(len(words))
                if gone:
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, [x["s"] for x in gone], 1)
                    np.add.at(change, [x["e"] for x in gone], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["text", "row", "n_words", "n_removed", "kept"])

    fields = [joined.schema["text"], joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of docs (doc_id, text)."""
    return cut(docs.select("doc_id", "text")).select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text; texts that lose nothing stay as they are. n_chars, if there, follows."""
    done = cut(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    own = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row")["n_chars"])}
    return done.select(*[(own[c] if c in own else F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


#: The same by comparing every window with every other.
SQL = rf"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
x as (select r, doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') as s from (select r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from d where len(w) >= {WINDOW} and doc_id is not null)),
m as (select s, min(doc_id) as lo from x group by 1),
c as (select distinct r, unnest(range(i, i + {WINDOW})) as p from x join m using (s) where lo < doc_id),
g as (select r, list(p) as ps from c group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(case when ps is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda k: not list_contains(ps, k)), lambda k: w[k]) end, ' '), '')) as kept_sha256
from d left join g using (r)
"""
