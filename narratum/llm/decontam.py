"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

An item is contained in a document if at least CONTAINMENT of its distinct word shingles occur there. Items are short
and documents long, so their resemblance is small and a fixed MinHash sketch would miss; instead the items are
partitioned by size, and each partition keeps as its sketch the k smallest shingle hashes (a bottom-k MinHash), where k is
one more than the shingles that an item of the partition's largest size may lack. An item that is contained then shares at
least one sketch hash with the document: the search loses none. Candidates are verified by exact containment, shingle by
shingle as text, over the whole document.

Words are runs of letters, digits and non-ASCII characters of the lower-cased text. A document is hashed once, in one
generated loop, and probes the sketches; they are broadcast if their number is at most BROADCAST_ROWS, else joined by a shuffle.

Cases: null and empty texts have no shingles and are never contained or containing; an item with fewer words than a
shingle is one shingle of its own length; repeated items give rows each under their id; repeated document ids count as one
document; null ids are ignored; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE, CONTAINMENT = 5, 0.8
#: Rows of items' shingles (some 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; an empty array for null and empty texts."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAKS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def _hash(at: Column, size: int) -> Column:
    """The hash of the shingle that begins at place `at` of the column words."""
    return F.xxhash64(F.lit(size), *[F.get("words", at + k) for k in range(size)])


def _text(at: Column, size: int) -> Column:
    return F.concat_ws(" ", *[F.get("words", at + k) for k in range(size)])


def _shingles(rows: DataFrame, size: int) -> DataFrame:
    """rows (with words) once for each place `at` of a shingle of that size."""
    return rows.where(F.size("words") >= size).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - size)))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, h, shingle, n, in_sketch): the distinct shingles of each item, stored."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words"))
    parts = None
    for size in range(SHINGLE, 0, -1):
        own = items if size == SHINGLE else items.where(F.size("words") == size)
        at = F.col("at")
        part = _shingles(own, size).select("item_id", F.lit(size).alias("size"), _hash(at, size).alias("h"), _text(at, size).alias("shingle"))
        parts = part if parts is None else parts.union(part)
    hashes = parts.distinct()
    # Partitions by size: powers of two; k for the largest size of the partition keeps the search lossless for all of it.
    sizes = hashes.groupBy("item_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("h")).alias("hs"))
    largest = F.pow(F.lit(2), F.ceil(F.log2("n"))) 
    k = (F.floor(largest * (1 - CONTAINMENT) + 1e-9) + 1).cast("int")
    sketched = sizes.select("item_id", "n", F.array_max(F.slice("hs", F.lit(1), F.least(k, F.size("hs")))).alias("limit"))
    return stored(hashes.join(sketched, "item_id").select("item_id", "size", "h", "shingle", "n", (F.col("h") <= F.col("limit")).alias("in_sketch")), "items")


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every item contained in a document."""
    items = item_shingles(benchmark)
    bounded = items.count() <= BROADCAST_ROWS
    small = F.broadcast if bounded else lambda df: df
    lengths = [r.size for r in items.select("size").distinct().collect()]  # 5 at most
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
    sketch = small(items.where("in_sketch").select("h", "item_id").distinct())
    candidates = None
    for size in lengths:
        found = _shingles(texts, size).select("doc_id", _hash(F.col("at"), size).alias("h")).join(sketch, "h").select("doc_id", "item_id")
        candidates = found if candidates is None else candidates.union(found)
    if candidates is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
    candidates = stored(candidates.distinct(), "candidates")
    suspects = texts.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = None
    for size in lengths:
        found = _shingles(suspects, size).select("doc_id", _hash(F.col("at"), size).alias("h"), _text(F.col("at"), size).alias("shingle"))
        found = found.join(small(items.select("h", "shingle", "item_id")), ["h", "shingle"]).select("doc_id", "item_id", "shingle")
        shared = found if shared is None else shared.union(found)
    counts = shared.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = items.groupBy("item_id").agg(F.first("n").alias("n_shingles"))
    return (
        counts.join(candidates, ["doc_id", "item_id"]).join(sizes, "item_id")
        .withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= CONTAINMENT)
        .select("doc_id", "item_id", F.col("n_shingles").cast("long").alias("n_shingles"), "n_shared", "containment")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no benchmark item."""
    dirty = contained(docs, benchmark).select(F.col("doc_id").alias("dirty_id")).distinct()
    return docs.join(dirty, docs["doc_id"].cast("long") == dirty["dirty_id"], "left_anti")


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text contains the text of a benchmark row, whatever their ids, left out."""
    key = F.xxhash64("text")
    items = benchmark.where("text is not null").select(key.alias("item_id"), "text").dropDuplicates(["item_id"])
    dirty = contained(docs.where("text is not null").select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("__dirty")).distinct()
    return docs.join(dirty, F.xxhash64(docs["text"]) == dirty["__dirty"], "left_anti")


SQL = rf"""
with d as (select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as t from documents where doc_id is not null),
b as (select item_id, trim(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as t from benchmark where item_id is not null),
dw as (select doc_id, string_split(t, ' ') as w from d where t <> ''), bw as (select item_id, string_split(t, ' ') as w from b where t <> ''),
bi as (select item_id, w, least(len(w), {SHINGLE}) as k from bw),
bs as (select distinct item_id, array_to_string(w[i : i + k - 1], ' ') as s from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from bi)),
bn as (select item_id, count(*) as n from bs group by 1),
ks as (select distinct k from bi),
ds as (select distinct doc_id, array_to_string(w[i : i + k - 1], ' ') as s from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, ks where len(w) >= k)),
m as (select doc_id, item_id, count(*) as c from ds join bs using (s) group by 1, 2)
select doc_id, item_id, cast(n as bigint) as n_shingles, cast(c as bigint) as n_shared, c::double / n as containment
from m join bn using (item_id) where c::double / n >= {CONTAINMENT}
"""
