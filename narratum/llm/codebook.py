"""Product codes of vectors, learned and written over the distinct parts instead of the vectors.

Vectors become integers and are cut into PARTS consecutive parts. At each position equal parts collapse to one row with the
number of vectors that have it; Lloyd's rounds run over these weighted rows, and give exactly what rounds over all vectors
would. A task assigns its rows to the nearest entries and hands on one sum for each entry, so a round sends at most PARTS *
ENTRIES rows of each task. The finished codes and errors of the distinct parts are joined back to the vectors. A part that
at least one in SHARE of all has (there are at most SHARE such) is joined by broadcast, so that no key of the other join is hot.

Codebooks have PARTS * ENTRIES entries, whatever the table: only they come to the driver.

Cases: null and empty vectors and those with null or non-finite components are dropped, and so are vectors of another length
than the one with the smallest id; a length that PARTS doesn't divide gives parts that differ by one; integers beyond LIMIT
are cut to it, so that sums fit 64 bits; repeated ids and equal vectors each get a row, ties of the first ENTRIES go by the
vector; null ids come last; fewer vectors than ENTRIES give smaller codebooks; equal labels are added up, nulls together; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
#: Keys that one in so many rows has are joined by broadcast; rows whose distances are taken at a time.
SHARE, ROWS = 4096, 4096


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """(row, vec_id, label, v array<long>) of the vectors that take part, stored."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT))
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, whole).alias("v"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def cut(v: Column, dim: int) -> Column:
    """An array of (pos, part) of a vector."""
    ends = [dim * k // PARTS for k in range(PARTS + 1)]
    return F.array(*[F.struct(F.lit(k).alias("pos"), F.slice(v, s + 1, e - s).alias("part")) for k, (s, e) in enumerate(zip(ends, ends[1:]))])


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, the first of equals."""
    index, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for at in range(0, len(parts), ROWS):
        x = parts[at : at + ROWS]
        distance = np.zeros((len(x), len(entries)), np.int64)
        for k in range(parts.shape[1]):
            distance += (x[:, k, None] - entries[None, :, k]) ** 2
        own = distance.argmin(axis=1)
        index[at : at + ROWS], error[at : at + ROWS] = own, distance[np.arange(len(x)), own]
    return index, error


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(pos, rows of the batch, their parts) for each position in a batch (pos, part, ...)."""
    pos, lists = batch.column(0).to_numpy(), batch.column(1)
    starts, flat = lists.offsets.to_numpy()[:-1].astype(np.int64), lists.values.to_numpy()
    width = np.diff(lists.offsets.to_numpy())
    for p in np.unique(pos):
        rows = np.flatnonzero(pos == p)
        yield int(p), rows, flat[starts[rows][:, None] + np.arange(width[rows[0]])[None, :]]


def lloyd(weighted: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round over (pos, part, n): each entry becomes the mean of its parts, rounded down; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            n = batch.column(2).to_numpy()
            for pos, rows, parts in _by_position(batch):
                own, _ = nearest(parts, books[pos])
                np.add.at(sums[pos], own, parts * n[rows][:, None])
                np.add.at(counts[pos], own, n[rows])
        out = [(p, int(e), int(counts[p][e]), sums[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["pos", "entry", "n", "total"])

    sums = weighted.mapInArrow(run, "pos int, entry int, n long, total array<long>").select("pos", "entry", "n", F.posexplode("total").alias("k", "x"))
    new = [b.copy() for b in books]
    for r in sums.groupBy("pos", "entry", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():  # at most ENTRIES vectors
        new[r.pos][r.entry, r.k] = r.x // r.n
    return new


def coded(weighted: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(pos, part, n, code, err) of the distinct parts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, err = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for pos, rows, parts in _by_position(batch):
                code[rows], err[rows] = nearest(parts, books[pos])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(err)], [*batch.schema.names, "code", "err"])

    return stored(weighted.mapInArrow(run, "pos int, part array<long>, n long, code int, err long"), "codes")


def matched(rows: DataFrame, few: DataFrame, by: list[str], total: int) -> DataFrame:
    """rows (pre-aggregated into few's n) joined with few by columns that may be null; hot keys by broadcast."""
    # Null-safe by a struct: a struct of nulls isn't null.
    keyed = lambda df: df.withColumn("__by", F.struct(*by)) if len(by) == 1 else df
    on = ["__by"] if len(by) == 1 else by
    small = keyed(few).drop(*(by if len(by) == 1 else []))
    hot = F.broadcast(small.where(F.col("n") * SHARE >= total).drop("n"))  # at most SHARE keys
    cold = small.where(F.col("n") * SHARE < total).drop("n")
    rows = keyed(rows)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(cold, on)).drop("__by")


def first_books(rows: DataFrame, dim: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    v = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    return [v[:, dim * k // PARTS : dim * (k + 1) // PARTS] for k in range(PARTS)]


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows of (vec_id, label, vector) to (vec_id, label, codes array<int>, error long), and the codebooks by position."""
    rows = kept(vectors, vector)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("dim")).first()
    dim = first.dim if first else PARTS
    rows = rows.where(F.size("v") == dim)
    parts = rows.select("row", "vec_id", "label", F.explode(cut(F.col("v"), dim)).alias("x")).select("row", "vec_id", "label", "x.pos", "x.part")
    books = first_books(rows, dim)
    weighted = stored(parts.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        books = lloyd(weighted, books)
    total = rows.count() * PARTS
    back = stored(matched(parts, coded(weighted, books), ["pos", "part"], total).select("row", "vec_id", "label", "pos", "code", "err"), "coded")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])  # PARTS of a row
    return back.groupBy("row", "vec_id", "label").agg(codes.alias("codes"), F.sum("err").alias("error")).drop("row"), books


def decode(codes: DataFrame, books: list[np.ndarray], column: str = "codes") -> DataFrame:
    """codes with `restored`: the vector that the codebooks give, in the original scale."""
    table = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in e]) for e in b]) for b in books])
    parts = F.zip_with(table, F.col(column), lambda b, c: F.get(b, c))
    return codes.withColumn("restored", F.transform(F.flatten(parts), lambda x: (x + 0.5) / SCALE))


def fingerprint(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components, by position, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each vector that takes part."""
    rows, books = compress(vectors.select("vec_id", "embedding", "label"))
    rows = stored(rows, "compressed")
    labels = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = matched(rows, labels, ["label"], rows.count())
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The same over all vectors, for tables whose vectors have one length that PARTS divides."""
    pick = f"cast(greatest(least(floor({SCALE} * x::double), {LIMIT}), -{LIMIT}) as bigint)"
    down = "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint"
    steps = [
        "k as (select vec_id, label, embedding as x from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0)",
        f"r as (select row_number() over (order by vec_id nulls last, v) - 1 as r, vec_id, label, v, len(v) // {PARTS} as w from (select vec_id, label, list_transform(x, lambda x: {pick}) as v from k))",
        "p as materialized (select r, i // w as pos, i % w as c, x from (select r, w, unnest(v) as x, unnest(range(0, len(v))) as i from r))",
        f"b0 as materialized (select r as e, pos, c, x from p where r < {ENTRIES})",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} as (select p.r, p.pos, b.e, sum((p.x - b.x) * (p.x - b.x)) as d from p join b{k} b on b.pos = p.pos and b.c = p.c group by 1, 2, 3)")
        steps.append(f"a{k} as materialized (select r, pos, min({{'d': d, 'e': e}}) as m from d{k} group by 1, 2)")
        if k < rounds:
            steps.append(f"m{k} as (select a.m.e as e, p.pos, p.c, {down} as x from p join a{k} a using (r, pos) group by 1, 2, 3)")
            steps.append(f"b{k + 1} as materialized (select b.e, b.pos, b.c, coalesce(m.x, b.x) as x from b{k} b left join m{k} m using (e, pos, c))")
    steps.append(f"o as (select r, string_agg(printf('%02x', m.e), '' order by pos) as code, cast(sum(m.d) as bigint) as error from a{rounds} group by 1)")
    steps.append(f"f as (select sha256(string_agg(x::varchar, ',' order by pos, e, c)) as h from b{rounds})")
    return f"with {', '.join(steps)} select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, f.h as codebooks_sha256 from r join o using (r) cross join f"


SQL = sql()
