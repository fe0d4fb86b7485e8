"""WARC shards with a Merkle fixity audit.

Pages in ascending id order become WARC/1.1 records, one gzip member each, cut into shards. The leaves of a shard's tree are
hashes of a record's stored bytes and of its offset range; a node's hash covers its two children's hashes and their whole range.
Replicas are compared by their roots; only where roots differ are the trees walked, and only down the branches that
differ, to the records that are corrupt. Shards are rows of a table (one to a file) written by Spark's own committer, so
any store works; `files` gives a shard's bytes, which any WARC reader opens.

Cases: null urls and texts count as empty; null ids are written as nothing; repeated rows are separate records; an empty
table gives no shards; a shard that one replica lacks is corrupt as a whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Records and bytes of text after which a shard ends.
SHARD_RECORDS, SHARD_BYTES = 4000, 32 << 20
#: The query's replica is damaged in records whose page id's crc32 this divides.
DAMAGED = 97
DATE = "2020-01-01T00:00:00Z"
SHARD = "part int, seq int, ids array<long>, offsets array<long>, payload binary"


def record(page_id: int | None, url: str | None, html: str, date: str = DATE) -> bytes:
    """One resource record. Its id follows from the page's id and url; a line end in the url is percent-encoded."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body, name = html.encode("utf-8", "surrogatepass"), "" if page_id is None else str(page_id)
    own = uuid.UUID(hashlib.md5(f"{name} {url or ''}".encode()).hexdigest())
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Target-URI: {url or ''}", f"WARC-Date: {date}", f"WARC-Record-ID: <urn:uuid:{own}>", "Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse(data: bytes) -> tuple[str, str] | None:
    """(url, html) of a record, None if it isn't one."""
    head, found, rest = data.partition(b"\r\n\r\n")
    size = re.search(rb"\r\nContent-Length: (\d+)", head)
    url = re.search(rb"\r\nWARC-Target-URI: ([^\r]*)", head)
    if not (found and size and url and head.startswith(b"WARC/")):
        return None
    return url[1].decode("utf-8", "replace"), rest[: int(size[1])].decode("utf-8", "replace")


def tree(payload: bytes, offsets: list[int]) -> list[list[bytes]]:
    """Levels from the leaves to the root; a node without a sibling is carried up as it is."""
    spans = list(zip(offsets[:-1], offsets[1:]))
    level = [hashlib.sha256(b"leaf" + struct.pack("<qq", s, e) + payload[s : e if e != offsets[-1] else None]).digest() for s, e in spans]
    levels = [level]
    while len(level) > 1:
        level = [hashlib.sha256(b"node" + b"".join(level[k : k + 2])).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        levels.append(level)
    return levels


def descend(a: list[list[bytes]], b: list[list[bytes]]) -> tuple[list[int], int]:
    """The leaves that differ or are in one tree only, and how many nodes were compared on the way down.

    A node at height d stands for 2 ** d records from a place on. Where both trees have all of these the nodes are compared, and
    branches that are equal are left; where a tree ends in them, the way goes on to their halves.
    """
    n, m = len(a[0]), len(b[0])
    both, front, seen = min(n, m), [0], 0
    for depth in range(max(len(a), len(b)) - 1, -1, -1):
        differ = []
        for k in front:
            if (k + 1) << depth <= both or n == m:
                seen += 1
                if a[depth][k] == b[depth][k]:
                    continue
            differ.append(k)
        front = [c for k in differ for c in (2 * k, 2 * k + 1) if c << (depth - 1) < max(n, m)] if depth else differ
    return front, seen


def flat(levels: list[list[bytes]]) -> bytes:
    return b"".join(x for level in levels for x in level)


def levels_of(data: bytes, leaves: int) -> list[list[bytes]]:
    out, at = [], 0
    while True:
        out.append([data[at + 32 * k : at + 32 * k + 32] for k in range(leaves)])
        at += 32 * leaves
        if leaves <= 1:
            return out
        leaves = -(-leaves // 2)


def write(pages: DataFrame, label: str = "warc") -> DataFrame:
    """The shards of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, members, weight = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            offsets = [0]
            for m in members:
                offsets.append(offsets[-1] + len(m))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(members)], pa.binary())], ["part", "seq", "ids", "offsets", "payload"])

        for piece, texts in slices(batches, "html"):
            for page_id, url, html in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts):
                ids.append(page_id)
                members.append(member(record(page_id, url, html)))
                weight += len(html)
                if len(ids) >= SHARD_RECORDS or weight >= SHARD_BYTES:
                    yield flush()
                    seq, ids, members, weight = seq + 1, [], [], 0
        if ids:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("h", F.xxhash64("url", "html"))
    ordered = rows.repartitionByRange("page_id", "h").sortWithinPartitions("page_id", "h").select("page_id", "url", "html")
    return replicate(ordered.mapInArrow(run, SHARD), label)


def replicate(shards: DataFrame, label: str = "warc") -> DataFrame:
    """The shards written once more, one to a file."""
    return stored(shards, label, maxRecordsPerFile=1)


def files(shards: DataFrame) -> DataFrame:
    """(name, payload) of each shard."""
    return shards.select(F.format_string("part-%05d-%05d.warc.gz", "part", "seq").alias("name"), "payload")


def read_records(shards: DataFrame) -> DataFrame:
    """(part, seq, place, page_id, url, html, length, sha256) of each record; url and html are null where a record can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, ids, offsets, payload in zip(*[c.to_pylist() for c in batch.columns]):
                for at in range(0, len(ids), 256):
                    rows = []
                    for k in range(at, min(at + 256, len(ids))):
                        try:
                            data = zlib.decompress(payload[offsets[k] : offsets[k + 1]], 31)
                        except zlib.error:
                            data = b""
                        rows.append((part, seq, k, ids[k], *(parse(data) or (None, None)), len(data), hashlib.sha256(data).hexdigest()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], ["part", "seq", "place", "page_id", "url", "html", "length", "sha256"])

    return shards.select("part", "seq", "ids", "offsets", "payload").mapInArrow(run, "part int, seq int, place int, page_id long, url string, html string, length long, sha256 string")


def trees(shards: DataFrame) -> DataFrame:
    """(part, seq, leaves, root, nodes) of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, seq, offsets, payload = (c.to_pylist() for c in batch.columns)
            made = [tree(p, o) for p, o in zip(payload, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(seq, pa.int32()), pa.array([len(x[0]) for x in made], pa.int32()), pa.array([x[-1][0] for x in made], pa.binary()), pa.array(map(flat, made), pa.binary())], ["part", "seq", "leaves", "root", "nodes"])

    return shards.select("part", "seq", "offsets", "payload").mapInArrow(run, "part int, seq int, leaves int, root binary, nodes binary")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(part, seq, place, compared) of every record that differs between two replicas' trees; compared: nodes looked at in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part, seq, n, x, m, y in zip(*[c.to_pylist() for c in batch.columns]):
                bad, seen = descend(levels_of(x, n), levels_of(y, m)) if x and y else (range(n or m), 1)
                out += [(part, seq, k, seen) for k in bad]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "seq", "place", "compared"])

    a = first.select("part", "seq", "leaves", "root", "nodes")
    b = second.select("part", "seq", F.col("leaves").alias("leaves_b"), F.col("root").alias("root_b"), F.col("nodes").alias("nodes_b"))
    differ = a.join(b, ["part", "seq"], "full_outer").where(~F.col("root").eqNullSafe(F.col("root_b")))
    return differ.select("part", "seq", "leaves", "nodes", "leaves_b", "nodes_b").mapInArrow(run, "part int, seq int, place int, compared long")


def damaged(shards: DataFrame, every: int = DAMAGED) -> DataFrame:
    """The shards with a byte changed in the middle of each record whose page id's crc32 `every` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, offsets, payload = row.column(2)[0].as_py(), row.column(3)[0].as_py(), bytearray(row.column(4)[0].as_py())
                for place, page_id in enumerate(ids):
                    if page_id is not None and zlib.crc32(str(page_id).encode()) % every == 0:
                        payload[(offsets[place] + offsets[place + 1]) // 2] ^= 255
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([bytes(payload)], pa.binary())], row.schema.names)

    return shards.mapInArrow(run, SHARD)


def fixity(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC with a second replica that has planted damage, audits that against the first, which it reads:
    page_id, record_length, record_sha256, and intact, whether the replica has the record unharmed."""
    shards = write(pages)
    copy = replicate(damaged(shards), "warc-replica")
    bad = audit(trees(shards), trees(copy)).select("part", "seq", "place", F.lit(True).alias("bad"))
    rows = read_records(shards).select("part", "seq", "place", "page_id", "length", "sha256")
    return rows.join(bad, ["part", "seq", "place"], "left").select("page_id", F.col("length").alias("record_length"), F.col("sha256").alias("record_sha256"), F.col("bad").isNull().alias("intact"))


#: crc32 of the id's decimal text.
CRC_SQL = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(page_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint)"
SQL = f"""
with p as (select page_id, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') as u, coalesce(html, '') as h, md5(coalesce(page_id::varchar, '') || ' ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A')) as m, chr(13) || chr(10) as n from pages),
r as (select page_id, 'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Target-URI: ' || u || n || 'WARC-Date: {DATE}' || n || 'WARC-Record-ID: <urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' || n
  || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(h)::varchar || n || n || h || n || n as t from p)
select page_id, cast(strlen(t) as bigint) as record_length, sha256(t) as record_sha256, page_id is null or {CRC_SQL} % {DAMAGED} <> 0 as intact from r
"""
