"""Merkle manifests: every row a leaf, a tree for each group of rows, and a tree over the groups' roots.

Leaves are numbered in order by a range partitioning, whatever their number, and cut into aligned blocks of at most BLOCK
(a power of the fanout). A block is a contiguous numpy matrix of hex digests, 64 bytes to a row; its rows are taken
`fanout` at a time and hashed level by level up to the block's one node, and these nodes are the next leaves, until a
tree has one. As blocks are aligned, a node of a block is the node that the whole tree has there. Proofs go the other
way: a block's rows find their siblings on all levels by index arithmetic, and what stands above the block is shared.
A group's tree can hold any share of the rows, as no task sees more than a block of it.

Cases: a null value is written as `-`, so null and empty differ; null groups are one group, the first; null ids come first,
rows with equal ids go by their leaf, and equal rows each have a leaf; a group of one row has that leaf as its root, and a
lone group's root is the whole root; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read_cell, stored

FANOUT, BLOCK = 2, 4096
#: Rows that a range of the numbering has about.
RANGE = 200_000
#: Bytes of a digest in hex.
WIDE = 64
PROOF = "array<struct<left: string, right: string>>"


def leaf(*values: Column) -> Column:
    """sha256 in hex of the values, each as its length in bytes, a colon and its text, or - for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a digest gives with the siblings of its proof."""
    return F.aggregate(proof, start, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]).cast("binary"), 256))


def joined(proof: Column) -> Column:
    """All siblings of a proof in one text."""
    return F.array_join(F.transform(proof, lambda at: F.concat(at["left"], at["right"])), "")


def block_of(fanout: int, most: int = BLOCK) -> int:
    """The largest power of the fanout that is at most `most`, or the fanout itself."""
    size = fanout
    while size * fanout <= most:
        size *= fanout
    return size


def levels(leaves: np.ndarray, fanout: int, until: int | None) -> list[np.ndarray]:
    """Digest matrices from the leaves up: `until` levels above them, or up to one node."""
    out = [np.ascontiguousarray(leaves)]
    while len(out) <= until if until is not None else len(out[-1]) > 1:
        data, step = memoryview(out[-1]).cast("B"), fanout * WIDE
        digests = [hashlib.sha256(data[at : at + step]).hexdigest() for at in range(0, len(data), step)]
        out.append(np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, WIDE))
    return out


def siblings(matrices: list[np.ndarray], fanout: int, above: list[tuple[bytes, bytes]]) -> pa.Array:
    """A proof for each leaf: its run's others on each level (left and right of it), then what stands above all of them."""
    n, depth = len(matrices[0]), len(matrices) - 1
    base = np.cumsum([0, *map(len, matrices)])
    rows = [np.frombuffer(x, np.uint8).reshape(-1, WIDE) for pair in above for x in pair]
    stack, own = np.concatenate([*matrices, *rows]), np.arange(n)
    begin, count = ([np.zeros((n, depth + len(above)), np.int64) for _ in range(2)] for _ in range(2))
    for k in range(depth):
        first = own // fanout * fanout
        end = np.minimum(first + fanout, len(matrices[k]))
        begin[0][:, k], count[0][:, k] = base[k] + first, own - first
        begin[1][:, k], count[1][:, k] = base[k] + own + 1, end - own - 1
        own = own // fanout
    at = base[-1]
    for k, pair in enumerate(above, depth):
        for side, x in enumerate(pair):
            begin[side][:, k], count[side][:, k] = at, len(x) // WIDE
            at += len(x) // WIDE
    texts = []
    for b, c in zip(begin, count):
        b, c = b.ravel(), c.ravel()
        ends = np.cumsum(c)
        rows = np.repeat(b - (ends - c), c) + np.arange(ends[-1] if len(ends) else 0)
        offsets = np.concatenate([[0], ends * WIDE]).astype(np.int32)
        texts.append(pa.StringArray.from_buffers(len(c), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(stack[rows]))))
    lists = np.arange(n + 1, dtype=np.int32) * (depth + len(above))
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(texts, ["left", "right"]))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, ...) with pos, from 0 in each tree by the order, and total, the tree's number of rows.

    Ranges of the whole order are sorted one by one and their parts of a tree counted; a row's place is its place in its
    range's part and what the ranges before hold of the tree. No tree is sorted in one task.
    """
    spark = rows.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, -(-rows.count() // RANGE))
    own = rows.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order)
    own = stored(own.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "ranges")
    parts = own.groupBy("tree", "range").agg(F.count("*").alias("many"), F.min("place").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("many").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(parts.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("many").over(tree).alias("total")), "starts")
    return own.join(starts, ["tree", "range"]).withColumn("pos", F.col("place") + F.col("shift")).drop("range", "place", "shift")


def matrix(table: pa.Table, column: str) -> tuple[pa.Table, np.ndarray]:
    """A block's rows in order of pos, and their digests as a matrix."""
    table = table.sort_by("pos").combine_chunks()
    data = table.column(column).combine_chunks()
    return table, np.frombuffer("".join(data.to_pylist()).encode(), np.uint8).reshape(-1, WIDE)


def _levels(table: pa.Table, digests: np.ndarray, fanout: int, block: int) -> list[np.ndarray]:
    """A block's levels: up to one node if it is the whole tree, else as many as a full block has."""
    whole, until = table.column("total")[0].as_py() <= block, 0
    while fanout**until < block:
        until += 1
    return levels(digests, fanout, None if whole else until)


def risen(nodes: DataFrame, fanout: int, block: int) -> DataFrame:
    """The blocks' own nodes as (tree, pos, total, digest) of the level above, stored."""

    def run(table: pa.Table) -> pa.Table:
        table, digests = matrix(table, "digest")
        top = _levels(table, digests, fanout, block)[-1]
        total = -(-table.column("total")[0].as_py() // block)
        return pa.table({"tree": table.column("tree")[:1], "pos": [table.column("block")[0].as_py()], "total": [total], "digest": [top.tobytes().decode()]})

    cut = nodes.select("tree", "pos", "total", "digest", F.floor(F.col("pos") / block).alias("block"))
    return stored(cut.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, total long, digest string"), "nodes")


def climb(nodes: DataFrame, fanout: int, block: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks, from the leaves on, and (tree, digest) of every tree's root.

    A tree that one block holds ends there; the others go on with a node for each block.
    """
    out, roots = [nodes], None
    while True:
        above = risen(out[-1], fanout, block)
        done = above.where("total = 1").select("tree", "digest")
        roots = done if roots is None else roots.union(done)
        more = above.where("total > 1")
        if not more.limit(1).count():
            return out, roots
        out.append(more)


def descend(nodes: DataFrame, above: DataFrame, keep: dict[str, str], fanout: int, block: int) -> DataFrame:
    """nodes (tree, pos, total, digest, kept columns) with their proof, by the proofs of their blocks.

    above: (tree, block, proof, subroot, root) for each block; the kept columns have the types given.
    """

    def run(table: pa.Table, up: pa.Table) -> pa.Table:
        table, digests = matrix(table, "digest")
        pairs = [(at["left"].encode(), at["right"].encode()) for at in read_cell(up, "proof")]
        proof = siblings(_levels(table, digests, fanout, block), fanout, pairs)
        shared = {c: pa.array([read_cell(up, c)] * len(table), pa.string()) for c in ("subroot", "root")}
        return pa.table({c: table.column(c) for c in ("tree", "pos", "total", "digest", *keep)} | {"proof": proof} | shared)

    schema = "tree string, pos long, total long, digest string, " + "".join(f"{c} {t}, " for c, t in keep.items()) + f"proof {PROOF}, subroot string, root string"
    cut = nodes.select("tree", "pos", "total", "digest", *keep, F.floor(F.col("pos") / block).alias("block"))
    return cut.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(run, schema)


def prove(rows: DataFrame, order: list[str], keep: list[str], fanout: int = FANOUT, most: int = BLOCK) -> DataFrame:
    """rows (tree string, order and kept columns, digest) to the kept columns, digest, proof, subroot and root, a row each.

    Trees stand in the bytewise order of their names. proof has the siblings of each level up to the root, left and right of
    the path; `folded` gives the root from a digest and its proof, and `joined` the proof as one text.
    """
    block = block_of(fanout, most)
    rows = stored(rows.select("tree", *dict.fromkeys([*order, *keep]), "digest").withColumn("row", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(rows, [*order, "digest", "row"])
    own, subroots = climb(stored(leaves, "numbered"), fanout, block)
    groups = numbered(stored(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots"), ["name"])
    tops, whole = climb(stored(groups, "groups"), fanout, block)
    none = F.array().cast(PROOF)
    above = whole.select("tree", F.lit(0).cast("long").alias("block"), none.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(tops):
        keeps = {"name": "string"} if "name" in level.columns else {}
        at = stored(descend(level, above, keeps, fanout, block), "proofs")
        above = at.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root")
    named = at.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "proof", F.col("digest").alias("subroot"), "root")
    inner = None
    for level in reversed(own):
        ended = level.where(F.col("total") <= block).select("tree").distinct()
        start = named.join(ended, "tree", "left_semi")
        above = start if inner is None else start.union(inner)
        if level is not own[0]:
            inner = stored(descend(level, above, {}, fanout, block), "proofs").select("tree", F.col("pos").alias("block"), "proof", "subroot", "root")
    types = {c: rows.schema[c].dataType.simpleString() for c in keep}
    return descend(own[0], above, types, fanout, block).select(*keep, "digest", "proof", "subroot", "root")


def manifest(docs: DataFrame, altered: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Rows of documents, a tree for each lang in order of doc_id: doc_id, leaf, claim, proof, subroot, root.

    altered gives n_chars as another holder of the rows has it; claim is the leaf of what that holder has.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    value = {c: F.col(c) for c in columns}
    claim = leaf(*(value | {"n_chars": altered(docs)}).values()) if altered else leaf(*value.values())
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))  # null first, an empty name next
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(*value.values()).alias("digest"), claim.alias("claim"))
    return prove(rows, ["doc_id"], ["doc_id", "claim"]).withColumnRenamed("digest", "leaf")


def tampered(docs: DataFrame) -> Column:
    """n_chars, one more where 7 divides the id's crc32."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    return F.when(hit, docs["n_chars"] + 1).otherwise(docs["n_chars"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, the last two of the tampered rows."""
    out = manifest(docs, tampered)
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(joined(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded(F.col("claim"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _raised(name: str, before: str, by: str) -> str:
    """One level more in SQL: nodes (tree, p, n, d) to the nodes above; a tree of one node stays as it is."""
    return f"{name} as (select {by}, p // 2 as p, any_value((n + 1) // 2) as n, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by p)) end as d from {before} group by {by}, p // 2)"


def sql(depth: int = 24, groups: int = 8) -> str:
    """The same level by level, for trees of up to 2 ** depth rows and 2 ** groups trees."""
    value = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    made = lambda n: "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    crc = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint)"
    steps = [
        f"leaves as (select row_number() over () as r, doc_id, coalesce('+' || lang, '') as tree, {made('n_chars')} as leaf, case when doc_id is not null and {crc} % 7 = 0 then {made('(n_chars + 1)')} else {made('n_chars')} end as claim from documents)",
        "l0 as materialized (select r, doc_id, tree, claim, leaf as d, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as p, count(*) over (partition by tree) as n from leaves)",
        "w0 as (select r, doc_id, tree, p, n, d as leaf, claim as f, '' as proof from l0)",
    ]

    def walk(k: int, levels: str, rows: str, out: str, by: str) -> str:
        proof, f = "w.proof || coalesce(s.d, '')", "case when w.n = 1 then w.f when s.d is null then sha256(w.f) when w.p % 2 = 0 then sha256(w.f || s.d) else sha256(s.d || w.f) end"
        return f"{out} as (select w.* replace (w.p // 2 as p, (w.n + 1) // 2 as n, {proof} as proof, {f} as f) from {rows} w left join {levels} s on s.{by} = w.{by} and s.p = xor(w.p, 1) and w.n > 1)"

    for k in range(depth):
        steps += [_raised(f"l{k + 1}", f"l{k}", "tree").replace(" as (", " as materialized (", 1), walk(k, f"l{k}", f"w{k}", f"w{k + 1}", "tree")]
    steps.append(f"g0 as materialized (select 0 as one, tree, d, row_number() over (order by tree) - 1 as p, count(*) over () as n from l{depth})")
    steps.append(f"v0 as (select w.* replace (g.p as p, g.n as n), g.d as subroot, 0 as one from w{depth} w join g0 g using (tree))")
    for k in range(groups):
        steps += [_raised(f"g{k + 1}", f"g{k}", "one").replace(" as (", " as materialized (", 1), walk(k, f"g{k}", f"v{k}", f"v{k + 1}", "one")]
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, g.d as root, sha256(proof) as proof_sha256, f as folded_root, f = g.d as verified from v{groups} cross join g{groups} g"


SQL = sql()
