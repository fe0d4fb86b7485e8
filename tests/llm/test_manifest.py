import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from narratum.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def rows():
    rng = random.Random(3)
    out = [(k, "é" * rng.randrange(40), "en" if rng.random() < 0.7 else rng.choice(["de", "fr", "", None]), rng.choice(["s", None]), k, "x", "y") for k in range(70)]
    out += [(5, "again", "en", "s", 1, "", ""), (6, None, "en", None, None, "", ""), (None, "no id", "en", "s", 2, "", ""), (None, "no id", "en", "s", 2, "", "")]
    return out + [(900, "equal rows", "en", "s", 3, "", "")] * 3 + [(901, "long " * 30_000, "zz", "s", 150_000, "", "")]


def own_leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def path(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        first = at // fanout * fanout
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return out


def expected(data, fanout):
    """All rows' results by plain loops over whole trees."""
    by = {}
    for r in data:
        by.setdefault(r[2], []).append((r[0], own_leaf(*r[:5]), r))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: tree([x[1] for x in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for k, v in by.items()}
    top, out = tree([trees[k][-1][0] for k in order], fanout), []
    for at, k in enumerate(order):
        for pos, (i, leaf, r) in enumerate(sorted(by[k], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            proof = path(trees[k], pos, fanout) + path(top, at, fanout)
            hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[4] is not None
            node = own_leaf(*r[:4], r[4] + 1) if hit else leaf
            for left, right in proof:
                node = h(left, node, right)
            out.append((i, leaf, trees[k][-1][0], top[-1][0], h(*["".join(x) for x in proof]), node, node == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("fanout", [2, 3])
def test_matches_whole_trees(spark, monkeypatch, fanout):
    """Blocks of a few leaves, ranges of a few rows: several levels of blocks in the large tree."""
    monkeypatch.setattr(manifest, "RANGE", 9)
    monkeypatch.setattr(manifest.prove, "__defaults__", (fanout, 4 if fanout == 2 else 3))
    got = manifest.digests(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == expected(rows(), fanout)


def test_matches_sql(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(map(str, con.execute(manifest.SQL).fetchall())) == expected(rows(), 2)


def test_one_row_and_none(spark):
    one = manifest.digests(spark.createDataFrame(rows()[:1], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, one))) == expected(rows()[:1], 2) and one[0].leaf == one[0].root and one[0].proof_sha256 == h()
    assert manifest.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_proof_shows_an_altered_row(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    out = manifest.manifest(docs, lambda d: F.when(F.col("doc_id") == 12, -1).otherwise(d["n_chars"]))
    wrong = out.where(manifest.folded(F.col("claim"), F.col("proof")) != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in wrong] == [12]


def test_siblings_by_index(spark):
    leaves = np.frombuffer("".join(h(str(k)) for k in range(11)).encode(), np.uint8).reshape(-1, 64)
    for fanout in (2, 3, 5):
        levels = manifest.levels(leaves, fanout, None)
        plain = tree([x.tobytes().decode() for x in leaves], fanout)
        assert [[x.tobytes().decode() for x in m] for m in levels] == plain
        above = [(b"a" * 64, b""), (b"", b"b" * 128)]
        got = manifest.siblings(levels, fanout, above).to_pylist()
        want = [path(plain, k, fanout) + [("a" * 64, ""), ("", "b" * 128)] for k in range(11)]
        assert [[(x["left"], x["right"]) for x in p] for p in got] == want
