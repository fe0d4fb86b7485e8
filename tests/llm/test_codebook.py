import hashlib
import math
import random
from collections import defaultdict

import duckdb
import pytest

from narratum.llm import codebook

SCHEMA = "vec_id long, embedding array<float>, label int, row int, n int"
NAN, INF = float("nan"), float("inf")


def vectors(dim=32, many=300):
    rng = random.Random(7)
    out = [(rng.randrange(10_000), [rng.gauss(0, 0.1) for _ in range(dim)], rng.choice([1, 2, 3, None]), 0, 0) for _ in range(many)]
    out += [(out[5][0], out[5][1], 2, 0, 0), (out[6][0], out[7][1], 2, 0, 0), (None, out[8][1], None, 0, 0)] + [(20_000 + k, out[9][1], 4, 0, 0) for k in range(90)]
    bad = [None, [], [None] * dim, [NAN] + [0.0] * (dim - 1), [INF] * dim, [-INF] * dim, [0.1] * (dim + 1)]
    return out + [(30_000 + k, v, 1, 0, 0) for k, v in enumerate(bad)] + [(40_000, [0.0] * dim, 1, 0, 0)]


def expected(rows, dim):
    f32 = lambda v: [math.floor(256 * x) for x in v]
    kept = [(i, f32(v), lab) for i, v, lab, *_ in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ends = [dim * k // 16 for k in range(17)]
    cut = lambda v: [v[s:e] for s, e in zip(ends, ends[1:])]
    books = [[cut(v)[p] for _, v, _ in kept[:64]] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    out, by = [], defaultdict(int)
    for i, v, lab in kept:
        best = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        by[lab] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(str((i, c, e, by[lab], sha)) for i, c, e, lab in out)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("dim,share", [(32, 4096), (40, 50), (16, 2)])
def test_matches_plain_loops(spark, monkeypatch, dim, share):
    monkeypatch.setattr(codebook, "SHARE", share)
    df = frame(spark, vectors(dim)).repartition(3)
    rows = [tuple(r) for r in df.collect()]  # as float32
    assert sorted(map(str, map(tuple, codebook.digests(df).collect()))) == expected(rows, dim)


def test_matches_sql(spark, tmp_path):
    rows = [r for r in vectors(32) if not r[1] or len(r[1]) == 32]
    df = frame(spark, rows)
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/e/*.parquet'")
    assert sorted(map(str, con.execute(codebook.SQL).fetchall())) == sorted(map(str, map(tuple, codebook.digests(df).collect())))


def test_few_and_none(spark):
    few = frame(spark, vectors(16)[:5])
    assert sorted(map(str, map(tuple, codebook.digests(few).collect()))) == expected([tuple(r) for r in few.collect()], 16)
    assert codebook.digests(frame(spark, [])).count() == 0
    assert codebook.digests(frame(spark, [(1, None, 1, 0, 0), (2, [NAN] * 16, 1, 0, 0)])).count() == 0


def test_restored_vectors_are_near(spark):
    rows, books = codebook.compress(frame(spark, vectors(32)))
    for r in codebook.decode(rows, books).collect():
        assert len(r.codes) == 16 and len(r.restored) == 32
    first = codebook.decode(rows, books).where("vec_id = 40000").first()
    own = sum((math.floor(256 * 0.0) - (x * 256 - 0.5)) ** 2 for x in first.restored)
    assert abs(own - first.error) < 1e-6
