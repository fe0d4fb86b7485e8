import random

import duckdb
import numpy as np

from narratum.llm import countjoin

SCHEMA = "doc_id long, text string, key long, n int"


def texts():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    out = []
    for n in (1, 2, 3, 4, 8, 9, 10, 11, 12, 13, 20, 40, 60, 90, 200, 700):
        base = say(n)
        out.append(base)
        for cut in (1, 2, 3, n // 25, n // 22, n // 18, n // 12):
            out += [base[: n - cut], base + say(cut), base[cut:] + say(cut), base[: n // 2] + say(cut) + base[n // 2 + cut :]]
        changed = list(base)
        changed[rng.randrange(n)] = "other"
        out += [changed, base + base[:3], base * 2]
    common = say(12)
    out += [common + say(k) for k in range(2, 14) for _ in range(4)]
    rows = [" ".join(w) for w in out] + ["", " \t\n", None, None, " ".join(out[30]).upper(), "  ".join(out[30]) + "\n", " ".join(out[0]), " ".join(say(30_000))]
    return [(k, t, 0, 0) for k, t in enumerate(rows)] + [(3, "an id again", 0, 0), (None, " ".join(out[40]), 0, 0), (None, "alone", 0, 0)]


def shingled(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def expected(rows):
    sets = [shingled(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(str((r[0], len(sets[i]), least.get(top(i)))) for i, r in enumerate(rows))


def got(df, **more):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in countjoin.groups(df, **more).collect())


def test_matches_all_pairs(spark, tmp_path):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(df) == expected(rows)
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert sorted(map(str, con.execute(countjoin.SQL).fetchall())) == expected(rows)


def test_cells_of_few_members(spark, monkeypatch):
    """Blocks of two members and one partner first: the same groups by way of many cells."""
    monkeypatch.setattr(countjoin.near, "PARTNERS", 1)
    rows = texts()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(2), block=2) == expected(rows)


def test_empty_table(spark):
    assert countjoin.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert got(spark.createDataFrame([(1, None, 0, 0), (2, "", 0, 0)], SCHEMA)) == ["(1, 0, 1)", "(2, 0, 2)"]


def test_similar_sets_share_a_key():
    """At every size up to a few hundred, with as many differences as the similarity allows, dealt in any way."""
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 90, 100, 171, 172, 250, 400]:
        for _ in range(6):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 20, dtype=np.uint64))
            rng.shuffle(pool)
            a = pool[:n]
            for drop in range(n // 8 + 2):
                for add in range(n // 8 + 2):
                    both, union = n - drop, n + add
                    if both > 0 and 100 * both >= 90 * union:
                        b = np.concatenate([a[drop:], pool[n : n + add]])
                        assert len(np.intersect1d(countjoin.keys(a), countjoin.keys(b))), (n, drop, add)


def test_tree_finds_what_bounds_allow():
    rng = np.random.default_rng(4)
    base = rng.poisson(4, (12, countjoin.GROUPS))
    points = np.concatenate([np.maximum(0, b + rng.integers(-1, 2, (60, countjoin.GROUPS)) * (rng.random((60, countjoin.GROUPS)) < 0.1)) for b in base])
    tree = countjoin.RTree(points, leaf=4, branch=3)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    found = set()
    for i, j in tree.search(points[:200]):
        found |= set(zip(i.tolist(), j.tolist()))
    size = points.sum(axis=1)
    want = {(i, j) for i in range(200) for j in range(len(points)) if np.minimum(points[i], points[j]).sum() >= countjoin.needed(size[i], size[j])}
    assert found == want and len(want) < 200 * len(points) / 4


def test_places_are_shuffled_once(spark):
    """Rows that buckets() shuffles, no join broadcast: each place of a key once, and a little for those in several sets."""
    rows = [(k, 0, [1000 * k + i for i in range(200)]) for k in range(200)] + [(200 + k, 0, [7, 8, 9, -5 - k]) for k in range(3)] + [(300, 0, [8, -100]), (301, 0, [])]
    told = spark.createDataFrame(rows, "key long, n int, hs array<long>")
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        found = countjoin.near.buckets(told)
        made = sum(n for k, n in written().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    members = {}
    for r in found.collect():
        members.setdefault((r.h, r.lo), set()).add((r.key, r.pos))
    # 7, 8 and 9 are key 0's too: of 7 and 9, with the same members, the first place stays.
    assert members == {(7, 0): {(0, 7), (200, 0), (201, 0), (202, 0)}, (8, 0): {(0, 8), (200, 1), (201, 1), (202, 1), (300, 0)}}
    places = sum(len(hs) for _, _, hs in rows)
    assert places <= made <= places + 100


def test_texts_are_shuffled_once(spark):
    """What pairs of near copies shuffle where no join is broadcast: all texts once, to lie in buckets, and then those of tried pairs."""
    rng = random.Random(5)
    rows = []
    for pair in range(60):
        words = [rng.randbytes(60).hex() for _ in range(150)]
        rows += [(2 * pair, " ".join(words)), (2 * pair + 1, " ".join(words[:-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    def shuffled(run):
        before = written()
        found = run()
        return found, sum(n for k, n in written().items() if k not in before)

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, once = shuffled(lambda: docs.repartition("doc_id").write.format("noop").mode("overwrite").save())
        found, most = shuffled(lambda: {r.doc_id: r.component_id for r in countjoin.groups(docs).collect()})
        roots, more = shuffled(lambda: {r.node: r.root for r in countjoin.near.groups(docs).collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert max(most, more) < 3.5 * once
    assert found == {k: k // 2 * 2 for k in range(120)}
    assert len(roots) == 120 and len(set(roots.values())) == 60
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("narratum")]
