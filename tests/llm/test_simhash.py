import random

import numpy as np
import xxhash

from narratum.llm import bitslice, resemblance, simhash
from narratum.llm.components import components


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def cluster(rng, n):
    base = rng.getrandbits(64)
    return list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) * rng.randrange(2) ^ (rng.randrange(5) << 40) for _ in range(n)})


def test_fingerprint():
    for text in ["", " \n", "one", "One two", "a b c", "a b c a b c a b c É x", "x " * 50]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_wide_comparison_matches_popcounts():
    rng = np.random.default_rng(5)
    for words, radius in ((1, 0), (1, 2), (1, 9), (2, 46), (2, 64), (4, 31)):
        base = rng.integers(0, 1 << 63, (1, words), np.uint64)
        flips = np.packbits(rng.random((150, 64 * words)) < rng.random((150, 1)) * 0.6, axis=1).view(np.uint64)
        values = base ^ flips
        want = np.bitwise_count(values[:, None, :] ^ values[None, :, :]).sum(axis=2, dtype=int) <= radius
        assert (bitslice.marked(bitslice.within(values, bitslice.planes(values), radius), 150) == want).all()
        assert (bitslice.marked(bitslice.within(None, bitslice.planes(values ^ values[:1]), radius)[0], 150) == want[0]).all()


def test_links_match_brute_force(spark):
    rng = random.Random(3)
    values = sorted({0, 1, 3, 7, 1 << 63, *[rng.getrandbits(64) for _ in range(200)], *[v for _ in range(6) for v in cluster(rng, 60)], *cluster(rng, 3)})
    pairs = [(a, b) for k, a in enumerate(values) for b in values[:k] if bin(a ^ b).count("1") <= 2]
    want = plain_components(pairs, values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for bucket in (4096, 10):
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in components(simhash.links(df, bucket)).collect()}
        sets = {}
        for v in values:
            sets.setdefault(got.get(v, v), set()).add(v)
        wanted = {}
        for v in values:
            wanted.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, wanted.values()))


def test_components_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0)).count() == 0


def test_groups_and_keep(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(5, "a b c d", "x"), (3, "A b  c d", "x"), (9, None, "x"), (8, "", "x"), (7, long, "x"), (6, long, "x"), (6, long, "x"), (1, "other words here now", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(docs).collect())
    fp = {i: f"{plain_fingerprint(t or ''):016x}" for i, t, _ in rows}
    want = {5: 3, 3: 3, 9: 8, 8: 8, 7: 6, 6: 6, 1: 1}
    assert got == sorted((i, fp[i], want[i]) for i, _, _ in rows)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3, 6, 8]
    assert simhash.groups(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def shingle_groups(texts):
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return plain_components(pairs, range(len(sets)))


def test_stage_finds_few_word_edits(spark):
    rng = random.Random(6)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts, line = [], say(12)
    for n in (6, 30, 60, 110, 200, 400):
        base = say(n)
        for edits in [0, 1, 1, 2, 3, 4, 6, 9, *([1] * 20)]:
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(n)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base[: n - n // 9]))
    texts += [" ".join(line + say(rng.randrange(30))) for _ in range(40)] + [None, "", "one two", "One  two", "one three"]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(shingle_groups(texts).values()))
    got = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert got == want and len(want) < len(texts) / 2
    whole = {r.node: r.root for r in resemblance.groups(docs).collect()}
    assert whole == {r.node: r.root for r in resemblance.groups(docs, block=3).collect()}


def test_members_of_a_crowded_bucket(spark, monkeypatch):
    """Texts of one long common line and short own parts: one bucket, several components, blocks and lanes of both kinds."""
    monkeypatch.setattr(resemblance, "TINY", 4)
    rng = random.Random(2)
    line = [f"w{k}" for k in range(40)]
    texts = [" ".join(line + [f"own{rng.randrange(12)}x{k}" for k in range(n)]) for n in (2, 9, 14) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(set(shingle_groups(texts).values()))
    for block in (2048, 7):
        assert len({r.root for r in resemblance.groups(docs, block=block).collect()}) <= len(want)
        keys = dict(docs.select("doc_id", resemblance.key_of(resemblance.F.col("text")).alias("k")).collect())
        roots = {r.node: r.root for r in resemblance.groups(docs, block=block).collect()}
        first = {}
        for i in sorted(keys):
            first.setdefault(roots.get(keys[i], keys[i]), i)
        assert sorted(first.values()) == want


def test_keep_one_decides_by_row(spark):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven", "twelve thirteen", "fourteen")
    rows = [(None, a), (None, b), (None, b), (4, c), (4, d), (7, c), (None, d), (2, "x y"), (9, "x  Y"), (9, "z"), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text or "") for r in simhash.keep_one(docs).collect())
    assert got == sorted([("None", a), ("None", b), ("4", c), ("4", d), ("2", "x y"), ("9", "z"), ("5", "")])


def test_keep_one_beside_columns_of_any_name(spark):
    rows = [(2, "a b c d e f g", "x", 1, "r"), (1, "a b c d e f g", "y", 2, "s"), (1, "a b c d e f g", "z", 3, "t"), (None, "q w e r t y u", "v", 4, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string, __id int, row string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q w e r t y u"), (1, "a b c d e f g")]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_possible_pairs_are_handed_on_once(spark):
    """Texts that share most of their buckets without being similar, and similar ones, in small and large cells."""
    rng = random.Random(21)
    rows = []
    for group in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for changes in (0, 5, 6, 1):
            at = rng.sample(range(len(words)), changes)
            rows.append((" ".join(f"{w}x{group}{changes}" if k in at else w for k, w in enumerate(words)),))
    texts = spark.createDataFrame(rows, "text string").select(resemblance.key_of(resemblance.F.col("text")).alias("key"), "text")
    told = resemblance.described(texts, resemblance.SHINGLE)
    members = resemblance.buckets(told).withColumn("root", resemblance.F.col("key"))
    sets = {r.key: resemblance.shingles(r.text, resemblance.SHINGLE) for r in texts.collect()}
    similar = {(a, b) for a in sets for b in sets if a < b and resemblance.alike(sets[a], sets[b])}
    for tiny in (64, 0):
        def across(batches, tiny=tiny):
            resemblance.TINY = tiny
            yield from resemblance._across(batches, None)

        made = [(r.a, r.b) for r in resemblance.cells(members, told, resemblance.BLOCK).mapInArrow(across, "a long, b long").collect()]
        assert similar <= set(made) and len(similar) >= 30 and len(made) <= 1.1 * len(set(made))
