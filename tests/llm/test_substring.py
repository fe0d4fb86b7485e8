import hashlib
import random
import time

import numpy as np
import pytest

from narratum.llm import substring


def plain(rows):
    """Every window of every document in a dictionary."""
    cut = lambda t: (t or "").encode().split()
    first = {}
    for i, t in rows:
        ws = cut(t)
        for k in range(len(ws) - 49):
            if i is not None:
                key = tuple(ws[k : k + 50])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        ws = cut(t)
        gone = set()
        for k in range(len(ws) - 49):
            if i is not None and first[tuple(ws[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((str(i), len(ws), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(ws) if k not in gone)).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(6)
    say = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(n)]
    passages = [say(rng.randrange(50, 140)) for _ in range(6)] + [["la"] * 120, ["x", "y"] * 60]
    rows = []
    for k in range(60):
        words = say(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1]), (2000, None), (2001, ""), (2002, rows[4][1]), (2003, " ".join(say(20_000) + passages[0])), (2004, "é\x1c " * 60), (2005, "é\x1c " * 55)]
    return rows


def test_index_groups_equal_windows():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 4, rng.integers(5, 40)).astype(np.uint64) for _ in range(30)]
    fm = substring.FMIndex(texts, depth=5)
    streams = texts[:10] + [rng.integers(1, 6, 30).astype(np.uint64) for _ in range(10)]
    groups = fm.statistics(np.concatenate(streams), np.array([len(s) for s in streams]))
    least = fm.smallest(np.arange(len(texts)) + 100)
    at = 0
    for s in streams:
        for k in range(len(s) - 4):
            want = [100 + j for j, t in enumerate(texts) for m in range(len(t) - 4) if (t[m : m + 5] == s[k : k + 5]).all()]
            assert (least[groups[at + k]] if groups[at + k] >= 0 else None) == (min(want) if want else None)
        at += len(s)


@pytest.mark.parametrize("crowd,shard", [(10_000, 1_000_000), (2, 1_000_000), (10_000, 300)])
def test_matches_brute_force(spark, monkeypatch, crowd, shard):
    monkeypatch.setattr(substring, "CROWD", crowd)
    monkeypatch.setattr(substring, "SHARD_WORDS", shard)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, th int").repartition(3)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect()) == plain(rows)


def test_dedup_keeps_columns(spark):
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, words + "  x", "a", 9), (2, "y " + words, "b", 9), (3, "z  z", "c", 4)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in substring.dedup(docs).collect()}
    assert substring.dedup(docs).columns == docs.columns
    assert got[1].text == words + "  x" and got[2].text == "y" and got[2].n_chars == 1 and got[3].text == "z  z" and got[3].spans == "c"
    assert substring.digests(docs.limit(0)).count() == 0


def test_one_row_many_times(spark):
    """Work is by distinct rows: 20,000 equal ones, one of them of an earlier document, and texts that share an id."""
    rng = random.Random(1)
    text = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(400))
    rows = spark.range(20_000).selectExpr("7L as doc_id", f"'{text}' as text")
    other = spark.createDataFrame([(3, text), (7, "own " * 60 + text), (7, "own " * 60), (9, text + " more")], "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.n_words, r.n_removed): r["count"] for r in substring.digests(rows.union(other)).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    assert time.time() - began < 60
    assert got == {(3, 400, 0): 1, (7, 400, 400): 20_000, (7, 460, 400): 1, (7, 60, 0): 1, (9, 401, 400): 1}
