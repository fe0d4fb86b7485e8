import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from narratum.llm import gru


def tiny(seed=1):
    net = gru.Network(np.array([5.0, 3, 2, 1, 0, 4, 1]), hidden=4, classes=3, seed=seed)
    rng = np.random.default_rng(seed)
    net.p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 * (v > -20) for k, v in net.p.items()}
    return net


def test_gradients():
    net, rng = tiny(), np.random.default_rng(4)
    source, target = rng.integers(0, 7, (5, 2)), rng.integers(0, 7, (5, 2))
    reset = np.zeros((5, 2), bool)
    reset[0, 0] = reset[3, 1] = True
    h = rng.standard_normal((2, 4)) * 0.1
    grads = {}
    net.window(source, target, reset, h, grads)
    for name, g in grads.items():
        for at in rng.integers(0, g.size, 6):
            old, total = net.p[name].flat[at], []
            for step in (1e-3, -1e-3):
                net.p[name].flat[at] = old + step
                total.append(net.window(source, target, reset, h)[0].sum())
            net.p[name].flat[at] = old
            assert g.flat[at] == pytest.approx((total[0] - total[1]) / 2e-3, abs=1e-2), name


def test_output_is_a_distribution():
    net = tiny()
    hs = np.random.default_rng(1).standard_normal((1, 4)).repeat(7, axis=0)
    assert np.exp(net.output(hs, np.arange(7))[0]).sum() == pytest.approx(1, abs=1e-6)


def test_state_is_carried_across_windows_and_streams():
    net, rng = tiny(), random.Random(2)
    docs = [np.array([rng.randrange(7) for _ in range(rng.randrange(1, 60))]) for _ in range(9)]
    whole = [net.window(np.array([0, *d[:-1]])[:, None], d[:, None], np.arange(len(d))[:, None] == 0, np.zeros((1, 4)))[0].sum() for d in docs]
    for streams, window in ((1, 3), (4, 8), (9, 64)):
        assert np.allclose(net.score(docs, 0, streams, window), whole, atol=1e-4)


def test_training_beats_first_guess():
    rng, net = random.Random(1), gru.Network(np.ones(6))
    docs = [np.array([x for _ in range(30) for x in ((0, 1, 2) if k % 2 else (3, 4))] + [5]) for k in range(40)]
    rng.shuffle(docs)
    before = net.score(docs, 5).sum()
    net.train(docs, 5, epochs=40, rate=0.02)
    assert net.score(docs, 5).sum() > 0.6 * before


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(gru, "HEAD", 6)
    monkeypatch.setattr(gru, "MODEL_WORDS", 4)
    rng = random.Random(3)
    words = ["The", "of", "cat", "dog", "rare", "Élan", "x"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for k in range(60)] + [(60, None), (61, ""), (None, "of new"), (5, "unseen words " * 4000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = gru.score(docs).collect()
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert gru.score(docs.limit(0)).count() == 0
    assert len(gru.score(docs.where("doc_id = 60")).collect()) == 1


def test_model_is_the_network_times_the_bucket_share():
    counts = {b"the": 50, b"of": 20, b"\n": 9, b"abc": 3, b"abd": 1, b"zz": 2}
    old, gru.MODEL_WORDS = gru.MODEL_WORDS, 3
    try:
        totals = {}
        for w, c in counts.items():
            if c < 9:
                n, v = totals.get(gru.bucket(w), (0, 0))
                totals[gru.bucket(w)] = (n + c, v + 1)
        s = gru.Scorer(sorted(counts.items(), key=lambda x: -x[1])[:5], totals, 85, 6)
        symbols, at, rest = s.symbols([b"the", b"abc", b"abd", b"never"])
        assert rest == [b"abd", b"never"] and at.tolist() == [0, 3, -1, -1, 2]
        assert symbols.tolist() == [0, *[3 + gru.bucket(w) for w in (b"abc", b"abd", b"never")], 2]
        assert s.inside[3] == pytest.approx(math.log10(3.1 / s.room(gru.bucket(b"abc"))))
    finally:
        gru.MODEL_WORDS = old


def test_frequent_words(spark):
    counts = spark.createDataFrame([(bytes([65 + k]), c) for k, c in enumerate([9, 1, 5, 5, 1, 1])], "word binary, c long")
    assert gru.frequent(counts, 6) == [(b"A", 9), (b"C", 5), (b"D", 5), (b"B", 1), (b"E", 1), (b"F", 1)]
    assert gru.frequent(counts, 5) == [(b"A", 9), (b"C", 5), (b"D", 5)]
    assert gru.frequent(counts, 0) == [] and gru.frequent(counts.limit(0)) == []


def test_network_learns_from_documents_outside_the_warm_start(spark, monkeypatch):
    monkeypatch.setattr(gru, "SAMPLE", 1)
    monkeypatch.setattr(gru, "ROUND_RATE", 0.02)
    docs = spark.createDataFrame([(k, "red green blue " * 200) for k in range(400)], "doc_id long, text string").repartition(3)
    trained = gru.fit(docs)[0]
    monkeypatch.setattr(gru, "ROUNDS", 0)
    warm = gru.fit(docs)[0]
    symbols = [trained.symbols(gru.words_of("red green blue " * 50))[0]]
    start = int(trained.start)
    assert trained.network.score(symbols, start).sum() > 0.7 * warm.network.score(symbols, start).sum()


def test_scores_by_a_plain_loop(spark, monkeypatch):
    """Each document word by word: the recurrent state, the class, the member, and a bucket's share for words without a symbol."""
    monkeypatch.setattr(gru, "HEAD", 9)
    monkeypatch.setattr(gru, "MODEL_WORDS", 5)
    rng = random.Random(6)
    words = ["the", "of", "Cat", "dog", "élan", "x", "y", "rare", "odd"]
    rows = [(k, " ".join(rng.choice(words[: 4 + k % 6]) for _ in range(rng.randrange(40)))) for k in range(70)] + [(70, None), (71, "never seen of"), (72, "the cat " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scorer, counts = gru.fit(docs)
    monkeypatch.setattr(gru, "fit", lambda d: (scorer, counts))
    table = {bytes(r.word): r.c for r in counts.collect()}
    head = [bytes(w) for w in scorer.words.to_pylist()]
    own = {w: k for k, w in enumerate(head[: scorer.size])}
    room = {}
    for w, c in table.items():
        if w not in own:
            n, v = room.get(gru.bucket(w), (0, 0))
            room[gru.bucket(w)] = (n + c, v + 1)
    p = {k: x.astype(float) for k, x in scorer.network.p.items()}
    classes, sigmoid = scorer.network.classes, lambda x: 1 / (1 + np.exp(-x))
    logs = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()

    def plain(text):
        total, h = 0.0, np.zeros(scorer.network.hidden)
        symbol = lambda w: own.get(w, scorer.size + gru.bucket(w))
        last = symbol(b"\n")
        for w in [*(text or "").encode().lower().split(), b"\n"]:
            z, r = (sigmoid(p["gate"][k, last] + h @ p["state"][k]) for k in (0, 1))
            new = np.tanh(p["gate"][2, last] + r * (h @ p["state"][2] + p["inner"]))
            h = new + z * (h - new)
            last = symbol(w)
            c, m = last % classes, last // classes
            total += logs(h @ p["class"] + p["class_bias"])[c] + logs(h @ p["member"][c] + p["member_bias"][c])[m]
            if w not in own:
                n, v = room.get(gru.bucket(w), (0, 0))
                total += math.log((table.get(w, 0) + 0.1) / (n + 0.1 * (v + 1)))
        return total / math.log(10)

    truth = dict(rows)
    for r in gru.score(docs).collect():
        assert r.score == pytest.approx(plain(truth[r.doc_id]), rel=1e-3, abs=1e-2)
