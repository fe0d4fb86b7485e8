import random
import zlib
from collections import defaultdict

import numpy as np

from narratum.llm import toxicity


def plain_model(texts):
    """Interpolated Kneser-Ney by dictionaries: class counts from CLASS_ORDER up, shared continuation counts below."""
    top, low, d = toxicity.ORDER, toxicity.CLASS_ORDER, toxicity.DISCOUNT
    own = {}
    for c, docs in texts.items():
        own[c] = {top: defaultdict(int)}
        for t in docs:
            b = b"\0" * (top - 1) + t.encode().lower()
            for k in range(top, len(b) + 1):
                own[c][top][b[k - top : k]] += 1
        for size in range(top - 1, low - 1, -1):
            own[c][size] = defaultdict(int)
            for g in own[c][size + 1]:
                own[c][size][g[1:]] += 1
    kinds = defaultdict(int)
    for c in own:
        for g in own[c][low]:
            kinds[g] += 1
    shared = {}
    for size in range(low - 1, 0, -1):
        shared[size] = defaultdict(int)
        for g in shared.get(size + 1, kinds):
            shared[size][g[1:]] += 1

    def chance(g, c):
        if not g:
            return 1 / 256
        table = own[c][len(g)] if len(g) >= low else shared[len(g)]
        same = {k: v for k, v in table.items() if k[:-1] == g[:-1]}
        total, below = sum(same.values()), chance(g[1:], c)
        return (max(same.get(g, 0) - d, 0) + d * len(same) * below) / total if total else below

    return lambda g: np.log(chance(g, 1)) - np.log(chance(g, 0))


def test_ratios_match_plain_model():
    texts = {1: ["you idiot", "Idiots all", "bad clown é"], 0: ["you are all here", "the clown car", "cars"]}
    model, plain = toxicity.Model(texts), plain_model(texts)
    for text in ["you idiot car", "zzz clown", "é", "x"]:
        b = b"\0" * (toxicity.ORDER - 1) + text.encode().lower()
        want = [plain(b[k - toxicity.ORDER : k]) for k in range(toxicity.ORDER, len(b) + 1)]
        assert np.allclose(model.bytes_ratio(toxicity.as_bytes(text)), want, atol=1e-4)
    many = ["you idiot", "", "car"]
    assert np.allclose(model.evidence(many), [model.evidence([t])[0] for t in many], atol=1e-6)


def corpus(n):
    rng = random.Random(2)
    words = ["the", "ing", "an", "ther", "of", "tion", "be"]
    for k in range(n):
        toxic = k % 5 == 0
        yield k, " ".join(rng.choice(words) if not toxic or rng.random() > 0.1 else "moron" for _ in range(rng.randrange(5, 120))) + (" moron" if toxic else ""), int(toxic)


def test_held_out_accuracy_and_edges(spark):
    rows = list(corpus(500)) + [(900, "", 0), (901, None, 0), (902, "moron " * 20_000, 1)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(900, "", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:400]] + [(0, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(rows) + 1
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    judged = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert sum(p == y for p, y in judged) >= 0.97 * len(judged)
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_missing_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.scores(docs, labels).collect()] == [0.0, 0.0]
    assert [r.score for r in toxicity.scores(docs, labels.limit(0)).collect()] == [0.0, 0.0]
    assert toxicity.scores(docs.limit(0), labels).count() == 0


def test_counts_in_executors_are_the_model_s(spark):
    rows = [(y, t) for _, t, y in corpus(60)]
    frame = spark.createDataFrame(rows, "toxic int, text string").repartition(3)
    own, plain = toxicity.class_counts(frame), {c: [t for y, t in rows if y == c] for c in (0, 1)}
    for c in (0, 1):
        keys, n = toxicity.counted(plain[c])
        assert (own[c][0] == keys).all() and (own[c][1] == n).all()
    model, again = toxicity.Model(own), toxicity.Model(plain)
    texts = [t for _, t in rows]
    assert (model.evidence(texts) == again.evidence(texts)).all()
    got = sorted(map(tuple, toxicity.evidence(frame, model).collect()))
    assert np.allclose(got, sorted((float(y), *again.evidence([t])[0]) for y, t in rows), atol=1e-9)


def test_an_id_with_many_texts_counts_once(spark):
    rows = [(i, t) for i, t, _ in corpus(200)]
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    again = docs.union(docs).union(docs.where("doc_id = 0"))
    scores = lambda df: sorted({(r.doc_id, round(r.score, 9)) for r in toxicity.scores(df, labels).collect()})
    assert scores(docs) == scores(again)
