import random
import re

from narratum.llm import decontam


def plain(docs, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    grams = lambda ws, k: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(cut(t))
    out = []
    for item, t in items:
        ws = cut(t)
        k = min(5, len(ws))
        own = grams(ws, k) if ws else set()
        for i, many in texts.items():
            n = len(own & set().union(*[grams(m, k) for m in many])) if own else 0
            if own and item is not None and i is not None and n / len(own) >= 0.8:
                out.append((i, item, len(own), n))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)] + ["É", "don't", "x-y"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(rng.randrange(1, 60))) for k in range(40)] + [(90, ""), (91, None), (92, "w1"), (93, "w1 w2 w3"), (None, "w1"), (94, items0 := say(33)), (95, items0)]
    docs = [(k, say(rng.randrange(0, 200))) for k in range(60)] + [(200, None), (201, ""), (None, "w1 w2"), (204, "w1"), (205, say(30_000))]
    for k in range(60):
        ws = rng.choice(items[:40])[1].split()
        for _ in range(rng.randrange(0, max(1, len(ws) // 12) + 1)):
            ws[rng.randrange(len(ws))] = "odd"
        docs.append((300 + k, f"{say(50)} {' '.join(ws).upper()}! {say(rng.randrange(300))}"))
    docs += [docs[-1], (206, "w1, w2; w3")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, dirty_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contained(d, b)
    assert sorted((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()) == plain(docs, items)
    bad = {x[0] for x in plain(docs, items)}
    kept = decontam.decontaminate(d, b)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    old, decontam.BROADCAST_ROWS = decontam.BROADCAST_ROWS, 0
    try:
        assert decontam.contained(d, b).count() == len(plain(docs, items))
    finally:
        decontam.BROADCAST_ROWS = old


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contained(d.limit(0), b).count() == 0
    assert decontam.contained(d, b.limit(0)).count() == 0 and decontam.decontaminate(d, b.limit(0)).count() == 1


def test_stage_goes_by_text(spark):
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    d = spark.createDataFrame([(None, f"x {one} y"), (1, f"x {two} y"), (2, "clean"), (None, "clean too"), (3, one), (3, "clean as well"), (4, None)], "doc_id long, text string")
    for ids in ((None, None), (7, 7), (None, 7)):
        b = spark.createDataFrame([(ids[0], one), (ids[1], two), (8, None)], "item_id long, text string")
        kept = decontam.without_items(d, b)
        assert kept.columns == d.columns and sorted(str(r.text) for r in kept.collect()) == ["None", "clean", "clean as well", "clean too"]
