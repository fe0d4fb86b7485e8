"""Path queries over JSON documents and contents of many levels, against plain recursion."""

import json
import random

from pyspark.sql import functions as F

from narratum.operators import book


def look(keys, datum, want=None):
    """(value, exact path) of a general query, (None, None) if it isn't met."""
    if not keys:
        return datum, []
    if isinstance(datum, list):
        for k, item in enumerate(datum):
            value, path = look(keys, item, want)
            if value is not None and (want is None or value == want):
                return value, [k, *path]
    elif isinstance(datum, dict) and keys[0] in datum:
        value, path = look(keys[1:], datum[keys[0]], want)
        if path is not None:
            return value, [keys[0], *path]
    return None, None


def at(path, datum):
    for p in path:
        if isinstance(datum, list) and isinstance(p, int) and p < len(datum) or isinstance(datum, dict) and p in datum:
            datum = datum[p]
        else:
            return None
    return datum


def tags(doc, rules):
    out = {}
    for names, own in rules.items():
        for rule in own:
            valid, exact = True, None
            for k, want in rule.get("validate", {}).items():
                value, exact = look(k.split("."), doc, want)
                valid = valid and value is not None and value == want
            if not valid:
                continue
            (path, processing), = rule["data"].items()
            parts = path.split(".")
            if exact is None:
                value, _ = look(parts, doc)
            else:
                up = next((k for k, p in enumerate(parts) if p != "pop"), len(parts))
                value = at(exact[: len(exact) - up] + parts[min(up, len(parts) - 1) :], doc) if up <= len(exact) else None
            for name in names.split(","):
                if value is None or processing == "raw":
                    out[name] = value
    return {k: v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False) for k, v in out.items()}


RULES = {
    "A,B": [{"data": {"x.y.z": "raw"}}, {"validate": {"x.y.id": "1"}, "data": {"pop.z": "raw"}}],
    "C": [{"validate": {"x.y.id": "1", "w.id": "2"}, "data": {"pop.pop.z": "raw"}}],
    "D": [{"validate": {"x.y.id": "2"}, "data": {"pop.pop.pop.y": "raw"}}, {"validate": {"x.y.z": "3"}, "data": {"pop": "raw"}}],
    "E": [{"validate": {"x.y.n": 4}, "data": {"id": "raw"}}],
    "F": [{"data": {"w": "raw"}}, {"data": {"nowhere.at.all": "raw"}}],
    "G": [{"data": {"w": "raw"}}, {"data": {"x": "other"}}],
    "H": [{"validate": {"x.y.z.k.m": "deep"}, "data": {"pop.pop.pop.pop.pop.pop.pop.pop.pop.pop.w": "raw"}}],
    "I": [{"validate": {"dc:t.opf:role": "1"}, "data": {"pop.te xt": "raw"}}],
}


def made(rng, depth=0):
    leaf = lambda: rng.choice(["1", "2", "3", None, "é\n\"", 4, True])
    if depth > 4 or rng.random() < 0.15:
        return leaf()
    if rng.random() < 0.35:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {k: made(rng, depth + 1) if k in "xyzwk" else leaf() for k in rng.sample(["x", "y", "z", "id", "n", "w", "k", "m"], 5)}


def test_rules_on_random_documents(spark):
    rng = random.Random(4)
    docs = [{"x": made(rng), "w": made(rng), **({"dc:t": [{"opf:role": "1", "te xt": "T"}]} if rng.random() < 0.5 else {})} for _ in range(300)]
    docs += [{"x": {"y": {"z": {"k": {"m": "deep"}}}}, "w": ["1"]}, {"x": {"y": [{"id": "1", "n": 4}]}, "w": [{"id": "2"}]}]
    docs += [{"x": [[[{"y": [{"id": "2"}, [{"id": "1", "z": ["k"]}]]}]]], "w": {"id": "2"}}, [], "text", {"x": {"y": {"z": {"k": {"m": "deep"}}}}, "w": "up"}]
    rows = [(k, json.dumps(x)) for k, x in enumerate(docs)] + [(-1, "{not json"), (-2, None)]
    got = {}
    for r in book.document_tags(spark.createDataFrame(rows, "book_id int, doc string").repartition(3), book.path_rules(spark, RULES)).collect():
        got.setdefault(r.book_id, {})[r.tag] = r.value
    assert got.pop(-1) == got.pop(-2) == {k: None for k in "ABFG"}
    for k, x in enumerate(docs):
        assert got.get(k, {}) == tags(x, RULES), x
    assert all(sum(k in v for v in got.values()) > 1 for k in "ABCDEFGHI")


def test_shipped_rules_agree_with_the_flat_form(spark):
    doc = {"dc:title": {"text": "T"}, "dc:creator": [{"text": "E", "opf:role": "edt"}, {"text": "A", "opf:role": "aut"}], "dc:date": {"text": "2012-01-02T03:04:05+00:00"}, "dc:identifier": [{"opf:scheme": "AMAZON", "text": "B0"}]}
    got = {r.tag: r.value for r in book.document_tags(spark.createDataFrame([("b", json.dumps(doc))], "book_id string, doc string"), book.path_rules(spark, book.RULES)).collect()}
    assert got == {"ALBUM": "T", "ALBUMSORT": "T", "ARTIST": "A", "ALBUMARTIST": "A", "PUBLISHER": None, "DATE": "2012-01-02", "ASIN": "B0"}
    assert book.document_tags(spark.createDataFrame([], "book_id string, doc string"), book.path_rules(spark, book.RULES)).count() == 0


def test_relative_paths(spark):
    cases = [(["a", "0", "b"], "pop.c", ["a", "0", "c"]), (["a", "0", "b"], "pop.pop.pop.c.d", ["c", "d"]), (["a"], "pop.pop.c", None), (["a", "b"], "c", ["a", "b", "c"]), (["a", "b"], "pop", ["a", "pop"]), (["a", "b"], "x.pop", ["a", "b", "x", "pop"])]
    df = spark.createDataFrame([(k, p, d.split(".")) for k, (p, d, _) in enumerate(cases)], "k int, p array<string>, d array<string>")
    got = {r.k: r.x for r in df.select("k", book.relative_path(F.col("p"), F.col("d")).alias("x")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, _, w in cases]


def test_contents_of_fifty_levels(spark):
    rows = [("b", f"n{k}", f"n{k - 1}" if k else None, 0, f"L{k}", "f#x" if k % 2 else "g") for k in range(50)]
    rows += [("b", f"s{k}", f"n{k}", 1, f"S{k}", None) for k in range(0, 50, 7)] + [("c", "r", None, 0, None, "h"), ("c", "q", "r", 0, "Q", "h#"), ("c", "lost", "gone", 0, "no", "no")]
    toc = book.flatten_contents(spark.createDataFrame(rows, "book_id string, node string, parent string, sibling int, label string, src string"))
    jobs = toc.orderBy("book_id", "toc_pos").collect()
    own = [r for r in jobs if r.book_id == "b"]
    assert [r.label for r in own[:50]] == [f"L{k}" for k in range(50)] and own[49].parent_labels == [f"L{k}" for k in range(49)]
    assert [r.label for r in own[50:]] == [f"S{k}" for k in range(49, -1, -7)] and [r.toc_pos for r in own] == list(range(58))
    assert [(r.label, r.parent_labels) for r in jobs if r.book_id == "c"] == [(None, []), ("Q", [None])]
