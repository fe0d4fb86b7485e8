"""Rules of the older module, corrections by template, contents without conflicts, and lines that arrive out of order."""

import itertools
import random
import re
import time
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from narratum.functions import text as X
from narratum.operators import book, legacy, lyrics, tracks
from narratum.streaming import lyrics as stream


def swaps(seqs):
    """The order after in-place swaps; None where they have no end."""
    order, left, idle = list(range(len(seqs))), list(range(len(seqs))), 0
    while left:
        cur, to = left[0], None
        if seqs[order[cur]] is not None and 1 <= seqs[order[cur]] <= len(seqs):
            to = seqs[order[cur]] - 1
            order[to], order[cur] = order[cur], order[to]
        idle += 1
        if not to:
            left.remove(cur)
            idle = 0
        elif to in left:
            left.remove(to)
            idle = 0
        if idle > len(seqs) + 1:
            return None
    return order


def test_display_sequences_of_all_kinds(spark):
    cases = [list(p) for n in range(1, 5) for p in itertools.product([None, *range(0, n + 2)], repeat=n)]
    rng = random.Random(3)
    cases += [list(p) for p in itertools.permutations(range(1, 6))] + [[rng.choice([None, 1, 2, 3, 4, 5]) for _ in range(5)] for _ in range(300)]
    rows = [(b, 10 * k, q) for b, c in enumerate(cases) for k, q in enumerate(c)]
    got = {}
    for r in legacy.order_creators(spark.createDataFrame(rows, "book_id int, pos int, display_seq int").repartition(4)).collect():
        got.setdefault(r.book_id, {})[r.place - 1] = r.pos // 10
    assert sum(swaps(c) is None for c in cases) > 10
    for b, c in enumerate(cases):
        want = swaps(c)
        assert [got[b][k] for k in range(len(c))] == (list(range(len(c))) if want is None else want), c


def test_references_by_automaton(spark):
    rng = random.Random(4)
    part = lambda: "".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 7)))
    files = [(b, f"{part()}{part()}", rng.randrange(50)) for b in range(4) for _ in range(90)] + [(9, None, 1), (None, "a", 1)]
    refs = [(b, rng.choice(["", "../", "./", "../../"]) + part() + rng.choice(["", "#x", "#y#z"])) for b in range(5) for _ in range(60)] + [(0, None), (None, "a"), (7, "a")]
    f, r = spark.createDataFrame(files, "book_id int, path string, load_seq int"), spark.createDataFrame(refs, "book_id int, ref string")

    def want(b, ref):
        bare = None if ref is None else ref.replace("../", "").replace("./", "").split("#", 1)[0]
        found = [(seq, p) for x, p, seq in files if x == b and p is not None and bare is not None and bare in p]
        return min(found)[1] if found and b is not None else None

    legacy_block = legacy.held_patterns.__defaults__
    legacy.held_patterns.__defaults__ = (16,)
    try:
        got = legacy.resolve_references(r, f).collect()
    finally:
        legacy.held_patterns.__defaults__ = legacy_block
    assert sorted(map(str, ((x.book_id, x.ref, x.file) for x in got))) == sorted(map(str, ((b, ref, want(b, ref)) for b, ref in refs)))
    assert legacy.resolve_references(r.limit(0), f).count() == 0 and legacy.resolve_references(r, f.limit(0)).where("file is not null").count() == 0


def test_images_of_pages(spark):
    pages = spark.createDataFrame([(0, k, f"<img src='i{k % 3}.png'/> i{k % 5}.png" if k else None) for k in range(40)], "book_id int, page_no int, markup string")
    images = spark.createDataFrame([(0, k, f"i{k}.png", f"/x{k}") for k in range(4)] + [(1, 0, "i0.png", "/y")], "book_id int, seq int, ref string, location string")
    got = sorted((r.page_no, r.ref, r.location) for r in legacy.page_images(pages, images).collect())
    assert got == sorted({(k, f"i{i}.png", f"/x{i}") for k in range(1, 40) for i in (k % 3, k % 5) if i < 4})


def test_spine_rows_and_track_numbers(spark):
    refs = spark.createDataFrame([("b", 0, "x"), ("b", 1, "gone"), ("b", 2, "img")], "book_id string, spine_pos int, idref string")
    items = spark.createDataFrame([("b", "x", 0, "old", "text/html+xml"), ("b", "x", 1, "new", "application/xhtml+xml"), ("b", "img", 2, "i.png", "image/png")], "book_id string, item_id string, seq int, href string, media_type string")
    assert [r.href for r in legacy.item_pages(refs, items).orderBy("spine_pos").collect()] == ["new", None, None]
    entries = spark.createDataFrame([(b, k) for b in ("b", "c") for k in range(6)], "book_id string, entry_no int")
    got = legacy.numbered_tracks(entries, spark.createDataFrame([("b", 2, 4), ("c", 0, 99)], "book_id string, start int, end int")).collect()
    assert sorted((r.book_id, r.entry_no, r.track_no) for r in got) == [("b", 2, 1), ("b", 3, 2), ("b", 4, 3)] + [("c", k, k + 1) for k in range(6)]


def test_contents_both_ways(spark):
    rng = random.Random(8)
    records, toc = [], []
    for b in range(120):
        at = 0
        for path in ("f", "g"):
            ids = [f"i{k}" for k in range(6)]
            for _ in range(rng.randrange(0, 9)):
                records.append((b, at, path, rng.sample(ids, rng.choice([0, 0, 1, 1, 2])) or rng.choice([[], None])))
                at += 1
        for k in range(rng.randrange(0, 5)):
            toc.append((b, k, rng.choice(["f", "g", "h", None]), rng.choice([None, "i0", "i1", "i2", "i9"])))
    r = spark.createDataFrame(records, "book_id int, rec_pos int, path string, ids array<string>").repartition(3)
    t = spark.createDataFrame(toc, "book_id int, toc_pos int, src_path string, src_id string")
    rows = lambda df: sorted((x.book_id, x.rec_pos, x.toc_pos) for x in df.collect())
    taken = []
    for b, pos, path, ids in sorted(records, key=lambda x: x[:2]):
        free = [k for bb, k, p, i in toc if bb == b and p == path and (i is None or i in (ids or [])) and (b, k) not in {(x, z) for x, _, z in taken}]
        if free:
            taken.append((b, pos, min(free)))
    assert rows(book.match_contents(r, t)) == rows(book.fold_contents(r, t)) == sorted(taken)
    plan = book.first_records(r, t)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_corrections_by_template(spark):
    word, line = "a.b", "x A.B y a.b acb é"
    df = spark.createDataFrame([("t", 0, line), ("t", 5, "none")], "track string, time_ms long, text string")
    for by in (r"new", r"<\g<0>>", r"a\\b", r"\n\t", r"$1 $0", r"\.", r"\101\0", r"\g<0>\g<0>", "é$"):
        got = lyrics.corrected(df, "track", word, by, template=True).collect()
        assert [(r.new, r.end_time) for r in got] == [(re.sub(re.escape(word), by, line, flags=re.IGNORECASE), 5)]
    for by in (r"\1", r"\g<1>", r"\g<x>", r"\q", "\\"):
        with pytest.raises(ValueError):
            lyrics.corrected(df, "track", word, by, template=True)


def test_letters_of_all_scripts(spark):
    rng = random.Random(5)
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(chr(c) for c in codes[k : k + 4000] if not unicodedata.combining(chr(c))) for k in range(0, len(codes), 4000)]
    texts += ["".join(chr(rng.choice(codes)) for _ in range(30)) for _ in range(50)] + ["한국어 é가각", "plain", "", None]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") for t in texts]
    # Java's marks are those of its own Unicode version; only characters whose category both have are compared.
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.x for r in df.select("k", X.strip_accents(F.col("t")).alias("x")).collect()}
    known = lambda s: None if s is None else sorted(c for c in s if not unicodedata.category(c).startswith("M"))
    assert [known(got[k]) for k in range(len(texts))] == [known(w) for w in want]
    assert got[len(texts) - 4] == want[-4]


def test_line_at_and_album_join(spark):
    lines = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y")], "track string, time_ms long, text string")
    assert [r.text for r in lyrics.line_at(lines, 9).collect()] == ["y"]
    with pytest.raises(PySparkException):
        lyrics.line_at(lines, 7).collect()
    rows = spark.createDataFrame([("b", 0, "Title page", 1), ("b", 1, "One", 1), ("b", 2, "Two", 5), ("c", 0, "Only", 2)], "book_id string, track_no int, name string, num_queries int")
    album = spark.createDataFrame([("b", {"ARTIST": "Ann"})], "book_id string, tags map<string, string>")
    done = tracks.finalize(rows, album, "book_id").collect()
    assert sorted((r.book_id, r.track, r.title, (r.tags or {}).get("ARTIST")) for r in done) == [("b", 1, "One", "Ann"), ("b", 2, "Two", "Ann"), ("c", 1, "Only", None)]


def settled(spark, query, name, many, wanted=lambda r: True):
    """Waits until a stream has given so many of the wanted rows; timers keep it from ever being idle."""
    until = time.time() + 90
    while time.time() < until and query.exception() is None and sum(map(wanted, spark.table(name).collect())) < many:
        time.sleep(1)
    query.stop()
    assert query.exception() is None


def test_marks_out_of_order(spark, tmp_path):
    rng = random.Random(7)
    schema = "track string, seq long, time_ms long, type string, value string"
    rows = [(t, k, rng.randrange(100), rng.choice(["sentence", "sentence", "preceding_realtime", "ssml"]), f"{t}{k}") for t in "ab" for k in range(30)]
    late = [("c", 3, 7, "sentence", "c3"), ("c", 1, 5, "preceding_realtime", None)]  # 0 and 2 never come
    shuffled = rng.sample(rows, len(rows)) + late
    for k in range(6):
        spark.createDataFrame(shuffled[k::6], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        marks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = stream.reordered_offset_stream(marks, patience=1).writeStream.format("memory").queryName("reordered").option("checkpointLocation", str(tmp_path / "c")).start()
        want = {(r.track, r.seq): r.at_ms for r in lyrics.offsets(spark.createDataFrame(rows, schema), "track", ["seq"]).where("type = 'sentence'").collect()}
        settled(spark, q, "reordered", 1, lambda r: r.track == "c")
        got = {(r.track, r.seq): r.at_ms for r in spark.table("reordered").collect()}
    finally:
        spark.conf.unset(store)
    assert got.pop(("c", 3), 12) == 12 and set(got) <= set(want)


def test_marks_in_any_batches(spark, tmp_path):
    rng = random.Random(9)
    schema = "track string, seq long, time_ms long, type string, value string"
    rows = [(t, k, rng.randrange(100), rng.choice(["sentence", "sentence", "preceding_realtime", "ssml"]), f"{t}{k}") for t in "abc" for k in range(30)]
    shuffled = rng.sample(rows, len(rows))
    for k in range(6):
        spark.createDataFrame(shuffled[k::6], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        marks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = stream.reordered_offset_stream(marks, patience=3_600_000).writeStream.format("memory").queryName("anyorder").option("checkpointLocation", str(tmp_path / "c")).start()
        settled(spark, q, "anyorder", sum(r[3] == "sentence" for r in rows))
        got = sorted((r.track, r.seq, r.at_ms, r.value) for r in spark.table("anyorder").collect())
    finally:
        spark.conf.unset(store)
    want = lyrics.offsets(spark.createDataFrame(rows, schema), "track", ["seq"]).where("type = 'sentence'").collect()
    assert got == sorted((r.track, r.seq, r.at_ms, r.value) for r in want)


def test_prices_by_voice(spark):
    voices = tracks.voice_catalogue(spark)
    rows = spark.createDataFrame([(1, "en-US", "Ruth", "long-form"), (2, "en-GB", "Amy", "standard")], "k int, language string, name string, voice_type string")
    assert sorted((r.k, r.usd_per_million) for r in tracks.rated(rows, voices).collect()) == [(1, 100.0), (2, 4.0)]
    with pytest.raises(PySparkException, match="no such voice: en-GB Ruth neural"):
        tracks.rated(spark.createDataFrame([(1, "en-GB", "Ruth", "neural")], rows.schema), voices).collect()
