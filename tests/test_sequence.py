"""Ordered computations against plain loops, on blocks of a few rows."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from narratum.operators import lyrics, sequence, ssml


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(sequence, "RANGE", 7)


def test_numbers_and_sums(spark, small):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(30)]), rng.randrange(5), "x") for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v long, pos_old string").repartition(5)
    got = sequence.running(sequence.numbered(df, ["k"], ["o", "v"], total="all"), ["k"], F.col("v"), "sum", block=4)
    got = sequence.following(got, ["k"], "v", "next", block=4).collect()
    assert len(got) == 200
    for k in ("a", "b", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.pos)
        want = sorted(((o is not None, o or 0, v) for x, o, v, _ in rows if x == k))
        assert [r.pos for r in own] == list(range(len(want))) and {r.all for r in own} == {len(want)}
        assert [(r.o is not None, r.o or 0, r.v) for r in own] == want
        assert [r.sum for r in own] == [sum(v for _, _, v in want[: i + 1]) for i in range(len(want))]
        assert [r.next for r in own] == [v for _, _, v in want[1:]] + [None]
    assert sequence.numbered(df.limit(0), ["k"], ["o"]).count() == 0


def test_ranked_is_the_same_either_way(spark):
    df = spark.createDataFrame([(k % 3, (k * 7) % 50) for k in range(50)], "k int, o int")
    rows = lambda most: sorted(tuple(r) for r in sequence.ranked(df, ["k"], ["o"], "pos", most).select("k", "o", "pos").collect())
    assert rows(5) == rows(1000)
    assert sorted(r.pos for r in sequence.ranked(df, [], ["o"], "pos", 5).collect()) == list(range(50))


def test_as_of(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), rng.randrange(-20, 200), rng.randrange(9)) for _ in range(60)]
    points = [(rng.randrange(3), rng.choice([None, rng.randrange(-60, 300)]), k) for k in range(120)]
    r, p = spark.createDataFrame(rows, "k int, place long, value int"), spark.createDataFrame(points, "k int, at long, id int")
    both = sequence.as_of(sequence.as_of(p, "at", r, ["k"], "later", True, span=16), "at", r, ["k"], "before", False, span=16)
    for x in both.collect():
        after = [(q, v) for k, q, v in rows if k == x.k and x["at"] is not None and q >= x["at"]]
        past = [(q, v) for k, q, v in rows if k == x.k and x["at"] is not None and q < x["at"]]
        assert (x.later, x.before) == (min(after)[1] if after else None, max(past)[1] if past else None)
    assert both.count() == len(points)


def test_reached_in_few_rounds(spark):
    jumps = [(0, k, k + 1 + k % 3) for k in range(300)] + [(1, 5, 9), (1, 9, None), (2, 0, 1)]
    got = sequence.reached(spark.createDataFrame(jumps, "k int, pos long, to long"), spark.createDataFrame([(0, 2), (1, 5)], "k int, pos long"), ["k"])
    want, at = {(1, 5), (1, 9)}, 2
    while at < 304:
        want.add((0, at))
        at = at + 1 + at % 3 if at < 300 else 10**6
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_states(spark, small):
    rng = random.Random(3)
    rows = [(k, p, sum(rng.randrange(4) << 2 * s for s in range(4)), [str(p)]) for k, n in ((0, 100), (1, 3), (2, 17)) for p in range(n)]
    got = sequence.states(spark.createDataFrame(rows, "k int, pos long, step int, carried array<string>").repartition(3), ["k"], "step", "state", fold=4).collect()
    assert len(got) == len(rows)
    for k in (0, 1, 2):
        state = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos):
            assert r.state == state and r.carried == [str(r.pos)]
            state = r.step >> 2 * state & 3


def paragraphs(records):
    """The merge by a plain loop: (tag, parents, content) in order."""
    out, carry, was = [], False, False
    for k, (tag, parents, content) in enumerate(records):
        inline = tag.split(".")[0] in ssml.INLINE
        if content is None:
            was = False
            continue
        other = inline or carry
        path = parents + [tag] if was else parents
        after = records[k + 1] if k + 1 < len(records) else None
        hit = after is not None and len(path) > 0 and after[1] + [after[0]] == path
        if carry:
            out[-1].append(content)
        else:
            if other and not out:
                out.append([])
            out.append([content])
        carry, was = other and hit, other
    return out


def test_merge_of_long_tracks(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(sequence, "RANGE", 40)
    tracks, kinds = {}, ["p.1", "p.2", "i.3", "b.4", "big.5", "div.6"]
    for t in range(40):
        rows = []
        for _ in range(rng.randrange(1, 60) if t else 700):
            parents = rng.choice([[], ["p.1"], ["p.2"], ["p.1", "i.3"], ["div.6"]])
            rows.append((rng.choice(kinds), parents, rng.choice([None, "x", "y", "z"])))
            if rng.random() < 0.5 and len(rows) > 1:  # what follows an inline element is often its parent's text
                tag, up, _ = rows[-1]
                if up:
                    rows.append((up[-1], up[:-1], rng.choice(["t", None])))
        tracks[t] = rows
    data = [(t, k, tag, parents, content) for t, rows in tracks.items() for k, (tag, parents, content) in enumerate(rows)]
    df = spark.createDataFrame(data, "track int, o int, tag string, parents array<string>, content string").repartition(4)
    want = sorted((t, k, x) for t, rows in tracks.items() for k, x in enumerate(paragraphs(rows)))
    monkeypatch.setattr(sequence.states, "__defaults__", ("pos", 8))
    for made in (ssml.merge_scan(df, "track", "o"), ssml.merge_inline(df, "track", "o"), ssml.merge_inline(df, "track", "o", long=30)):
        assert sorted((r.track, r.par_no, r.content) for r in made.collect()) == want
    assert ssml.merge_scan(df.limit(0), "track", "o").count() == 0


def packed(lengths, limit=2850, frame=21):
    size = q = 0
    out = []
    for n in lengths:
        if frame + size + n < limit:
            size += n
        else:
            q, size = q + 1, n
        out.append(q)
    return out


def test_packing_by_jumps(spark, small):
    rng = random.Random(6)
    limits = [[2828], [2829], [2830, 5], [2829, 1], [2828, 1], [1414, 1414, 1], [1414, 1415], [0, 2829, 0, 0, 2829], [5000, 5000], [0], [1] * 3000]
    tracks = limits + [[rng.choice([0, 1, 20, 400, 900, 2000, 2828, 2829, 2900]) for _ in range(rng.randrange(1, 80))] for _ in range(40)]
    data = [(t, k, n, "x") for t, ns in enumerate(tracks) for k, n in enumerate(ns)]
    df = spark.createDataFrame(data, "t int, o int, n int, more string").repartition(4)
    want = [(t, k, n, "x", k, q) for t, ns in enumerate(tracks) for k, (n, q) in enumerate(zip(ns, packed(ns)))]
    for made in (ssml.pack_jumps(df, ["t"], ["o"], "n"), ssml.pack(df, ["t"], ["o"], "n"), ssml.pack(df, ["t"], ["o"], "n", long=50)):
        assert sorted(tuple(r) for r in made.select("t", "o", "n", "more", "place", "query_no").collect()) == want
    assert ssml.pack_jumps(df.limit(0), ["t"], ["o"], "n").count() == 0


def test_packing_a_million_portions(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("t"), "id", (F.col("id") * 7919 % 1900).cast("int").alias("n"))
    began = time.time()
    got = ssml.pack(rows, ["t"], ["id"], "n").select("id", "query_no").toPandas().sort_values("id")
    assert got["query_no"].tolist() == packed([k * 7919 % 1900 for k in range(1_000_000)])
    assert time.time() - began < 180


def splice(levels, t, end):
    """The silence around a time, by plain loops."""
    n, loud = len(levels), lambda x: x >= lyrics.LOUD
    after = t
    while after < n and not loud(levels[after]):
        after += 1
    before = min(after, n)
    before = next((k + 1 for k in range(before - 1, -1, -1) if not loud(levels[k])), 0)
    out = [(after + before) // 2, (after - before) // 2]
    if end is None:
        return (*out, None, None)
    past = next((k + 1 for k in range(min(end, n) - 1, -1, -1) if loud(levels[k])), 0)
    quiet = next((k for k in range(past, n) if not loud(levels[k])), n)
    return (*out, (past + quiet) // 2, (quiet - past) // 2)


def test_silence_by_runs(spark):
    rng = random.Random(9)
    tracks = {0: [-70.0] * 50, 1: [-10.0] * 50, 2: [-10.0], 3: [-70.0]}
    for t in range(4, 10):
        levels, loud = [], True
        while len(levels) < 400:
            levels += [rng.uniform(-59, 0) if loud else rng.uniform(-90, -61) for _ in range(rng.choice([1, 2, 5, 40, 120]))]
            loud = not loud
        tracks[t] = levels
    frames = [(t, k, x) for t, xs in tracks.items() for k, x in enumerate(xs)]
    targets = [(t, k, rng.randrange(0, len(xs) + 5), rng.choice([None, rng.randrange(0, len(xs) + 9)])) for t, xs in tracks.items() for k in range(30)]
    f, g = spark.createDataFrame(frames, "track int, ms int, dbfs double").repartition(3), spark.createDataFrame(targets, "track int, line int, t int, end_t int")
    for span in (16, 1 << 16):
        got = lyrics.splice_points(f, g, "track", span=span)
        rows = sorted((r.track, r.line, r.start_splice, r.start_half, r.end_splice, r.end_half) for r in got.collect())
        assert rows == sorted((t, k, *splice(tracks[t], at, end)) for t, k, at, end in targets)


def test_silence_in_an_hour_of_audio(spark):
    """4 million frames in one track."""
    n = 4_000_000
    frames = spark.range(n).select(F.lit(1).alias("track"), F.col("id").alias("ms"), F.when(F.col("id") % 50_000 < 700, -80.0).otherwise(-20.0).alias("dbfs"))
    targets = spark.range(2000).select(F.lit(1).alias("track"), F.col("id").alias("line"), (F.col("id") * 2000 + 1).alias("t"), (F.col("id") * 2000 + 1900).alias("end_t"))
    began = time.time()
    got = {r.line: r for r in lyrics.splice_points(frames, targets, "track").collect()}
    assert time.time() - began < 60 and len(got) == 2000
    assert (got[0].start_splice, got[0].start_half) == (700, 0) and (got[1].start_splice, got[1].start_half) == ((2001 + 700) // 2, (2001 - 700) // 2)


def spliced(levels, cuts, readings):
    """The edited frames by cutting lists, one cut after the other."""
    out, delta = list(levels), 0
    for k, (start, end, start_half, end_half) in enumerate(cuts):
        reading = list(readings[k])
        if reading:
            first = next((i for i, x in enumerate(reading) if x >= lyrics.LOUD), len(reading)) - 1 - start_half
            reading = [-math.inf] * -first + reading if first < 0 else reading[first:]
            if end_half is not None:
                last = next((i + 1 for i in range(len(reading) - 1, -1, -1) if reading[i] >= lyrics.LOUD), 0) + 1 + end_half
                reading = (reading + [-math.inf] * last)[:last]
        place = lambda x, n=len(out): max(n + x, 0) if x < 0 else min(x, n)
        if end is None:
            out = out[: place(start + delta)] + reading
        else:
            out = out[: place(start + delta)] + reading + out[place(end + delta) :]
            delta += len(reading) - (end - start)
    return out


def test_edited_frames_of_overlapping_cuts(spark):
    rng = random.Random(12)
    frames, cuts, readings, want = [], [], [], []
    for t in range(60):
        level = lambda n: [rng.choice([-80.0, -70.0, -20.0, -5.0]) for _ in range(n)]
        own = level(rng.randrange(1, 150))
        marks, said = [], []
        at = 0
        for k in range(rng.randrange(0, 6)):
            start = rng.randrange(0, 170)
            end = rng.choice([None, start, start + rng.randrange(40), max(0, start - rng.randrange(20))])
            if t % 2:  # one behind the other
                start = min(at + rng.randrange(20), len(own))
                end = at = min(start + rng.randrange(20), len(own))
            marks.append((start, end, rng.randrange(4), None if end is None else rng.choice([None, 0, 3, 9])))
            said.append(level(rng.choice([0, 1, 5, 30])))
        frames += [(t, k, x) for k, x in enumerate(own)]
        cuts += [(t, k, *m) for k, m in enumerate(marks)]
        readings += [(t, k, i, x) for k, xs in enumerate(said) for i, x in enumerate(xs)]
        want += [(t, k, x) for k, x in enumerate(spliced(own, marks, said))]
    got = lyrics.edited_frames(
        spark.createDataFrame(frames, "track int, ms int, dbfs double").repartition(3), spark.createDataFrame(cuts, "track int, o int, start_splice int, end_splice int, start_half int, end_half int"),
        spark.createDataFrame(readings, "track int, o int, ms int, dbfs double"), "track", "o", span=16,
    )
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_cuts_of_a_long_track(spark):
    """4,000 cuts, some overlapping or backward, the last ones beyond the audio's end: no fold over the whole track."""
    rng = random.Random(5)
    n, tracks = 40_000, (0, 1)
    cuts, pieces = [], {}
    for t in tracks:
        own = []
        for k in range(4000):
            start = 10 * k + 2
            end = start + rng.randrange(7)
            if t and k % 50 == 7:
                start, end = rng.choice([(start, start - 4), (start - 9, end), (start - 5, start - 5)])
            own.append((start, end, rng.randrange(9)))
        own += [(n - 3, n + 4, 2), (n + 7, None if t else n + 9, 3), (n + 1, n + 2, 1)][: 3 if t else 1]
        cuts += [(t, k, *c) for k, c in enumerate(own)]
        audio, delta = [(None, i) for i in range(n)], 0
        for k, (start, end, size) in enumerate(own):
            place = lambda x, m=len(audio): max(m + x, 0) if x < 0 else min(x, m)
            audio[place(start + delta) :] = [(k, i) for i in range(size)] + (audio[place(end + delta) :] if end is not None else [])
            delta += 0 if end is None else size - (end - start)
        pieces[t] = audio
    cuts = spark.createDataFrame(cuts, "track int, o int, start_splice int, end_splice int, new_length int")
    began = time.time()
    got = lyrics.pieces(cuts, spark.createDataFrame([(t, n) for t in (*tracks, 2)], "track int, length int"), "track", "o").where("hi > lo").collect()
    assert time.time() - began < 60
    for t in tracks:
        audio = [None] * len(pieces[t])
        for r in got:
            if r.track == t:
                assert all(x is None for x in audio[r.new_start : r.new_start + r.hi - r.lo])
                audio[r.new_start : r.new_start + r.hi - r.lo] = [(r.src, i) for i in range(r.lo, r.hi)]
        assert audio == pieces[t]
    assert [tuple(r) for r in got if r.track == 2] == [(2, None, 0, n, 0)]
