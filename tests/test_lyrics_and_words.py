import random

from narratum.operators import lyrics, words
from narratum.sources import files
from narratum.streaming import lyrics as stream


def test_parse_and_correct(spark, tmp_path):
    (tmp_path / "a.lrc").write_text("[ar:Me]\n[0:1.57] The Hat \n[0:3.0]no\n[0:3.0]the end the\nrest\n")
    got = files.read_lyrics(spark, str(tmp_path / "a.lrc")).drop("book_id")
    assert sorted(map(tuple, got.collect())) == [(1569, "The Hat"), (3000, "the end the")]
    fixed = lyrics.corrected(files.read_lyrics(spark, str(tmp_path / "a.lrc")), "book_id", "THE", r"a\1$")
    assert sorted((r.new, r.end_time) for r in fixed.collect()) == [(r"a\1$ Hat", 3000), (r"a\1$ end a\1$", None)]


def test_splice_points_against_loops(spark):
    rng = random.Random(2)
    frames, targets = [], []
    for track in range(6):
        n, loud = rng.randrange(5, 60), True
        sound = []
        while len(sound) < n:
            sound += [-20.0 if loud else -80.0] * rng.randrange(1, 9)
            loud = not loud
        sound = sound[:n]
        frames += [(track, k, v) for k, v in enumerate(sound)]
        for line in range(8):
            t = rng.randrange(n)
            e = rng.choice([None, rng.randrange(n + 4)])
            after = next((k for k in range(t, n) if sound[k] >= -60), n)
            before = max([k for k in range(after) if sound[k] < -60], default=-1) + 1
            want = [(after + before) // 2, (after - before) // 2, None, None]
            if e is not None:
                ea = max([k for k in range(min(e, n)) if sound[k] >= -60], default=-1) + 1
                eb = next((k for k in range(ea, n) if sound[k] < -60), n)
                want[2:] = [(ea + eb) // 2, (eb - ea) // 2]
            targets.append((track, line, t, e, want))
    df = lyrics.splice_points(spark.createDataFrame(frames, "track int, ms int, dbfs double"), spark.createDataFrame([x[:4] for x in targets], "track int, line int, t int, end_t int"), "track")
    got = {(r.track, r.line): [r.start_splice, r.start_half, r.end_splice, r.end_half] for r in df.collect()}
    assert got == {x[:2]: x[4] for x in targets}


def test_frequencies_file_and_report(spark, tmp_path):
    (tmp_path / "f.csv").write_text("word,count\n The ,5\ncat,2\nthe,10\n")
    general = files.read_frequencies(spark, str(tmp_path / "f.csv"))
    assert sorted(map(tuple, general.collect())) == [("cat", 2), ("the", 10)]
    q = spark.createDataFrame([(0, "<p>The cat</p> dog, zebra the cat ant")], "no int, q string")
    scored = words.importance(q, general, "q", ["no"])
    assert [r.value for r in words.report_lines(scored).collect()] == ["cat: 1.000000", "zebra: 1.000000", "ant: 1.000000", "the: 0.200000"]


def test_offset_stream(spark, tmp_path):
    rows = [("a", 0, 5, "sentence", "x"), ("a", 1, 100, "preceding_realtime", None), ("b", 0, 1, "sentence", "y"), ("a", 2, 7, "sentence", "z")]
    schema = "track string, seq long, time_ms long, type string, value string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    marks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.offset_stream(marks).writeStream.format("memory").queryName("offsets").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.track, r.at_ms) for r in spark.table("offsets").collect()) == [("a", 5), ("a", 107), ("b", 1)]


def test_trimmed_readings(spark):
    sound = {"a": [-80] * 5 + [-10] * 4 + [-80] * 6, "b": [-10] * 3, "c": [-80] * 4}
    frames = spark.createDataFrame([(t, k, float(v)) for t, vs in sound.items() for k, v in enumerate(vs)], "track string, ms int, dbfs double")
    halves = spark.createDataFrame([("a", 2, 1), ("b", 0, 4), ("c", 1, None)], "track string, start_half int, end_half int")
    got = {r.track: (r.cut_start, r.new_length) for r in lyrics.trimmed_readings(frames, halves).collect()}
    assert got == {"a": (2, 7 + 1 + 1), "b": (-1, 4 + 1 + 4), "c": (2, 2)}
