import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from narratum.functions import text as X
from narratum.operators import ssml, tracks


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


def test_speech_text(spark):
    assert one(spark, X.speech_text, "Tom & \"Jerry\" <’s> ça—vapß “x” nb\xa0sp Ǻ") == "Tom &amp; &quot;Jerry&quot; &lt;&apos;s&gt; ca vap x nbsp A"
    assert one(spark, X.strip_accents, "é é ṩ Ω") == "e e s Ω"
    assert one(spark, X.clean_spoken, "a(b)c/d\\e:f<g>h=i&j\r\nk\nl") == "a b c d e f g hequalsi and jkl"


def test_dates_times_paths(spark):
    dates = {"2012": None, "2012-01-02": "2012-01-02", "2012-1-2": "2012-01-02", "2012-01-02T03:04:05+00:00": "2012-01-02", "2012-01-02T03:04:05Z": None, "2012-01-02T03:04:05-05:00": None}
    for given, want in dates.items():
        assert one(spark, X.read_date, given) == want
    assert one(spark, X.parse_time, "[0:1.57]x") == 1569 and one(spark, X.parse_time, "1:2.5") == 62050 and one(spark, X.parse_time, "[ar:x]") is None
    assert [one(spark, X.is_time, t) for t in ("01:02.03", "[1:02.03]", "1:2.03", "100:02.03")] == [True, True, False, False]
    df = spark.range(1).select(X.show_time(F.lit(3_723_459)).alias("a"), X.show_time(F.lit(62_050), padded=False).alias("b")).first()
    assert df.a == "[62:03.45]" and df.b == "[1:2.5]"
    assert one(spark, X.target_id, "a#b#c") == "b#c" and one(spark, X.target_path, "a#b#c") == "a" and one(spark, X.target_id, "a") is None
    assert [one(spark, X.under_folder, p, d) for p, d in (("x", ""), ("x", "O"), ("/x", "O"), ("x", "O/"))] == ["x", "O/x", "/x", "O/x"]
    assert one(spark, X.first_year, "c. 1999 or 2001") == "1999" and one(spark, X.first_year, "no") is None
    assert [one(spark, f, "a/b/c.d.e") for f in (X.base_name, X.folder_name, X.extension)] == ["c.d.e", "a/b", ".e"]


def test_split_stages(spark):
    cut = lambda t, n: one(spark, lambda c: X.split_to_limit(c, n), t)
    assert cut("short", 10) == ["short"] and cut("x" * 9, 9) == ["x" * 9]
    assert cut("one two. three four. five", 12) == ["one two.", "three four.", "five"]
    assert cut("aaa, bbb ccc", 9) == ["aaa,", "bbb ccc"] and cut("aaa, bbb ccc", 7) == ["aaa,", "bbb", "ccc"]
    assert cut("ab-cd-ef", 5) == ["ab", "cd", "ef"]
    with pytest.raises(PySparkException):
        ssml.split_paragraphs(spark.createDataFrame([(0, ["y" * 30])], "par_no int, content array<string>"), limit=10).collect()


def merged(spark, records):
    df = spark.createDataFrame([("t", k, *r) for k, r in enumerate(records)], "track string, pos int, tag string, parents array<string>, content string")
    return [r.content for r in ssml.merge_inline(df, "track", "pos").orderBy("par_no").collect()]


def test_merge_inline(spark):
    p = ["p.1"]
    text = [("p.1", [], "text "), ("i.2", p, "x"), ("p.1", [], " more "), ("b.3", p, "y"), ("p.1", [], " z")]
    assert merged(spark, text)[:2] == [["text "], ["x", " more "]]
    assert merged(spark, [("p.1", [], "a"), ("p.2", [], "b"), ("img.3", [], None), ("p.4", [], "c")]) == [["a"], ["b"], ["c"]]
    assert merged(spark, [("i.2", p, "first"), ("p.3", [], "b")]) == [[], ["first"], ["b"]]


def test_packing_limits(spark):
    def packed(*sizes):
        df = spark.createDataFrame([("t", k, n) for k, n in enumerate(sizes)], "track string, pos int, n int")
        return [r.query_no for r in ssml.pack(df, ["track"], ["pos"], "n").orderBy("pos").collect()]

    assert packed(2828) == [0] and packed(2829) == [1]
    assert packed(1000, 1828, 1) == [0, 0, 1] and packed(1000, 1829) == [0, 1] and packed(10, 10, 2829, 5) == [0, 0, 1, 2]
    df = spark.createDataFrame([("t", 0, "x" * 2829), ("u", 0, "y")], "track string, pos int, ssml string").withColumn("n", F.length("ssml"))
    made = ssml.requests(ssml.pack(df, ["track"], ["pos"], "n"), ["track"], ["pos"])
    made = ssml.with_empty_tracks(made, spark.createDataFrame([("v",), ("u",)], "track string"), ["track"])
    assert sorted((r.track, r.query_no, len(r["query"])) for r in made.collect()) == [("t", 0, 15), ("t", 1, 2844), ("u", 0, 16), ("v", 0, 15)]
    with pytest.raises(PySparkException):
        ssml.render(spark.createDataFrame([("x" * 2840, 1)], "text string, pos int"), None, ["pos"]).collect()


def test_texts_meet_their_numbers(spark):
    sizes = {("b", 1): [900, 900, 1200, 1800], ("b", 2): [5], ("c", 3): [1890, 1890], ("b", 4): []}
    rows = [(book, track, k // 2, k % 2, f"{track}{k}".ljust(n, "x"), n) for (book, track), own in sizes.items() for k, n in enumerate(own)]
    pieces = spark.createDataFrame(rows, "book string, track int, line int, piece int, text string, char_length int")
    key, order = ["track"], ["line", "piece"]
    want = ssml.pack(ssml.render(pieces, "book", ["track", *order]), key, order)
    want = {(r.track, r.query_no): r["query"] for r in ssml.requests(want, key, order).collect()}
    packed = ssml.pack(ssml.measured(pieces.drop("text"), "book", ["track", *order]), key, order)
    assert "text" not in packed.columns
    assert {(r.track, r.query_no): r["query"] for r in ssml.requests(ssml.written(pieces, packed, key, order), key, ["place"]).collect()} == want and len(want) == 6
    with pytest.raises(PySparkException):
        ssml.measured(spark.createDataFrame([(2840, 1)], "char_length int, pos int"), None, ["pos"]).collect()


def test_tracks(spark):
    rows = [("b", 0, "Cover", 1, ["q"]), ("b", 1, "Untitled", 2, ["q", "r"]), ("b", 2, "Copyright", 3, ["q", "r", "s"]), ("b", 3, "One", 1, [" "]), ("b", 4, "Two", 1, ["<speak></speak>"])]
    df = spark.createDataFrame(rows, "book string, track_no int, name string, num_queries int, queries array<string>")
    assert [(r.track, r.title) for r in tracks.finalize(df, book="book").orderBy("track").collect()] == [(1, "Copyright"), (2, "Two")]
    with pytest.raises(PySparkException):
        tracks.rate(tracks.voice_catalogue(spark), "en-US", "Nobody", "neural").collect()
    voices = tracks.voice_catalogue(spark)
    assert voices.select("language").distinct().count() == 8 and voices.select("language", "name").distinct().count() == 28
