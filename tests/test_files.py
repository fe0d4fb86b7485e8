"""JSON inputs, line files and a book's output files."""

import json
import os

from pyspark.sql import functions as F

from narratum.operators import book
from narratum.sources import files, formats


def test_book_documents(spark, tmp_path):
    doc = {
        "metadata": {"name_spaces": {}, "dc:title": {"text": "Tom & Zoë"}, "dc:creator": [{"opf:role": "aut", "text": "Ann"}]},
        "tracklist": [
            {"entry": {"label": "Pre"}, "spine_readable_tags": []},
            {"entry": {"label": "One", "parent_labels": ["Part"], "src": "a#x"}, "spine_readable_tags": [{"tag": "p.1", "parent_tag_list": ["div.0"], "id": ["x", "y"], "content": "hi", "class": "k"}, {"tag": "a.2", "id": "z", "path": "a"}, {"tag": "i.3", "content": ""}]},
        ],
    }
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    (tmp_path / "rules.json").write_text(json.dumps({"name_spaces": {}, "id3_mappings": book.RULES}))
    records, segments = files.read_book(spark, str(tmp_path / "b.json"))
    assert [(r.track_no, r.label, r.parent_labels) for r in segments.orderBy("track_no").collect()] == [(0, "Pre", None), (1, "One", ["Part"])]
    got = [(r.track_no, r.rec_pos, r.tag, r.parents, r.ids, r.content, r.path) for r in records.orderBy("rec_pos").collect()]
    assert got == [(1, 0, "p.1", ["div.0"], ["x", "y"], "hi", None), (1, 1, "a.2", None, ["z"], None, "a"), (1, 2, "i.3", None, [], "", None)]
    meta, rules = files.read_documents(spark, str(tmp_path / "b.json"), "metadata"), files.read_rules(spark, str(tmp_path / "rules.json"))
    tags = book.document_tags(meta, book.path_rules(spark, rules))
    assert {r.tag: r.value for r in tags.collect()} == {"ALBUM": "Tom & Zoë", "ALBUMSORT": "Tom & Zoë", "ARTIST": "Ann", "ALBUMARTIST": "Ann", "PUBLISHER": None, "DATE": None}
    formats.write_files(files.tag_documents(tags, F.lit("metadata.json")), str(tmp_path / "out"))
    text = (tmp_path / "out" / "metadata.json").read_text(encoding="utf-8")
    want = {"ALBUM": "Tom & Zoë", "ALBUMARTIST": "Ann", "ALBUMSORT": "Tom & Zoë", "ARTIST": "Ann", "DATE": None, "PUBLISHER": None}
    assert text == json.dumps(want, indent=4, sort_keys=True, ensure_ascii=False)
    assert files.read_album(spark, str(tmp_path / "out")).first().tags == want


def test_request_documents_round_trip(spark, tmp_path):
    names = spark.createDataFrame([("b", 0, "Pre"), ("b", 1, "É/1"), ("c", 0, "x")], "book_id string, track_no int, name string")
    queries = spark.createDataFrame([("b", 1, k, f"<speak>{k}</speak>") for k in range(12)] + [("c", 0, 0, "q")], "book_id string, track_no int, query_no int, query string")
    formats.write_files(files.request_documents(queries, names, F.concat("book_id", F.lit(".json"))), str(tmp_path))
    doc = {"tracklist": [{"name": "Pre", "num_queries": 0, "ssml_queries": []}, {"name": "É/1", "num_queries": 12, "ssml_queries": [f"<speak>{k}</speak>" for k in range(12)]}]}
    assert (tmp_path / "b.json").read_text(encoding="utf-8") == json.dumps(doc, indent=4, sort_keys=True, ensure_ascii=False)
    back = files.read_tracks(spark, str(tmp_path / "b.json")).orderBy("track_no").collect()
    assert [(r.track_no, r.name, len(r.queries), r.num_queries, r.tags) for r in back] == [(0, "Pre", 0, 0, None), (1, "É/1", 12, 12, None)]


def test_track_files(spark, tmp_path):
    tracks = spark.createDataFrame([("b", 1, "One / 1", "Ann"), ("b", 2, "Two", None)], "book_id string, track int, title string, artist string")
    marks = [(0, 0, "sentence", "Hello."), (1, 61_234, "sentence", "Zoë?"), (2, 61_300, "ssml", "p0"), (3, 70_000, "preceding_realtime", None), (4, 5, "sentence", "Again"), (5, 9, "ssml", "p1"), (6, 9, "ssml", "p2"), (7, 10, "sentence", "end")]
    rows = spark.createDataFrame([("b", 1, *m) for m in marks], "book_id string, track int, seq int, time_ms long, type string, value string").repartition(3)
    formats.write_files(files.track_files(tracks, rows, ["book_id", "track"], ["seq"], F.lit("Ann/[2012] Album")), str(tmp_path))
    at = tmp_path / "Ann" / "[2012] Album"
    assert sorted(os.listdir(at)) == sorted(f"{n}{e}" for n in ("1 - One - 1", "2 - Two") for e in (".json", ".lrc", ".txt"))
    read = lambda n: (at / n).read_text(encoding="utf-8")
    assert read("1 - One - 1.lrc") == "[ar:Ann]\n[al:Unknown Album]\n[ti:One / 1]\n\n[00:00.00]Hello.\n[01:01.23]Zoë?\n[01:10.00]Again\n[01:10.01]end\n"
    assert read("1 - One - 1.txt") == "Hello. Zoë?\nAgain\nend\n"
    want = [{"time": t, "type": k, **({"value": v} if v is not None else {})} for _, t, k, v in marks]
    assert read("1 - One - 1.json") == json.dumps(want, indent=4, ensure_ascii=False)
    assert read("2 - Two.lrc") == "[ar:Unknown Artist]\n[al:Unknown Album]\n[ti:Two]\n\n" and read("2 - Two.txt") == "" and read("2 - Two.json") == "[]"
    back = files.read_lyrics(spark, str(at / "1 - One - 1.lrc").replace("[", "\\[")).orderBy("time_ms").collect()
    assert [(r.time_ms, r.text) for r in back] == [(0, "Hello."), (61_230, "Zoë?"), (70_000, "Again"), (70_010, "end")]


def test_files_in_many_splits(spark, tmp_path):
    """Lines keep their order though a file is read in pieces."""
    lines = ["word,count", *[f"{w},{k}" for k in range(3000) for w in ("The", " the ", '"a,b"')], ""]
    (tmp_path / "u.csv").write_text("\r\n".join(lines))
    (tmp_path / "v.csv").write_text("word,count\nzoë,7\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.read_lines(spark, str(tmp_path / "u.csv"))
        assert rows.rdd.getNumPartitions() > 5 and [r.line for r in rows.orderBy("at").collect()] == lines[:-1]
        assert {r.word: r.freq for r in files.read_frequencies(spark, str(tmp_path)).collect()} == {"the": 2999, "a,b": 2999, "zoë": 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_entry_files(spark, tmp_path):
    schema = "index int, text string, xml array<string>, images array<string>, paragraphs array<string>, ssml array<string>, metaTags map<string, string>"
    rows = [(3, "Chapter é", ["a.xhtml"], None, ["one", "two"], ["<speak/>"], {"TRACK": "1", "TITLE": "Chapter/é"}), (4, None, None, None, None, None, {"TRACK": "2"})]
    formats.write_files(files.entry_files(spark.createDataFrame(rows, schema), F.lit("Ann/Album")), str(tmp_path))
    at = tmp_path / "Ann" / "Album"
    assert sorted(os.listdir(at)) == ["1 - Chapter-é.fulldata.json", "1 - Chapter-é.txt", "2 - .fulldata.json", "2 - .txt"]
    want = {"index": 3, "text": "Chapter é", "xml": ["a.xhtml"], "paragraphs": [{"text": "one"}, {"text": "two"}], "ssml": ["<speak/>"], "metaTags": {"TRACK": "1", "TITLE": "Chapter/é"}}
    assert (at / "1 - Chapter-é.fulldata.json").read_text() == json.dumps(want, indent=2, sort_keys=True)
    assert (at / "1 - Chapter-é.txt").read_text() == "one\n\ntwo\n\n" and (at / "2 - .txt").read_text() == ""
