import io
import zipfile

import pytest
from pyspark.errors import PySparkException

from narratum.operators import book, legacy, ssml
from narratum.sources import epub

OPF = """<?xml version="1.0"?><package><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<dc:title>A &amp; B</dc:title><dc:creator opf:role="aut" id="c1">Ann</dc:creator><dc:creator id="id-1">Bob</dc:creator><dc:date>2012-1-2</dc:date></metadata>
<manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="one" href="one.xhtml" media-type="application/xhtml+xml"/>
<item id="img" href="old.png" media-type="image/png"/><item id="img" href="i/c.png" media-type="image/png" properties="cover-image"/></manifest>
<spine toc="ncx"><itemref idref="one"/><itemref idref="missing"/></spine><guide><reference type="text" href="one.xhtml"/></guide></package>"""
NCX = """<ncx><navMap><navPoint><navLabel><text>Part</text></navLabel><content src="one.xhtml#p1"/><navPoint><navLabel><text>Tom &amp; Co</text></navLabel><content src="one.xhtml#p2"/></navPoint></navPoint>
<navPoint><navLabel><text>Never</text></navLabel><content src="two.xhtml"/></navPoint></navMap></ncx>"""
PAGE = "<html><body><p>before</p><p id='p1'>one</p><p id='p2' class='k'>two <i id='q'>in</i> out</p><a id='z'/></body></html>"


def archive(kind="application/epub+zip", container=True):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as box:
        box.writestr("mimetype", kind)
        if container:
            box.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>')
        for name, text in (("c.opf", OPF), ("toc.ncx", NCX), ("one.xhtml", PAGE), ("i/c.png", "PNG")):
            box.writestr(f"OEBPS/{name}", text)
    return data.getvalue()


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shelf")
    for name, data in (("a", archive()), ("b", archive("text/plain")), ("c", archive(container=False)), ("d", b"no zip")):
        (folder / f"{name}.epub").write_bytes(data)
    return epub.members(epub.read_archives(spark, str(folder))).cache()


def test_errors(shelf):
    errors = {r.book_id[-6]: r.error for r in shelf.where("error is not null").collect()}
    assert errors == {"b": "mimetype is text/plain", "c": "no META-INF/container.xml", "d": "not a zip archive"}
    assert epub.archive_error(archive("application/epub+zip "), strict=True)


def test_book_end_to_end(spark, shelf):
    files = shelf.where("error is null")
    package = epub.packages(files, epub.rootfiles(files)).cache()
    meta = epub.metadata(package)
    assert {r.element: r.attrs.get("text") for r in meta.collect() if r.element == "dc:title"} == {"dc:title": " B"}
    whole = epub.metadata(epub.packages(files, epub.rootfiles(files), faithful=False))
    assert whole.where("element = 'dc:title'").first().attrs["text"] == "A & B"
    items = epub.manifest(package)
    assert sorted((r.item_id, r.href) for r in items.collect()) == [("img", "OEBPS/i/c.png"), ("ncx", "OEBPS/toc.ncx"), ("one", "OEBPS/one.xhtml")]
    assert book.cover(items, meta).first().href == "OEBPS/i/c.png"
    assert [(r.name, bytes(r.bytes)) for r in epub.images(items, files).collect()] == [("c.png", b"PNG")]
    assert epub.guide(package).first().type == "text"
    toc = book.flatten_contents(epub.contents(files, epub.contents_path(package, items))).cache()
    assert [(r.label, r.parent_labels, r.src_path, r.src_id) for r in toc.orderBy("toc_pos").collect()] == [("Part", [], "OEBPS/one.xhtml", "p1"), (" Co", ["Part"], "OEBPS/one.xhtml", "p2"), ("Never", [], "OEBPS/two.xhtml", None)]
    pages = book.resolve_spine(epub.spine(package), items, files.select("book_id", "path", "bytes"))
    records = epub.bodies(pages).cache()
    matches = book.match_contents(records, toc)
    done = book.segment(records, matches)
    got = [(r.track_no, r.tag.split(".")[0], r.content) for r in done.orderBy("rec_pos").collect()]
    assert got == [(0, "body", None), (0, "p", "before"), (1, "p", "one"), (2, "p", "two "), (2, "i", "in"), (2, "p", " out"), (2, "a", None)]
    names = book.segment_names(records, matches, toc)
    assert [(r.track_no, r.label) for r in names.orderBy("track_no").collect()] == [(0, book.PRE), (1, "Part"), (2, " Co")]
    merged = ssml.merge_inline(done.where("track_no = 2"), "track_no", "rec_pos").orderBy("par_no")
    assert [r.content for r in merged.collect()] == [["two "], ["in", " out"]]
    tags = {r.tag: r.value for r in book.album_tags(meta, book.rules_frame(spark)).collect()}
    assert tags == {"ALBUM": " B", "ALBUMSORT": " B", "ARTIST": "Bob", "ALBUMARTIST": "Bob", "PUBLISHER": None, "DATE": "2012-01-02"}


def test_album_tags_join_only_rules(spark):
    meta = [("a", "t", 0, {"text": "x"}), ("a", "c", 2, {"text": "late", "role": "aut"}), ("a", "c", 1, {"text": "first", "role": "aut", "id": "1"}), ("a", "c", 3, {"id": "2"}), ("b", "c", 0, {"id": "2", "text": "y"})]
    meta = spark.createDataFrame(meta, "book_id string, element string, seq int, attrs map<string, string>")
    rules = {
        "T": [{"data": {"t.text": "raw"}}], "C": [{"validate": {"c.role": "aut"}, "data": {"pop.text": "raw"}}, {"validate": {"c.role": "aut", "c.id": "2"}, "data": {"pop.text": "raw"}}],
        "D": [{"validate": {"c.id": "2"}, "data": {"pop.text": "raw"}}, {"data": {"c.role": "raw"}}, {"data": {"t.text": "other"}}], "N": [{"validate": {"c.role": "edt"}, "data": {"pop.text": "raw"}}],
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tags = book.album_tags(meta, book.rules_frame(spark, rules))
        assert "SortMergeJoin" not in tags._jdf.queryExecution().sparkPlan().toString()
        assert {(r.book_id, r.tag): r.value for r in tags.collect()} == {("a", "T"): "x", ("a", "C"): None, ("a", "D"): "aut", ("b", "T"): None, ("b", "D"): None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_missing_page_is_an_error(spark):
    spine = spark.createDataFrame([("b", 0, "x")], "book_id string, spine_pos int, idref string")
    items = spark.createDataFrame([("b", "x", 0, "gone")], "book_id string, item_id string, seq int, href string")
    files = spark.createDataFrame([], "book_id string, path string, bytes binary")
    with pytest.raises(PySparkException):
        book.resolve_spine(spine, items, files).collect()


def test_contents_are_taken_once(spark):
    records = spark.createDataFrame([("b", k, "f", ids) for k, ids in enumerate([[], ["x"], [], ["y"]])], "book_id string, rec_pos int, path string, ids array<string>")
    toc = spark.createDataFrame([("b", 0, "f", None), ("b", 1, "f", None), ("b", 2, "f", "y"), ("b", 3, "f", "x")], "book_id string, toc_pos int, src_path string, src_id string")
    assert sorted((r.rec_pos, r.toc_pos) for r in book.match_contents(records, toc).collect()) == [(0, 0), (1, 1), (3, 2)]


def test_legacy(spark):
    runs = spark.createDataFrame([("b", k, n) for k, n in enumerate([0, 5, 5, 0, 1, 1, 0, 9])], "book string, i int, n int")
    assert tuple(legacy.longest_run(runs, "book", "i", "n").first()) == ("b", 1, 2)
    kept = legacy.in_range(runs, legacy.F.lit(2), legacy.F.lit(4), "i", legacy.F.lit(8))
    assert sorted(r.i for r in kept.collect()) == [2, 3, 4]
    files = spark.createDataFrame([("b", "OEBPS/a.png"), ("b", "c.png")], "book_id string, path string")
    items = spark.createDataFrame([("b", "a.png"), ("b", "c.png")], "book_id string, href string")
    assert sorted((r.href, r.path) for r in epub.legacy_file(items, files).collect()) == [("a.png", "OEBPS/a.png"), ("c.png", "c.png")]
    elements = spark.createDataFrame([("b", "x", {"k": "v"})], "book_id string, id string, attrs map<string, string>")
    lost = spark.createDataFrame([("b", "#y", "p", "t", 0)], "book_id string, refines string, property string, text string, seq int")
    with pytest.raises(PySparkException):
        legacy.refine(elements, lost).collect()


def test_legacy_packing(spark):
    df = spark.createDataFrame([("e", 0, "x" * 2699), ("e", 1, "y"), ("e", 2, "z")], "entry string, par_no int, text string")
    got = [(r.query_no, r["query"]) for r in legacy.pack_entries(df, ["entry"]).orderBy("query_no").collect()]
    head, tail = legacy.HEAD, legacy.TAIL
    assert got == [(0, f'{head}<p>{"x" * 2699}</p>\n<mark name="p0"/>\n{tail}'), (1, f'{head}<p>y</p>\n<mark name="p1"/>\n<p>z</p>\n<mark name="p2"/>\n{tail}\n')]
    with pytest.raises(PySparkException):
        legacy.pack_entries(spark.createDataFrame([("e", 0, "x" * 2700)], "entry string, par_no int, text string"), ["entry"]).collect()


def test_legacy_markup(spark):
    page = "<html><body><h1>Head</h1><div>lead <p>one <i>in</i></p> tail</div><p>two\nlines é</p></body></html>".encode()
    pages = spark.createDataFrame([("b", 0, bytearray(page)), ("b", 1, bytearray(b"<html><body>bare</body></html>"))], "book_id string, spine_pos int, bytes binary")
    got = [r.text for r in epub.page_paragraphs(pages).orderBy("spine_pos", "par_no").collect()]
    assert got == ["Head", "lead one in tail", "two lines "]
    rows = list(epub.element_rows(OPF.encode(), "metadata"))
    assert [(r["tag"], dict(r["attrs"]).get("text")) for r in rows] == [("title", "A & B"), ("creator", "Ann"), ("creator", "Bob"), ("date", "2012-1-2")]
    assert dict(rows[1]["attrs"])["role"] == "aut"
    creators = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 2), ("b", 2, 2)], "book_id string, pos int, display_seq int")
    assert sorted((r.book_id, r.pos, r.place) for r in legacy.order_creators(creators).collect()) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("b", 2, 2)]
    images = spark.createDataFrame([("b", 0, "x.png", "/x"), ("b", 1, "Cover.png", "/c"), ("c", 0, "y.png", "/y"), ("c", 1, "mycover", "/m")], "book_id string, seq int, ref string, location string")
    shown = legacy.page_images(spark.createDataFrame([("b", 3, "<img src='x.png'/>"), ("c", 0, "")], "book_id string, page_no int, markup string"), images)
    assert sorted(map(tuple, legacy.first_image(shown, images).collect())) == [("b", "/x"), ("c", "/m")]


def test_legacy_tags(spark):
    rows = [
        ("a", 0, "creator", {"text": "X", "role": "trl"}), ("a", 1, "creator", {"text": "Y"}), ("a", 2, "date", {"text": "1999", "event": "creation"}),
        ("a", 3, "date", {"text": "none", "event": "publication"}), ("a", 4, "rights", {"file-as": "c 2001", "text": "x"}), ("a", 5, "subject", {"text": "g"}), ("a", 6, "subject", {"id": "s"}),
        ("b", 0, "title", {"file-as": "T, The"}), ("c", 0, "creator", {"id": "x"}),
    ]
    album = legacy.album_tags(spark.createDataFrame(rows, "book_id string, seq int, element string, attrs map<string, string>"))
    got = {r.book_id: (dict(r.tags), list(r.genres)) for r in album.collect()}
    a = {"ARTIST": "X", "ALBUMARTIST": "X", "COMPOSER": "X", "COPYRIGHT": "c 2001", "YEAR": "2001", "GENRE": "g"}
    assert got == {"a": (a, ["g"]), "b": ({"ALBUMSORT": "T, The", "ALBUM": "T, The"}, []), "c": ({}, [])}
    entries = spark.createDataFrame([("b", 0, None), ("b", 1, "x/y"), ("z", 0, "t")], "book_id string, entry_no int, text string")
    titles = {(r.book_id, r.entry_no): dict(r.tags) for r in legacy.entry_tags(entries, album).collect()}
    assert titles["b", 0]["TITLE"] == "Entry Number 0" and titles["b", 1] == got["b"][0] | {"TITLE": "x-y"} and titles["z", 0] == {"TITLE": "t"}
