"""The epub format and named files: broken books, retried and failing tasks."""

import io
import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from narratum.sources import epub, formats
from tests.test_book_and_epub import NCX, OPF, PAGE, archive

BOX = '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>'


def packed(**changes):
    """An archive with members replaced, left out (None) or added (names with __ for / and _ for .)."""
    parts = {"mimetype": "application/epub+zip", "META-INF/container.xml": BOX, "OEBPS/c.opf": OPF, "OEBPS/toc.ncx": NCX, "OEBPS/one.xhtml": PAGE}
    parts |= {k.replace("__", "/").replace("_", "."): v for k, v in changes.items()}
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as box:
        for name, text in parts.items():
            if text is not None:
                box.writestr(name, text)
    return data.getvalue()


def encrypted(data, name):
    """The archive with a member's encryption bit set in the central directory and its own header."""
    box, out = zipfile.ZipFile(io.BytesIO(data)), bytearray(data)
    out[box.getinfo(name).header_offset + 6] |= 1
    at = data.index(b"PK\x01\x02")
    while data[at : at + 4] == b"PK\x01\x02":
        n = int.from_bytes(data[at + 28 : at + 30], "little")
        if data[at + 46 : at + 46 + n] == name.encode():
            out[at + 8] |= 1
        at += 46 + n + int.from_bytes(data[at + 30 : at + 32], "little") + int.from_bytes(data[at + 32 : at + 34], "little")
    return bytes(out)


def corrupt(data, name):
    out = bytearray(data)
    info = zipfile.ZipFile(io.BytesIO(data)).getinfo(name)
    start = info.header_offset + 30 + len(name)
    out[start + 3 : start + info.compress_size] = b"\xff" * (info.compress_size - 3)
    return bytes(out)


BOOKS = {
    "good1": packed(), "good2": packed(OEBPS__one_xhtml=PAGE.replace("before", "other")), "sub/good3": packed(),
    "truncated": packed()[:-60], "nozip": b"text", "plain": archive("text/plain"), "nobox": archive(container=False),
    "locked": encrypted(packed(), "OEBPS/one.xhtml"), "lockedtype": encrypted(packed(), "mimetype"), "rotten": corrupt(packed(OEBPS__one_xhtml=PAGE * 50), "OEBPS/one.xhtml"),
    "badpage": packed(OEBPS__one_xhtml="<html><body><p>one</body></html>"), "badpackage": packed(OEBPS__c_opf=OPF[:200]), "badtoc": packed(OEBPS__toc_ncx="<ncx>&nbsp;</ncx>"), "badbox": packed(**{"META-INF__container_xml": "<a>"}),
    "nopage": packed(OEBPS__one_xhtml=None), "nopackage": packed(OEBPS__c_opf=None), "notoc": packed(OEBPS__c_opf=OPF.replace(' toc="ncx"', "")), "lostocs": packed(OEBPS__toc_ncx=None),
    "nobody": packed(OEBPS__one_xhtml="<html/>"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("books")
    for name, data in BOOKS.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / f"{name}.epub").write_bytes(data)
    (at / "other.txt").write_text("no book")
    return str(at)


def short(book_id):
    return book_id.rsplit("/", 1)[-1].removesuffix(".epub")


def test_format_gives_the_same_as_spark_s_reader(spark, folder):
    rows = lambda df: sorted((r.book_id, r.path or "", bytes(r.bytes or b""), r.error or "") for r in df.collect())
    got = formats.read_epub(spark, folder)
    assert rows(got) == rows(epub.members(epub.read_archives(spark, folder))) and {short(r[0]) for r in rows(got)} == {short(x) for x in BOOKS}
    many = formats.read_epub(spark, folder, partitionBytes="1500", members=r"\.opf$")
    assert many.rdd.getNumPartitions() > 5 and rows(many.where("error is null")) == [r for r in rows(got) if r[1].endswith(".opf") and not r[3]]
    one = formats.read_epub(spark, f"{folder}/good1.epub")
    assert {short(r.book_id) for r in one.collect()} == {"good1"} and formats.read_epub(spark, folder, suffix=".none").count() == 0
    small = formats.read_epub(spark, f"{folder}/good1.epub", memberBytes="300").where("path = 'OEBPS/c.opf'").first()
    assert small.bytes is None and "over the limit" in small.error


def test_only_wanted_members_are_inflated(spark, folder, monkeypatch):
    seen, inflated = [], epub._inflated
    monkeypatch.setattr(epub, "_inflated", lambda box, info, most: seen.append(info.filename) or inflated(box, info, most))
    reader = formats.EpubReader(spark.createDataFrame([], epub.MEMBERS).schema, {"path": f"{folder}/good1.epub", "members": r"\.ncx$"})
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.column(1).to_pylist() for b in batches] == [["OEBPS/toc.ncx"]] and seen == ["mimetype", "OEBPS/toc.ncx"]


def test_shelf_with_broken_books(spark, folder):
    shelf = epub.open_shelf(formats.read_epub(spark, folder))
    errors = {(short(r.book_id), r.stage) for r in shelf.errors.collect()}
    want = {"truncated": "archive", "nozip": "archive", "plain": "archive", "nobox": "archive", "lockedtype": "archive", "locked": "pages", "rotten": "pages", "badpage": "pages", "nopage": "pages", "badpackage": "package", "nopackage": "package", "badtoc": "contents", "notoc": "contents", "lostocs": "contents", "badbox": "container"}
    assert errors == set(want.items())
    for table in (shelf.metadata, shelf.manifest, shelf.spine, shelf.contents):
        assert {short(r.book_id) for r in table.select("book_id").distinct().collect()} == {"good1", "good2", "good3", "nobody"}
    records = {}
    for r in shelf.records.orderBy("rec_pos").collect():
        records.setdefault(short(r.book_id), []).append(r.content)
    assert set(records) == {"good1", "good2", "good3"} and records["good1"] == records["good3"] and records["good2"][1] == "other"
    assert "encrypted" in shelf.errors.where("book_id like '%locked.epub'").first().error


def test_several_packages(spark, tmp_path):
    """A later package's sections replace those of the ones before; what it lacks stays."""
    box = BOX.replace("</rootfiles>", '<rootfile full-path="alt/b.opf"/></rootfiles>')
    other = '<package><metadata><dc:title xmlns:dc="x">Second</dc:title></metadata><manifest><item id="two" href="two.xhtml" media-type="application/xhtml+xml"/></manifest></package>'
    (tmp_path / "a.epub").write_bytes(packed(**{"META-INF__container_xml": box, "alt__b_opf": other}))
    files = formats.read_epub(spark, str(tmp_path))
    package = epub.packages(files, epub.rootfiles(files)).cache()
    assert [(r.item_id, r.href) for r in epub.manifest(package).collect()] == [("two", "alt/two.xhtml")]
    assert [r.attrs["text"] for r in epub.metadata(package).collect()] == ["Second"]
    assert [r.idref for r in epub.spine(package).orderBy("spine_pos").collect()] == ["one", "missing"] and epub.guide(package).count() == 1


def test_files_are_written_once(spark, tmp_path):
    rows = [(f"{k % 3}/{k} - title é.txt", f"text {k}\n") for k in range(20)] + [("empty", None), ("deep/er/x", "y")]
    df = spark.createDataFrame(rows, "path string, content string").repartition(4)
    formats.write_files(df, str(tmp_path))
    found = {os.path.relpath(os.path.join(d, f), tmp_path): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path) for f in fs}
    assert found == {k: v or "" for k, v in rows}
    assert not [d for d in os.listdir(tmp_path) if d.startswith("_staging")]
    with pytest.raises(PySparkException, match="already"):
        formats.write_files(df, str(tmp_path))
    formats.write_files(spark.createDataFrame([("empty", bytearray(b"\x00\xff"))], "path string, content binary"), str(tmp_path), "overwrite")
    assert (tmp_path / "empty").read_bytes() == b"\x00\xff" and (tmp_path / "0/0 - title é.txt").exists()


def test_failing_and_retried_tasks(spark, tmp_path):
    shown = lambda: [n for n in (os.listdir(tmp_path / "out") if (tmp_path / "out").exists() else []) if not n.startswith("_staging-")]
    rows = spark.range(40).repartition(4)
    text = F.when(F.col("id") == 17, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id").cast("string"))
    with pytest.raises(PySparkException):
        formats.write_files(rows.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), text.alias("content")), str(tmp_path / "out"))
    assert shown() == []
    for bad in (["a", "a"], ["../x"], ["a/"], [None]):
        with pytest.raises(PySparkException):
            formats.write_files(spark.createDataFrame([(x, "t") for x in bad], "path string, content string"), str(tmp_path / "out"))
        assert shown() == []
    # A task's first attempt that wrote and was lost: its message never comes, so its files aren't moved.
    writer = formats.FilesWriter(spark.createDataFrame([], "path string, content string").schema, {"path": str(tmp_path / "again")}, False)
    first, second = [{"path": "x", "content": "1"}], [{"path": "x", "content": "1"}]
    writer.write(iter(first))
    writer.commit([writer.write(iter(second)), None])
    assert os.listdir(tmp_path / "again") == ["x"]
