"""EPUB archives to tables. Archives and XML need Python; each stage is an Arrow-batched map over its rows, no shuffle.

`faithful` keeps the event chunks as the XML reader hands them out: of an element with several chunks of text only the last
counts, and each chunk of a body is a record of its own. Without it, texts are joined.
"""

from __future__ import annotations

import io
import re
import struct
import xml.sax
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.scratch import stored

#: Rows and bytes of a batch, and bytes of an archive's member, 256 MB.
BATCH_ROWS, BATCH_BYTES, MEMBER_BYTES = 2000, 8 << 20, 256 << 20
#: What archives and markup that aren't as they should be raise.
FAULTS = (zipfile.BadZipFile, zlib.error, xml.sax.SAXException, ElementTree.ParseError, NotImplementedError, RuntimeError, LookupError, ValueError, EOFError, OSError, struct.error)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, content): the files below a path; the path is the book's id."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("book_id"), "content")


def batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of bounded rows and bytes (of their binary and text values)."""
    held, weight = [], 0
    for row in rows:
        held.append({n: row.get(n) for n in schema.names})
        weight += sum(len(v) for v in row.values() if isinstance(v, (bytes, str)))
        if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def flat_map(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str, fault: Callable[[dict], dict] | None = None) -> DataFrame:
    """Rows of df, each to any number of rows of the schema, in batches of bounded rows and bytes.

    fault: a row that can't be read becomes the row that this makes of it, with the `error`, and no other; without it the job fails.
    """
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if fault is None:
                    yield from make(row)
                    continue
                try:
                    made = list(make(row))
                except FAULTS as error:
                    made = [fault(row) | {"error": f"{type(error).__name__}: {error}"}]
                yield from made

    return df.mapInArrow(lambda batches: batched(rows(batches), arrow), schema)


def _inflated(box: zipfile.ZipFile, info: zipfile.ZipInfo, most: int) -> bytes:
    """A member's bytes, no more than `most` of them in memory."""
    if info.flag_bits & 1:
        raise ValueError("encrypted")
    if info.file_size > most:
        raise ValueError(f"{info.file_size} bytes, over the limit of {most}")
    with box.open(info) as member:
        data = member.read(most + 1)
    if len(data) > most:
        raise ValueError(f"over the limit of {most} bytes")
    return data


def _open(file: BinaryIO, strict: bool) -> tuple[zipfile.ZipFile | None, str | None]:
    """The archive by its central directory, and why it isn't an EPUB."""
    try:
        box = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, ValueError):  # the second: a file too short for the end record, by Arrow's files
        return None, "not a zip archive"
    try:
        kind = _inflated(box, box.getinfo("mimetype"), 1 << 10).decode("utf-8", "replace")
    except KeyError:
        return None, "no mimetype"
    except FAULTS as error:
        return None, f"mimetype: {error}"
    if not (kind == "application/epub+zip" if strict else all(x in kind for x in ("application", "epub", "zip"))):
        return None, f"mimetype is {kind}"
    return box, None if "META-INF/container.xml" in box.NameToInfo else "no META-INF/container.xml"


def archive_error(content: bytes, strict: bool = False) -> str | None:
    """Why an archive isn't an EPUB, None if it is. strict: the media type must be exact and the container there."""
    return _open(io.BytesIO(content), strict)[1]


def archive_rows(book_id: str, file: BinaryIO, wanted: Callable[[str], bool] = lambda path: True, strict: bool = False, most: int = MEMBER_BYTES) -> Iterator[dict]:
    """(book_id, path, bytes, error) of an archive's wanted members, inflated one by one.

    An invalid archive gives one row with its error and no path; a member that can't be read (encrypted, corrupt, over `most`
    bytes) one with its path and error.
    """
    box, error = _open(file, strict)
    if error:
        yield {"book_id": book_id, "error": error}
        return
    for info in box.infolist():
        if info.is_dir() or not wanted(info.filename):
            continue
        try:
            yield {"book_id": book_id, "path": info.filename, "bytes": _inflated(box, info, most)}
        except FAULTS as fault:
            yield {"book_id": book_id, "path": info.filename, "error": f"{type(fault).__name__}: {fault}"}


MEMBERS = "book_id string, path string, bytes binary, error string"


def members(archives: DataFrame, pattern: str | None = None, strict: bool = False, most: int = MEMBER_BYTES) -> DataFrame:
    """archive_rows of the members whose path matches. spark.read.format("epub") gives the same without whole archives in memory."""
    wanted = (lambda path: True) if pattern is None else re.compile(pattern).search
    return flat_map(archives, lambda row: archive_rows(row["book_id"], io.BytesIO(row["content"]), wanted, strict, most), MEMBERS)


class _Events(xml.sax.ContentHandler):
    """Forwards events to a generator-friendly list."""

    def __init__(self) -> None:
        super().__init__()
        self.events: list[tuple] = []

    def startElement(self, name, attrs):
        self.events.append(("start", name, dict(attrs.items())))

    def endElement(self, name):
        self.events.append(("end", name, None))

    def characters(self, content):
        self.events.append(("text", content, None))


def events(data: bytes) -> list[tuple]:
    handler = _Events()
    parser = xml.sax.make_parser()
    parser.setContentHandler(handler)
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.parse(io.BytesIO(data))
    return handler.events


def _fault(row: dict) -> dict:
    return {"book_id": row["book_id"], "path": row.get("path") or row.get("href")}


def _parsed(df: DataFrame, make: Callable[[dict], Iterator[dict]], schema: str, errors: bool) -> DataFrame:
    """flat_map; with errors, the schema has `error` at its end, and `path` if it has none."""
    if not errors:
        return flat_map(df, make, schema)
    return flat_map(df, make, schema + ("" if ", path string" in schema else ", path string") + ", error string", _fault)


def rootfiles(files: DataFrame, errors: bool = False) -> DataFrame:
    """(book_id, seq, attrs) of the container's rootfiles. With errors, here and below, what can't be parsed is a row with path and error."""

    def make(row: dict) -> Iterator[dict]:
        found = [a for kind, name, a in events(row["bytes"]) if kind == "start" and name == "rootfile"]
        for seq, attrs in enumerate(found):
            yield {"book_id": row["book_id"], "seq": seq, "attrs": list(attrs.items())}

    return _parsed(files.where("path = 'META-INF/container.xml' and bytes is not null"), make, "book_id string, seq int, attrs map<string, string>", errors)


SECTIONS = ("metadata", "manifest", "spine", "guide")


def package_rows(data: bytes, faithful: bool = True) -> Iterator[dict]:
    """Rows (section, seq, name, attrs, text) of a package file. A section lasts until the next one begins."""
    section, seq, open_name, pending = "", 0, None, None
    for kind, name, attrs in events(data):
        if kind == "start":
            if name in SECTIONS:
                section = name
                if name == "spine" and "toc" in attrs:
                    yield {"section": "spine_toc", "seq": 0, "name": attrs["toc"], "attrs": [], "text": None}
                if name == "metadata":
                    for k, v in attrs.items():
                        if k.startswith("xmlns:"):
                            yield {"section": "namespace", "seq": 0, "name": k[6:], "attrs": [], "text": v}
            elif section:
                if pending:
                    yield pending
                pending = {"section": section, "seq": seq, "name": name, "attrs": list(attrs.items()), "text": None}
                seq, open_name = seq + 1, name
        elif kind == "text" and pending and section == "metadata" and open_name:
            if name.strip() or not faithful:
                pending["text"] = name if faithful or pending["text"] is None else pending["text"] + name
        elif kind == "end" and name == open_name:
            open_name = None
    if pending:
        yield pending


def packages(files: DataFrame, roots: DataFrame, faithful: bool = True, errors: bool = False) -> DataFrame:
    """(book_id, root_seq, folder, section, seq, name, attrs, text) of the packages that the rootfiles name."""
    wanted = roots.select("book_id", F.col("seq").alias("root_seq"), F.element_at("attrs", F.lit("full-path")).alias("path"))
    rows = files.join(wanted.where("root_seq is not null"), ["book_id", "path"]).where("bytes is not null")

    def make(row: dict) -> Iterator[dict]:
        for x in package_rows(row["bytes"], faithful):
            yield x | {"book_id": row["book_id"], "root_seq": row["root_seq"], "folder": row["path"].rpartition("/")[0]}

    schema = "book_id string, root_seq int, folder string, section string, seq int, name string, attrs map<string, string>, text string"
    if errors:
        return _parsed(rows, make, schema, True)
    return merged_packages(flat_map(rows, make, schema))


def merged_packages(every: DataFrame) -> DataFrame:
    """Of several packages of a book a later one replaces whole sections, if it has them."""
    last = every.groupBy("book_id", "section").agg(F.max("root_seq").alias("root_seq"))
    return every.join(last, ["book_id", "section", "root_seq"])


def manifest(package: DataFrame) -> DataFrame:
    """(book_id, item_id, seq, href, media_type, properties): hrefs under the package's folder; of equal ids the last counts."""
    from ..functions.text import under_folder

    a = lambda k: F.element_at("attrs", F.lit(k))
    rows = package.where("section = 'manifest' and name = 'item'").select("book_id", a("id").alias("item_id"), "seq", under_folder(a("href"), F.col("folder")).alias("href"), a("media-type").alias("media_type"), a("properties").alias("properties"))
    return rows.groupBy("book_id", "item_id").agg(F.max_by(F.struct("seq", "href", "media_type", "properties"), "seq").alias("x")).select("book_id", "item_id", "x.*")


def spine(package: DataFrame) -> DataFrame:
    rows = package.where("section = 'spine' and name = 'itemref'")
    from pyspark.sql import Window

    return rows.select("book_id", (F.row_number().over(Window.partitionBy("book_id").orderBy("seq")) - 1).alias("spine_pos"), F.element_at("attrs", F.lit("idref")).alias("idref"))


def metadata(package: DataFrame) -> DataFrame:
    """(book_id, element, seq, attrs): the text is an attribute too."""
    text = F.when(F.col("text").isNotNull(), F.map_from_arrays(F.array(F.lit("text")), F.array("text"))).otherwise(F.expr("cast(map() as map<string, string>)"))
    return package.where("section = 'metadata'").select("book_id", F.col("name").alias("element"), "seq", F.map_concat("attrs", text).alias("attrs"))


def guide(package: DataFrame) -> DataFrame:
    return package.where("section = 'guide'").select("book_id", F.element_at("attrs", F.lit("type")).alias("type"), "seq", "attrs")


def contents_path(package: DataFrame, items: DataFrame) -> DataFrame:
    """(book_id, path) of the contents file that the spine names. Books that name none aren't there."""
    named = package.where("section = 'spine_toc'").select("book_id", F.col("name").alias("item_id"))
    return named.join(items, ["book_id", "item_id"]).select("book_id", F.col("href").alias("path"))


def contents_rows(data: bytes, faithful: bool = True) -> Iterator[dict]:
    """Navigation points (node, parent, sibling, label, src); nodes are numbered in the order of their start."""
    stack, made, inside, label = [], [], False, False
    for kind, name, attrs in events(data):
        if kind == "start":
            if name == "navMap":
                inside = True
            elif inside and name == "navPoint":
                made.append({"node": len(made), "parent": stack[-1]["node"] if stack else None, "sibling": len(made), "label": None, "src": None})
                stack.append(made[-1])
            elif stack and name == "text":
                label = True
            elif stack and name == "content":
                stack[-1]["src"] = attrs.get("src")
        elif kind == "text" and label and stack:
            stack[-1]["label"] = name if faithful or stack[-1]["label"] is None else stack[-1]["label"] + name
        elif kind == "end":
            if name == "text":
                label = False
            elif name == "navPoint" and stack:
                stack.pop()
            elif name == "navMap":
                inside = False
    yield from made


def contents(files: DataFrame, where: DataFrame, faithful: bool = True, errors: bool = False) -> DataFrame:
    """(book_id, node, parent, sibling, label, src): sources stand under the contents file's folder, if it has one."""

    def make(row: dict) -> Iterator[dict]:
        folder = row["path"].rpartition("/")[0]
        for x in contents_rows(row["bytes"], faithful):
            src = x["src"]
            yield x | {"book_id": row["book_id"], "src": f"{folder}/{src}" if folder and src and not src.startswith("/") else src}

    return _parsed(files.join(where, ["book_id", "path"]).where("bytes is not null"), make, "book_id string, node int, parent int, sibling int, label string, src string", errors)


def body_records(data: bytes, faithful: bool = True) -> Iterator[dict]:
    """Records (rec_no, tag, parents, ids, attrs, content) of a page's body.

    Elements are numbered as they start; bare text of the body takes a number too. A text takes the attributes of its
    elements (the nearest first) and all their ids that no earlier record took, the innermost first. An element that ends
    without a text, or with its id untaken, gives a record without content. Blank texts without an id are left out.
    """
    stack, number, inside, made, pending = [], 0, False, [], None

    def emit(tag: str, parents: list[str], ids: list[str], attrs: dict, content: str | None) -> None:
        if content is None or ids or content.strip():
            made.append({"rec_no": len(made), "tag": tag, "parents": parents, "ids": ids, "attrs": list(attrs.items()), "content": content})

    def inherited() -> dict:
        out: dict = {}
        for item in reversed(stack):
            out = {k: v for k, v in item["attrs"].items() if k not in out} | out
        return out

    def text(content: str) -> None:
        nonlocal number
        if not stack:
            emit(f"body.{number}", [], [], {}, content)
            number += 1
            return
        ids = [item["id"] for item in reversed(stack) if item["id"] is not None]
        for item in stack:
            item["id"], item["used"] = None, True
        emit(stack[-1]["tag"], [item["tag"] for item in stack[:-1]], ids, inherited(), content)

    for kind, name, attrs in events(data):
        if kind == "text" and inside:
            if faithful:
                text(name)
            else:
                pending = name if pending is None else pending + name
            continue
        if pending is not None:
            text(pending)
            pending = None
        if kind == "start" and name == "body":
            inside = True
            made.append({"rec_no": len(made), "tag": f"body.{number}", "parents": [], "ids": [attrs["id"]] if "id" in attrs else [], "attrs": [(k, v) for k, v in attrs.items() if k != "id"], "content": None})
            number += 1
        elif kind == "start" and inside:
            stack.append({"tag": f"{name}.{number}", "id": attrs.get("id"), "used": False, "attrs": {k: v for k, v in attrs.items() if k != "id"}})
            number += 1
        elif kind == "end" and name == "body":
            inside = False
        elif kind == "end" and inside:
            top = stack[-1]
            if not top["used"] or top["id"] is not None:
                emit(top["tag"], [item["tag"] for item in stack[:-1]], [top["id"]] if top["id"] is not None else [], inherited(), None)
                for item in stack:
                    item["used"] = True
            stack.pop()
    yield from made


def bodies(pages: DataFrame, faithful: bool = True, errors: bool = False) -> DataFrame:
    """Spine pages (book_id, spine_pos, href, bytes) to records with rec_pos, their order in the book, and path on every row."""

    def make(row: dict) -> Iterator[dict]:
        for x in body_records(row["bytes"], faithful):
            yield x | {"book_id": row["book_id"], "spine_pos": row["spine_pos"], "path": row["href"]}

    schema = "book_id string, spine_pos int, rec_no int, path string, tag string, parents array<string>, ids array<string>, attrs map<string, string>, content string"
    rows = _parsed(pages.select("book_id", "spine_pos", "href", "bytes"), make, schema, errors)
    return rows.withColumn("rec_pos", F.col("spine_pos").cast("long") * F.lit(1 << 32) + F.col("rec_no"))


@dataclass
class Shelf:
    """The tables of a shelf's sound books, and (book_id, stage, path, error) of what is wrong with the others."""

    metadata: DataFrame
    manifest: DataFrame
    spine: DataFrame
    contents: DataFrame
    records: DataFrame
    errors: DataFrame


def open_shelf(files: DataFrame, faithful: bool = True) -> Shelf:
    """Members (book_id, path, bytes, error) of any number of archives to the tables of their books.

    A book with an invalid archive, a member that is needed and can't be read, markup that can't be parsed, a page that is missing or
    no contents is in none of the tables; each reason is a row of errors. Members and the tables of each stage are stored once.
    """
    files = stored(files, "members")
    bad = files.where("path is null").select("book_id", F.lit("archive").alias("stage"), "path", "error")
    broken = files.where("path is not null and error is not null").select("book_id", "path", "error")
    sound = files.where("bytes is not null")
    tables, faults = {}, [bad]

    def stage(name: str, rows: DataFrame) -> DataFrame:
        rows = stored(rows, name)
        faults.append(rows.where("error is not null").select("book_id", F.lit(name).alias("stage"), "path", "error"))
        return rows.where("error is null").drop("error")

    def needed(name: str, wanted: DataFrame) -> DataFrame:
        """The wanted (book_id, path, ...) that are there; the others are errors."""
        found = wanted.join(sound.select("book_id", "path", F.lit(True).alias("there")), ["book_id", "path"], "left").join(broken.withColumnRenamed("error", "why"), ["book_id", "path"], "left")
        faults.append(found.where("there is null").select("book_id", F.lit(name).alias("stage"), "path", F.coalesce("why", F.lit("no such file in the archive")).alias("error")))
        return found.where("there").drop("there", "why")

    books = files.where("path is not null").select("book_id").distinct()
    needed("container", books.withColumn("path", F.lit("META-INF/container.xml")))
    roots = stage("container", rootfiles(sound, errors=True)).drop("path")
    named = roots.select("book_id", F.element_at("attrs", F.lit("full-path")).alias("path")).where("path is not null").distinct()
    needed("package", named)
    package = merged_packages(stage("package", packages(sound, roots, faithful, errors=True)).drop("path"))
    tables["metadata"], tables["manifest"], tables["spine"] = metadata(package), stored(manifest(package), "manifest"), spine(package)
    where = stored(contents_path(package, tables["manifest"]), "toc")
    lacking = package.select("book_id").distinct().join(where, "book_id", "left_anti")
    faults.append(lacking.select("book_id", F.lit("contents").alias("stage"), F.lit(None).cast("string").alias("path"), F.lit("the spine names no contents").alias("error")))
    needed("contents", where)
    tables["contents"] = stage("contents", contents(sound, where, faithful, errors=True)).drop("path")
    items = tables["manifest"].select("book_id", F.col("item_id").alias("idref"), F.col("href").alias("path"))
    pages = needed("pages", tables["spine"].join(items, ["book_id", "idref"]).where("path is not null"))
    pages = pages.join(sound.select("book_id", "path", "bytes"), ["book_id", "path"]).withColumnRenamed("path", "href")
    tables["records"] = stage("pages", bodies(pages, faithful, errors=True))
    errors = faults[0]
    for more in faults[1:]:
        errors = errors.unionByName(more)
    errors = stored(errors.distinct(), "errors")
    return Shelf(**{k: t.join(errors.select("book_id").distinct(), "book_id", "left_anti") for k, t in tables.items()}, errors=errors)


def page_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Lenient tokens of markup that no XML parser takes: (key, tok_no, tag, content), in the JVM.

    tag: the element named by the last start or end tag before the text; comments, scripts and styles are left out.
    """
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    found = F.regexp_extract_all(plain, F.lit(r"<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)"), F.lit(0))
    rows = pages.select(key, F.posexplode(found).alias("tok_no", "raw"))
    return rows.select(key, "tok_no", F.lower(F.regexp_extract("raw", r"^<(/?[A-Za-z][A-Za-z0-9]*)", 1)).alias("tag"), F.regexp_extract("raw", r"^<[^>]*>([^<]*)", 1).alias("content"))


def with_text(tokens: DataFrame) -> DataFrame:
    """Tokens with something else than white space."""
    return tokens.where(~F.col("content").rlike(r"^(?U)\s*$"))


def images(items: DataFrame, files: DataFrame) -> DataFrame:
    """(book_id, name, bytes): image files under their base name; of equal names the last item counts."""
    from ..functions.text import base_name

    rows = items.where("contains(media_type, 'image')").join(files.select("book_id", F.col("path").alias("href"), "bytes"), ["book_id", "href"])
    return rows.groupBy("book_id", base_name(F.col("href")).alias("name")).agg(F.max_by("bytes", "seq").alias("bytes"))


def legacy_file(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items with the file they name: as it is, else under OEBPS/, else under OPS/; none is an error."""
    rows = items
    for k, folder in enumerate(("", "OEBPS/", "OPS/")):
        own = files.select("book_id", F.regexp_replace("path", rf"^\Q{folder}\E", "").alias("href"), F.col("path").alias(f"path{k}")).where(F.col(f"path{k}").startswith(folder))
        rows = rows.join(own, ["book_id", "href"], "left")
    path = F.coalesce("path0", "path1", "path2")
    return rows.withColumn("path", F.when(path.isNotNull(), path).otherwise(F.raise_error(F.concat(F.lit("no file for "), F.col("href"))).cast("string"))).drop("path0", "path1", "path2")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def element_rows(data: bytes, section: str) -> Iterator[dict]:
    """(tag, seq, attrs) of a section's children, names without their namespaces; text is all ASCII text below, else the element's own."""
    top = next((e for e in ElementTree.fromstring(data).iter() if _local(e.tag) == section), ())
    for seq, child in enumerate(top):
        attrs = {_local(k): v for k, v in child.attrib.items()}
        text = "".join(child.itertext()).encode("ascii", "ignore").decode().strip() or child.text
        yield {"tag": _local(child.tag), "seq": seq, "attrs": list((attrs | ({"text": text} if text else {})).items())}


def elements(files: DataFrame, section: str) -> DataFrame:
    """element_rows of package files (book_id, path, bytes)."""

    def make(row: dict) -> Iterator[dict]:
        for x in element_rows(row["bytes"], section):
            yield x | {"book_id": row["book_id"]}

    return flat_map(files.where("path like '%.opf'"), make, "book_id string, tag string, seq int, attrs map<string, string>")


#: Elements whose text is one paragraph.
SINGLE = ("p", "h1", "h2", "h3", "h4")


def collapsed(element: ElementTree.Element, single: tuple[str, ...] = SINGLE) -> list[str]:
    """An element's text, then the paragraphs of its children, unless it is a single paragraph itself.

    A child's paragraph leaves the element's text if it stands at its blank edge; one inside it is dropped, as it is read there.
    """
    own, below = "".join(element.itertext()).encode("ascii", "ignore").decode(), []
    for child in () if _local(element.tag) in single else element:
        for part in collapsed(child, single):
            at = own.find(part)
            if at < 0:
                below.append(part)
            elif not own[:at].strip() or not own[at:].strip():
                own = own[:at] + " " + own[at + len(part) :]
                below.append(part)
    return [own, *below]


def page_paragraphs(pages: DataFrame, use_div: bool = False) -> DataFrame:
    """(book_id, spine_pos, par_no, text) of pages (book_id, spine_pos, bytes) by the older rule; blank paragraphs are left out.

    A body without child elements gives none.
    """
    single = (*SINGLE, "div") if use_div else SINGLE

    def make(row: dict) -> Iterator[dict]:
        body = next((e for e in ElementTree.fromstring(row["bytes"]) if _local(e.tag) == "body"), ())
        texts = [t.replace("\n", " ") for t in collapsed(body, single)] if len(body) else []
        for k, text in enumerate(t for t in texts if t.strip()):
            yield {"book_id": row["book_id"], "spine_pos": row["spine_pos"], "par_no": k, "text": text}

    return flat_map(pages.select("book_id", "spine_pos", "bytes"), make, "book_id string, spine_pos int, par_no int, text string")
