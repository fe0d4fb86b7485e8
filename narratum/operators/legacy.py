"""The older single-pass rules: chapter ranges, chunking, reference lookup, refinements, packing."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import clean_entry, first_year
from . import sequence
from .ssml import pack, requests

PARAGRAPH, QUERY = 2000, 2700


def chunk_sentences(text: Column, limit: int = PARAGRAPH) -> Column:
    """array<string>: a text over the limit cut at full stops into near equal chunks; the rest is joined by blanks."""
    n = F.length(text)
    groups = F.ceil(n / limit)
    size = F.floor(n / groups / 100) * 100
    # The size goes into the fold's state, so that it is computed once for a text and not at each sentence.
    start = F.struct(size.alias("size"), F.array().cast("array<string>").alias("cur"), F.lit(0).cast("int").alias("n"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        cur, many = F.concat(a["cur"], F.array(F.concat(s, F.lit(".")))), a["n"] + F.length(s) + 1
        full = many > a["size"]
        return F.struct(a["size"].alias("size"), F.when(full, F.array().cast("array<string>")).otherwise(cur).alias("cur"), F.when(full, 0).otherwise(many).alias("n"),
                        F.when(full, F.concat(a["out"], F.array(F.array_join(cur, "")))).otherwise(a["out"]).alias("out"))

    folded = F.aggregate(F.split(text, r"\.", -1), start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["out"]))
    return F.when(n > limit, folded).otherwise(F.array(text))


def contents_entry(entries: DataFrame, book: str, index: str, path: str, text: str) -> DataFrame:
    """(book, toc_index): the first entry whose path holds `toc` or whose text holds `contents`; -1 without one."""
    hit = F.contains(F.lower(path), F.lit("toc")) | F.contains(F.lower(text), F.lit("contents"))
    return entries.groupBy(book).agg(F.coalesce(F.min(F.when(hit, F.col(index))), F.lit(-1)).alias("toc_index"))


def longest_run(entries: DataFrame, book: str, index: str, length: str) -> DataFrame:
    """(book, start, end): the longest run of consecutive entries with text, the first of equals."""
    rows = entries.where(F.col(length) > 0)
    islands = rows.withColumn("island", F.col(index) - F.row_number().over(Window.partitionBy(book).orderBy(index)))
    runs = islands.groupBy(book, "island").agg(F.min(index).alias("start"), F.max(index).alias("end"))
    best = F.min(F.struct((F.col("start") - F.col("end")).alias("order"), "start", "end"))
    return runs.groupBy(book).agg(best.alias("x")).select(book, "x.start", "x.end")


def past_contents(ranges: DataFrame) -> DataFrame:
    """Moves a range's start behind a contents entry inside it; entry 0 doesn't count."""
    inside = (F.col("toc_index") > 0) & (F.col("toc_index") >= F.col("start")) & (F.col("toc_index") < F.col("end"))
    return ranges.withColumn("start", F.when(inside, F.col("toc_index") + 1).otherwise(F.col("start")))


def in_range(entries: DataFrame, start: Column, end: Column, index: str, count: Column) -> DataFrame:
    """Entries from start to end (inclusive, within the number of entries); numbered by track_no from 1 elsewhere."""
    return entries.where((F.col(index) >= start) & (F.col(index) < F.least(count, end + 1)))


def numbered_tracks(entries: DataFrame, ranges: DataFrame, index: str = "entry_no") -> DataFrame:
    """The entries (book_id, index, ...) in their book's range (book_id, start, end), with track_no from 1."""
    kept = entries.join(ranges, "book_id").where((F.col(index) >= F.col("start")) & (F.col(index) <= F.col("end"))).drop("start", "end")
    return sequence.ranked(kept, ["book_id"], [index], "track_no").withColumn("track_no", (F.col("track_no") + 1).cast("int"))


def item_pages(itemrefs: DataFrame, items: DataFrame) -> DataFrame:
    """Spine rows (book_id, spine_pos, idref), each with the href of its item if that is markup, else null; none is left out."""
    markup = items.where(F.contains("media_type", F.lit("xml"))).groupBy("book_id", F.col("item_id").alias("idref")).agg(F.max_by("href", "seq").alias("href"))
    return itemrefs.join(markup, ["book_id", "idref"], "left")


#: Texts of a book that one task searches at a time.
TEXTS = 512


def held_patterns(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, order: list[str], firsts: bool, block: int = TEXTS) -> DataFrame:
    """Which patterns (book_id, pattern) a book's texts (book_id, order, text) hold: (book_id, pattern, order columns).

    With firsts only the first text in order that holds a pattern, else all. A book's texts are dealt to blocks by hash; in a block
    an automaton of all the book's patterns reads each text once. An empty pattern is in every text, a null one in none.
    """
    sizes = texts.groupBy("book_id").agg(F.ceil(F.count("*") / block).alias("__blocks"))
    place = F.pmod(F.xxhash64(*order), F.col("__blocks"))
    dealt = texts.join(sizes, "book_id").select("book_id", place.alias("__block"), *order, F.col(text).alias("__text")).where("__text is not null")
    asked = patterns.where(F.col(pattern).isNotNull()).select("book_id", F.col(pattern).alias("__pattern")).distinct().join(sizes, "book_id")
    # Names of their own: texts and patterns may come from one frame.
    asked = asked.select(F.col("book_id").alias("__book"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)).alias("__at"), "__pattern")
    kinds = {c: texts.schema[c].dataType for c in order}
    schema = StructType([StructField("book_id", texts.schema["book_id"].dataType), StructField(pattern, StringType()), *[StructField(c, t) for c, t in kinds.items()]])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[str, int]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([(c, "ascending") for c in order]) if firsts else left
            wanted, seen = right.column("__pattern").to_pylist(), set()
            tree = ahocorasick.Automaton()
            for p in filter(None, wanted):
                tree.add_word(p, p)
            tree.make_automaton()
            for k, own in enumerate(left.column("__text").to_pylist()):
                here = ({p for _, p in tree.iter(own)} if len(tree) else set()) | ({""} if "" in wanted else set())
                found += [(p, k) for p in sorted(here - seen)]
                if firsts:
                    seen |= here
        rows = pa.array([k for _, k in found], pa.int64())
        columns = {"book_id": left.column("book_id").take(rows), pattern: pa.array([p for p, _ in found], pa.string())} | {c: left.column(c).take(rows) for c in order}
        return pa.table(columns).cast(arrow)

    out = dealt.groupBy("book_id", "__block").cogroup(asked.groupBy("__book", "__at")).applyInArrow(run, schema)
    if not firsts:
        return out
    best = F.min(F.struct(*order)).alias("x")
    return out.groupBy("book_id", pattern).agg(best).select("book_id", pattern, "x.*")


def resolve_references(refs: DataFrame, files: DataFrame, ref: str = "ref", path: str = "path", order: str = "load_seq") -> DataFrame:
    """Each reference with the first loaded file whose path contains it, after leading dots and its fragment are cut.

    A book's references are one automaton, which reads each path once (column book_id).
    """
    bare = F.substring_index(F.replace(F.replace(ref, F.lit("../"), F.lit("")), F.lit("./"), F.lit("")), "#", 1)
    rows = refs.withColumn("__bare", bare)
    own = files.select("book_id", F.col(order).alias("__seq"), F.col(path).alias("file"))
    found = held_patterns(own, rows, "file", "__bare", ["__seq", "file"], True).select("book_id", "__bare", "file")
    return rows.join(found, ["book_id", "__bare"], "left").drop("__bare")


def refine(elements: DataFrame, refinements: DataFrame) -> DataFrame:
    """Elements (book_id, id, attrs) with each refinement's property and text added; later ones overwrite. Unknown ids are an error."""
    last = refinements.groupBy("book_id", F.regexp_replace("refines", "^#", "").alias("id"), "property").agg(F.max_by("text", "seq").alias("text"))
    maps = last.groupBy("book_id", "id").agg(F.map_from_entries(F.collect_list(F.struct("property", "text"))).alias("more"))
    lost = maps.join(elements, ["book_id", "id"], "left_anti").agg(F.when(F.count("*") > 0, F.raise_error(F.lit("a refinement of an unknown id")).cast("int")).otherwise(0).alias("lost"))
    joined = elements.join(maps, ["book_id", "id"], "left").join(F.broadcast(lost), F.col("lost") == 0)
    kept = F.map_filter("attrs", lambda k, v: F.col("more").isNull() | ~F.coalesce(F.map_contains_key("more", k), F.lit(False)))
    return joined.withColumn("attrs", F.map_concat(kept, F.coalesce("more", F.expr("cast(map() as map<string, string>)")))).drop("more", "lost")


def page_entries(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """Pages (book_id, page_no, path) under contents rows (book_id, toc_pos, label, src): (book_id, page_no, entry_no, label).

    Only the next contents row is tried at each page, so one that never matches holds back all later ones; pages before the
    first match have no entry; consecutive rows of one file open one entry together.
    """
    files = toc.withColumn("file", F.substring_index("src", "#", 1))
    files = files.withColumn("same", F.coalesce(F.lag("file").over(Window.partitionBy("book_id").orderBy("toc_pos")) == F.col("file"), F.lit(False))).where("not same")
    ts = files.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("toc_pos", "file", "label"))).alias("ts"))
    ps = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "path"))).alias("ps")).join(ts, "book_id")
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        hit = F.coalesce(F.contains(p["path"], F.get("ts", a["next"])["file"]), F.lit(False))
        at = F.when(hit, a["next"] + 1).otherwise(a["next"])
        return F.struct(at.alias("next"), F.concat(a["out"], F.array(at - 1)).alias("out"))

    rows = ps.withColumn("at", F.aggregate("ps", start, step)["out"]).select("book_id", "ts", F.explode(F.arrays_zip("ps", "at")).alias("x")).where("x.at >= 0")
    return rows.select("book_id", F.col("x.ps.page_no").alias("page_no"), F.col("x.at").alias("entry_no"), F.get("ts", F.col("x.at"))["label"].alias("label"))


def output_folder(artist: Column, year: Column, album: Column) -> Column:
    return F.concat_ws("/", artist, F.concat(F.lit("["), year, F.lit("] "), album))


def id3_fields(tracks: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """Final tracks with a map of tags to (keep, field, value) rows; a date's field takes its year, no genre is 183."""
    fields = F.array(*[F.struct(F.lit(field).alias("field"), (F.substring(F.element_at("tags", F.lit(tag)), 1, 4) if field == "year" else F.element_at("tags", F.lit(tag))).alias("value")) for tag, field in names.items()],
                     F.struct(F.lit("genre").alias("field"), F.coalesce(F.element_at("tags", F.lit("GENRE")), F.lit("183")).alias("value")))
    return tracks.select(*keep, F.explode(fields).alias("x")).select(*keep, "x.field", "x.value").where("value is not null")


HEAD, TAIL = '<speak>\n<prosody rate="medium">\n', '<mark name="end"/>\n</prosody>\n</speak>'


def pack_entries(paragraphs: DataFrame, key: list[str], order: str = "par_no", limit: int = QUERY) -> DataFrame:
    """Paragraphs (key, order, text) to (key, query_no, query): packed by their bare text, marks numbered within an entry.

    A paragraph at the limit is an error. The last request of an entry ends with a line end.
    """
    mark = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    fine = F.length("text") < limit
    text = F.when(fine, F.col("text")).otherwise(F.raise_error(F.lit(f"a paragraph has {limit} characters or more")).cast("string"))
    ssml = F.concat(F.lit("<p>"), text, F.lit('</p>\n<mark name="p'), mark.cast("string"), F.lit('"/>\n'))
    rows = paragraphs.select(*key, order, F.length("text").alias("n"), ssml.alias("ssml"))
    made = requests(pack(rows, key, [order], "n", limit, frame=0), key, [order], head=HEAD, tail=TAIL)
    last = F.max("query_no").over(Window.partitionBy(*key))
    return made.withColumn("query", F.when(F.col("query_no") == last, F.concat("query", F.lit("\n"))).otherwise(F.col("query")))


def swapped(seqs: Column) -> Column:
    """The places (from 0) of creators in the order that the swaps of their display sequences leave, for an array of sequences.

    The first open place's creator changes places with the one where its sequence wants it. That place is settled then; if the
    first wants to stay, wants the first place of all, or has no sequence from 1 to n, its own place is settled. Where swaps with
    settled places go round without an end the order stays as it was.
    """
    n = F.size(seqs)
    first = F.sequence(F.lit(0), n - 1)
    start = F.struct(first.alias("at"), first.alias("open"))

    def step(a: Column, _: Column) -> Column:
        cur = F.get(a["open"], F.lit(0))
        own = F.get(a["at"], cur)
        want = F.get(seqs, own)
        to = F.when(want.between(1, n), want - 1)
        at = F.when(to.isNull(), a["at"]).otherwise(F.transform(a["at"], lambda x, k: F.when(k == to, own).when(k == cur, F.get(a["at"], to)).otherwise(x)))
        settled = F.when(to.isNull() | (to == 0), cur).otherwise(to)
        return F.when(F.size(a["open"]) == 0, a).otherwise(F.struct(at.alias("at"), F.filter(a["open"], lambda x: x != settled).alias("open")))

    done = F.aggregate(F.sequence(F.lit(1), n * (n + 1)), start, step)
    return F.when(F.size(done["open"]) == 0, done["at"]).otherwise(first)


def order_creators(creators: DataFrame, seq: str = "display_seq") -> DataFrame:
    """Adds place: creators (book_id, pos, seq) by their display sequence where a book's sequences are exactly 1 to n, else as `swapped` leaves them."""
    book = Window.partitionBy("book_id")
    n = F.count("*").over(book)
    fit = (F.size(F.collect_set(seq).over(book)) == n) & (F.min(seq).over(book) == 1) & (F.max(seq).over(book) == n)
    keyed = creators.withColumns({"__fit": fit, "__no": F.row_number().over(book.orderBy("pos")) - 1})
    odd = keyed.where(~F.coalesce("__fit", F.lit(False))).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("__no").alias("no"), F.col(seq).cast("int").alias("seq")))).alias("all"))
    moved = odd.select("book_id", F.posexplode(swapped(F.transform("all", lambda x: x["seq"]))).alias("__to", "__no"))
    return keyed.join(moved, ["book_id", "__no"], "left").withColumn("place", F.coalesce(F.col("__to") + 1, F.col(seq)).cast("int")).drop("__fit", "__no", "__to")


def page_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, page_no, ref, location): the image references that a page's markup contains; one pass over each page."""
    found = held_patterns(pages, images, "markup", "ref", ["page_no"], False)
    return found.join(images.select("book_id", "ref", "location"), ["book_id", "ref"]).select("book_id", "page_no", "ref", "location")


def first_image(found: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, location): the first image of the first page that has one, else the first whose reference holds `cover`."""
    shown = found.join(images.select("book_id", "ref", "seq"), ["book_id", "ref"]).groupBy("book_id").agg(F.min_by("location", F.struct("page_no", "seq")).alias("shown"))
    cover = images.where(F.contains(F.lower("ref"), F.lit("cover"))).groupBy("book_id").agg(F.min_by("location", "seq").alias("cover"))
    return shown.join(cover, "book_id", "full_outer").select("book_id", F.coalesce("shown", "cover").alias("location"))


def album_tags(metadata: DataFrame) -> DataFrame:
    """Metadata (book_id, element, seq, attrs map with text) to (book_id, tags map, genres array) by the older rules.

    A name is an element's `file-as`, else its text; of repeated elements the first counts. Of several creators, in
    display order, the last whose role holds `aut` is the artist and the last whose role holds `tr` the composer; the
    first creator is the artist where no role says so. The year is that of the only date, or of the first publication among
    several that has one, else of the rights. Every subject is a genre, the first of them the tag. Null names give no tag.
    """
    attr = lambda key: F.try_element_at("attrs", F.lit(key))
    rows = metadata.select("book_id", "element", "seq", "attrs", F.coalesce(attr("file-as"), attr("text")).alias("name"))
    creators = rows.where("element = 'creator'").withColumns({"pos": F.col("seq"), "display_seq": attr("display-seq").try_cast("int"), "role": F.lower(attr("role"))})
    creators = order_creators(creators, "display_seq").groupBy("book_id").agg(
        F.count("*").alias("several"), F.min_by("name", "place").alias("first"),
        *[F.max_by("name", F.when(F.contains("role", F.lit(part)), F.col("place"))).alias(part) for part in ("aut", "tr")],
    )
    first = lambda element, value: F.min_by(value, F.when(F.col("element") == element, F.col("seq")))
    year = first_year(attr("text"))
    published = (F.col("element") == "date") & F.contains(attr("event"), F.lit("publication")) & year.isNotNull()
    books = rows.groupBy("book_id").agg(
        first("publisher", "name").alias("publisher"), first("rights", "name").alias("rights"), first("title", attr("text")).alias("title"), first("title", "name").alias("album"),
        F.count_if(F.col("element") == "date").alias("dates"), first("date", year).alias("dated"), F.min_by(year, F.when(published, F.col("seq"))).alias("published"),
        F.array_sort(F.collect_list(F.when((F.col("element") == "subject") & F.col("name").isNotNull(), F.struct("seq", "name")))).alias("subjects"),
    ).join(creators, "book_id", "left")
    several = F.col("several") > 1
    artist = F.when(several, F.coalesce("aut", "first")).otherwise(F.col("first"))
    genres = F.col("subjects")["name"]
    values = {
        "ARTIST": artist, "ALBUMARTIST": artist, "COMPOSER": F.when(several, F.col("tr")), "PUBLISHER": F.col("publisher"), "COPYRIGHT": F.col("rights"),
        "YEAR": F.coalesce(F.when(F.col("dates") > 1, F.col("published")).otherwise(F.col("dated")), first_year(F.col("rights"))),
        "ALBUMSORT": F.coalesce("title", "album"), "ALBUM": F.col("album"), "GENRE": F.get(genres, F.lit(0)),
    }
    tags = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))
    return books.select("book_id", F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"), genres.alias("genres"))


def entry_tags(entries: DataFrame, album: DataFrame) -> DataFrame:
    """Entries (book_id, entry_no, text) with the album's tags and a TITLE: the text, or the entry's number where there is none."""
    title = F.coalesce(clean_entry(F.col("text")), F.concat(F.lit("Entry Number "), F.col("entry_no").cast("string")))
    none = F.expr("cast(map() as map<string, string>)")
    return entries.join(album, "book_id", "left").withColumn("tags", F.map_concat(F.coalesce("tags", none), F.create_map(F.lit("TITLE"), title)))
