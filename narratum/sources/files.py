"""Other inputs and outputs: JSON documents, CSV and timed lyrics by their lines, and a book's files under their names."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lyrics, words

TRACKS = "tracklist array<struct<name: string, ssml_queries: array<string>, num_queries: int, metadata: map<string, string>>>"


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, track_no, name, queries, num_queries, tags) of request and final track documents, one to a file."""
    rows = spark.read.schema(TRACKS).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("book_id"), F.posexplode("tracklist").alias("track_no", "t"))
    return rows.select("book_id", "track_no", "t.name", F.col("t.ssml_queries").alias("queries"), "t.num_queries", F.col("t.metadata").alias("tags"))


def read_documents(spark: SparkSession, path: str, within: str | None = None) -> DataFrame:
    """(book_id, doc) of JSON documents, one to a file; `within` takes the value of a key. book.document_tags reads a book's `metadata`."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("book_id"), "value")
    if within is None:
        return rows.select("book_id", F.col("value").alias("doc"))
    return rows.select("book_id", F.to_json(F.try_variant_get(F.try_parse_json("value"), f"$[{json.dumps(within)}]", "variant")).alias("doc"))


def read_album(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, tags map) of flat tag documents, one to a file; a null tag stays, one that isn't there doesn't."""
    return read_documents(spark, path).select("book_id", F.from_json("doc", "map<string, string>").alias("tags"))


def read_rules(spark: SparkSession, path: str) -> dict:
    """The rules of a mapping document, as book.path_rules takes them."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)["id3_mappings"]


def read_book(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Book documents, one to a file, as records (book_id, track_no, rec_pos, tag, parents, ids, content, path) and segments
    (book_id, track_no, label, parent_labels). An id may be a text or a list of them."""
    docs = read_documents(spark, path).select("book_id", F.try_parse_json("doc").alias("doc"))
    take = "try_variant_get({0}, '$.{1}', '{2}')".format
    sql = spark.sql("SELECT book_id, t.pos AS track_no, t.value AS track FROM {docs}, LATERAL variant_explode(try_variant_get(doc, '$.tracklist', 'variant')) t", docs=docs)
    segments = sql.select("book_id", "track_no", F.expr(take("track", "entry.label", "string")).alias("label"), F.expr(take("track", "entry.parent_labels", "array<string>")).alias("parent_labels"))
    rows = spark.sql("SELECT book_id, track_no, r.pos AS rec_pos, r.value AS record FROM {tracks}, LATERAL variant_explode(try_variant_get(track, '$.spine_readable_tags', 'variant')) r", tracks=sql)
    ids = F.coalesce(F.expr(take("record", "id", "array<string>")), F.expr(f"if({take('record', 'id', 'string')} is null, cast(array() as array<string>), array({take('record', 'id', 'string')}))"))
    text = lambda c, kind="string": F.expr(take("record", c, kind))
    records = rows.select("book_id", "track_no", "rec_pos", text("tag").alias("tag"), text("parent_tag_list", "array<string>").alias("parents"), ids.alias("ids"), text("content").alias("content"), text("path").alias("path"))
    return records, segments


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, at, line) of text files; `at` orders the lines of a file, wherever Spark splits it."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("book_id"), at.alias("at"), F.regexp_replace("value", r"\r$", "").alias("line"))


def read_lyrics(spark: SparkSession, path: str) -> DataFrame:
    return lyrics.parse_lyrics(read_lines(spark, path), "book_id", "at")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of word,count files with a header line; of a word's lines the last counts."""
    rows = read_lines(spark, path)
    heads = rows.groupBy("book_id").agg(F.min("at").alias("at"))
    rows = rows.join(heads, ["book_id", "at"], "left_anti").where("line <> ''").select(F.struct("book_id", "at").alias("line_no"), F.from_csv("line", "word string, count string").alias("x"))
    return words.frequencies(rows.select("line_no", "x.word", "x.count"))


def pretty(doc: Column, indent: int = 4, sort: bool = True, ascii_only: bool = False) -> Column:
    """JSON text in lines, indented, keys sorted, characters as they are unless ascii_only has them escaped."""

    @F.pandas_udf("string")
    def made(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in docs:
            yield part.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=indent, sort_keys=sort, ensure_ascii=ascii_only))

    return made(doc)


def file_name(track: Column, title: Column, ending: str) -> Column:
    """`{track} - {title}{ending}`; a slash can't be in a name."""
    return F.concat(track.cast("string"), F.lit(" - "), F.regexp_replace(title, r"[/\\]", "-"), F.lit(ending))


def track_files(tracks: DataFrame, marks: DataFrame, key: list[str], order: list[str], folder: Column | None = None) -> DataFrame:
    """Rows (path, content) for formats.write_files: each track's marks as .json, its timed lines as .lrc and its paragraphs as .txt.

    tracks: (key, track, title, and artist, album if known); marks: (key, order, time_ms, type, value).
    """
    one = F.array_sort(F.collect_list(F.struct(*order, F.struct(F.col("time_ms").alias("time"), "type", "value").alias("mark"))))
    listed = marks.groupBy(*key).agg(F.to_json(F.transform(one, lambda m: m["mark"])).alias("json"))
    lines = marks.withColumn("__key", F.struct(*key))
    timed = lyrics.lyric_lines(lines, "__key", order)
    timed = timed.groupBy("__key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("lrc"))
    spoken = lyrics.paragraphs(lines, "__key", order)
    spoken = spoken.groupBy("__key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_no", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("txt"))
    known = lambda c: F.coalesce(F.col(c), F.lit(f"Unknown {c.title()}")) if c in tracks.columns else F.lit(f"Unknown {c.title()}")
    head = F.concat(F.lit("[ar:"), known("artist"), F.lit("]\n[al:"), known("album"), F.lit("]\n[ti:"), known("title"), F.lit("]\n\n"))
    rows = tracks.withColumn("__key", F.struct(*key)).join(listed, key, "left").join(timed, "__key", "left").join(spoken, "__key", "left")
    texts = {".json": pretty(F.coalesce("json", F.lit("[]")), sort=False), ".lrc": F.concat(head, F.coalesce("lrc", F.lit(""))), ".txt": F.coalesce("txt", F.lit(""))}
    name = lambda ending: file_name(F.col("track"), F.coalesce("title", F.lit("")), ending)
    path = lambda ending: name(ending) if folder is None else F.concat(folder, F.lit("/"), name(ending))
    made = rows.select(F.array(*[F.struct(path(e).alias("path"), t.alias("content")) for e, t in texts.items()]).alias("files"))
    return made.select(F.explode("files").alias("x")).select("x.path", "x.content")


def entry_files(entries: DataFrame, folder: Column) -> DataFrame:
    """Rows (path, content) of the older module's entries (index, text, xml, images, paragraphs, ssml: arrays; metaTags: a map with
    TRACK and TITLE): the whole entry as .fulldata.json and its paragraphs as .txt. What is null isn't in the document."""
    tag = lambda key: F.coalesce(F.try_element_at("metaTags", F.lit(key)), F.lit(""))
    name = lambda ending: F.concat(folder, F.lit("/"), file_name(tag("TRACK"), tag("TITLE"), ending))
    document = F.struct("index", "text", "xml", "images", F.transform("paragraphs", lambda p: F.struct(p.alias("text"))).alias("paragraphs"), "ssml", "metaTags")
    spoken = F.concat(F.array_join(F.transform(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: F.concat(p, F.lit("\n\n"))), ""))
    both = F.array(F.struct(name(".fulldata.json").alias("path"), pretty(F.to_json(document), 2, ascii_only=True).alias("content")), F.struct(name(".txt").alias("path"), spoken.alias("content")))
    return entries.select(F.explode(both).alias("x")).select("x.path", "x.content")


def request_documents(queries: DataFrame, names: DataFrame, path: Column) -> DataFrame:
    """Rows (path, content): for each book the document of its tracks' requests. queries: (book_id, track_no, query_no, query);
    names: (book_id, track_no, name); path: the file's name by book_id."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("query_no", "query"))), lambda q: q["query"])
    tracks = names.join(queries.groupBy("book_id", "track_no").agg(one.alias("ssml_queries")), ["book_id", "track_no"], "left")
    track = F.struct("name", F.coalesce(F.size("ssml_queries"), F.lit(0)).alias("num_queries"), F.coalesce("ssml_queries", F.array().cast("array<string>")).alias("ssml_queries"))
    books = tracks.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_no", track.alias("t")))), lambda t: t["t"]).alias("tracklist"))
    return books.select(path.alias("path"), pretty(F.to_json(F.struct("tracklist"))).alias("content"))


def tag_documents(tags: DataFrame, path: Column) -> DataFrame:
    """Rows (path, content): for each book the document of its tags (book_id, tag, value); null values stay."""
    listed = tags.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("tags"))
    return listed.select(path.alias("path"), pretty(F.to_json("tags", {"ignoreNullFields": "false"})).alias("content"))
