"""Text records to speech requests: inline merge, splitting, rendering and greedy packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from ..functions.text import fits, split_to_limit
from . import sequence

#: Elements that continue a paragraph, and the limits in characters.
INLINE = ("small", "b", "big", "i")
PARAGRAPH_LIMIT, QUERY_LIMIT = 1900, 2850
#: Length of the request's frame before its text is put in: <speak>{text}</speak>.
FRAME = 21
#: Records or portions of a track up to which it is one array in a task.
LONG = 4096


def _append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _records(records: DataFrame, key: str, order: str) -> DataFrame:
    parents = F.coalesce("parents", F.array().cast("array<string>"))
    inline = F.substring_index("tag", ".", 1).isin(*INLINE)
    return records.select(key, order, "content", inline.alias("inline"), F.col("content").isNotNull().alias("has"), F.concat(parents, F.array("tag")).alias("path"), parents.alias("parents"))


def _steps(rows: DataFrame) -> DataFrame:
    """Records with next_path as maps of (carries on, the record before took the inline way) to the same after them."""
    same = lambda p: F.coalesce((F.size(p) > 0) & (F.col("next_path") == F.col(p)), F.lit(False))
    step = F.lit(0)
    for carry in (False, True):
        for was in (False, True):
            other = F.col("has") & (F.col("inline") | carry)
            on = F.when(F.col("has"), other & same("path" if was else "parents")).otherwise(carry)
            to = on.cast("int") + 2 * other.cast("int")
            step = step + to * (1 << 2 * (int(carry) + 2 * int(was)))
    return rows.withColumn("step", step)


def merge_scan(records: DataFrame, key: str, order: str) -> DataFrame:
    """merge_inline for tracks of any length: an associative scan of the records' maps, paragraphs numbered by a running sum."""
    rows = sequence.numbered(_records(records, key, order), [key], [order])
    rows = _steps(sequence.following(rows, [key], "path", "next_path")).select(key, "pos", "content", "inline", "has", "step")
    rows = stored(sequence.states(rows, [key], "step", "state"), "merged")
    carry = F.col("state").bitwiseAND(1) == 1
    rows = sequence.running(rows, [key], F.when(F.col("has") & ~carry, 1).otherwise(0), "opened")
    first = rows.where("has and opened = 1").groupBy(key).agg(F.min_by("inline", "pos").cast("int").alias("extra"))
    kept = rows.where("has").join(first, key).withColumn("par_no", (F.col("opened") - 1 + F.col("extra")).cast("int"))
    made = kept.groupBy(key, "par_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]).alias("content"))
    return made.unionByName(first.where("extra = 1").select(key, F.lit(0).alias("par_no"), F.array().cast("array<string>").alias("content")))


def merge_inline(records: DataFrame, key: str, order: str, long: int = LONG) -> DataFrame:
    """Records (key, order, tag, parents, content) of a track to paragraphs (key, par_no, content array).

    tag has the form name.number. A record opens a paragraph unless the one before it, carrying on, made it a sibling's
    continuation; the carry depends on the record after it, whose path must equal the current one's parents (with the
    current tag added once more if the record before was itself inline or carried). Tracks over `long` records go by merge_scan,
    others by a fold over the track.
    """
    records, crowd = sequence.split(records.select(key, order, "tag", "parents", "content"), [key], long)
    w = Window.partitionBy(key).orderBy(order)
    rows = _records(records, key, order).withColumn("next_path", F.lead("path").over(w))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "content", "inline", "has", "path", "parents", "next_path"))).alias("rs"))
    text = "array<array<string>>"
    start = F.struct(F.lit(False).alias("carry"), F.lit(False).alias("was"), F.array().cast(text).alias("out"))

    def step(a: Column, r: Column) -> Column:
        other = r["has"] & (r["inline"] | a["carry"])
        # The record before, when it took the inline way, has put the current record's tag on its list of parents already.
        path = F.when(a["was"], r["path"]).otherwise(r["parents"])
        hit = F.coalesce((F.size(path) > 0) & (r["next_path"] == path), F.lit(False))
        fresh = F.when(other & ~a["carry"] & (F.size(a["out"]) == 0), F.array(F.array().cast("array<string>"))).otherwise(F.array().cast(text))
        joined = F.when(
            F.size(a["out"]) > 0, _append(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), _append(F.element_at(a["out"], -1), r["content"]))
        ).otherwise(F.array(F.array(r["content"])))
        out = F.when(~r["has"], a["out"]).when(a["carry"], joined).otherwise(F.concat(a["out"], fresh, F.array(F.array(r["content"]))))
        return F.struct(F.when(r["has"], other & hit).otherwise(a["carry"]).alias("carry"), other.alias("was"), out.alias("out"))

    merged = grouped.select(key, F.aggregate("rs", start, step)["out"].alias("out"))
    merged = merged.select(key, F.posexplode("out").alias("par_no", "content"))
    return merged if crowd is None else merged.unionByName(merge_scan(crowd, key, order))


def split_paragraphs(paragraphs: DataFrame, order: str = "par_no", limit: int = PARAGRAPH_LIMIT, strict: bool = True) -> DataFrame:
    """Paragraphs (order, content array) to pieces: (order, piece_no, text, char_length).

    A paragraph under the limit stays whole; of others each item is a piece, split further if it is too long itself. With
    strict, a piece that can't be shortened enough is an error.
    """
    total = F.aggregate("content", F.lit(0), lambda a, x: a + F.length(x))
    finer = F.flatten(F.transform("content", lambda x: split_to_limit(x, limit)))
    if strict:
        finer = F.when(fits(finer, limit), finer).otherwise(F.raise_error(F.lit(f"a paragraph can't be split to under {limit} characters")).cast("array<string>"))
    pieces = F.when(total < limit, F.array(F.array_join("content", ""))).otherwise(finer)
    keep = [c for c in paragraphs.columns if c not in ("content", "piece_no", "text", "char_length")]
    out = paragraphs.select(*keep, F.posexplode(pieces).alias("piece_no", "text"))
    return out.withColumn("char_length", F.length("text"))


def render(pieces: DataFrame, book: str | None, order: list[str], mark: bool = True, limit: int = QUERY_LIMIT) -> DataFrame:
    """Adds mark_no (over the whole book, from 0), ssml and ssml_length. A portion that can't fit a request is an error."""
    out = sequence.ranked(pieces, [book] if book else [], order, "mark_no")
    sign = F.concat(F.lit('<mark name="p'), F.col("mark_no").cast("string"), F.lit('"/>')) if mark else F.lit("")
    ssml = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"), sign)
    out = out.withColumn("ssml", ssml)
    ok = F.length("ssml") + FRAME <= limit
    return out.withColumn("ssml", F.when(ok, F.col("ssml")).otherwise(F.raise_error(F.lit(f"a portion is over {limit} characters")).cast("string"))).withColumn("ssml_length", F.length("ssml"))


def measured(pieces: DataFrame, book: str | None, order: list[str], limit: int = QUERY_LIMIT) -> DataFrame:
    """render without texts: pieces with char_length get mark_no and ssml_length, so that numbers and packing move no text."""
    out = sequence.ranked(pieces, [book] if book else [], order, "mark_no")
    n = F.col("char_length") + F.length(F.concat(F.lit('<p></p><mark name="p'), F.col("mark_no").cast("string"), F.lit('"/>')))
    return out.withColumn("ssml_length", F.when(n + FRAME <= limit, n).otherwise(F.raise_error(F.lit(f"a portion is over {limit} characters")).cast("int")))


def written(pieces: DataFrame, packed: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, place, query_no, ssml): the texts of pieces (key, order, char_length, text) meet their numbers in packed (key, order,
    char_length, mark_no, place, query_no), track by track; texts are shuffled once."""
    lists = lambda df, *own: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "char_length", *own))).alias(own[0] + "s"))
    both = lists(pieces, "text").join(lists(packed, "place", "mark_no", "query_no"), key)
    rows = both.select(*key, F.explode(F.arrays_zip("texts", "places")).alias("x")).select(*key, F.col("x.texts.text").alias("text"), "x.places.place", "x.places.mark_no", "x.places.query_no")
    return rows.select(*key, "place", "query_no", F.concat(F.lit("<p>"), F.col("text"), F.lit('</p><mark name="p'), F.col("mark_no").cast("string"), F.lit('"/>')).alias("ssml"))


def pack_jumps(portions: DataFrame, key: list[str], order: list[str], length: str = "ssml_length", limit: int = QUERY_LIMIT, frame: int = FRAME) -> DataFrame:
    """pack for tracks of any length, by prefix sums and doubled jumps.

    A request that begins with a portion ends before the first later one whose running sum is `limit - frame` beyond what stood
    before it: a lookup of running sums. From the first request's end these jumps reach all beginnings; twice as far each round.
    """
    room = limit - frame
    rows = sequence.numbered(portions, key, order, "place", "__total")
    rows = stored(sequence.running(rows, key, F.col(length).cast("long"), "__end", "place"), "sums").withColumn("__start", F.col("__end") - F.col(length))
    ends = rows.select(*key, F.col("__end").alias("place"), F.col("place").alias("value"))
    points = rows.select(*key, "place", "__total", (F.col("__start") + room).alias("__want"))
    next_one = sequence.as_of(points, "__want", ends, key, "__to", True)
    to = F.greatest(F.col("place") + 1, F.col("__to"))
    jumps = next_one.where("__to is not null").select(*key, F.col("place").alias("pos"), F.when(to < F.col("__total"), to).alias("to"))
    roots = ends.where(F.col("place") >= room).groupBy(*key).agg(F.min("value").alias("pos"))
    begins = sequence.reached(jumps, roots, key).withColumnRenamed("pos", "place").select(*key, "place", F.lit(1).alias("__begins"))
    rows = rows.alias("r").join(begins.alias("b"), sequence.on("r", "b", key, "place", "place"), "left").select("r.*", F.coalesce("b.__begins", F.lit(0)).alias("__begins"))
    out = sequence.running(rows, key, F.col("__begins"), "query_no", "place")
    return out.select(*portions.columns, "place", F.col("query_no").cast("int").alias("query_no"))


def pack(portions: DataFrame, key: list[str], order: list[str], length: str = "ssml_length", limit: int = QUERY_LIMIT, frame: int = FRAME, long: int = LONG) -> DataFrame:
    """Adds query_no and place (from 0): portions of a track, in order, fill a request while frame + text stays under the limit.

    A request that would reach the limit is closed first, so a first portion that fills one alone leaves an empty request
    0 before it. Tracks over `long` portions go by pack_jumps, others by a fold that carries the portions along.
    """
    rest = [c for c in portions.columns if c not in (*key, *order)]
    portions, crowd = sequence.split(portions, key, long)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("__rest"))))
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("q"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        n = r["__rest"][length]
        more = frame + a["size"] + n < limit
        q = F.when(more, a["q"]).otherwise(a["q"] + 1)
        return F.struct(F.when(more, a["size"] + n).otherwise(n).cast("int").alias("size"), q.alias("q"), _append(a["out"], q).alias("out"))

    folded = portions.groupBy(*key).agg(rows.alias("__rs")).withColumn("__qs", F.aggregate("__rs", start, step)["out"])
    at = folded.select(*key, F.posexplode(F.arrays_zip("__rs", "__qs")).alias("place", "__x"))
    columns = {c: F.col(f"__x.__rs.{c}") for c in order} | {c: F.col(f"__x.__rs.__rest.{c}") for c in rest}
    out = at.select(*[F.col(c) if c in key else columns[c].alias(c) for c in portions.columns], F.col("place").cast("long").alias("place"), F.col("__x.__qs").alias("query_no"))
    return out if crowd is None else out.unionByName(pack_jumps(crowd, key, order, length, limit, frame))


def requests(packed: DataFrame, key: list[str], order: list[str], text: str = "ssml", head: str = "<speak>", tail: str = "</speak>") -> DataFrame:
    """(key, query_no, query): the packed portions in their frame, the empty request 0 included where packing left one."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t"))))
    made = packed.groupBy(*key, "query_no").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"), F.min("place").alias("first"))
    one = lambda no, text: F.struct(no.alias("query_no"), text.alias("text"))
    own = one(F.col("query_no"), F.col("text"))
    rows = F.when((F.col("first") == 0) & (F.col("query_no") > 0), F.array(one(F.lit(0), F.lit("")), own)).otherwise(F.array(own))
    return made.select(*key, F.explode(rows).alias("x")).select(*key, "x.query_no", F.concat(F.lit(head), F.col("x.text"), F.lit(tail)).alias("query"))


def with_empty_tracks(queries: DataFrame, tracks: DataFrame, key: list[str]) -> DataFrame:
    """A track without any portion still has one empty request; requests of other tracks stay."""
    all_tracks = tracks.select(*key).distinct()
    joined = all_tracks.join(queries, key, "full_outer")
    return joined.select(*key, F.coalesce("query_no", F.lit(0)).alias("query_no"), F.coalesce("query", F.lit("<speak></speak>")).alias("query"))
