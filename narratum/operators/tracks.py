"""Tracks: names, filters, numbers and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequence import ranked

#: Words in the names of short tracks that aren't read.
UNREAD = ("contents", "copyright", "insert", "title", "cover", "newsletter", "illustrations", "j-novel")
#: The voices by language, and US dollars for a million characters by kind of voice.
VOICES = {
    "en-US": (
        ("Danielle", "Female", ("standard",)), ("Gregory", "Male", ("standard",)), ("Ivy", "Female (child)", ("neural",)),
        ("Joanna", "Female", ("standard", "neural")), ("Kendra", "Female", ("standard", "neural")), ("Kimberly", "Female", ("standard", "neural")),
        ("Salli", "Female", ("standard", "neural")), ("Joey", "Male", ("standard", "neural")), ("Justin", "Male (child)", ("standard", "neural")),
        ("Kevin", "Male (child)", ("standard", "neural")), ("Matthew", "Male", ("standard", "long-form")),
        ("Ruth", "Female", ("generative", "long-form", "neural")), ("Stephen", "Male", ("long-form",)),
    ),
    "en-GB": (
        ("Amy", "Female", ("standard", "neural", "generative")), ("Emma", "Female", ("standard", "neural")), ("Brian", "Male", ("standard", "neural")),
        ("Arthur", "Male", ("standard", "neural")), ("Geraint", "Male", ("standard",)),
    ),
    "en-AU": (("Nicole", "Female", ("standard",)), ("Olivia", "Female", ("neural",)), ("Russell", "Male", ("standard",))),
    "en-IN": (("Aditi", "Female", ("standard",)), ("Raveena", "Female", ("standard",)), ("Kajal", "Female", ("neural",))),
    "en-IE": (("Niamh", "Female", ("neural", "standard")),),
    "en-NZ": (("Aria", "Female", ("neural",)),),
    "en-ZA": (("Ayanda", "Female", ("neural", "standard")),),
    "en-GB-WLS": (("Geraint", "Male", ("standard",)),),
}
PRICES = {"standard": 4.0, "neural": 16.0, "generative": 30.0, "long-form": 100.0}


def voice_catalogue(spark: SparkSession, voices: dict = VOICES, prices: dict[str, float] | None = None) -> DataFrame:
    """(language, name, gender, voice_type, usd_per_million): a row for each voice and kind."""
    rows = [(lang, name, gender, kind, (prices or PRICES)[kind]) for lang, own in voices.items() for name, gender, kinds in own for kind in kinds]
    return spark.createDataFrame(rows, "language string, name string, gender string, voice_type string, usd_per_million double")


def track_name(label: Column, parents: Column, recursive: bool = False) -> Column:
    return F.array_join(F.concat(F.coalesce(parents, F.array().cast("array<string>")), F.array(label)), ": ") if recursive else label


def unreadable(queries: Column) -> Column:
    """No requests, or a single blank one."""
    return (F.size(queries) == 0) | ((F.size(queries) == 1) & F.element_at(queries, 1).rlike(r"^(?U)\s*$"))


def unread_name(name: Column, num_queries: Column) -> Column:
    """A name that holds an unread word, of a track with fewer than three requests."""
    return F.lower(name).rlike("|".join(UNREAD)) & (num_queries < 3)


def finalize(tracks: DataFrame, album: DataFrame | None = None, book: str | None = None, order: str = "track_no", genre: str = "audiobook") -> DataFrame:
    """Readable tracks (book, order, name, num_queries, queries if there) numbered from 1, with title, genre and the album's tags."""
    kept = tracks.where(~unread_name(F.col("name"), F.col("num_queries")))
    if "queries" in tracks.columns:
        kept = kept.where(~unreadable(F.col("queries")))
    out = ranked(kept, [book] if book else [], [order], "track").withColumns({"track": (F.col("track") + 1).cast("int"), "title": F.col("name"), "genre": F.lit(genre)})
    return out.join(album, book, "left") if album is not None and book else out


def rate(voices: DataFrame, language: str, name: str, kind: str) -> DataFrame:
    """One row with the price of a voice; an unknown voice is an error."""
    found = voices.where((F.col("language") == language) & (F.col("name") == name) & (F.col("voice_type") == kind))
    price = F.first("usd_per_million")
    return found.agg(F.when(price.isNull(), F.raise_error(F.lit("no such voice")).cast("double")).otherwise(price).alias("usd_per_million"))


def rated(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Requests (language, name, voice_type, ...) with usd_per_million, the first price of their voice; an unknown voice is an error."""
    key = ["language", "name", "voice_type"]
    first = voices.withColumn("__no", F.monotonically_increasing_id()).groupBy(*key).agg(F.min_by("usd_per_million", "__no").alias("__usd"))
    found = requests.join(F.broadcast(first), key, "left")  # a catalogue of some dozen voices
    price = F.when(F.col("__usd").isNotNull(), F.col("__usd")).otherwise(F.raise_error(F.concat(F.lit("no such voice: "), F.concat_ws(" ", *key))).cast("double"))
    return found.withColumn("usd_per_million", price).drop("__usd")


def cost(queries: DataFrame, voices: DataFrame, key: list[str], query: str = "query") -> DataFrame:
    """(key, language, name, voice_type, chars, usd) of synthesising the requests with each voice. Markup is billed too."""
    sums = queries.groupBy(*key).agg(F.sum(F.length(query)).alias("chars"))
    return sums.crossJoin(F.broadcast(voices)).select(*key, "language", F.col("name"), "voice_type", "chars", (F.col("chars") / F.lit(1e6) * F.col("usd_per_million")).alias("usd"))


def longest(queries: DataFrame, order: list[str], query: str = "query") -> DataFrame:
    """The longest request, the first of equals."""
    return queries.orderBy(F.desc(F.length(query)), *order).limit(1)
