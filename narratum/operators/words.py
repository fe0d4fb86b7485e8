"""Words that a text uses unusually often."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spoken_words


def frequencies(lines: DataFrame, word: str = "word", count: str = "count", order: str = "line_no") -> DataFrame:
    """General frequencies (word, freq): words trimmed and in lower case, the last line of a word counts."""
    key = F.lower(F.regexp_replace(word, r"^(?U)\s+|(?U)\s+$", ""))
    return lines.groupBy(key.alias("word")).agg(F.max_by(F.col(count).cast("long"), F.col(order)).alias("freq"))


def importance(queries: DataFrame, general: DataFrame, query: str, order: list[str]) -> DataFrame:
    """(word, n, score, first_seen, rank): uses over the general frequency (1 if unknown), falling, ties by first use."""
    words = queries.select(*order, F.posexplode(spoken_words(F.col(query))).alias("pos", "word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct(*order, "pos")).alias("first_seen"))
    scored = counted.join(general, "word", "left").withColumn("score", F.col("n") / F.coalesce("freq", F.lit(1)))
    return scored.select("word", "n", "score", "first_seen")


def ranked(scored: DataFrame, top: int | None = None) -> DataFrame:
    """importance() in order of rank; a top-k report if top is given."""
    out = scored.orderBy(F.desc("score"), "first_seen")
    return out.limit(top) if top else out


def report_lines(scored: DataFrame) -> DataFrame:
    """The text report: word, colon, score with six decimals."""
    return ranked(scored).select(F.format_string("%s: %.6f", "word", "score").alias("value"))


def rank_in(scored: DataFrame, group: str) -> DataFrame:
    """rank from 1 within each group."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "first_seen")
    return scored.withColumn("rank", F.row_number().over(w))
