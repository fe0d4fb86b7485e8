"""Registered queries for the engine's own operators, over the synthetic tables, each with DuckDB SQL for the same rows.

Stand-ins: documents are tracks of lines in the book of their source; conversations are tracks of ordered portions; events
are a user's speech marks, lyric lines or frames; pages are markup.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scratch import stored
from ..operators import book, legacy, lyrics, sequence, ssml, tracks, words
from ..sources import epub

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MARKUP_SQL = "regexp_replace(replace(replace(replace(replace(replace(replace(replace(strip_accents({0}), '&', '&amp;'), '\"', '&quot;'), '''', '&apos;'), '<', '&lt;'), '>', '&gt;'), '’', '&apos;'), '—', ' '), '[^\\x00-\\x7F]', '', 'g')"


@query(f"select doc_id, md5({MARKUP_SQL.format('text')}) as spoken_md5, cast(length({MARKUP_SQL.format('text')}) as bigint) as n from documents")
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    spoken = X.speech_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(spoken.cast("binary")).alias("spoken_md5"), F.length(spoken).cast("long").alias("n"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(~F.col("line").rlike(r"^(?U)\s*$")).select("source", "doc_id", "line_no", X.speech_text(F.col("line")).alias("text"))


def _split_sql(limit: int) -> str:
    steps, last = [], "lines"
    for k, (at, left) in enumerate(X.SPLITS):
        a, b = at.replace("'", "''"), left.replace("'", "''")
        steps.append(f"s{k} as (select source, doc_id, line_no, case when len(list_filter(ps, lambda p: length(p) >= {limit})) = 0 then ps else flatten(list_transform(ps, lambda p: case when length(p) >= {limit} then list_transform(string_split(p, '{a}'), lambda q, i: case when i < len(string_split(p, '{a}')) then q || '{b}' else q end) else [p] end)) end as ps from {last})")
        last = f"s{k}"
    lines = f"lines as (select source, doc_id, line_no, [{MARKUP_SQL.format('line')}] as ps from (select source, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as line_no from documents) where not regexp_full_match(line, '[\\s\\x{{00A0}}]*'))"
    pieces = f"pieces as (select source, doc_id, line_no, unnest(ps) as text, unnest(range(0, len(ps))) as piece_no from {last})"
    return f"with recursive {lines}, {', '.join(steps)}, {pieces}"


SPLIT_TEST = 120


def _pieces(spark: SparkSession, d: str, limit: int) -> DataFrame:
    rows = _lines(spark, d).select("source", "doc_id", "line_no", F.array("text").alias("content"))
    return ssml.split_paragraphs(rows, "line_no", limit, strict=False)


@query(f"{_split_sql(SPLIT_TEST)} select doc_id, line_no, piece_no, md5(text) as piece_md5, cast(length(text) as bigint) as char_length from pieces")
def split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, SPLIT_TEST).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("piece_no").cast("long").alias("piece_no"), F.md5(F.col("text").cast("binary")).alias("piece_md5"), F.col("char_length").cast("long").alias("char_length"))


def _pack_sql(source: str, key: str, length: str) -> str:
    """Recursive packing over rows (key, o, n) numbered from 1 in o."""
    return f"""g as (select {key}, o, {length} as n from {source} where o = 1 union all select 0, 0, 0 where false),
p as (select {key}, o, case when {ssml.FRAME} + {length} < {ssml.QUERY_LIMIT} then 0 else 1 end as q, {length} as size from {source} where o = 1
  union all select s.{key}, s.o, case when {ssml.FRAME} + p.size + s.{length} < {ssml.QUERY_LIMIT} then p.q else p.q + 1 end, case when {ssml.FRAME} + p.size + s.{length} < {ssml.QUERY_LIMIT} then p.size + s.{length} else s.{length} end
  from p join {source} s on s.{key} = p.{key} and s.o = p.o + 1)"""


@query(f"with recursive c as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as o from conversations), {_pack_sql('c', 'conv_id', 'n')} select c.conv_id, c.turn, cast(p.q as bigint) as query_no from c join p on p.conv_id = c.conv_id and p.o = c.o")
def pack_queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return ssml.pack(rows, ["conv_id"], ["turn"], "n").select("conv_id", "turn", F.col("query_no").cast("long").alias("query_no"))


@query(f"""{_split_sql(ssml.PARAGRAPH_LIMIT)},
marked as (select doc_id, row_number() over (partition by doc_id order by line_no, piece_no) as o, '<p>' || text || '</p><mark name="p' || (row_number() over (partition by source order by doc_id, line_no, piece_no) - 1)::varchar || '"/>' as x from pieces),
m as (select doc_id, o, x, length(x) as n from marked), {_pack_sql('m', 'doc_id', 'n')},
q as (select m.doc_id, p.q, '<speak>' || string_agg(x, '' order by m.o) || '</speak>' as t from m join p on p.doc_id = m.doc_id and p.o = m.o group by 1, 2),
e as (select doc_id, 0 as q, '<speak></speak>' as t from q group by 1 having min(q) > 0 union all select doc_id, 0, '<speak></speak>' from documents where doc_id not in (select doc_id from q))
select doc_id, cast(count(*) as bigint) as num_queries, cast(sum(length(t)) as bigint) as chars, round(sum(length(t)) / 1e6 * 16.0, 9) as usd, md5(string_agg(t, '' order by q)) as queries_md5 from (select * from q union all select * from e) group by 1""")
def speech_requests(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: documents as tracks, line by line to size-bounded requests, with their number, length and price."""
    track, order = ["doc_id"], ["line_no", "piece_no"]
    pieces = stored(_pieces(spark, d, ssml.PARAGRAPH_LIMIT), "pieces")
    sizes = ssml.measured(pieces.select("source", *track, *order, "char_length"), "source", [*track, *order])
    packed = ssml.pack(sizes.select(*track, *order, "char_length", "mark_no", "ssml_length"), track, order)
    made = ssml.with_empty_tracks(ssml.requests(ssml.written(pieces, packed, track, order), track, ["place"]), table(spark, d, "documents"), track)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("query_no", "query"))), lambda q: q["query"]), "")
    chars = F.sum(F.length("query"))
    return made.groupBy("doc_id").agg(F.count("*").alias("num_queries"), chars.alias("chars"), F.round(chars / F.lit(1e6) * 16.0, 9).alias("usd"), F.md5(text.cast("binary")).alias("queries_md5"))


@query("select doc_id, row_number() over (partition by source order by doc_id) - 1 as mark_no from documents")
def mark_numbering(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.lit("x").alias("text"))
    return ssml.render(rows, "source", ["doc_id"]).select("doc_id", F.col("mark_no").cast("long").alias("mark_no"))


@query(f"select doc_id, row_number() over (partition by source order by doc_id) as track, name as title, 'audiobook' as genre from (select source, doc_id, string_split(text, chr(10))[1] as name, len(string_split(text, chr(10))) as n from documents) where not (n < 3 and regexp_matches(lower(name), '{'|'.join(tracks.UNREAD)}')) and not (n = 1 and trim(name) = '')")
def track_finalize(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    rows = table(spark, d, "documents").select("source", "doc_id", F.get(lines, F.lit(0)).alias("name"), F.size(lines).alias("num_queries"), lines.alias("queries"))
    return tracks.finalize(rows, book="source", order="doc_id").select("doc_id", F.col("track").cast("long").alias("track"), "title", "genre")


@query("select s_suppkey, concat_ws(': ', r_name, n_name, s_name) as name, s_name as plain_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def track_name_path(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    parents = F.array("r_name", "n_name")
    return rows.select("s_suppkey", tracks.track_name(F.col("s_name"), parents, True).alias("name"), tracks.track_name(F.col("s_name"), parents).alias("plain_name"))


VOICES_SQL = ", ".join(f"('{lang}', '{name}', '{kind}', {tracks.PRICES[kind]})" for lang, own in tracks.VOICES.items() for name, _, kinds in own for kind in kinds)


@query(f"select conv_id, language, name, voice_type, cast(chars as bigint) as chars, round(chars / 1e6 * price, 9) as usd from (select conv_id, sum(length(text)) as chars from conversations group by 1), (values {VOICES_SQL}) v(language, name, voice_type, price)")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    out = tracks.cost(table(spark, d, "conversations"), tracks.voice_catalogue(spark), ["conv_id"], "text")
    return out.withColumn("usd", F.round("usd", 9))


@query("""select conv_id, turn, cast(length(text) as bigint) as chars, case role when 'user' then 16.0::double when 'assistant' then 30.0 else 4.0 end as usd_per_million,
  round(length(text) / 1e6 * case role when 'user' then 16.0 when 'assistant' then 30.0 else 4.0 end, 9) as usd from conversations""")
def voice_rate(spark: SparkSession, d: str) -> DataFrame:
    """Each turn priced by the voice that reads its role."""
    role = F.col("role")
    turns = table(spark, d, "conversations").select(
        "conv_id", "turn", F.length("text").cast("long").alias("chars"), F.when(role == "user", "en-US").when(role == "assistant", "en-GB").otherwise("en-AU").alias("language"),
        F.when(role == "user", "Joanna").when(role == "assistant", "Amy").otherwise("Nicole").alias("name"), F.when(role == "user", "neural").when(role == "assistant", "generative").otherwise("standard").alias("voice_type"),
    )
    out = tracks.rated(turns, tracks.voice_catalogue(spark))
    return out.select("conv_id", "turn", "chars", "usd_per_million", F.round(F.col("chars") / F.lit(1e6) * F.col("usd_per_million"), 9).alias("usd"))


@query("select conv_id, turn, cast(length(text) as bigint) as n from conversations order by length(text) desc, conv_id, turn limit 1")
def longest_query(spark: SparkSession, d: str) -> DataFrame:
    return tracks.longest(table(spark, d, "conversations"), ["conv_id", "turn"], "text").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query(r"""with w as (select doc_id, unnest(regexp_split_to_array(replace(replace(text, '<', ' <'), '>', '> '), '[\s\x{00A0}]+')) as w from documents),
c as (select lower(w) as word, count(*) as n from w where regexp_full_match(w, '\p{L}+') group by 1),
g as (select lower(w) as word, count(*) as f from (select unnest(string_split(text, ' ')) as w from benchmark) group by 1)
select c.word, cast(n as bigint) as n, round(n / coalesce(f, 1), 9) as score from c left join g using (word)""")
def word_importance(spark: SparkSession, d: str) -> DataFrame:
    general = table(spark, d, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("freq"))
    out = words.importance(table(spark, d, "documents").select("doc_id", "text"), general, "text", ["doc_id"])
    return out.select("word", "n", F.round("score", 9).alias("score"))


@query(r"""with w as (select doc_id, unnest(list_transform(list_filter(regexp_split_to_array(text, '[\s\x{00A0}]+'), lambda x: regexp_full_match(x, '\p{L}+')), lambda x, i: {'w': lower(x), 'i': i})) as x from documents),
c as (select x.w as word, count(*) as n, min({'d': doc_id, 'i': x.i}) as f from w group by 1)
select word, cast(n as bigint) as n, row_number() over (order by n desc, f) as rank from c order by rank limit 50""")
def top_words(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 50 most used words, ties in the order of their first use."""
    none = spark.createDataFrame([], "word string, freq bigint")
    scored = words.importance(table(spark, d, "documents").select("doc_id", "text"), none, "text", ["doc_id"])
    top = words.ranked(scored, 50).withColumn("all", F.lit(1))
    return words.rank_in(top, "all").select("word", "n", F.col("rank").cast("long").alias("rank"))


@query("select user_id as track, lower(trim(event_type)) as word, arg_max(event_id, event_id) as freq from events group by 1, 2")
def last_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.concat(F.lit(" "), F.upper("event_type")).alias("word"), F.col("event_id").alias("count"), F.col("event_id").alias("line_no"))
    out = words.frequencies(rows.withColumn("word", F.concat_ws("\u0001", "user_id", "word")))
    return out.select(F.split("word", "\u0001")[0].cast("long").alias("track"), F.trim(F.split("word", "\u0001")[1]).alias("word"), "freq")


def _marks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "preceding_realtime").when(F.col("event_type") == "signup", "ssml").otherwise("sentence")
    return table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").alias("time_ms"), kind.alias("type"), F.concat(F.col("event_type"), F.col("event_id").cast("string")).alias("value"))


MARKS_SQL = "m as (select user_id, ts, event_id, cast(floor(value) as bigint) as time_ms, case event_type when 'error' then 'preceding_realtime' when 'signup' then 'ssml' else 'sentence' end as type, event_type || event_id::varchar as value from events)"


@query(f"with {MARKS_SQL}, o as (select *, time_ms + coalesce(sum(case when type = 'preceding_realtime' then time_ms end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as at_ms from m) select user_id, event_id, cast(at_ms as bigint) as at_ms, printf('[%02d:%02d.%02d]', cast(at_ms // 60000 as int), cast(at_ms % 60000 // 1000 as int), cast(at_ms % 1000 // 10 as int)) || value as line from o where type = 'sentence'")
def lyric_offsets(spark: SparkSession, d: str) -> DataFrame:
    return lyrics.lyric_lines(_marks(spark, d), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "at_ms", "line")


@query(f"with {MARKS_SQL}, o as (select *, time_ms + coalesce(sum(case when type = 'ssml' then time_ms end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as at_ms from m) select user_id, event_id, cast(at_ms as bigint) as at_ms from o")
def legacy_offsets(spark: SparkSession, d: str) -> DataFrame:
    return lyrics.offsets(_marks(spark, d), "user_id", ["ts", "event_id"], F.col("type") == "ssml").select("user_id", "event_id", "at_ms")


@query(f"with {MARKS_SQL}, b as (select *, coalesce(sum(case when type = 'ssml' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as block from m), p as (select user_id, block, string_agg(value, ' ' order by ts, event_id) as text from b where type = 'sentence' group by 1, 2) select user_id, row_number() over (partition by user_id order by block) as par_no, text from p")
def lyric_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return lyrics.paragraphs(_marks(spark, d), "user_id", ["ts", "event_id"]).withColumn("par_no", F.col("par_no").cast("long"))


@query("""with r as (select user_id, event_type, string_agg('{"time": ' || cast(floor(value) as bigint)::varchar || ', "type": "sentence", "value": "' || event_id::varchar || '"}', chr(10) order by event_id) as b, cast(sum(cast(floor(value) as bigint)) as bigint) as n from events group by 1, 2),
l as (select user_id, event_type, unnest(string_split(b, chr(10))) as j, unnest(range(0, len(string_split(b, chr(10))))) as k from r)
select user_id, event_type, cast(k as bigint) as seq_line, cast(j->>'$.time' as bigint) as time_ms, j->>'$.type' as type, j->>'$.value' as value from l union all select user_id, event_type, 2147483647, n, 'preceding_realtime', null from r""")
def speech_marks(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit('{"time": '), F.floor("value").cast("string"), F.lit(', "type": "sentence", "value": "'), F.col("event_id").cast("string"), F.lit('"}'))
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", F.floor("value").alias("n"), line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    responses = rows.groupBy("user_id", "event_type").agg(F.concat(lines, F.lit("\n")).alias("body"), F.sum("n").alias("duration_ms"))
    out = lyrics.speech_marks(responses, "user_id", "event_type")
    return out.select("user_id", F.col("seq_query").alias("event_type"), F.col("seq_line").cast("long").alias("seq_line"), "time_ms", "type", "value")


@query("with m as (select event_id, cast(floor(value * 1000) as bigint) as ms from events), s as (select event_id, ms, printf('[%02d:%02d.%02d]', cast(ms // 60000 as int), cast(ms % 60000 // 1000 as int), cast(ms % 1000 // 10 as int)) as stamp, '[' || (ms // 60000)::varchar || ':' || (ms % 60000 // 1000)::varchar || '.' || (ms % 1000 // 10)::varchar || ']' as short from m) select event_id, stamp, short, cast(trunc((cast(regexp_extract(short, '(\\d+):', 1) as bigint) * 60 + (cast(regexp_extract(short, ':(\\d+)', 1) as bigint) + cast(regexp_extract(short, '\\.(\\d+)', 1) as bigint) / 100.0::double)) * 1000) as bigint) as back, regexp_full_match(short, '\\[?\\d{1,2}:\\d{2}\\.\\d{2}\\]?') as valid from s".replace("\\\\", "\\"))
def lrc_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.floor(F.col("value") * 1000).alias("ms"))
    rows = rows.select("event_id", X.show_time(F.col("ms")).alias("stamp"), X.show_time(F.col("ms"), padded=False).alias("short"))
    return rows.select("*", X.parse_time(F.col("short")).alias("back"), X.is_time(F.col("short")).alias("valid"))


@query("select conv_id, turn, end_time, from_line from (select conv_id, turn, text, lead(turn) over (partition by conv_id order by turn) as end_time, 'line ' || turn::varchar as from_line from conversations) where contains(lower(text), 'the')")
def next_line(spark: SparkSession, d: str) -> DataFrame:
    rows = lyrics.with_end(table(spark, d, "conversations"), "conv_id", "turn")
    return lyrics.with_word(rows, "THE").select("conv_id", "turn", "end_time", F.concat(F.lit("line "), F.col("turn").cast("string")).alias("from_line"))


@query("select conv_id, time_ms, md5('<speak>' || regexp_replace(text, 'the', 'a$b', 'gi') || '</speak>') as ssml_md5, end_time from (select conv_id, turn as time_ms, text, lead(turn) over (partition by conv_id order by turn) as end_time from conversations) where contains(lower(text), 'the')")
def heal_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("time_ms"), "text")
    return lyrics.corrected(rows, "conv_id", "the", "a$b").select("conv_id", "time_ms", F.md5(F.col("ssml").cast("binary")).alias("ssml_md5"), "end_time")


EDITED_SQL = "l as (select user_id, event_id * 100 as time_ms, event_type as text from events), e as (select user_id, event_id * 100 as time_ms, 'fixed' as new, event_id * 100 + 3 as new_start, case when value >= 100 then event_id * 100 + cast(floor(value) as bigint) end as edit_end from events where event_type = 'error')"


@query(f"with {EDITED_SQL}, n as (select *, lead(time_ms) over (partition by user_id order by time_ms) as end_time from l), j as (select n.*, e.new, e.new_start, e.edit_end from n left join e using (user_id, time_ms)), s as (select *, coalesce(last_value(case when new is not null then edit_end - end_time end ignore nulls) over (partition by user_id order by time_ms rows between unbounded preceding and 1 preceding), 0) as shift from j), a as (select user_id, time_ms, case when new is not null then new_start else time_ms + shift end as at_ms, coalesce(new, text) as t from s) select user_id, time_ms, cast(at_ms as bigint) as at_ms, '[' || (at_ms // 60000)::varchar || ':' || (at_ms % 60000 // 1000)::varchar || '.' || (at_ms % 1000 // 10)::varchar || ']' || t as line from a where at_ms >= 0")
def lyric_shift(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", (F.col("event_id") * 100).alias("time_ms"), "event_type", "value")
    edits = events.where("event_type = 'error'").select("user_id", "time_ms", F.lit("fixed").alias("new"), (F.col("time_ms") + 3).alias("new_start"), F.when(F.col("value") >= 100, F.col("time_ms") + F.floor("value")).alias("edit_end"))
    return lyrics.shifted(events.select("user_id", "time_ms", F.col("event_type").alias("text")), edits, "user_id").where("at_ms >= 0")


@query("""with c as (select user_id, event_id as o, event_id * 50 as s, case when event_type <> 'error' then event_id * 50 + cast(floor(value) as bigint) end as e, case when event_id % 3 = 0 then event_id % 7 end as half, cast(floor(value / 2) as bigint) as n from events),
x as (select *, s + coalesce(sum(case when e is not null then n - (e - s) end) over (partition by user_id order by o rows between unbounded preceding and 1 preceding), 0) as a from c)
select user_id, o, cast(a as bigint) as new_start, cast(a + n + case when e is not null then coalesce(half, 0) else 0 end as bigint) as new_end from x""")
def splice_deltas(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("event_id") * 50
    cuts = table(spark, d, "events").select("user_id", F.col("event_id").alias("o"), at.alias("start_splice"), F.when(F.col("event_type") != "error", at + F.floor("value")).alias("end_splice"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("half"), F.floor(F.col("value") / 2).alias("new_length"))
    return lyrics.splices(cuts, "user_id", "o").select("user_id", "o", "new_start", "new_end")


@query("""with f as (select user_id % 10 as track, row_number() over (partition by user_id % 10 order by event_id) - 1 as ms, -value / 4 as dbfs from events),
n as (select track, max(ms) + 1 as len from f group by 1),
t as (select track, ms as t, case when ms % 3 <> 0 then ms + 15 end as e from f where ms % 20 = 0),
a as (select t.*, len, case when t.t >= len then t.t else coalesce((select min(ms) from f where f.track = t.track and ms >= t.t and dbfs >= -60), len) end as after from t join n using (track)),
b as (select *, coalesce((select max(ms) from f where f.track = a.track and ms < a.after and dbfs < -60) + 1, 0) as before from a),
c as (select *, coalesce((select max(ms) from f where f.track = b.track and ms < b.e and dbfs >= -60) + 1, 0) as ea from b),
g as (select *, coalesce((select min(ms) from f where f.track = c.track and ms >= c.ea and dbfs < -60), len) as eb from c)
select track, cast(t as bigint) as t, cast((after + before) // 2 as bigint) as start_splice, cast((after - before) // 2 as bigint) as start_half, cast(case when e is not null then (ea + eb) // 2 end as bigint) as end_splice, cast(case when e is not null then (eb - ea) // 2 end as bigint) as end_half from g""")
def silence_splice(spark: SparkSession, d: str) -> DataFrame:
    frames = _frames(spark, d)
    targets = frames.where("ms % 20 = 0").select("track", F.col("ms").alias("line"), F.col("ms").alias("t"), F.when(F.col("ms") % 3 != 0, F.col("ms") + 15).alias("end_t"))
    out = lyrics.splice_points(frames, targets, "track")
    return out.select("track", *[F.col(c).cast("long").alias(c) for c in ("t", "start_splice", "start_half", "end_splice", "end_half")])


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Events of ten tracks as frames, a millisecond each."""
    events = table(spark, d, "events").select((F.col("user_id") % 10).alias("track"), "event_id", (-F.col("value") / 4).alias("dbfs"))
    return sequence.ranked(events, ["track"], ["event_id"], "ms").select("track", "ms", "dbfs")


@query("""with f as (select user_id % 10 as track, row_number() over (partition by user_id % 10 order by event_id) - 1 as ms, -value / 4 as dbfs from events),
n as (select track, max(ms) + 1 as len, max(ms) // 60 as last from f group by 1),
c as (select track, k, 60 * k + 5 as s, case when k < last then 60 * k + 10 + k % 15 end as e, k % 3 as sh, case when k < last then k % 5 end as eh from (select track, last, unnest(range(0, last + 1)) as k from n)),
r as (select c.track, c.k, f.ms - (60 * c.k + 30) as ms, f.dbfs from c join f on f.track = c.track and f.ms >= 60 * c.k + 30 and f.ms < 60 * c.k + 50),
b as (select track, k, max(ms) + 1 as len, min(case when dbfs >= -60 then ms end) as lo, max(case when dbfs >= -60 then ms end) as hi from r group by 1, 2),
t as (select c.*, b.len, coalesce(b.lo, b.len) - 1 - sh as cs, b.hi from c left join b using (track, k)),
u as (select *, greatest(coalesce(coalesce(hi - cs + 1, 0) + 1 + eh, len - cs, 0), 0) as nl from t),
v as (select *, coalesce(sum(nl - (e - s)) over (partition by track order by k rows between unbounded preceding and 1 preceding), 0) as delta, lag(e) over (partition by track order by k) as prev from u),
o as (select f.track, f.ms + v.delta as ms, f.dbfs from f join v on v.track = f.track and f.ms >= coalesce(v.prev, 0) and f.ms < v.s),
p as (select v.track, v.s + v.delta + i as ms, r.dbfs from (select *, unnest(range(0, nl)) as i from v) v left join r on r.track = v.track and r.k = v.k and r.ms = v.i + v.cs)
select track, cast(ms as bigint) as ms, round(dbfs, 6) as dbfs from o union all select track, cast(ms as bigint), round(coalesce(dbfs, -999), 6) from p""")
def splice_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a cut each 60 ms, whose reading is a passage of the track's own; the last cut runs to the end."""
    frames = stored(_frames(spark, d), "frames")
    ends = frames.groupBy("track").agg(F.floor(F.max("ms") / 60).alias("last"))
    k, more = F.col("k"), F.col("k") < F.col("last")
    cuts = ends.select("track", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k"))
    cuts = cuts.select("track", "k", (60 * k + 5).alias("start_splice"), F.when(more, 60 * k + 10 + k % 15).alias("end_splice"), (k % 3).alias("start_half"), F.when(more, k % 5).alias("end_half"))
    readings = frames.where("ms % 60 >= 30 and ms % 60 < 50").select("track", F.floor(F.col("ms") / 60).alias("k"), (F.col("ms") % 60 - 30).alias("ms"), "dbfs")
    out = lyrics.edited_frames(frames, cuts, readings, "track", "k")
    return out.select("track", "ms", F.round(F.when(F.col("dbfs") == float("-inf"), -999.0).otherwise(F.col("dbfs")), 6).alias("dbfs"))


@query("""with n as (select 'r' || r_regionkey::varchar as node, null as parent, r_regionkey as sib, r_name as label, r_name || '.xhtml' as src from region union all select 'n' || n_nationkey::varchar, 'r' || n_regionkey::varchar, n_nationkey, n_name, n_name || '.xhtml#x#' || n_nationkey::varchar from nation),
t as (select label, '' as parents, src, [sib] as path from n where parent is null union all select n.label, p.label, n.src, [p.sib, n.sib] from n join n p on n.parent = p.node)
select row_number() over (order by path) - 1 as toc_pos, label, parents, string_split(src, '#')[1] as src_path, case when contains(src, '#') then src[strpos(src, '#') + 1:] end as src_id from t""")
def toc_flatten(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    roots = r.select(F.lit(1).alias("book_id"), node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("sibling"), F.col("r_name").alias("label"), F.concat("r_name", F.lit(".xhtml")).alias("src"))
    leaves = n.select(F.lit(1).alias("book_id"), node("n", "n_nationkey").alias("node"), node("r", "n_regionkey").alias("parent"), F.col("n_nationkey").alias("sibling"), F.col("n_name").alias("label"), F.concat("n_name", F.lit(".xhtml#x#"), F.col("n_nationkey").cast("string")).alias("src"))
    out = book.flatten_contents(roots.union(leaves))
    return out.select(F.col("toc_pos").cast("long").alias("toc_pos"), "label", F.array_join("parent_labels", ": ").alias("parents"), "src_path", "src_id")


@query(r"""select page_id, string_split(url, '#')[1] as bare, case when contains(url, '#') then url[strpos(url, '#') + 1:] end as fragment, string_split(string_split(url, '#')[1], '/')[-1] as base, case when starts_with(url, '/') then url else 'OEBPS/' || url end as joined, replace(replace(url, '/', '-'), '\', '-') as entry from pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    url, bare = F.col("url"), X.target_path(F.col("url"))
    return table(spark, d, "pages").select("page_id", bare.alias("bare"), X.target_id(url).alias("fragment"), X.base_name(bare).alias("base"), X.under_folder(url, F.lit("OEBPS")).alias("joined"), X.clean_entry(url).alias("entry"))


@query("select user_id, event_id, last_value(case when event_type = 'signup' then props end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as path from events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", F.col("props")).alias("path"))
    return book.carried(rows, "path", ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "path")


@query("""with t(toc_pos, p, i) as (values (0, 'click', null), (1, 'view', '3'), (2, 'error', '5'), (3, 'nowhere', null)),
b as (select user_id, toc_pos, min(event_id) as rec from events, t where event_type = p and (i is null or (event_id % 7)::varchar = i) group by 1, 2),
s as (select e.user_id, e.event_id, sum(case when b.rec is not null then 1 else 0 end) over (partition by e.user_id order by e.event_id rows between unbounded preceding and current row) as n from events e left join b on b.user_id = e.user_id and b.rec = e.event_id)
select user_id as book_id, event_id as rec_pos, cast(n as bigint) as track_no from s""")
def segment_book(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    records = events.select(F.col("user_id").alias("book_id"), F.col("event_id").alias("rec_pos"), F.col("event_type").alias("path"), F.array((F.col("event_id") % 7).cast("string")).alias("ids"))
    rows = spark.createDataFrame([(0, "click", None), (1, "view", "3"), (2, "error", "5"), (3, "nowhere", None)], "toc_pos int, src_path string, src_id string")
    toc = records.select("book_id").distinct().crossJoin(F.broadcast(rows))
    return book.segment(records, book.match_contents(records, toc)).select("book_id", "rec_pos", F.col("track_no").cast("long").alias("track_no"))


@query("""with recursive r as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as o, role = 'user' as inl, text is not null and role <> 'system' as has, case when turn % 3 = 0 then [] else ['p.' || (turn - turn % 3)::varchar] end as parents, case when role = 'user' then 'i.' else 'p.' end || turn::varchar as tag from conversations),
x as (select *, list_append(parents, tag) as path, lead(list_append(parents, tag)) over (partition by conv_id order by o) as np from r),
f as (select conv_id, o, has, case when has then (inl and coalesce(len(parents) > 0 and np = parents, false)) else false end as c, has and inl as w, case when not has then -1 when inl then 1 else 0 end as par, case when not has then null when inl then 1 else 0 end as own, false as app from x where o = 1
 union all select x.conv_id, x.o, x.has,
  case when x.has then ((x.inl or f.c) and coalesce(len(case when f.w then x.path else x.parents end) > 0 and x.np = (case when f.w then x.path else x.parents end), false)) else f.c end,
  x.has and (x.inl or f.c), case when not x.has then f.par when f.c then f.par else f.par + 1 + case when (x.inl or f.c) and f.par = -1 then 1 else 0 end end, case when not x.has then null when f.c then f.par else f.par + 1 + case when x.inl and f.par = -1 then 1 else 0 end end, f.c
  from f join x on x.conv_id = f.conv_id and x.o = f.o + 1),
g as (select conv_id, own, count(*) as n from f where own is not null group by 1, 2)
select conv_id, cast(own as bigint) as par_no, cast(n as bigint) as n_items from g union all select conv_id, 0, 0 from g group by 1 having min(own) = 1""")
def merge_inline(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    tag = F.concat(F.when(F.col("role") == "user", "i.").otherwise("p."), turn.cast("string"))
    parents = F.when(turn % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("p."), (turn - turn % 3).cast("string"))))
    rows = table(spark, d, "conversations").select("conv_id", "turn", tag.alias("tag"), parents.alias("parents"), F.when(F.col("role") != "system", F.col("text")).alias("content"))
    out = ssml.merge_inline(rows, "conv_id", "turn")
    return out.select("conv_id", F.col("par_no").cast("long").alias("par_no"), F.size("content").cast("long").alias("n_items"))


TOKENS_SQL = r"t as (select page_id, unnest(x) as raw, unnest(range(0, len(x))) as tok_no from (select page_id, regexp_extract_all(regexp_replace(html, '<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'gs'), '<(/?[A-Za-z][A-Za-z0-9]*)[^>]*>([^<]*)') as x from pages)), k as (select page_id, tok_no, lower(regexp_extract(raw, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) as tag, regexp_extract(raw, '^<[^>]*>([^<]*)', 1) as content from t)"


@query(f"with {TOKENS_SQL} select page_id, cast(tok_no as bigint) as tok_no, tag, content from k")
def page_tokens(spark: SparkSession, d: str) -> DataFrame:
    return epub.page_tokens(table(spark, d, "pages")).withColumn("tok_no", F.col("tok_no").cast("long"))


@query(rf"with {TOKENS_SQL} select page_id, tag, cast(count(*) as bigint) as n, cast(sum(length(content)) as bigint) as chars from k where not regexp_full_match(content, '[\s\x{{00A0}}]*') group by 1, 2")
def body_text_filter(spark: SparkSession, d: str) -> DataFrame:
    return epub.with_text(epub.page_tokens(table(spark, d, "pages"))).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query("""with p as (select p_partkey as book_id, p_name, p_brand, p_type, p_size from part)
select book_id, tag, value from (
select book_id, unnest(['ALBUM', 'ALBUMSORT']) as tag, p_name as value from p union all
select book_id, unnest(['ARTIST', 'ALBUMARTIST']), case when p_size % 5 = 0 then p_type else p_brand end from p where p_size % 5 = 0 or p_size % 3 = 0 union all
select book_id, 'PUBLISHER', null from p union all
select book_id, 'DATE', case p_size % 4 when 2 then null when 3 then null else '2012-01-0' || (p_size % 4 + 2)::varchar end from p union all
select book_id, 'ASIN', 'B' || book_id::varchar from p where p_size % 7 = 0)""")
def tag_rules(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    size = F.col("p_size")
    date = F.when(size % 4 == 0, "2012-01-02").when(size % 4 == 1, "2012-01-03T03:04:05+00:00").when(size % 4 == 2, "2012").otherwise("2012-1-2T3:4:5Z")
    pairs = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k.replace("__", ":")) for k in kv]), F.array(*[v.cast("string") for v in kv.values()]))
    kinds = F.array(
        F.struct(F.lit("dc:title").alias("element"), F.lit(0).alias("seq"), pairs(text=F.col("p_name")).alias("attrs")),
        F.struct(F.lit("dc:creator").alias("element"), F.lit(1).alias("seq"), pairs(text=F.col("p_brand"), opf__role=F.when(size % 3 == 0, "aut").otherwise("edt")).alias("attrs")),
        F.struct(F.lit("dc:creator").alias("element"), F.lit(2).alias("seq"), pairs(text=F.col("p_type"), id=F.when(size % 5 == 0, "creator01").otherwise("x")).alias("attrs")),
        F.struct(F.lit("dc:date").alias("element"), F.lit(3).alias("seq"), pairs(text=date).alias("attrs")),
        F.struct(F.lit("dc:identifier").alias("element"), F.lit(4).alias("seq"), pairs(text=F.concat(F.lit("B"), F.col("p_partkey").cast("string")), opf__scheme=F.when(size % 7 == 0, "AMAZON").otherwise("ISBN")).alias("attrs")),
    )
    meta = p.select(F.col("p_partkey").alias("book_id"), F.explode(kinds).alias("x")).select("book_id", "x.*")
    return book.album_tags(meta, book.rules_frame(spark))


NESTED_RULES = {
    "SPEAKER,FIRST": [{"validate": {"conv.turns.who.role": "assistant"}, "data": {"pop.pop.body.text": "raw"}}],
    "OPENING": [{"data": {"conv.turns.body.text": "raw"}}, {"validate": {"conv.turns.who.role": "system"}, "data": {"pop.n": "raw"}}],
    "BOTH": [{"validate": {"conv.turns.who.role": "user", "conv.turns.who.n": 2}, "data": {"pop.role": "raw"}}],
    "TOP": [{"validate": {"conv.turns.who.role": "user"}, "data": {"pop.pop.pop.pop.pop.pop.kind": "raw"}}],
    "NONE": [{"data": {"conv.turns.body.missing": "raw"}}],
    "DAY": [{"data": {"conv.day": "read_datetime"}}],
}


@query("""with t as (select conv_id, turn, role, text, {'l': turn % 2, 't': turn} as o from conversations),
a as (select conv_id, arg_min(text, o) filter (where role = 'assistant') as speaker, arg_min(text, o) filter (where text is not null) as opening, arg_min(turn, o) filter (where role = 'system') as sys, bool_or(role = 'system') as has_sys,
  bool_or(role = 'user') as has_user, bool_or(role = 'assistant') as has_assistant, arg_min(role, o) filter (where turn = 2) as second, bool_or(turn = 2) as has_second from t group by 1)
select conv_id, tag, case when tag in ('SPEAKER', 'FIRST', 'OPENING') then md5(value) else value end as value from (
select conv_id, unnest(['SPEAKER', 'FIRST']) as tag, speaker as value from a where has_assistant union all
select conv_id, 'OPENING', case when has_sys then sys::varchar else opening end from a union all
select conv_id, 'BOTH', second from a where has_user and has_second union all
select conv_id, 'TOP', 'talk' from a where has_user union all
select conv_id, 'NONE', null from a union all
select conv_id, 'DAY', '2012-01-0' || (conv_id % 8 + 1)::varchar from a)""")
def nested_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules with paths of several levels, through lists of lists, over a JSON document for each conversation."""
    turn = F.struct(F.struct("role", F.col("turn").alias("n")).alias("who"), F.struct("text").alias("body"))
    own = lambda odd: F.transform(F.filter(F.col("turns"), lambda t: t["n"] % 2 == odd), lambda t: t["x"])
    lists = F.array(own(0), own(1))
    day = F.concat(F.lit("2012-1-"), (F.col("conv_id") % 8 + 1).cast("string"), F.lit("T01:02:03+00:00"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("n"), turn.alias("x")))).alias("turns"))
    doc = F.to_json(F.struct(F.struct(lists.alias("turns"), day.alias("day")).alias("conv"), F.lit("talk").alias("kind")))
    out = book.document_tags(talks.select(F.col("conv_id").alias("book_id"), doc.alias("doc")), book.path_rules(spark, NESTED_RULES))
    value = F.when(F.col("tag").isin("SPEAKER", "FIRST", "OPENING"), F.md5(F.col("value").cast("binary"))).otherwise(F.col("value"))
    return out.select(F.col("book_id").alias("conv_id"), "tag", value.alias("value"))


@query("select event_id, props->>'$.k' as k, null as missing from events")
def json_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", book.path_value(F.col("props"), ["k"]).alias("k"), book.path_value(F.col("props"), ["dc:x", 0]).alias("missing"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as plain, strftime(o_orderdate, '%Y-%m-%d') as timed, null::varchar as zulu, null::varchar as yearly, strftime(o_orderdate, '%Y') as year from orders")
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    day, year = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy")
    return table(spark, d, "orders").select(
        "o_orderkey", X.read_date(day).alias("plain"), X.read_date(F.concat(day, F.lit("T01:02:03+05:00"))).alias("timed"),
        X.read_date(F.concat(day, F.lit("T01:02:03Z"))).alias("zulu"), X.read_date(year).alias("yearly"), X.first_year(F.concat(F.lit("c. "), day)).alias("year"),
    )


@query("""with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, case when event_type = 'error' then 0 else 1 end as n from events),
r as (select user_id, i - row_number() over (partition by user_id order by i) as g, i from e where n > 0), k as (select user_id, g, min(i) as s, max(i) as e from r group by 1, 2),
b as (select *, row_number() over (partition by user_id order by e - s desc, s) as o from k)
select user_id, cast(case when 2 >= s and 2 < e then 3 else s end as bigint) as start, cast(e as bigint) as "end" from b where o = 1""")
def chapter_range(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, d, "events").select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("n"))
    out = legacy.past_contents(legacy.longest_run(rows, "user_id", "i", "n").withColumn("toc_index", F.lit(2)))
    return out.select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("select source, coalesce(min(case when contains(lower(lang), 'toc') or contains(lower(text), 'contents') then doc_id end), -1) as toc_index from documents group by 1")
def toc_detect(spark: SparkSession, d: str) -> DataFrame:
    return legacy.contents_entry(table(spark, d, "documents"), "source", "doc_id", "lang", "text")


@query("""with recursive t as (select doc_id, replace(text, chr(10), ' ') as t from documents), l as (select doc_id, t, string_split(t, '.') as s, floor(length(t) / ceil(length(t) / 2000.0) / 100) * 100 as size from t where length(t) > 2000),
f as (select doc_id, 0 as k, 0 as g, 0::bigint as n, 0 as new from l union all
 select l.doc_id, f.k + 1, case when f.n > l.size then f.g + 1 else f.g end, case when f.n > l.size then 0 else f.n end + length(l.s[f.k + 1]) + 1, 1 from f join l on l.doc_id = f.doc_id where f.k < len(l.s)),
p as (select f.doc_id, f.g, string_agg(l.s[f.k] || '.', '' order by f.k) as joined, string_agg(l.s[f.k] || '.', ' ' order by f.k) as spaced, max(f.n) > any_value(l.size) as closed from f join l on l.doc_id = f.doc_id where f.k > 0 group by 1, 2)
select doc_id, cast(g as bigint) as chunk_no, md5(case when closed then joined else spaced end) as chunk_md5 from p union all select doc_id, 0, md5(t) from t where length(t) <= 2000""")
def legacy_chunks(spark: SparkSession, d: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(legacy.chunk_sentences(text)).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query(r"""select page_id, md5(replace(replace(replace(replace(translate(html, '()/\:<>', '       '), '=', 'equals'), '&', ' and '), chr(13) || chr(10), ''), chr(10), '')) as clean_md5 from pages""")
def legacy_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.clean_spoken(F.col("html")).cast("binary")).alias("clean_md5"))


@query("select d.doc_id, 'doc ' || d.doc_id::varchar as name, q.quality::varchar as quality, q.toxic::varchar as toxic, 'x' as kind from documents d left join labels q using (doc_id)")
def legacy_refine(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    name = lambda c: F.concat(F.lit("doc "), F.col(c).cast("string"))
    elements = docs.select(F.lit(1).alias("book_id"), name("doc_id").alias("id"), "doc_id", F.map_from_arrays(F.array(F.lit("kind"), F.lit("toxic")), F.array(F.lit("x"), F.lit(None).cast("string"))).alias("attrs"))
    more = labels.select(F.lit(1).alias("book_id"), F.concat(F.lit("#"), name("doc_id")).alias("refines"), F.col("doc_id").alias("seq"), F.explode(F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(F.col("quality").cast("string"), F.col("toxic").cast("string")))).alias("property", "text"))
    out = legacy.refine(elements, more)
    return out.select("doc_id", F.col("id").alias("name"), *[F.try_element_at("attrs", F.lit(k)).alias(k) for k in ("quality", "toxic", "kind")])


@query("""with f as (select page_id % 10 as b, string_split(url, '#')[1] as file, page_id as seq from pages), r as (select distinct page_id % 10 as b, '../' || string_split(string_split(url, '#')[1], '/')[-1] || '#f' as ref from pages)
select r.b as book_id, r.ref, arg_min(f.file, f.seq) as file from r join f on f.b = r.b and contains(f.file, string_split(replace(r.ref, '../', ''), '#')[1]) group by 1, 2""")
def ref_resolve(spark: SparkSession, d: str) -> DataFrame:
    bare = X.target_path(F.col("url"))
    files = table(spark, d, "pages").select((F.col("page_id") % 10).alias("book_id"), bare.alias("path"), F.col("page_id").alias("load_seq"))
    refs = files.select("book_id", F.concat(F.lit("../"), X.base_name(F.col("path")), F.lit("#f")).alias("ref")).distinct()
    return legacy.resolve_references(refs, files)


@query("""with recursive p as (select user_id as b, event_id as n, event_type as path, row_number() over (partition by user_id order by event_id) as o from events), t(k, file, label) as (values (0, 'click', 'A'), (1, 'view', 'B'), (2, 'error', 'C')),
f as (select b, n, o, case when contains(path, 'click') then 1 else 0 end as x from p where o = 1 union all select p.b, p.n, p.o, case when t.file is not null and contains(p.path, t.file) then f.x + 1 else f.x end from f join p on p.b = f.b and p.o = f.o + 1 left join t on t.k = f.x)
select b as book_id, n as page_no, cast(x - 1 as bigint) as entry_no, label from f join t on t.k = f.x - 1 where x > 0""")
def page_entries(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "events").select(F.col("user_id").alias("book_id"), F.col("event_id").alias("page_no"), F.col("event_type").alias("path"))
    rows = spark.createDataFrame([(0, "A", "click#1"), (1, "A2", "click#2"), (2, "B", "view"), (3, "C", "error")], "toc_pos int, label string, src string")
    out = legacy.page_entries(pages, pages.select("book_id").distinct().crossJoin(F.broadcast(rows)))
    return out.select("book_id", "page_no", F.col("entry_no").cast("long").alias("entry_no"), "label")


@query("""select p_partkey, unnest(['TIT2', 'year', 'genre']) as field, unnest([p_name, (1990 + p_size)::varchar, case when p_size % 2 = 0 then 'drama' else '183' end]) as value, p_brand || '/[' || (1990 + p_size)::varchar || '] ' || replace(p_type, '/', '-') as folder from part""")
def id3_fields(spark: SparkSession, d: str) -> DataFrame:
    year = (F.col("p_size") + 1990).cast("string")
    tags = F.map_from_arrays(F.array(F.lit("TITLE"), F.lit("DATE"), F.lit("GENRE")), F.array(F.col("p_name"), F.concat(year, F.lit("-01-01")), F.when(F.col("p_size") % 2 == 0, "drama")))
    rows = table(spark, d, "part").select("p_partkey", tags.alias("tags"), legacy.output_folder(F.col("p_brand"), year, X.clean_entry(F.col("p_type"))).alias("folder"))
    return legacy.id3_fields(rows, {"TITLE": "TIT2", "DATE": "year"}, ["p_partkey", "folder"]).select("p_partkey", "field", "value", "folder")


@query("""with p as (select *, p_size % 5 = 0 as alone from part),
t as (select p_partkey, unnest(['ARTIST', 'ALBUMARTIST']) as tag, case when alone or p_size % 3 = 0 then p_brand when p_size % 3 = 1 or p_size % 4 = 0 then p_type else p_brand end as value from p
 union all select p_partkey, 'COMPOSER', p_type from p where not alone and p_size % 3 <> 1 union all select p_partkey, 'COPYRIGHT', '(c) 1970 ' || p_brand from p
 union all select p_partkey, 'YEAR', case when p_size % 6 = 0 then '1987' when p_size % 7 = 0 then '1970' else (2000 + p_size)::varchar end from p
 union all select p_partkey, 'ALBUMSORT', p_name from p union all select p_partkey, 'ALBUM', case when p_size % 2 = 0 then upper(p_name) else p_name end from p
 union all select p_partkey, 'GENRE', case when p_size % 2 = 1 then 'drama' else 'poetry' end from p
 union all select p_partkey, 'TITLE', case when p_size % 2 = 0 then replace(p_type, '/', '-') else 'Entry Number ' || p_size::varchar end from p)
select p_partkey, tag, value, case when p_size % 2 = 1 then 'drama, poetry' else 'poetry' end as genres from t join p using (p_partkey)""")
def legacy_tags(spark: SparkSession, d: str) -> DataFrame:
    p, size, no = table(spark, d, "part"), F.col("p_size"), iter(range(10))
    pairs = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("string") for v in kv.values()]))
    element = lambda name, **kv: F.struct(F.lit(name).alias("element"), F.lit(next(no)).alias("seq"), pairs(**kv).alias("attrs"))
    swapped = size % 4 == 0
    kinds = F.array(
        element("title", text=F.col("p_name"), file_as=F.when(size % 2 == 0, F.upper("p_name"))),
        element("creator", text=F.col("p_brand"), role=F.when(size % 3 == 0, "aut").otherwise("edt"), display_seq=F.when(swapped & (size % 5 != 0), 2).otherwise(1)),
        F.when(size % 5 != 0, element("creator", text=F.col("p_type"), role=F.when(size % 3 == 1, "Aut").otherwise("trl"), display_seq=F.when(swapped, 1).otherwise(2))),
        F.when(size % 6 == 0, element("date", text="1987-05", event=None)).otherwise(element("date", text="c. 1999", event="creation")),
        F.when(size % 6 != 0, element("date", text=size + 2000, event=F.when(size % 7 == 0, "modification").otherwise("original-publication"))),
        element("rights", text=F.concat(F.lit("(c) 1970 "), F.col("p_brand"))),
        F.when(size % 2 == 1, element("subject", text="drama")),
        element("subject", text="poetry"),
    )
    meta = p.select(F.col("p_partkey").alias("book_id"), F.explode(kinds).alias("x")).where("x is not null").select("book_id", "x.*")
    entries = p.select(F.col("p_partkey").alias("book_id"), F.col("p_size").alias("entry_no"), F.when(size % 2 == 0, F.col("p_type")).alias("text"))
    out = legacy.entry_tags(entries, legacy.album_tags(meta))
    return out.select(F.col("book_id").alias("p_partkey"), F.explode("tags").alias("tag", "value"), F.array_join("genres", ", ").alias("genres"))


# The relational surface that the engine has from Spark itself.


@query("""select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(distinct o_orderkey) as n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1""")
def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


@query("select lang, source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by cube (lang, source)")
def document_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
