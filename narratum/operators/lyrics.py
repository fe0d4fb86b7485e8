"""Timed lines: speech marks, lyrics, corrections and splices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored
from ..functions.text import parse_time, replace_by_template, replace_word, show_time
from .sequence import SPAN, as_of

LOUD = -60.0


def speech_marks(responses: DataFrame, track: str = "track", order: str = "query_no") -> DataFrame:
    """Responses (track, order, body: JSON lines, duration_ms) to marks (track, seq_query, seq_line, time_ms, type, value).

    After each response's marks comes one of type preceding_realtime with its audio's duration.
    """
    lines = responses.select(track, F.col(order).alias("seq_query"), F.posexplode(F.split(F.regexp_replace("body", r"\n$", ""), "\n", -1)).alias("seq_line", "line")).where("line <> ''")
    mark = F.from_json("line", "time bigint, type string, value string")
    marks = lines.select(track, "seq_query", "seq_line", mark.alias("m")).select(track, "seq_query", "seq_line", F.col("m.time").alias("time_ms"), F.col("m.type").alias("type"), F.col("m.value").alias("value"))
    ends = responses.select(track, F.col(order).alias("seq_query"), F.lit(2**31 - 1).alias("seq_line"), F.col("duration_ms").cast("long").alias("time_ms"), F.lit("preceding_realtime").alias("type"), F.lit(None).cast("string").alias("value"))
    return marks.unionByName(ends)


def _before(track: str, order: list[str]) -> Window:
    return Window.partitionBy(track).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def offsets(marks: DataFrame, track: str, order: list[str], is_offset: Column | None = None) -> DataFrame:
    """Adds at_ms: a mark's time after all durations before it. The older rule passes its own is_offset (closing marks)."""
    moved = F.when(F.col("type") == "preceding_realtime" if is_offset is None else is_offset, F.col("time_ms"))
    return marks.withColumn("at_ms", F.col("time_ms") + F.coalesce(F.sum(moved).over(_before(track, order)), F.lit(0)))


def lyric_lines(marks: DataFrame, track: str, order: list[str]) -> DataFrame:
    """Sentences with their offset time and the line [mm:ss.xx]text."""
    timed = offsets(marks, track, order).where("type = 'sentence'")
    return timed.withColumn("line", F.concat(show_time(F.col("at_ms")), F.col("value")))


def paragraphs(marks: DataFrame, track: str, order: list[str]) -> DataFrame:
    """(track, par_no, text): the sentences between paragraph marks, joined by blanks. Empty paragraphs are left out."""
    ends = F.coalesce(F.sum(F.when(F.col("type") == "ssml", 1).otherwise(0)).over(_before(track, order)), F.lit(0))
    rows = marks.withColumn("block", ends).where("type = 'sentence'")
    texts = F.array_sort(F.collect_list(F.struct(*order, "value")))
    made = rows.groupBy(track, "block").agg(F.array_join(F.transform(texts, lambda x: x["value"]), " ").alias("text"))
    return made.select(track, F.row_number().over(Window.partitionBy(track).orderBy("block")).alias("par_no"), "text")


def parse_lyrics(lines: DataFrame, track: str, order: str, line: str = "line") -> DataFrame:
    """(track, time_ms, text) of the lines with a time; others (headers) go; the last of equal times counts."""
    rows = lines.where(F.col(line).rlike(r"^\[\d+:\d+\.\d+\]"))
    text = F.regexp_replace(F.regexp_extract(line, r"^\[\d+:\d+\.\d+\](.*)", 1), r"^(?U)\s+|(?U)\s+$", "")
    return rows.select(track, order, parse_time(F.col(line)).alias("time_ms"), text.alias("text")).groupBy(track, "time_ms").agg(F.max_by("text", order).alias("text"))


def with_end(lines: DataFrame, track: str, time: str = "time_ms") -> DataFrame:
    """Adds end_time: the next line's time, null for the last. Take it over all lines, before any filter."""
    return lines.withColumn("end_time", F.lead(time).over(Window.partitionBy(track).orderBy(time)))


def with_word(lines: DataFrame, word: str, text: str = "text") -> DataFrame:
    return lines.where(F.contains(F.lower(text), F.lit(word.lower())))


def line_at(lines: DataFrame, time_ms: int) -> DataFrame:
    """The line at a time; none there is an error once the row is read."""
    found = lines.where(F.col("time_ms") == time_ms)
    guard = found.agg(F.when(F.count("*") == 0, F.raise_error(F.lit(f"no line at {time_ms} ms")).cast("int")).otherwise(0).alias("missing"))
    return found.join(F.broadcast(guard), F.col("missing") == 0).drop("missing")


def corrected(lines: DataFrame, track: str, word: str, by: str, template: bool = False) -> DataFrame:
    """Lines that hold the word, with `new`, the request `ssml` and end_time. With template, `by` may have escapes and the match as \\g<0>."""
    out = with_word(with_end(lines, track), word)
    out = out.withColumn("new", (replace_by_template if template else replace_word)(F.col("text"), word, by))
    return out.withColumn("ssml", F.concat(F.lit("<speak>"), F.col("new"), F.lit("</speak>")))


def shifted(lines: DataFrame, edits: DataFrame, track: str) -> DataFrame:
    """All lines (track, time_ms, text) after the edits (track, time_ms, new, new_start, edit_end): (track, time_ms, at_ms, line).

    An edited line starts at new_start. Each other line moves by what the last edited line before it with both ends known
    runs over its original next line.
    """
    rows = with_end(lines, track).join(edits, [track, "time_ms"], "left")
    shift = F.when(F.col("new").isNotNull(), F.col("edit_end") - F.col("end_time"))
    before = F.coalesce(F.last(shift, ignorenulls=True).over(_before(track, ["time_ms"])), F.lit(0))
    at = F.when(F.col("new").isNotNull(), F.col("new_start")).otherwise(F.col("time_ms") + before)
    rows = rows.withColumn("at_ms", at)
    return rows.select(track, "time_ms", "at_ms", F.concat(show_time(F.col("at_ms"), padded=False), F.coalesce("new", "text")).alias("line"))


def splices(cuts: DataFrame, track: str, order: str) -> DataFrame:
    """Cuts (track, order, start_splice, end_splice, half, new_length) applied in order: adds new_start and new_end.

    Each start moves by what the cuts before it have added; a cut without an end runs to the end of the audio and adds nothing.
    """
    added = F.when(F.col("end_splice").isNotNull(), F.col("new_length") - (F.col("end_splice") - F.col("start_splice")))
    delta = F.coalesce(F.sum(added).over(_before(track, [order])), F.lit(0))
    out = cuts.withColumn("new_start", F.col("start_splice") + delta)
    return out.withColumn("new_end", F.col("new_start") + F.col("new_length") + F.when(F.col("end_splice").isNotNull(), F.coalesce("half", F.lit(0))).otherwise(0))


def silence_runs(frames: DataFrame, track: str, loud: float = LOUD, span: int = SPAN) -> DataFrame:
    """Frames (track, ms, dbfs) to runs (track, block, start, end, silent): consecutive milliseconds, all silent or all sounding.

    Islands are found in blocks of `span` milliseconds, so a longer run has a row for each block. Frames without a level end
    a run and are neither.
    """
    rows = frames.select(track, F.floor(F.col("ms") / span).cast("long").alias("block"), F.col("ms").cast("long").alias("ms"), (F.col("dbfs") < loud).alias("silent")).where("silent is not null and ms is not null")
    w = Window.partitionBy(track, "block").orderBy("ms")
    fresh = (F.lag("ms").over(w) == F.col("ms") - 1) & (F.lag("silent").over(w) == F.col("silent"))
    rows = rows.withColumn("fresh", F.when(fresh, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(track, "block", "island").agg(F.min("ms").alias("start"), F.max("ms").alias("end"), F.first("silent").alias("silent")).drop("island")


def sounding(runs: DataFrame, track: str) -> DataFrame:
    """The sounding runs (track, start, end, quiet_before, quiet_after): the last silent ms before and the first one after them."""
    up, down = (Window.partitionBy(track, "block").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("start", F.desc("start")))
    quiet = lambda c: F.when(F.col("silent"), F.col(c))
    near = runs.withColumns({"before": F.last(quiet("end"), True).over(up), "after": F.last(quiet("start"), True).over(down)}).where("not silent")
    blocks = runs.groupBy(track, "block").agg(F.min(quiet("start")).alias("first"), F.max(quiet("end")).alias("last"))
    up, down = (Window.partitionBy(track).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("block", F.desc("block")))
    far = blocks.select(F.col(track).alias("far_track"), F.col("block").alias("far_block"), F.last("last", True).over(up).alias("far_before"), F.last("first", True).over(down).alias("far_after"))
    near = near.join(far, F.col(track).eqNullSafe(F.col("far_track")) & (F.col("block") == F.col("far_block")))
    return near.select(track, "start", "end", F.coalesce("before", "far_before").alias("quiet_before"), F.coalesce("after", "far_after").alias("quiet_after"))


def splice_points(frames: DataFrame, targets: DataFrame, track: str, loud: float = LOUD, span: int = SPAN) -> DataFrame:
    """Frames (track, ms, dbfs) and targets (track, line, t, end_t) to start_splice, start_half, end_splice and end_half.

    Around a time the silence is widened frame by frame: to the next sounding frame after a start (else the audio's end),
    then back over silence; for an end the other way round. The splice is the middle. Frames become runs, and a target needs
    two as-of lookups on the sounding ones, which know the silence on both sides: the first that ends at or after a start, and
    the last that begins before an end. Work is linear in the frames, in blocks of `span` milliseconds.
    """
    runs = silence_runs(frames, track, loud, span)
    quiet = F.when(F.col("silent"), F.col("start"))
    silence = runs.groupBy(track).agg(F.min(quiet).alias("first_quiet"), F.max(F.when(F.col("silent"), F.col("end"))).alias("last_quiet"))
    length = frames.groupBy(track).agg((F.max("ms") + 1).alias("length"))
    heard = sounding(runs, track)
    out = targets.select(track, "line", F.col("t").cast("long").alias("t"), F.col("end_t").cast("long").alias("end_t")).join(length, track).join(silence, track, "left")
    out = as_of(out, "t", heard.select(track, F.col("end").alias("place"), F.struct("start", "quiet_before").alias("value")), [track], "next", True, span)
    out = as_of(out, "end_t", heard.select(track, F.col("start").alias("place"), F.struct("end", "quiet_after").alias("value")), [track], "past", False, span)
    there, heard_before = F.col("next").isNotNull(), F.col("past").isNotNull()
    after = F.when(F.col("t") >= F.col("length"), F.col("t")).when(there, F.greatest("t", "next.start")).otherwise(F.col("length"))
    before = F.coalesce(F.when(there, F.col("next.quiet_before")).otherwise(F.col("last_quiet")) + 1, F.lit(0))
    end_after = F.when(heard_before, F.least(F.col("past.end"), F.col("end_t") - 1) + 1).otherwise(0)
    end_before = F.coalesce(F.when(heard_before, F.col("past.quiet_after")).otherwise(F.col("first_quiet")), "length")
    out = out.withColumns({"after": after, "before": before, "end_after": end_after, "end_before": end_before})
    known = F.col("end_t").isNotNull()
    out = out.withColumns({
        "start_half": F.expr("(after - before) div 2"), "start_splice": F.expr("(after + before) div 2"),
        "end_half": F.when(known, F.expr("(end_before - end_after) div 2")), "end_splice": F.when(known, F.expr("(end_before + end_after) div 2")),
    })
    return out.select(track, "line", "t", "end_t", "start_splice", "start_half", "end_splice", "end_half")


def trimmed_readings(frames: DataFrame, halves: DataFrame, track: str | list[str] = "track", loud: float = LOUD) -> DataFrame:
    """Readings (track, ms, dbfs) and halves (track, start_half, end_half) to what is done to the audio: cut_start and new_length.

    The silence before the first sound is cut to start_half (cut_start frames go; if negative, so many silent ones are put
    before); one after the last sound is kept and end_half more, cut or padded. A null end_half leaves the end as it is.
    """
    key = [track] if isinstance(track, str) else track
    sounding = F.when(F.col("dbfs") >= loud, F.col("ms"))
    seen = frames.groupBy(*key).agg(F.min(sounding).alias("first"), F.max(sounding).alias("last"), (F.max("ms") + 1).alias("length"))
    out = halves.join(seen, key).withColumn("cut_start", F.coalesce("first", "length") - 1 - F.col("start_half"))
    end = F.coalesce(F.col("last") - F.col("cut_start") + 1, F.lit(0)) + 1 + F.col("end_half")
    return out.select(*key, "cut_start", F.coalesce(end, F.col("length") - F.col("cut_start")).alias("new_length"))


def pieces(cuts: DataFrame, lengths: DataFrame, track: str, order: str) -> DataFrame:
    """The edited audio as pieces (track, src, lo, hi, new_start), see fold_pieces.

    A cut leaves what stands behind all places of the cuts so far as it was, only moved. So where no later cut reaches back before
    those places, the audio is parted, and each part has its own cuts and a running sum as its begin. A part of one cut, as of
    corrected lines, gives its pieces at once, the track's last one beyond the audio's end too; only parts of several cuts, that
    overlap or run backward, are folded. Behind an open cut or one beyond the audio there is no parting, nor in a track with a place
    before its begin.
    """
    rows = cuts.select(track, F.col(order).cast("long").alias("o"), *[F.col(c).cast("long").alias(c) for c in ("start_splice", "end_splice", "new_length")]).join(lengths, track)
    start, end, length, delta = (F.col(c) for c in ("start_splice", "end_splice", "length", "delta"))
    whole = Window.partitionBy(track)
    w, before = whole.orderBy("o"), _before(track, ["o"])
    wild = end.isNull() | (start > length) | (end > length)
    rows = rows.withColumns({
        "delta": F.coalesce(F.sum(F.col("new_length") - (end - start)).over(before), F.lit(0).cast("long")),
        "behind": F.coalesce(F.max(F.greatest(start, end)).over(before), F.lit(0).cast("long")),
        "lost": F.coalesce(F.bool_or(wild).over(before), F.lit(False)), "first": F.lag("o").over(w).isNull(),
    })
    place = F.least(start, end) + delta
    rows = rows.withColumns({"reach": F.min(place).over(whole.orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, 0)), "least": F.min(place).over(whole)})
    parted = F.col("first") | (~F.col("lost") & (F.col("least") >= 0) & (F.col("reach") >= F.col("behind") + delta))
    rows = rows.withColumn("part", F.sum(F.when(parted, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(track, "part")
    rows = rows.withColumns({
        "many": F.count("*").over(own), "from": F.min("behind").over(own), "base": F.first("delta").over(own.orderBy("o")) + F.min("behind").over(own),
        "till": F.when(F.col("part") == F.max("part").over(whole), length).otherwise(F.max(F.greatest("behind", start, end)).over(own)),
    })
    rows = stored(rows.select(track, "o", "start_splice", "end_splice", "new_length", "length", "delta", "least", "part", "many", "from", "base", "till"), "cuts")
    alone = (F.col("many") == 1) & (F.col("least") >= 0)
    one = lambda src, lo, hi, at: F.struct(src.cast("long").alias("src"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), at.cast("long").alias("new_start"))
    none, at = F.lit(None), F.least(start, length)
    made = [one(none, F.col("from"), at, F.col("base")), one(F.col("o"), F.lit(0), F.col("new_length"), at + delta)]
    tail = one(none, F.least(end, length), F.col("till"), at + delta + F.col("new_length"))
    plain = rows.where(alone).select(track, F.explode(F.when(end.isNotNull(), F.array(*made, tail)).otherwise(F.array(*made))).alias("x")).select(track, "x.*")
    uncut = lengths.join(cuts.select(track).distinct(), track, "left_anti").select(track, one(none, F.lit(0), length, F.lit(0)).alias("x")).select(track, "x.*")
    part = F.struct(F.col(track).alias("track"), "part", "from", "base")
    shared = rows.where(~F.coalesce(alone, F.lit(False))).select(part.alias("part"), "o", *[(c - F.col("from")).alias(n) for c, n in ((start, "start_splice"), (end, "end_splice"))], "new_length", (F.col("till") - F.col("from")).alias("length"))
    folded = fold_pieces(shared.drop("length"), shared.select("part", "length").distinct(), "part", "o")
    moved = F.when(F.col("src").isNull(), F.col("part.from")).otherwise(0)
    folded = folded.select(F.col("part.track").alias(track), "src", (F.col("lo") + moved).alias("lo"), (F.col("hi") + moved).alias("hi"), (F.col("new_start") + F.col("part.base")).alias("new_start"))
    return plain.unionByName(uncut).unionByName(folded)


def fold_pieces(cuts: DataFrame, lengths: DataFrame, track: str, order: str) -> DataFrame:
    """The edited audio as pieces (track, src, lo, hi, new_start): frames lo to hi of a source stand from new_start on.

    cuts (track, order, start_splice, end_splice, new_length) apply in order, each to what the ones before left, as places of the
    original moved by what those have added: the frames up to the start, the cut's reading, the frames from the end on. Cuts may
    overlap, run backward or reach beyond the audio; places before its begin count from its end. src is the cut's order, null for
    the original (lengths: track, length). One array of cuts for a track, and a pass over the pieces for each; the frames aren't touched.
    """
    kind = "array<struct<src: bigint, lo: bigint, hi: bigint, at: bigint>>"
    one = lambda src, lo, hi, at: F.struct(src.cast("long").alias("src"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), at.cast("long").alias("at"))
    size = lambda p: p["hi"] - p["lo"]

    def part(ps: Column, start: Column, end: Column, to: Column) -> Column:
        there = F.filter(ps, lambda p: (size(p) > 0) & (p["at"] < end) & (p["at"] + size(p) > start) & (end > start))
        return F.transform(there, lambda p: one(p["src"], p["lo"] + F.greatest(start - p["at"], F.lit(0)), p["lo"] + F.least(end - p["at"], size(p)), F.greatest(p["at"], start) - start + to))

    def cut(a: Column, c: Column) -> Column:
        total, nothing = a["total"], F.lit(0).cast("long")
        place = lambda x: F.when(x < 0, F.greatest(total + x, nothing)).otherwise(F.least(x, total))
        start, end = place(c["start_splice"] + a["delta"]), place(c["end_splice"] + a["delta"])
        open_end = c["end_splice"].isNull()
        tail = F.when(open_end, F.array().cast(kind)).otherwise(part(a["ps"], end, total, start + c["new_length"]))
        ps = F.concat(part(a["ps"], nothing, start, nothing), F.array(one(c["o"], nothing, c["new_length"], start)), tail)
        added = c["new_length"] - (c["end_splice"] - c["start_splice"])
        rest = F.when(open_end, nothing).otherwise(total - end)
        return F.struct(ps.cast(kind).alias("ps"), (a["delta"] + F.coalesce(added, nothing)).cast("long").alias("delta"), (start + c["new_length"] + rest).cast("long").alias("total"))

    own = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), *[F.col(c).cast("long").alias(c) for c in ("start_splice", "end_splice", "new_length")])))
    rows = lengths.join(cuts.groupBy(track).agg(own.alias("cuts")), track, "left")
    uncut = F.array(one(F.lit(None), F.lit(0), F.col("length"), F.lit(0))).cast(kind)
    start = F.struct(uncut.alias("ps"), F.lit(0).cast("long").alias("delta"), F.col("length").cast("long").alias("total"))
    ps = F.when(F.col("cuts").isNull(), uncut).otherwise(F.aggregate("cuts", start, cut)["ps"])
    return rows.select(track, F.explode(ps).alias("x")).select(track, "x.src", "x.lo", "x.hi", F.col("x.at").alias("new_start"))


def edited_frames(frames: DataFrame, cuts: DataFrame, readings: DataFrame, track: str, order: str, loud: float = LOUD, span: int = 1024) -> DataFrame:
    """Frames (track, ms, dbfs) after the cuts (track, order, start_splice, end_splice, start_half, end_half) have put in the readings
    (track, order, ms, dbfs): the new table (track, ms, dbfs), silence (minus infinity) where a reading is padded.

    The frames meet the pieces by blocks of `span` milliseconds. A cut without a reading puts in nothing.
    """
    trims = trimmed_readings(readings, cuts.select(track, order, "start_half", "end_half"), [track, order], loud)
    lengths = frames.groupBy(track).agg((F.max("ms") + 1).alias("length"))
    full = cuts.join(trims, [track, order], "left").withColumn("new_length", F.greatest(F.coalesce("new_length", F.lit(0)), F.lit(0)))
    made = pieces(full, lengths, track, order).where("hi > lo")
    blocks = F.sequence(F.floor(F.col("lo") / span), F.floor((F.col("hi") - 1) / span))
    made = made.select(F.col(track).alias("to_track"), F.col("src").alias("to_src"), "lo", "hi", "new_start", F.explode(blocks).alias("to_block"))
    put = readings.join(trims, [track, order]).select(track, F.col(order).cast("long").alias("src"), (F.col("ms") - F.col("cut_start")).cast("long").alias("ms"), "dbfs")
    seen = readings.groupBy(track, order).agg((F.max("ms") + 1).alias("length")).join(trims, [track, order])
    behind = F.col("length") - F.col("cut_start")
    runs = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    gaps = F.concat(runs(F.lit(0).cast("long"), -F.col("cut_start").cast("long")), runs(F.greatest(behind, F.lit(0)).cast("long"), F.col("new_length").cast("long")))
    silent = seen.select(track, F.col(order).cast("long").alias("src"), F.explode(gaps).alias("ms"), F.lit(float("-inf")).alias("dbfs"))
    source = frames.select(track, F.lit(None).cast("long").alias("src"), F.col("ms").cast("long").alias("ms"), "dbfs").unionByName(put).unionByName(silent)
    source = source.withColumn("block", F.floor(F.col("ms") / span))
    same = (F.col(track) == F.col("to_track")) & F.col("src").eqNullSafe(F.col("to_src")) & (F.col("block") == F.col("to_block"))
    out = source.join(made, same & (F.col("ms") >= F.col("lo")) & (F.col("ms") < F.col("hi")))
    return out.select(track, (F.col("new_start") + F.col("ms") - F.col("lo")).alias("ms"), "dbfs")
