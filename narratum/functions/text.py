"""Column functions on text, times and paths. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The replacements of the speech markup, in their order (the ampersand comes first).
MARKUP = (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;"), ("’", "&apos;"), ("—", " "))
#: What a too long text is split at, and what stays on the left of each split.
SPLITS = ((". ", "."), ("! ", "!"), ("? ", "?"), ('." ', '."'), ('!" ', '!"'), ('?" ', '?"'), (", ", ","), (" ", ""), ("-", ""))


@cache
def _accents() -> tuple[str, str, dict[str, str]]:
    """Precomposed characters and their bases, from the canonical decompositions; apart those with several bases, Hangul left out."""
    pairs, several = [], {}
    for code in range(0xC0, 0x110000):
        if not 0xD800 <= code < 0xE000 and not 0xAC00 <= code < 0xD7A4:
            base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
            if len(base) == 1 and base != chr(code):
                pairs.append((chr(code), base))
            elif len(base) > 1:
                several[chr(code)] = base
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), several


@cache
def _hangul() -> tuple[str, list[str], str]:
    """All Hangul syllables, each one's first and second letter, and the third, for which a space stands if there is none."""
    syllables = [chr(code) for code in range(0xAC00, 0xD7A4)]
    parts = [unicodedata.normalize("NFD", c) for c in syllables]
    return "".join(syllables), ["".join(p[k] for p in parts) for k in (0, 1)], "".join(p[2] if len(p) > 2 else " " for p in parts)


def strip_accents(text: Column) -> Column:
    """Letters without their accents: decomposable characters become their bases, combining marks go.

    Texts without any such character pass by the translation, those without Hangul by its letters.
    """
    one, base, several = _accents()
    plain = F.translate(text, one, base)
    odd = plain
    for c, bases in several.items():
        odd = F.replace(odd, F.lit(c), F.lit(bases))
    plain = F.when(plain.rlike(f"[{''.join(several)}]"), odd).otherwise(plain)
    whole, letters, third = _hangul()
    syllable = lambda c: F.concat(F.translate(c, whole, letters[0]), F.translate(c, whole, letters[1]), F.rtrim(F.translate(c, whole, third)))
    spelt = F.array_join(F.transform(F.split(plain, "", -1), lambda c: F.when(c.between("\uac00", "\ud7a3"), syllable(c)).otherwise(c)), "")
    plain = F.when(plain.rlike("[\uac00-\ud7a3]"), spelt).otherwise(plain)
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(plain, r"\p{Mn}", "")).otherwise(text)


def escape_markup(text: Column) -> Column:
    for old, new in MARKUP:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def speech_text(text: Column) -> Column:
    """What is spoken: no accents, markup escaped, nothing outside ASCII."""
    return ascii_only(escape_markup(strip_accents(text)))


def split_to_limit(text: Column, limit: int) -> Column:
    """array<string>: texts of `limit` characters or more are split at ever finer places until all pieces fit.

    Each stage splits every piece that is too long at all its places; stages stop once all pieces fit. Pieces that no
    stage can shorten stay too long; see `fits`.
    """

    stages = F.array(*[F.struct(F.lit(rf"\Q{at}\E").alias("at"), F.lit(left).alias("left")) for at, left in SPLITS])

    def split(piece: Column, stage: Column) -> Column:
        parts = F.array(F.split(piece, stage["at"], -1))  # an array of one, whose lambda binds the parts
        joined = F.transform(parts, lambda ps: F.transform(ps, lambda p, k: F.when(k < F.size(ps) - 1, F.concat(p, stage["left"])).otherwise(p)))
        return F.when(F.length(piece) >= limit, F.flatten(joined)).otherwise(F.array(piece))

    # A fold over the stages names the pieces once; nested expressions would repeat them threefold at every stage.
    cut = F.aggregate(stages, F.array(text), lambda ps, stage: F.when(fits(ps, limit), ps).otherwise(F.flatten(F.transform(ps, lambda p: split(p, stage)))))
    return F.when(F.length(text) < limit, F.array(text)).otherwise(cut)


def fits(pieces: Column, limit: int) -> Column:
    return F.forall(pieces, lambda p: F.length(p) < limit)


def clean_spoken(text: Column) -> Column:
    """The older cleaning: brackets, slashes, colons and angles to blanks, signs to words, no line ends."""
    text = F.translate(text, "()/\\:<>", "       ")
    text = F.replace(F.replace(text, F.lit("="), F.lit("equals")), F.lit("&"), F.lit(" and "))
    for quote in ("\xe2\x80\x9c", "\xe2\x80\x9d"):
        text = F.replace(text, F.lit(quote), F.lit('"'))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit(""))


def clean_entry(text: Column) -> Column:
    """Slashes to hyphens, for use in file names."""
    return F.translate(text, "/\\", "--")


def first_year(text: Column) -> Column:
    """The first run like a year of 1000 to 2999, else null."""
    return F.nullif(F.regexp_extract(text, r"([1-2]\d{3})", 1), F.lit(""))


def read_date(text: Column) -> Column:
    """yyyy-MM-dd of a date, or of a time cut before its first plus; null for other forms."""
    timed = F.try_to_timestamp(F.substring_index(text, "+", 1), F.lit("yyyy-M-d'T'H:m:s"))
    plain = F.try_to_timestamp(text, F.lit("yyyy-M-d"))
    return F.date_format(F.when(F.contains(text, F.lit("T")), timed).otherwise(plain), "yyyy-MM-dd")


def parse_time(stamp: Column) -> Column:
    """Milliseconds of [m:s.f]; f counts hundredths by its value. Null if it isn't a time."""
    pattern = r"^\[?(\d+):(\d+)\.(\d+)\]?"
    m, s, f = (F.regexp_extract(stamp, pattern, k).try_cast("long") for k in (1, 2, 3))
    return F.when(stamp.rlike(pattern), ((m * 60 + (s + f / F.lit(100.0))) * 1000).cast("long"))


def is_time(stamp: Column) -> Column:
    return stamp.rlike(r"^\[?\d{1,2}:\d{2}\.\d{2}\]?$")


def show_time(ms: Column, padded: bool = True) -> Column:
    """[mm:ss.xx], or the unpadded form of corrected lyrics. Minutes have no bound."""
    parts = [F.floor(ms / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000), F.floor(F.pmod(ms, F.lit(1000)) / 10)]
    form = "[%02d:%02d.%02d]" if padded else "[%d:%d.%d]"
    return F.format_string(form, *[p.cast("long") for p in parts])


def replace_word(text: Column, word: str, by: str) -> Column:
    """Every occurrence of the literal word, in any case, replaced by the literal text."""
    literal = by.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(text, rf"(?iu)\Q{word}\E", literal)


def template(by: str) -> str:
    """A replacement template as Java's regular expressions take it: \\\\ and letter escapes are characters, \\g<0> is the match.

    There are no groups to refer to, so any other reference is an error, like an unknown letter after a backslash.
    """
    letters, out, at = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\"}, [], 0
    quoted = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    while at < len(by):
        c = by[at : at + 2]
        octal = re.match(r"\\(0[0-7]{0,2}|[0-3][0-7]{2})", by[at:])
        if by[at] != "\\":
            out.append(quoted(by[at]))
            at += 1
        elif by[at:].startswith("\\g<0>"):
            out.append("$0")
            at += 5
        elif octal:
            out.append(quoted(chr(int(octal[1], 8))))
            at += len(octal[0])
        elif c[1:] in letters:
            out.append(quoted(letters[c[1:]]))
            at += 2
        elif not c[1:] or c[1:].isascii() and c[1:].isalnum():
            raise ValueError(f"bad escape {c} in a replacement")
        else:
            out.append(quoted(c))
            at += 2
    return "".join(out)


def replace_by_template(text: Column, word: str, by: str) -> Column:
    """Every occurrence of the literal word, in any case, replaced by a template (see `template`)."""
    return F.regexp_replace(text, rf"(?iu)\Q{word}\E", template(by))


def spoken_words(markup: Column) -> Column:
    """Words of speech markup that are letters only, in lower case; words that touch other characters are lost."""
    spaced = F.replace(F.replace(markup, F.lit("<"), F.lit(" <")), F.lit(">"), F.lit("> "))
    return F.transform(F.filter(F.split(spaced, r"(?U)\s+", -1), lambda w: w.rlike(r"^\p{L}+$")), F.lower)


def under_folder(path: Column, folder: Column) -> Column:
    """A path joined to its folder; an absolute path stays."""
    return F.when(path.startswith("/") | (folder == ""), path).when(folder.endswith("/"), F.concat(folder, path)).otherwise(F.concat_ws("/", folder, path))


def target_path(src: Column) -> Column:
    return F.substring_index(src, "#", 1)


def target_id(src: Column) -> Column:
    """What follows the first #, null without one."""
    return F.when(F.contains(src, F.lit("#")), F.substr(src, F.instr(src, "#") + 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"(?<=[^/])/+$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1)
