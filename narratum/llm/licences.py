"""Licence scan by a positional rare-token index, in DataFrame operations only.

The templates' words are counted over all documents. Each template is posted under its rarest word there (its highest
IDF), with that word's place in the template. A document's places of such words are looked up in the index: each gives
the place where the template would begin, the other words' postings are intersected at their relative places, and the
template's mandatory key phrase is verified word by word. Every place of a key phrase contains its rarest word, so
none is missed. A licence's name is a label by itself; where a template is a licence's text (BESIDE words or more beside the key
phrase), words with the share EVIDENCE of their IDF weight must stand at their relative places too, so a licence with
words changed or cut off is found and its key phrase alone is not. All of this happens inside a document's row: nothing is shuffled but the counts of the template words.

Cases: null and empty texts have no words, labels '' and score 0; repeated rows are each scanned; overlapping places all
count; other columns are ignored; an empty table gives no rows; null ids are kept.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import WORD_BREAKS

# Fixed values: (label, text, key phrase, base). Base templates are the contract's phrases; the others are the opening
# or identifying words of well-known licences. The key phrase must stand in full where the text aligns.
TEMPLATES = (
    ("gpl", "gnu general public license", "gnu general public license", True),
    ("apache", "apache license", "apache license", True),
    ("cc-by", "cc by", "cc by", True),
    ("mit", "mit license", "mit license", True),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "under the terms of the gnu general public license", False),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license", False),
    ("agpl", "gnu affero general public license", "gnu affero general public license", False),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache license", False),
    ("apache", "spdx license identifier apache 2 0", "spdx license identifier apache", False),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge", False),
    ("mit", "spdx license identifier mit", "spdx license identifier mit", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee", False),
    ("mpl", "mozilla public license version 2 0", "mozilla public license", False),
    ("epl", "eclipse public license version 2 0", "eclipse public license", False),
    ("cc-by", "creative commons attribution", "creative commons attribution", False),
    ("cc-by-nc", "cc by nc", "cc by nc", False),
    ("cc-by-sa", "cc by sa", "cc by sa", False),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal", False),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software", False),
)
#: The IDF-weighted share of the words beside the key phrase that must stand at their relative places, in templates with so many.
EVIDENCE, BESIDE = 0.15, 5
VOCABULARY = sorted({w for _, text, _, _ in TEMPLATES for w in text.split()})


def words(text: Column) -> Column:
    """Words with A-Z in lower case; an empty array for null and empty texts."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    plain = F.trim(F.regexp_replace(lower, WORD_BREAKS, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1))


def document_counts(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of rows, and in how many of them each template word occurs."""
    known = F.array(*map(F.lit, VOCABULARY))
    held = docs.select(F.explode_outer(F.array_union(F.array_intersect(words(F.col("text")), known), F.array(F.lit("")))).alias("word"))
    rows = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most a row for each template word
    return rows.pop("", 0), rows


def index(total: int, counts: dict[str, int]) -> list[dict]:
    """The templates with the IDF of their words and the place of the rarest (the first of equals)."""
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in VOCABULARY}
    out = []
    for label, text, key, base in TEMPLATES:
        own, phrase = text.split(), key.split()
        # The rarest word is sought in the key phrase, which every match contains.
        offset = next(k for k in range(len(own)) if own[k : k + len(phrase)] == phrase)
        place = min(range(offset, offset + len(phrase)), key=lambda k: (-idf[own[k]], k))
        out.append({"label": label, "words": own, "key": phrase, "offset": offset, "base": base, "place": place, "rare": own[place], "idf": [idf[w] for w in own]})
    return out


def _matches(template: dict, places: Column, text: Column) -> Column:
    """Array of struct(at, label, base, sure, part, more): the template aligned at each place of its rarest word."""

    def aligned(spot: Column) -> Column:
        begin = spot["i"] - template["place"]
        same = lambda k: F.coalesce(F.get(text, begin + k) == template["words"][k], F.lit(False))
        sure, part, more = F.lit(True), F.lit(0.0), F.lit(0.0)
        key = range(template["offset"], template["offset"] + len(template["key"]))
        for k in key:
            sure = sure & same(k)
        for k, weight in enumerate(template["idf"]):
            part = part + F.when(same(k), weight).otherwise(0.0)
            more = more if k in key else more + F.when(same(k), weight).otherwise(0.0)
        beside = [weight for k, weight in enumerate(template["idf"]) if k not in key]
        more = more / sum(beside) if len(beside) >= BESIDE else F.lit(1.0)
        return F.struct(begin.cast("long").alias("at"), F.lit(template["label"]).alias("label"), F.lit(template["base"]).alias("base"), sure.alias("sure"), (part / sum(template["idf"])).alias("part"), more.alias("more"))

    return F.transform(F.filter(places, lambda s: s["w"] == template["rare"]), aligned)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs (doc_id, text).

    score: the IDF-weighted share of a template that stands at its relative places, at its best; halved if the key phrase isn't there.
    """
    templates = index(*document_counts(docs))
    rare = F.array(*map(F.lit, sorted({t["rare"] for t in templates})))
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    spots = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), x.alias("w"))), lambda s: F.array_contains(rare, s["w"]))
    kind = "array<struct<i: int, w: string>>"
    rows = rows.select("doc_id", "w", F.when(F.arrays_overlap("w", rare), spots).otherwise(F.array().cast(kind)).alias("spots"))
    none = "array<struct<at: bigint, label: string, base: boolean, sure: boolean, part: double, more: double>>"
    found = F.when(F.size("spots") > 0, F.concat(*[_matches(t, F.col("spots"), F.col("w")) for t in templates])).otherwise(F.array().cast(none))
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found"))
    base = F.filter("found", lambda m: m["base"] & m["sure"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["at"])).alias("first_word"), F.array_max(F.transform(base, lambda m: m["at"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.filter("found", lambda m: m["sure"] & (F.round(m["more"], 9) >= EVIDENCE))).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda m: F.when(m["sure"], m["part"]).otherwise(m["part"] / 2))), F.lit(0.0)), 6).alias("score"),
    )


def sql() -> str:
    """The same by plain search for every template at every place of its rarest word."""
    quote = lambda s: "'" + s + "'"
    values = ",\n".join(
        f"({k}, {quote(label)}, {str(base).lower()}, string_split({quote(text)}, ' '), string_split({quote(key)}, ' '), {text.split().index(key.split()[0]) if len(key.split()) == 1 else next(j for j in range(len(text.split())) if text.split()[j : j + len(key.split())] == key.split())})"
        for k, (label, text, key, base) in enumerate(TEMPLATES)
    )
    return rf"""
with d as (select row_number() over () as r, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as t from documents),
dw as (select r, doc_id, case when t = '' then [] else string_split(t, ' ') end as w from d),
t(k, label, base, ws, ph, off) as (values {values}),
v as (select distinct unnest(ws) as word from t),
x as (select r, unnest(w) as word, unnest(range(0, len(w))) as i from dw),
xv as (select x.* from x join v using (word)),
df as (select word, count(distinct r) as n from xv group by 1),
idf as (select word, ln((select count(*) + 1 from dw) / (coalesce(n, 0) + 1)) + 1 as z from v left join df using (word)),
tw as (select k, unnest(ws) as word, unnest(range(0, len(ws))) as j from t),
tz as (select k, j, word, z from tw join idf using (word)),
rare as (select k, j, word from (select tz.k, j, word, row_number() over (partition by tz.k order by z desc, j) as o from tz join t using (k) where j >= off and j < off + len(ph)) where o = 1),
al as (select distinct xv.r, rare.k, xv.i - rare.j as b from xv join rare using (word)),
pt as (select al.r, al.k, al.b, sum(case when xv.word is not null then z else 0 end) / sum(z) as part, bool_and(xv.word is not null or j < off or j >= off + len(ph)) as sure,
  case when any_value(len(ws) - len(ph)) >= {BESIDE} then sum(case when xv.word is not null and (j < off or j >= off + len(ph)) then z else 0 end) / sum(case when j < off or j >= off + len(ph) then z else 0 end) else 1 end as more
  from al join tz using (k) join t using (k) left join xv on xv.r = al.r and xv.i = al.b + j and xv.word = tz.word group by 1, 2, 3),
m as (select r, count(*) filter (base and sure) as n_base, min(b) filter (base and sure) as f, max(b) filter (base and sure) as l,
  string_agg(distinct label, ',' order by label) filter (base and sure) as bl, string_agg(distinct label, ',' order by label) filter (sure and round(more, 9) >= {EVIDENCE}) as ls, max(case when sure then part else part / 2 end) as s
  from pt join t using (k) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(f as bigint) as first_word, cast(l as bigint) as last_word,
  coalesce(bl, '') as base_labels, coalesce(ls, '') as labels, round(coalesce(s, 0.0), 6)::double as score
from dw left join m using (r)
"""
