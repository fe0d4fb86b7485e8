import re

import duckdb

from narratum.llm import licences

BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
LINES = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License. mit license MIT  license",
         "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file", "Permission is hereby granted, free of charge, to any person", "GNU Lesser General Public License",
         "mit", "license gnu", "", None, "é mit-license", "the mit licenses", "gnu general public", "CC0 1.0 Universal", "redistribution and use in source or binary forms", "by cc by cc by"]


def plain(text):
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]
    at = sorted((k, label) for label, p in BASE.items() for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split())
    return len(ws), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_base_and_sql(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(LINES)] + [(3, LINES[0], "x"), (None, LINES[2], "x"), (99, "word " * 30_000 + "apache license", "x"), (98, " ".join(x or "" for x in LINES) * 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, w string")
    got = licences.scan(docs).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got])) == sorted(str((i, *plain(t))) for i, t, _ in rows)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[1] == "cc-by,cc-by-nc" and labels[4] == "mit" and labels[5] == "lgpl" and labels[13] == "cc0" and labels[6] == ""
    assert all(0 <= r.score <= 1 for r in got)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    names = [c.name for c in licences.scan(docs).schema.fields]
    want = con.execute(f"select {', '.join(names)} from ({licences.sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert licences.scan(docs.limit(0)).count() == 0


def test_a_text_needs_more_than_its_key_phrase(spark):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    lines = [bsd, "redistribution and use in source and binary forms is hard", bsd.replace("permitted", "allowed").replace("following", "next"), "Permission is hereby granted, free of charge, said the king",
             "free and unencumbered software", "This is free and unencumbered software, released into the PUBLIC domain", "Mozilla Public License", "MIT Kelvin"]
    got = {r.doc_id: r.labels for r in licences.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: "bsd", 1: "", 2: "bsd", 3: "", 4: "", 5: "unlicense", 6: "mpl", 7: ""}
