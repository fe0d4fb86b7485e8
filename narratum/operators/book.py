"""Books: spine and contents to ordered segments, and album tags by declarative rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import read_date, target_id, target_path

PRE = "Pre Table of Contents"


def resolve_spine(spine: DataFrame, manifest: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Spine rows (book_id, spine_pos, idref) with their href; unknown ids and items without href are skipped.

    With members (book_id, path, ...), a href that names none of them is an error.
    """
    items = manifest.groupBy("book_id", "item_id").agg(F.max_by("href", "seq").alias("href"))
    rows = spine.join(items, (spine["book_id"] == items["book_id"]) & (spine["idref"] == items["item_id"])).where("href is not null").select(spine["book_id"], "spine_pos", "idref", "href")
    if members is None:
        return rows
    found = rows.join(members.withColumnRenamed("path", "href"), ["book_id", "href"], "left")
    there = F.col("bytes").isNotNull()
    return found.withColumn("bytes", F.when(there, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("no such file in the archive: "), F.col("href"))).cast("binary")))


def _recursive(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """A recursive query. Its rows aren't limited in number, which Spark does by default, and its levels are to DEEP."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(sql, **tables)


#: Levels that contents and JSON documents may have.
DEEP = 1000


def flatten_contents(toc: DataFrame) -> DataFrame:
    """Contents rows (book_id, node, parent, sibling, label, src) to pre-order rows with toc_pos, parent_labels, src_path and src_id."""
    out = _recursive(
        toc.sparkSession,
        f"""WITH RECURSIVE t(book_id, node, label, src, parent_labels, path) MAX RECURSION LEVEL {DEEP} AS (
        SELECT book_id, node, label, src, cast(array() as array<string>), array(sibling) FROM {{toc}} WHERE parent IS NULL
        UNION ALL SELECT c.book_id, c.node, c.label, c.src, array_append(t.parent_labels, t.label), array_append(t.path, c.sibling)
        FROM {{toc}} c JOIN t ON c.book_id = t.book_id AND c.parent = t.node) SELECT * FROM t""",
        toc=toc,
    )
    out = out.withColumn("toc_pos", F.row_number().over(Window.partitionBy("book_id").orderBy("path")) - 1)
    return out.select("book_id", "toc_pos", "label", "parent_labels", "src", target_path(F.col("src")).alias("src_path"), target_id(F.col("src")).alias("src_id"))


def first_records(records: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, path, toc_pos, rec_pos): the first record of its file that each contents row could open, if there is one."""
    ids = records.select("book_id", "path", "rec_pos", F.explode_outer("ids").alias("id")).groupBy("book_id", "path", "id").agg(F.min("rec_pos").alias("rec_pos"))
    any_id = F.lit(None).cast("string")
    ids = ids.where("id is not null").unionByName(ids.groupBy("book_id", "path").agg(F.min("rec_pos").alias("rec_pos")).withColumn("id", any_id)).withColumnsRenamed({"book_id": "b", "path": "p"})
    rows = toc.where("src_path is not null").select("book_id", F.col("src_path").alias("path"), "toc_pos", "src_id")
    return rows.join(ids, (F.col("book_id") == F.col("b")) & (F.col("path") == F.col("p")) & F.col("src_id").eqNullSafe(F.col("id"))).select("book_id", "path", "toc_pos", "rec_pos")


def match_contents(records: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, rec_pos, toc_pos): which record opens which contents row.

    Records of one file, in order, each take the first contents row of that file not yet taken whose fragment is among the
    record's ids (or that has none). Where no two rows of a file could open the same record first, each opens its own; only files
    with such a conflict are folded, one file of one book at a time.
    """
    firsts = first_records(records, toc)
    conflicts = firsts.groupBy("book_id", "path", "rec_pos").agg(F.count("*").alias("n")).where("n > 1").select("book_id", "path").distinct()
    plain = firsts.join(conflicts, ["book_id", "path"], "left_anti").select("book_id", F.col("rec_pos").cast("long").alias("rec_pos"), F.col("toc_pos").cast("int").alias("toc_pos"))
    return plain.unionByName(fold_contents(records.join(conflicts, ["book_id", "path"], "left_semi"), toc))


def fold_contents(records: DataFrame, toc: DataFrame) -> DataFrame:
    """match_contents record by record, for files of any kind."""
    rs = records.groupBy("book_id", "path").agg(F.array_sort(F.collect_list(F.struct("rec_pos", "ids"))).alias("rs"))
    ts = toc.where("src_path is not null").groupBy("book_id", F.col("src_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("toc_pos", "src_id"))).alias("ts"))
    pair = "struct<rec_pos: bigint, toc_pos: int>"
    start = F.struct(F.col("ts").alias("left"), F.array().cast(f"array<{pair}>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        fit = F.filter(a["left"], lambda t: t["src_id"].isNull() | F.coalesce(F.array_contains(r["ids"], t["src_id"]), F.lit(False)))
        first = F.get(fit, F.lit(0))
        hit = F.size(fit) > 0
        out = F.when(hit, F.concat(a["out"], F.array(F.struct(r["rec_pos"].cast("long").alias("rec_pos"), first["toc_pos"].cast("int").alias("toc_pos"))))).otherwise(a["out"])
        return F.struct(F.when(hit, F.filter(a["left"], lambda t: t["toc_pos"] != first["toc_pos"])).otherwise(a["left"]).alias("left"), out.alias("out"))

    return rs.join(ts, ["book_id", "path"]).select("book_id", F.explode(F.aggregate("rs", start, step)["out"]).alias("x")).select("book_id", "x.rec_pos", "x.toc_pos")


def segment(records: DataFrame, matches: DataFrame) -> DataFrame:
    """Records with track_no: the number of opened contents rows up to the record; 0 is what stands before the first."""
    marked = records.join(matches, ["book_id", "rec_pos"], "left")
    w = Window.partitionBy("book_id").orderBy("rec_pos").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("track_no", F.sum(F.when(F.col("toc_pos").isNotNull(), 1).otherwise(0)).over(w).cast("int")).drop("toc_pos")


def segment_names(records: DataFrame, matches: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, track_no, label, parent_labels) of each segment; number 0 is there even if it is empty."""
    w = Window.partitionBy("book_id").orderBy("rec_pos")
    named = matches.withColumn("track_no", F.row_number().over(w)).join(toc, ["book_id", "toc_pos"]).select("book_id", "track_no", "label", "parent_labels")
    first = records.select("book_id").distinct().select("book_id", F.lit(0).alias("track_no"), F.lit(PRE).alias("label"), F.lit(None).cast("array<string>").alias("parent_labels"))
    return first.unionByName(named)


def carried(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


#: The shipped rules; the last rule of a tag that holds wins.
RULES = {
    "ALBUM,ALBUMSORT": [{"data": {"dc:title.text": "raw"}}],
    "ARTIST,ALBUMARTIST": [
        {"validate": {"dc:creator.opf:role": "aut"}, "data": {"pop.text": "raw"}},
        {"validate": {"dc:creator.id": "id-1"}, "data": {"pop.text": "raw"}},
        {"validate": {"dc:creator.id": "creator01"}, "data": {"pop.text": "raw"}},
    ],
    "PUBLISHER": [{"data": {"dc:publisher.text": "raw"}}],
    "DATE": [{"data": {"dc:date.text": "read_datetime"}}],
    "ASIN": [
        {"validate": {"dc:identifier.opf:scheme": "AMAZON"}, "data": {"pop.text": "raw"}},
        {"validate": {"dc:identifier.opf:scheme": "MOBI-ASIN"}, "data": {"pop.text": "raw"}},
    ],
}


def rules_frame(spark: SparkSession, rules: dict = RULES) -> DataFrame:
    """(tag, rule_no, tests array<struct<element, attr, value>>, element, field, processing) of rules as in RULES.

    Paths are element.attribute; a data path of `pop`s and a field is relative to the last test's attribute. For paths of
    any length see path_rules.
    """
    rows = []
    for names, own in rules.items():
        for no, rule in enumerate(own):
            if "data" not in rule:
                continue
            path, processing = next(iter(rule["data"].items()))
            parts = path.split(".")
            tests = [(*k.split(".", 1), v) for k, v in rule.get("validate", {}).items()]
            up = len(parts) - len([p for p in parts if p != "pop"]) if tests else 0
            element = None if tests else parts[0]
            for name in names.split(","):
                rows.append((name, no, tests, element, ".".join(parts[up:] if tests else parts[1:]), processing))
    return spark.createDataFrame(rows, "tag string, rule_no int, tests array<struct<element: string, attr: string, value: string>>, element string, field string, processing string")


def album_tags(metadata: DataFrame, rules: DataFrame) -> DataFrame:
    """Metadata (book_id, element, seq, attrs map with text) to (book_id, tag, value): a row for each tag with a rule that holds.

    A test holds if some occurrence of the element has that value; the data is taken from the first such occurrence of the
    last test, or from the first occurrence that has the field. The last rule that holds gives the value, null or not.
    Only the rules, a handful, are broadcast; what they meet is grouped by book, and no two tables of the books' size are joined.
    """
    number, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    tests = rules.select("tag", "rule_no", "field", F.size("tests").alias("all"), F.posexplode("tests").alias("test_no", "test"))
    asked = tests.select("tag", "rule_no", "test_no", F.col("test.element").alias("element"), F.col("test.attr").alias("attr"), F.col("test.value").alias("want"), F.when(F.col("test_no") == F.col("all") - 1, F.col("field")).alias("field"))
    free = rules.where("size(tests) = 0").select("tag", "rule_no", F.lit(0).alias("test_no"), "element", text.alias("attr"), text.alias("want"), "field")
    found = F.element_at("attrs", F.col("field"))
    holds = F.when(F.col("attr").isNull(), found.isNotNull()).otherwise(F.element_at("attrs", F.col("attr")) == F.col("want"))
    met = metadata.join(F.broadcast(asked.unionByName(free)), "element").where(holds).select("book_id", "tag", "rule_no", "test_no", "seq", found.alias("value"))
    # Rules without a test hold for each book; their rows have no place, so that any found value goes before.
    always = metadata.select("book_id").distinct().crossJoin(F.broadcast(free)).select("book_id", "tag", "rule_no", "test_no", number.alias("seq"), text.alias("value"))
    met = met.unionByName(always).groupBy("book_id", "tag", "rule_no", "test_no").agg(F.min_by("value", "seq").alias("value"))
    passed = met.groupBy("book_id", "tag", "rule_no").agg(F.count("*").alias("met"), F.max_by("value", "test_no").alias("value"))
    tried = passed.join(F.broadcast(rules.select("tag", "rule_no", "processing", F.greatest(F.size("tests"), F.lit(1)).alias("all"))), ["tag", "rule_no"]).where("met = all")
    value = F.col("value")
    done = F.when(F.col("processing") == "read_datetime", read_date(value)).when(F.col("processing") == "raw", value)
    tried = tried.where(F.col("processing").isin("raw", "read_datetime") | value.isNull())
    last = tried.groupBy("book_id", "tag").agg(F.max_by(F.struct(done.alias("value")), "rule_no").alias("x"))
    return last.select("book_id", "tag", F.col("x.value").alias("value"))


def path_value(doc: Column, path: list[str | int]) -> Column:
    """A JSON text's value at an exact path of keys and places, null if it isn't there."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"[{json.dumps(p)}]" for p in path)
    return F.try_variant_get(F.try_parse_json(doc), "$" + steps, "string")


def relative_path(path: Column, data: Column) -> Column:
    """An exact path (keys and places) after one step up for each leading `pop` of data, then the rest of data.

    If data has nothing but `pop`s, the last one is taken as a key too. More steps up than the path has give null.
    """
    other = F.transform(data, lambda p, k: F.when(p != "pop", k))
    up = F.coalesce(F.array_min(F.filter(other, lambda k: k.isNotNull())), F.size(data))
    rest = F.slice(data, F.least(up, F.size(data) - 1) + 1, F.size(data))
    return F.when(up <= F.size(path), F.concat(F.slice(path, F.lit(1), F.size(path) - up), rest))


def flatten_documents(docs: DataFrame) -> DataFrame:
    """JSON documents (book_id, doc) to a row for each value below the root: (book_id, keys, places, path, named, value, json).

    keys are the object keys on the way, places the places in lists, path both in order as text, named whether a key came last. value is a text as it is and
    anything else as JSON, json is JSON always; JSON nulls have neither. Documents that aren't JSON give no rows.
    """
    return _recursive(
        docs.sparkSession,
        f"""WITH RECURSIVE n(book_id, keys, places, path, named, value) MAX RECURSION LEVEL {DEEP} AS (
        SELECT book_id, cast(array() as array<string>), cast(array() as array<int>), cast(array() as array<string>), false, try_parse_json(doc) FROM {{docs}}
        UNION ALL SELECT n.book_id, if(e.key IS NULL, n.keys, array_append(n.keys, e.key)), if(e.key IS NULL, array_append(n.places, e.pos), n.places),
        array_append(n.path, coalesce(e.key, cast(e.pos AS string))), e.key IS NOT NULL, e.value FROM n, LATERAL variant_explode(n.value) e)
        SELECT book_id, keys, places, path, named, if(schema_of_variant(value) = 'STRING', try_variant_get(value, '$', 'string'), if(is_variant_null(value), null, to_json(value))) AS value,
        if(is_variant_null(value), null, to_json(value)) AS json FROM n WHERE size(path) > 0""",
        docs=docs,
    )


def general_query(nodes: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """flatten_documents rows and questions (by, keys, want: JSON or null) to (book_id, by, path, value), a row for each that is met.

    A list on the way, at any depth and in lists too, is met by any of its items; the first in the document's order counts. Without
    want that is the first that isn't null. A value right behind the last key is taken whole, a list too.
    """
    own = nodes.where("named").select("book_id", "keys", "places", "path", "value", "json")
    met = own.join(F.broadcast(asked), "keys").where("json IS NOT NULL AND (want IS NULL OR want = json)")
    first = F.min(F.struct("places", "path", "value"))
    return met.groupBy("book_id", *by).agg(first.alias("x")).select("book_id", *by, "x.path", "x.value")


def path_rules(spark: SparkSession, rules: dict) -> DataFrame:
    """(tag, rule_no, tests array<struct<keys, want>>, data array<string>, processing) of rules as in RULES, with paths of any length."""
    rows = [
        (tag, no, [(k.split("."), json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for k, v in rule.get("validate", {}).items()], next(iter(rule["data"])).split("."), next(iter(rule["data"].values())))
        for names, own in rules.items() for no, rule in enumerate(own) if "data" in rule for tag in names.split(",")
    ]
    return spark.createDataFrame(rows, "tag string, rule_no int, tests array<struct<keys: array<string>, want: string>>, data array<string>, processing string")


def document_tags(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """JSON documents (book_id, doc) and path_rules to (book_id, tag, value): a row for each tag with a rule that holds.

    All tests of a rule must be met; its data is at the exact path that the last test met, changed by the data path's `pop`s, or
    at the first place where the data path leads if there is no test. The last rule that holds gives the value, null or not;
    one whose processing is unknown gives none unless its data is null.
    """
    nodes = flatten_documents(docs)
    tests = rules.select("tag", "rule_no", F.size("tests").alias("all"), F.posexplode("tests").alias("test_no", "test")).select("tag", "rule_no", "all", "test_no", "test.keys", "test.want")
    met = general_query(nodes, tests, ["tag", "rule_no", "test_no", "all"])
    passed = met.groupBy("book_id", "tag", "rule_no").agg(F.count("*").alias("met"), F.max("all").alias("all"), F.max_by("path", "test_no").alias("at")).where("met = all")
    data = rules.select("tag", "rule_no", "data", "processing")
    exact = passed.join(F.broadcast(data), ["tag", "rule_no"]).withColumn("path", relative_path(F.col("at"), F.col("data"))).select("book_id", "tag", "rule_no", "processing", "path")
    exact = exact.join(nodes.select("book_id", "path", "value"), ["book_id", "path"], "left").select("book_id", "tag", "rule_no", "processing", "value")
    free = rules.where("size(tests) = 0").select("tag", "rule_no", "processing", F.col("data").alias("keys"), F.lit(None).cast("string").alias("want"))
    tried = docs.select("book_id").distinct().crossJoin(F.broadcast(free.drop("keys", "want")))  # rules are a handful, each tried once for a book
    plain = tried.join(general_query(nodes, free, ["tag", "rule_no"]).drop("path"), ["book_id", "tag", "rule_no"], "left")
    value = F.col("value")
    done = F.when(F.col("processing") == "read_datetime", read_date(value)).otherwise(value)
    last = exact.unionByName(plain).where(F.col("processing").isin("raw", "read_datetime") | value.isNull())
    return last.groupBy("book_id", "tag").agg(F.max_by(F.struct(done.alias("value")), "rule_no").alias("x")).select("book_id", "tag", "x.value")


def cover(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """(book_id, href) of the cover: the last image item marked so, else the item that a meta element names."""
    marked = manifest.where("properties = 'cover-image' and contains(media_type, 'image')").groupBy("book_id").agg(F.max_by("href", "seq").alias("own"))
    meta = metadata.where("element = 'meta' and element_at(attrs, 'content') = 'cover-image'").select("book_id", F.element_at("attrs", F.lit("name")).alias("item_id"), "seq")
    named = meta.join(manifest.select("book_id", "item_id", "href"), ["book_id", "item_id"]).groupBy("book_id").agg(F.max_by("href", "seq").alias("other"))
    return marked.join(named, "book_id", "full_outer").select("book_id", F.coalesce("own", "other").alias("href"))
