"""Ordered computations without a task for each sequence: numbers, running sums, as-of lookups, jumps and state machines.

A sequence (all rows with one key) may hold any share of the rows. Rows are numbered by a range partitioning of the whole order;
everything after works on blocks of bounded size and on a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import stored

#: Rows that a range of the numbering has about, rows of a block of positions, and the span of a block of places.
RANGE, BLOCK, SPAN = 200_000, 4096, 1 << 16
#: Records whose maps one fold composes.
FOLD = 512


def numbered(rows: DataFrame, key: list[str], order: list[str], pos: str = "pos", total: str | None = None) -> DataFrame:
    """rows with pos, from 0 in each sequence by the order (nulls first), and the sequence's number of rows if total names it.

    Ranges of the whole order are sorted one by one; a row's place is its place in its range's part of the sequence and what the
    ranges before hold of it. Rows with equal order are numbered in some order. The rows are stored once on the way.
    """
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, rows.sparkSession.sparkContext.defaultMinPartitions)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    ranges = max(ranges, -(-rows.count() // RANGE))
    own = rows.repartitionByRange(ranges, *key, *order, "__row").sortWithinPartitions(*key, *order, "__row")
    own = stored(own.withColumns({"__range": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "ranges")
    parts = own.groupBy(*key, "__range").agg(F.count("*").alias("__many"), F.min("__place").alias("__first"))
    whole = Window.partitionBy(*key)
    before = F.coalesce(F.sum("__many").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(parts.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__range").alias("__part"), (before - F.col("__first")).alias("__shift"), F.sum("__many").over(whole).alias("__total")), "starts")
    same = F.col("__range") == F.col("__part")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = own.join(starts, same).withColumn(pos, F.col("__place") + F.col("__shift"))
    return out.select(*[c for c in rows.columns if c != "__row"], pos, *([F.col("__total").alias(total)] if total else []))


def crowded(rows: DataFrame, key: list[str], most: int) -> DataFrame | None:
    """The keys with more than `most` rows, None if there are none."""
    found = rows.groupBy(*key).agg(F.count("*").alias("__many")).where(F.col("__many") > most).drop("__many")
    return found if found.limit(1).count() else None


def ranked(rows: DataFrame, key: list[str], order: list[str], pos: str, most: int = RANGE) -> DataFrame:
    """rows with pos, from 0 in each sequence: by a window, or in ranges if a sequence has more than `most` rows."""
    if crowded(rows, key, most) is not None:
        return numbered(rows, key, order, pos)
    return rows.withColumn(pos, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long"))


def split(rows: DataFrame, key: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the keys with up to `most` rows, and those of the others (None if there are none). Null keys aren't kept apart."""
    crowd = crowded(rows, key, most)
    if crowd is None:
        return rows, None
    same = lambda: on("r", "c", key, key[0], key[0])
    return rows.alias("r").join(crowd.alias("c"), same(), "left_anti"), rows.alias("r").join(crowd.alias("c"), same(), "left_semi")


def following(rows: DataFrame, key: list[str], value: str, out: str, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """rows (numbered) with the value of the row that comes next: in blocks, and the next block's first for their last rows."""
    cut = rows.withColumn("__block", F.floor(F.col(pos) / block).cast("long"))
    next_in = F.lead(F.struct(value)).over(Window.partitionBy(*key, "__block").orderBy(pos))
    firsts = rows.where(F.col(pos) % block == 0).select(*[F.col(k).alias(f"__{k}") for k in key], (F.floor(F.col(pos) / block) - 1).cast("long").alias("__at"), F.struct(value).alias("__first"))
    same = F.col("__block") == F.col("__at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = cut.withColumn("__next", next_in).join(firsts, same, "left")
    return joined.select(*rows.columns, F.coalesce("__next", "__first")[value].alias(out))


def running(rows: DataFrame, key: list[str], value: Column, out: str, pos: str = "pos", block: int = BLOCK) -> DataFrame:
    """rows (numbered) with the sum of value up to and with each row: sums in blocks, and of the blocks before."""
    cut = rows.withColumns({"__block": F.floor(F.col(pos) / block), "__value": value})
    within = Window.partitionBy(*key, "__block")
    cut = cut.withColumn(out, F.sum("__value").over(within.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.select(*key, F.floor(F.col(pos) / block).alias("__block"), value.alias("__value")).groupBy(*key, "__block").agg(F.sum("__value").alias("__sum"))
    ahead = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__block").alias("__at"), F.sum("__sum").over(ahead).alias("__ahead"))
    same = F.col("__block") == F.col("__at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = cut.join(ahead, same).withColumn(out, F.coalesce(out, F.lit(0)) + F.coalesce("__ahead", F.lit(0)))
    return joined.select(*rows.columns, out)


def as_of(points: DataFrame, at: str, rows: DataFrame, key: list[str], name: str, later: bool, span: int = SPAN) -> DataFrame:
    """points with `name`, the value of the nearest of rows (key, place, value): the first at or after `at` if later, else the last before it.

    Of rows at one place the smallest value counts if later, else the largest. Points and rows meet in blocks of `span` places,
    each sorted once; where a block has no such row, the nearest block's edge row is taken. A null `at` finds nothing.
    """
    block = lambda c: F.floor(F.col(c) / span).cast("long")
    kind = rows.schema["value"].dataType
    found = rows.select(*key, block("place").alias("__block"), F.col("place").cast("long").alias("__place"), F.col("value").alias("__value"), F.lit(None).cast(points.schema).alias("__point"))
    asked = points.select(*key, block(at).alias("__block"), F.col(at).cast("long").alias("__place"), F.lit(None).cast(kind).alias("__value"), F.struct(*points.columns).alias("__point"))
    both = found.unionByName(asked)
    order = [F.desc("__place"), F.col("__point").isNotNull(), F.desc("__value")] if later else ["__place", F.col("__point").isNull(), "__value"]
    near = F.last("__value", ignorenulls=True).over(Window.partitionBy(*key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    pick = F.min if later else F.max
    edges = both.groupBy(*key, "__block").agg(pick(F.when(F.col("__point").isNull(), F.struct("__place", "__value"))).alias("__edge"))
    beyond = Window.partitionBy(*key).orderBy(F.desc("__block") if later else "__block").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__block").alias("__at"), F.last(F.col("__edge"), ignorenulls=True).over(beyond).alias("__edge")).where("__edge is not null")
    same = F.col("__block") == F.col("__at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = both.withColumn("__near", near).where(F.col("__point").isNotNull()).join(edges, same, "left")
    return out.select(*[F.col("__point")[c].alias(c) for c in points.columns], F.coalesce("__near", F.col("__edge")["__value"]).alias(name))


def reached(jumps: DataFrame, roots: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos) of all that roots (key, pos) reach over jumps (key, pos, to: larger), the roots included.

    Each round reaches as many steps further as all before: the found ones take the jumps of 2, 4, 8, ... steps that the rounds
    make by joining the jumps with themselves. Both lists are stored, so that a round is two joins.
    """
    found, k = stored(roots.select(*key, "pos"), "reached"), 0
    jumps = stored(jumps.where("to is not null").select(*key, "pos", "to"), "jumps")
    while True:
        new = found.alias("f").join(jumps.alias("j"), on("f", "j", key, "pos", "pos")).select(*[F.col(f"f.{c}").alias(c) for c in key], F.col("j.to").alias("pos"))
        new = stored(new, "reached")
        if not new.limit(1).count():
            return found
        found = found.unionByName(new)
        jumps = stored(jumps.alias("a").join(jumps.alias("b"), on("a", "b", key, "to", "pos")).select(*[F.col(f"a.{c}").alias(c) for c in key], F.col("a.pos").alias("pos"), F.col("b.to").alias("to")), "jumps")


def on(a: str, b: str, key: list[str], x: str, y: str) -> Column:
    out = F.col(f"{a}.{x}") == F.col(f"{b}.{y}")
    for c in key:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def then(first: Column, second: Column) -> Column:
    """Two maps of four states one after the other. A map is a number: two bits from 2 * s on are where state s goes."""
    out = F.lit(0)
    for s in range(4):
        to = F.shiftright(first, 2 * s).bitwiseAND(3)
        out = out.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", second, 2 * to).bitwiseAND(3), F.lit(2 * s)))
    return out


def states(rows: DataFrame, key: list[str], step: str, out: str, pos: str = "pos", fold: int = FOLD) -> DataFrame:
    """rows (numbered, step: a map as in `then`) with the state before each row; every sequence starts in state 0.

    An associative scan: the maps of `fold` rows are composed to one of their block, the blocks' maps likewise, until a sequence
    is one block; then the blocks' states go down the same way. No fold is longer than `fold`. Other columns must be orderable.
    """
    stay = F.lit(0b11100100)
    carried = [c for c in rows.columns if c not in (*key, pos, step)]
    block = F.floor(F.col(pos) / fold).cast("long")
    cut = rows.select(*key, block.alias("__block"), F.struct(F.col(pos).alias("pos"), F.col(step).alias("step"), F.struct(F.lit(0).alias("__"), *carried).alias("row")).alias("__x"))
    maps = rows.select(*key, block.alias("__block"), F.struct(F.col(pos).alias("pos"), F.col(step).alias("step")).alias("__x")).groupBy(*key, "__block").agg(F.array_sort(F.collect_list("__x")).alias("__xs"))
    maps = stored(maps.select(*key, F.col("__block").alias("pos"), F.aggregate("__xs", stay, lambda a, x: then(a, x["step"])).alias("step")), "maps")
    if maps.where("pos > 0").limit(1).count():
        before = states(maps, key, "step", "__state", "pos", fold)
    else:
        before = maps.select(*key, "pos", "step", F.lit(0).alias("__state"))
    before = before.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("pos").alias("__at"), "__state")
    folded = cut.groupBy(*key, "__block").agg(F.array_sort(F.collect_list("__x")).alias("__xs"))
    same = F.col("__block") == F.col("__at")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    move = lambda s, x: F.call_function("shiftright", x["step"], 2 * s).bitwiseAND(3)
    start = F.struct(F.col("__state").alias("s"), F.array().cast("array<int>").alias("seen"))
    seen = F.aggregate("__xs", start, lambda a, x: F.struct(move(a["s"], x).alias("s"), F.concat(a["seen"], F.array(a["s"])).alias("seen")))["seen"]
    rows_of = folded.join(before, same).select(*key, F.explode(F.arrays_zip(F.col("__xs").alias("x"), seen.alias("s"))).alias("__y"))
    return rows_of.select(*key, F.col("__y.x.pos").alias(pos), F.col("__y.x.step").alias(step), *[F.col(f"__y.x.row.{c}").alias(c) for c in carried], F.col("__y.s").alias(out))
