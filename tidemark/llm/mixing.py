"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. The documents of a source stand in a
row, by size and then doc_id; each is expected ``target / source size`` times.
The prefix sums of these expectations, plus one random offset for the source,
cross an integer so many times in a document: that many copies are taken. As
the row is ordered by size, the words taken stay within about one largest
document of the target; of ``OFFSETS`` random offsets the one is used with which
they come nearest to it. The offset used is therefore not quite uniform, and a
document's expected copies over all seeds are only about ``target / source size``.

The row of a source is cut by ranges into partitions: ranks within partitions
and the counts of the partitions before give prefix sums, so that no source
has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import columns_free, materialise

_SPACES = " \t\n\x0b\x0c\r"
OFFSETS = 16


def word_count(text: str):
    """Words of a text column, between ASCII white space; 0 for null."""
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), total_share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in order of code points, null last, have the given weights in
    turn. They share ``total_share`` of all sizes by weight; a target stops at
    ``most`` times its source's size, and the excess is shared again by weight
    until none is above.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = totals.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size"))
    # Sources fill up in order of cap / weight; each target is the smaller of its cap and level * weight.
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", (F.lit(float(total_share)) * F.sum("source_size").over(every) - before) / weight_left).withColumn("place", F.row_number().over(filled))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"]
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first") * F.col("weight")))
    return leveled.withColumn("first", first).select("source", "source_size", target.alias("target"))


def sampling_plan(docs: DataFrame, seed: int = 17, **rule) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    copies.

    ``docs`` needs doc_id, text and source. A null text has size 0; a null
    source is a source of its own; documents without words are taken as often
    as the others of their source and add no words; a source without words
    has a target of 0 and nothing of it is taken. Rows with one doc_id are
    rows of their own. The same input gives the same copies.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()]
    row = F.monotonically_increasing_id()
    placed = materialise(sized.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("row", row))
    placed = placed.withColumn("part", F.shiftright("row", 33))
    parts = placed.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).select(F.col("source").alias("s"), F.col("part").alias("p"), "first_row", "before")
    targets = source_targets(placed.select("source", "size"), **rule).select(F.col("source").alias("s"), "source_size", "target")
    # The parts are as many as partitions and sources, the targets as sources: sizes that Spark knows when it chooses the joins.
    ranked = placed.join(parts, placed["source"].eqNullSafe(parts["s"]) & (placed["part"] == parts["p"])).drop("s", "p")
    ranked = ranked.join(targets, ranked["source"].eqNullSafe(targets["s"])).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = ranked.withColumns({"rate": rate, "rank": F.col("before") + F.col("row") - F.col("first_row")}).select("doc_id", "source", "size", "source_size", "target", "rate", "rank")
    # The words that each offset would take of each source, in one aggregate; the nearest to the target is used.
    copies = lambda offset: F.floor(F.col("rate") * (F.col("rank") + 1) + offset) - F.floor(F.col("rate") * F.col("rank") + offset)
    named = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    offset = lambda i: F.conv(F.substring(F.md5(F.concat(named, F.lit(f"|{seed}|{i}"))), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))
    drawn = ranked.groupBy("source", "target").agg(*[F.sum(F.col("size") * copies(offset(i))).alias(f"t{i}") for i in range(OFFSETS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("miss"), F.lit(i), offset(i).alias("offset")) for i in range(OFFSETS)]))
    drawn = drawn.select(F.col("source").alias("s"), best["offset"].alias("offset"))  # one row for each source
    ranked = ranked.join(drawn, ranked["source"].eqNullSafe(drawn["s"])).drop("s")
    return ranked.select("doc_id", "source", "size", "source_size", "target", copies(F.col("offset")).cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 17, **rule) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as it is taken, all its
    columns kept.

    Rows that agree in doc_id, source and size share their copies evenly in an
    order of their texts, so that what is taken of them does not depend on
    their order in the table. A null or empty text has size 0 and is taken as
    often as the others of its source, with its text as it was.
    """
    key, number, at, copies = columns_free(docs, "key", "number", "at", "copies")
    same = lambda size: F.struct(F.col("doc_id").cast("long").alias("d"), F.col("source").cast("string").alias("s"), size.alias("n"))
    plan = sampling_plan(docs, seed, **rule).filter("copies > 0").select(same(F.col("size")).alias(key), F.col("copies").alias(copies))
    plan = plan.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(F.col(copies).desc())))
    rows = docs.withColumn(key, same(word_count("text")))
    rows = rows.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("text"))))
    taken = rows.join(plan, [key, number])
    return taken.withColumn(at, F.explode(F.expr(f"sequence(1L, {copies})"))).select(docs.columns)
