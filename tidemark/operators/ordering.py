"""Global positions and average ranks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written


def by_ranges(df: DataFrame, *order) -> DataFrame:
    """``df`` dealt by ranges of the order, sorted within them, and written
    once with ``_row``: the range in the bits above 33, the place in the range
    below. Range borders are sampled anew by each plan that asks for them, so
    whatever compares ranges has to read them from one table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), "ranges")


def positions(df: DataFrame, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with its position, from 0, in a complete order of all rows, or of
    the rows that share the keys.

    Rows are dealt by ranges of the order; a row's position is its place in
    its range and the rows before. No task sorts more than a range, and the
    offsets are one row for each range, or for each key and range it is in."""
    placed = by_ranges(df, *keys, *order).withColumn("_range", F.shiftright("_row", 33))
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(earlier.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    match = placed["_range"] == offsets["_r"]
    for i, k in enumerate(keys):
        match &= placed[k].eqNullSafe(offsets[f"_key{i}"])
    joined = placed.join(offsets if keys else F.broadcast(offsets), match)  # without keys as many rows as ranges
    return joined.withColumn("position", F.col("_row") - F.col("_first") + F.col("_before")).select(*df.columns, "position")


def average_rank(value: Column, *keys: str) -> Column:
    """Rank from 1 within the keys; ties share the mean of their ranks."""
    tied = F.count("*").over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (tied - 1) / 2


def counted_before(df: DataFrame, keys: list[str], value: str, weight: str | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """(keys..., value, n, before, total) of the distinct values of each group:
    how many rows have one, how many rows of the group have a smaller one, and
    how many there are. A row counts as many times as its ``weight``. ``also``
    are further aggregates of the rows that have a value.

    Values are counted before they are exchanged, and numbered by ranges as in
    ``positions``: no task holds a group, however large."""
    also = also or {}
    counts = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"), *[column.alias(name) for name, column in also.items()])
    ranged = by_ranges(counts, *keys, value).withColumn("_range", F.shiftright("_row", 33))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = ranged.withColumn("before", earlier(Window.partitionBy("_range", *keys).orderBy(value)))
    # A group that goes on in further ranges: its rows in the ranges before, one row for each range and group.
    held = ranged.groupBy("_range", *keys).agg(F.sum("n").alias("n"))
    every = F.sum("n").over(Window.partitionBy(*keys))
    held = held.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), earlier(Window.partitionBy(*keys).orderBy("_range")).alias("_ahead"), every.alias("total"))
    match = own["_range"] == held["_r"]
    for i, k in enumerate(keys):
        match &= own[k].eqNullSafe(held[f"_{i}"])
    return own.join(held, match).select(*keys, value, "n", *also, (F.col("before") + F.col("_ahead")).alias("before"), "total")


#: Cells that the range of a column is cut into, evenly in its logarithm.
CELLS = 1024


def _cell(value: Column, low: float | None, high: float | None) -> Column:
    """The cell of a value, from 0; it never falls where the value grows. What
    is not finite has cells of its own at the ends."""
    width = (high or 0.0) - (low or 0.0)
    scale = CELLS / width if width > CELLS / 1e300 else 0.0
    inner = F.least(F.floor((_log(value) - F.lit(low or 0.0)) * F.lit(scale)), F.lit(CELLS - 1))
    return F.when(F.isnan(value) | (value == float("inf")), CELLS).when(value == float("-inf"), -1).otherwise(inner).cast("int")


def _log(value: Column) -> Column:
    return F.signum(value) * F.log1p(F.abs(value))


def quantiles(df: DataFrame, value: str, shares: list[float], *keys: str, weight: str | None = None, spread: Callable[[DataFrame], DataFrame] | None = None, kept: bool = False) -> DataFrame:
    """(keys..., q0, q1, ...): exact, linearly interpolated quantiles of the
    known values of each group, by counting and not by buffering them.

    Rows are counted by group and cell, from which follows the cell that each
    quantile is in; only the values of these cells are numbered. ``spread``
    repeats rows (all columns but the value and weight, and what else there is)
    for the groups that they stand in: it is given counts of cells, and rows of
    the cells that are looked into, and not every row. ``kept`` rows are those
    of a table already, and are not written again."""
    keys = list(keys)
    own = [c for c in df.columns if c not in (value, weight)] if spread else keys
    spread = spread or (lambda rows: rows)
    known = df.filter(F.col(value).isNotNull()).select(*own, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n"))
    # Written: the values are read for their range, for the counts, and where a quantile is.
    known = known if kept else written(known, "values")
    low, high = known.filter(~F.isnan("_v") & (F.abs("_v") != float("inf"))).agg(F.min(_log(F.col("_v"))), F.max(_log(F.col("_v")))).first()
    known = known.withColumn("_cell", _cell(F.col("_v"), low, high))
    counts = spread(known.groupBy(*own, "_cell").agg(F.sum("_n").alias("_n"))).groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # at most as many rows as cells
    ahead = F.coalesce(F.sum("_n").over(every.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "_cell", "_n", ahead.alias("_ahead"), F.sum("_n").over(every).alias("total"))
    position = lambda q: (F.col("total") - 1) * F.lit(float(q))
    places = [side(position(q)) for q in shares for side in (F.floor, F.ceil)]
    inside = [(F.col("_ahead") <= p) & (p < F.col("_ahead") + F.col("_n")) for p in places]
    asked = written(counts.filter(reduce(or_, inside)).drop("_n"), "cells")
    there = known.join(F.broadcast(asked.select("_cell").distinct()), "_cell", "left_semi")  # no more rows than cells
    picked = joined_by(spread(there), asked.select(*keys, "_cell"), [*keys, "_cell"], "inner")
    values = counted_before(picked, [*keys, "_cell"], "_v", "_n").drop("total")
    values = joined_by(values, asked, [*keys, "_cell"], "inner").withColumn("before", F.col("before") + F.col("_ahead"))
    # Position p of a group is in the value with before <= p < before + n.
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("_v")))
    found = values.groupBy(*keys, "total").agg(*[f.alias(f"{side}{i}") for i, q in enumerate(shares) for side, f in (("_low", at(F.floor(position(q)))), ("_high", at(F.ceil(position(q)))))])
    part = lambda q: position(q) - F.floor(position(q))
    return found.select(*keys, *[(F.col(f"_low{i}") + part(q) * (F.col(f"_high{i}") - F.col(f"_low{i}"))).alias(f"q{i}") for i, q in enumerate(shares)])


def quantiles_of(df: DataFrame, columns: list[str], shares: list[float], *keys: str) -> DataFrame:
    """(keys..., column, q0, q1, ...): exact quantiles of the known values of
    many columns and groups together, in the passes that one column takes.
    Groups and columns without known values give no row."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_value")) for c in columns])
    long = df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.*")
    return quantiles(long, "_value", shares, *keys, "column")


def joined_by(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``df`` with the further columns of ``other``, a row for each value of
    the keys, in which null is a value like any other."""
    named = other.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    match = F.lit(True)
    for i, k in enumerate(keys):
        match &= df[k].eqNullSafe(named[f"_key{i}"])
    return df.join(named, match, how).drop(*[f"_key{i}" for i in range(len(keys))])


def medians(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys..., median): exact, of the known values of each group, null for
    groups without any. No group's values stand in one buffer."""
    return joined_by(df.select(*keys).distinct(), quantiles(df, value, [0.5], *keys).withColumnRenamed("q0", "median"), list(keys))
