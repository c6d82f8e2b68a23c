"""Rolling-origin folds: quarter windows, membership and sample gates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

SPLITS = ("train", "valid", "test")


@dataclass(frozen=True)
class FoldRule:
    train_years: int = 3
    valid_quarters: int = 2
    test_quarters: int = 1
    step_quarters: int = 1
    least_train: int = 1000
    least_valid: int = 500
    least_test: int = 500
    first_day: str = "2019-01-01"
    drop_incomplete_last: bool = True

    def __post_init__(self):
        if min(self.train_years, self.valid_quarters, self.test_quarters, self.step_quarters) <= 0:
            raise ValueError("fold widths must be positive")


def _quarter(day: dt.date) -> int:
    return day.year * 4 + (day.month - 1) // 3


def _starts(quarter: int) -> dt.date:
    return dt.date(quarter // 4, quarter % 4 * 3 + 1, 1)


def _ends(quarter: int) -> dt.date:
    return _starts(quarter + 1) - dt.timedelta(days=1)


def usable_quarters(df: DataFrame, day: str, rule: FoldRule) -> list[int]:
    """Quarters (year * 4 + 0..3) from the first usable day to the last; the
    last one only if its last day is there, unless the rule says otherwise."""
    first = F.lit(rule.first_day).cast("date")
    low, high = df.filter(F.col(day) >= first).agg(F.min(day), F.max(day)).first()
    if low is None:
        return []
    last = _quarter(high)
    if rule.drop_incomplete_last and high < _ends(last):
        last -= 1
    return list(range(_quarter(low), last + 1))


def candidate_folds(df: DataFrame, day: str, rule: FoldRule) -> DataFrame:
    """(candidate_id, and start and end of each split): one row for each
    position of the window, so a few dozen rows for decades of data."""
    quarters = usable_quarters(df, day, rule)
    train = rule.train_years * 4
    width = train + rule.valid_quarters + rule.test_quarters
    rows = []
    for i in range(0, len(quarters) - width + 1, rule.step_quarters):
        cuts = [quarters[i], quarters[i] + train, quarters[i] + train + rule.valid_quarters, quarters[i] + width]
        rows.append((len(rows) + 1, *[x for a, b in zip(cuts, cuts[1:]) for x in (_starts(a), _ends(b - 1))]))
    return df.sparkSession.createDataFrame(rows, "candidate_id int, " + ", ".join(f"{s}_start date, {s}_end date" for s in SPLITS))


def split_bounds(folds: DataFrame) -> DataFrame:
    """(candidate_id, split, low, high): three rows for each fold."""
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_start").alias("low"), F.col(f"{s}_end").alias("high")) for s in SPLITS])
    return folds.select("candidate_id", F.inline(parts))


def fold_counts(df: DataFrame, day: str, rule: FoldRule) -> DataFrame:
    """candidate_id, bounds, rows by split, fold_id (accepted folds count on;
    null if rejected) and exclusion_reason."""
    folds = candidate_folds(df, day, rule)
    # Counted by day first: the interval join then meets days, not rows.
    days = df.filter(F.col(day) >= F.lit(rule.first_day).cast("date")).groupBy(F.col(day).alias("_d")).agg(F.count("*").alias("_n"))
    bounds = split_bounds(folds)
    counts = days.join(F.broadcast(bounds), F.col("_d").between(F.col("low"), F.col("high"))).groupBy("candidate_id").agg(*[F.sum(F.when(F.col("split") == s, F.col("_n")).otherwise(0)).alias(f"{s}_rows") for s in SPLITS])
    out = folds.join(counts, "candidate_id", "left").withColumns({f"{s}_rows": F.coalesce(f"{s}_rows", F.lit(0)) for s in SPLITS})
    reasons = [F.when(F.col(f"{s}_rows") < least, F.lit(f"{s}_rows < {least}")) for s, least in zip(SPLITS, (rule.least_train, rule.least_valid, rule.least_test))]
    out = out.withColumn("exclusion_reason", F.concat_ws("; ", *reasons))
    accepted = F.expr("count_if(exclusion_reason = '') OVER (ORDER BY candidate_id)")  # over the few folds
    return out.withColumn("fold_id", F.when(F.col("exclusion_reason") == "", accepted.cast("int")))


def accepted_bounds(df: DataFrame, day: str, rule: FoldRule) -> DataFrame:
    """(fold_id, split, low, high): three rows for each accepted fold."""
    folds = fold_counts(df, day, rule).filter("fold_id IS NOT NULL")
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"{s}_start").alias("low"), F.col(f"{s}_end").alias("high")) for s in SPLITS])
    return folds.select("fold_id", F.inline(parts))


def dealt(df: DataFrame, day: str, rule: FoldRule, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that folds can have (the day and the given columns), and the
    bounds of the accepted folds. Written: the rows are read for the first and
    last day, for the counts and for every use of the members, and may come
    from joins."""
    usable = written(df.filter(F.col(day) >= F.lit(rule.first_day).cast("date")).select(*dict.fromkeys([day, *columns])), "usable")
    return usable, written(accepted_bounds(usable, day, rule), "bounds")


def among(rows: DataFrame, bounds: DataFrame, day: str, columns: list[str]) -> DataFrame:
    """(fold_id, split, and the given columns) of the rows. The bounds are a
    few dozen rows, so the interval join sends them to the rows."""
    return rows.join(F.broadcast(bounds), F.col(day).between(F.col("low"), F.col("high"))).select("fold_id", "split", *columns)


def membership(df: DataFrame, day: str, rule: FoldRule, columns: list[str]) -> DataFrame:
    """(fold_id, split, and the given columns) of accepted folds."""
    return among(*dealt(df, day, rule, columns), day, columns)


def low_count_groups(members: DataFrame, group: str, least: int = 30) -> DataFrame:
    """Groups with few test rows, by fold."""
    return members.filter("split = 'test'").groupBy("fold_id", group).agg(F.count("*").alias("n")).filter(F.col("n") < least)


def missing_ids(members: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """The members that ``table`` has no row for."""
    return members.join(table.select(id_col), id_col, "left_anti")


def attach(members: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """``members`` with the columns of ``table``; ValueError if it lacks one."""
    lost = missing_ids(members, table, id_col)
    if not lost.isEmpty():
        raise ValueError(f"no row for {id_col} {lost.first()[id_col]} and {lost.count() - 1} others")
    return members.join(table, id_col)
