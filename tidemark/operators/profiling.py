"""Column profiles, value counts and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import joined_by, positions, quantiles_of
from tidemark.schema import require_columns


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, n), nulls as ``<NA>``, most frequent first, then by value."""
    out = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<NA>")).alias("value")).agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.col("n").desc(), "value").limit(top)


def _unpivoted(df: DataFrame, columns: list[str], stats: dict) -> DataFrame:
    """One aggregate over all columns, then a row for each."""
    one = df.agg(*[f(c).alias(f"_{i}_{name}") for i, c in enumerate(columns) for name, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}_{name}").alias(name) for name in stats]) for i, c in enumerate(columns)])
    return one.select(F.inline(rows))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing, missing_ratio, distinct): exact, nulls not distinct."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    return _unpivoted(df, columns, {"missing": missing, "missing_ratio": lambda c: F.avg(F.col(c).isNull().cast("double")), "distinct": lambda c: F.countDistinct(c)})


def zero_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with at most one known value."""
    return profile(df, columns).filter("distinct <= 1").select("column")


def _with_quantiles(stats: DataFrame, df: DataFrame, columns: list[str], names: dict[str, float]) -> DataFrame:
    """``stats`` by column with exact quantiles, of all columns in the same
    passes: no column's values stand in one buffer."""
    found = quantiles_of(df, columns, list(names.values()))
    return joined_by(stats, found.withColumnsRenamed({f"q{i}": n for i, n in enumerate(names)}), ["column"])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles, max by column."""
    as_double = lambda f: lambda c: f(F.col(c).cast("double"))
    stats = _unpivoted(df, columns, {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": as_double(F.min), "max": as_double(F.max)})
    quarters = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return _with_quantiles(stats, df, columns, quarters).select("column", "count", "mean", "std", "min", *quarters, "max")


def feature_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """missing, missing_ratio, min, mean, median, max by column."""
    as_double = lambda f: lambda c: f(F.col(c).cast("double"))
    stats = _unpivoted(df, columns, {"missing": lambda c: F.count_if(F.col(c).isNull()), "missing_ratio": lambda c: F.avg(F.col(c).isNull().cast("double")), "min": as_double(F.min), "mean": F.avg, "max": as_double(F.max)})
    return _with_quantiles(stats, df, columns, {"median": 0.5}).select("column", "missing", "missing_ratio", "min", "mean", "median", "max")


def id_checks(df: DataFrame, id_col: str) -> DataFrame:
    """rows, missing ids, rows beyond the first of each id, and all rows of
    ids that occur more than once."""
    n = df.groupBy(id_col).agg(F.count("*").alias("c"))
    known = F.col(id_col).isNotNull()
    return n.agg(F.sum("c").alias("rows"), F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("missing_ids"), F.coalesce(F.sum(F.when(known, F.col("c") - 1)), F.lit(0)).alias("extra_rows"), F.coalesce(F.sum(F.when(known & (F.col("c") > 1), F.col("c"))), F.lit(0)).alias("duplicated_rows"))


def leakage_check(pairs: DataFrame, day: str = "_day", other: str = "c_day", *groups: str) -> DataFrame:
    """Of pairs of dates: how many there are, how many do not lie strictly in
    the past, and PASS or FAIL."""
    return pairs.groupBy(*groups).agg(F.count("*").alias("pairs"), F.count_if(F.col(other) >= F.col(day)).alias("violations")).withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))


def sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the same in every run, in an order of hashed keys."""
    require_columns(df, [key])
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key).limit(n)


def levels(df: DataFrame, column: str) -> DataFrame:
    """(value, n, level): levels of a column numbered by frequency."""
    counts = value_counts(df, column).withColumn("_less", -F.col("n"))
    return positions(counts, ["_less", "value"]).select("value", "n", (F.col("position") + 1).cast("int").alias("level"))


def same_row_count(before: DataFrame, after: DataFrame) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise ValueError(f"row count changed: {a} before, {b} after")
