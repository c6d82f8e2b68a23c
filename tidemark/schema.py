"""Column checks and null normalisation shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names) -> None:
    """Raise ValueError naming every column that is absent."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def nan_to_null(df: DataFrame, *names: str) -> DataFrame:
    """NaN and infinities become null: downstream statistics are over finite values."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in names}
    return df.withColumns(finite)


def with_missing(df: DataFrame, names, kind: str = "string") -> DataFrame:
    """Add absent columns as nulls; extra columns stay."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in names if c not in df.columns})


def group_key(*keys: str):
    """One value for a group, in which null is a value like any other."""
    return F.struct(*[F.col(k) for k in keys])
