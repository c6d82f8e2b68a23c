"""Reading tables and cutting lineage on storage that every executor shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.scratch import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once, as Parquet in the shared checkpoint folder, and read
    it from there.

    What follows does not depend on shuffle files or on executors that may be
    lost, and a frame used several times is computed once. Unlike a checkpoint
    the files are compressed and their size is known to the planner. They stay
    until the folder is cleared, as after any job that checkpoints.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns_free(df: DataFrame, *names: str) -> list[str]:
    """Working column names that do not clash with the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        free = f"_{name}"
        while free.lower() in taken:
            free = f"_{free}"
        taken.add(free.lower())
        out.append(free)
    return out
