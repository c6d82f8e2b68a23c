"""Files in and out: discovery, encodings, release folders, layers, sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import require_columns, with_missing
from tidemark.sources.scratch import written
from tidemark.sources.text_csv import csv_records

CURRENT_ORDER = 999_999
# How text files may be encoded, in the order they are tried.
ENCODINGS = ("utf-8-sig", "cp950", "big5")


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, length) of files below ``root`` with the given name, whatever
    its case, outside ``@eaDir`` folders; listed by Spark, so any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.filter((base == name.lower()) & ~F.contains("path", F.lit("@eaDir"))).orderBy(F.lower("path"))


def read_text_csv(spark: SparkSession, paths: list[str], encodings=ENCODINGS) -> DataFrame:
    """Rows of CSV files, all columns strings, with provenance columns
    source_file, source_folder and row_order. Each file may have its own
    encoding (a byte order mark is dropped) and its own columns; fields may hold
    line breaks in quotes; a row with more fields than its header is left out, a
    shorter one padded with empty text. Files of any size are read by ranges,
    all in the same jobs. Lines end with a line feed; records that only a
    carriage return parts share a row_order."""
    records, heads = csv_records(spark, paths, encodings)
    heads = written(heads.filter("head_at >= 0"), "heads")
    layouts = [header_names(r["names"]) for r in heads.groupBy("names").agg(F.min("path").alias("path")).orderBy("path").collect()]  # one row for each layout
    names = list(dict.fromkeys(n for layout in layouts for n in layout))
    trimmed = F.udf(lambda names: header_names(names), "array<string>")  # once for each file
    heads = heads.select("path", "head_at", trimmed("names").alias("names"))
    rows = records.join(heads, "path").withColumn("row_order", (F.col("record") - F.col("head_at")).cast("int")).filter("row_order > 0 AND size(fields) > 0 AND size(fields) <= size(names)")
    value = lambda n: F.when(F.array_contains("names", n), F.coalesce(F.get("fields", (F.array_position("names", n) - 1).cast("int")), F.lit("")))
    return rows.select(*[value(n).alias(n) for n in names], F.col("path").alias("source_file"), F.element_at(F.split("path", "/"), -2).alias("source_folder"), "row_order")


def header_names(fields: list[str]) -> list[str]:
    """Trimmed names; a repeated one gets .1, .2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in (f.strip().lstrip("﻿") for f in fields):
        seen[name] = seen.get(name, -1) + 1
        out.append(name if seen[name] == 0 else f"{name}.{seen[name]}")
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def release(folder):
    """(source_release, source_order) of a release folder name column: era year
    and quarter, the current one last, others in front."""
    year, quarter = F.regexp_extract(folder, r"(\d{2,3})\D*?[年第]?\s*[QqSs第]?\s*([1-4])", 1), F.regexp_extract(folder, r"(\d{2,3})\D*?[年第]?\s*[QqSs第]?\s*([1-4])", 2)
    known = year != ""
    name = F.when(F.contains(folder, F.lit("本期")), "CURRENT").when(known, F.concat(year, F.lit("Q"), quarter)).otherwise(folder)
    order = F.when(F.contains(folder, F.lit("本期")), CURRENT_ORDER).when(known, F.concat(year, quarter).try_cast("int")).otherwise(0)
    return name, order


def read_layer(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None, required: list[str] = ()) -> DataFrame:
    """A Parquet layer; only ``columns`` that it has, if given."""
    df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
    require_columns(df, required)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema`` in order: missing ones null, values
    that do not fit null."""
    df = with_missing(df, [f.name for f in schema])
    return df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema])


def read_csv_layer(spark: SparkSession, path: str, schema: T.StructType, required: list[str] = ()) -> DataFrame:
    """A layer that was written as CSV, with the columns and types of
    ``schema``; values that do not fit are null."""
    df = spark.read.option("header", True).csv(path)
    require_columns(df, required)
    return with_schema(df, schema)


def write_layer(df: DataFrame, path: str, csv_path: str | None = None, partition_by: list[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    if csv_path:
        df.write.mode("overwrite").option("header", True).csv(csv_path)


def write_both(df: DataFrame, base: str, **parquet_options) -> DataFrame:
    """``df`` as ``base``.parquet, as far as that can be done, and as ``base``.csv
    in any case; (path, format, status, error) of both."""
    error = ""
    try:
        df.write.mode("overwrite").options(**parquet_options).parquet(f"{base}.parquet")
    except PySparkException as e:
        error = str(e).split("\n")[0]
    df.write.mode("overwrite").option("header", True).csv(f"{base}.csv")
    rows = [(f"{base}.parquet", "parquet", "failed" if error else "ok", error), (f"{base}.csv", "csv", "ok", "")]
    return df.sparkSession.createDataFrame(rows, "path string, format string, status string, error string")


def save_json(spark: SparkSession, value: dict, *paths: str) -> None:
    """A small document as one text file in each of the folders."""
    text = json.dumps(value, ensure_ascii=False, indent=2)
    for path in paths:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, *paths: str) -> tuple[dict, str]:
    """The document of the first of the folders that is there, and its path."""
    for path in paths:
        try:
            return json.loads(spark.read.text(path, wholetext=True).first()[0]), path
        except PySparkException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {', '.join(paths)} is there")


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none at the path."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def markdown(df: DataFrame, top: int = 100) -> str:
    """A small table as Markdown; ``top`` rows of it."""
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in df.limit(top).collect()])
