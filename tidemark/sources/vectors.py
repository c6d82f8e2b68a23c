"""Text embedding and reranking through pluggable backends, with a cache of
vectors by model and text hash."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordering import positions
from tidemark.sources.files import load_json, optional, save_json


class EmbeddingBackend(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class RerankerBackend(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


class HashingBackend:
    """Signed counts of hashed words, normalised: deterministic, offline."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, make_backend: Callable[[], EmbeddingBackend], batch: int = 64) -> DataFrame:
    """(text_sha, embedding) for each distinct text; the backend is made once
    for each task."""
    distinct = df.select(F.sha2(text, 256).alias("text_sha"), F.col(text).alias("_text")).filter("_text IS NOT NULL").dropDuplicates(["text_sha"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"text_sha": part["text_sha"], "embedding": list(np.asarray(backend.encode(part["_text"].tolist()), dtype=np.float32))})

    return distinct.mapInPandas(run, "text_sha string, embedding array<float>")


def embed_cached(df: DataFrame, text: str, make_backend: Callable[[], EmbeddingBackend], cache: str, model: str = "default") -> DataFrame:
    """``df`` with an embedding column. Texts that the Parquet cache lacks for
    this ``model`` are embedded and appended to it; a changed text has a new
    hash, and each model has its own vectors."""
    spark = df.sparkSession
    have = optional(spark, cache)
    keyed = df.withColumn("text_sha", F.sha2(text, 256))
    missing = df if have is None else keyed.join(have.filter(F.col("model") == model).select("text_sha"), "text_sha", "left_anti")
    embed(missing, text, make_backend).withColumn("model", F.lit(model)).write.mode("append").partitionBy("model").parquet(cache)
    # Two runs at once may both have embedded a text; one of its vectors counts.
    own = spark.read.parquet(cache).filter(F.col("model") == model).select("text_sha", "embedding").dropDuplicates(["text_sha"])
    return keyed.join(own, "text_sha", "left").drop("text_sha")


def table_identity(df: DataFrame, id_col: str, text: str, order: list[str], model: str) -> str:
    """A name for the vectors of a table: another model, text, id, number of
    rows or order of ids has another one. Rows are placed and hashed where they
    are; only sums come together."""
    placed = positions(df.select(*dict.fromkeys([*order, id_col]), F.sha2(F.coalesce(text, F.lit("")), 256).alias("_sha"), F.col(text).isNull().alias("_none")), order)
    mark = lambda seed: F.xxhash64(F.lit(seed), "position", F.col(id_col).cast("string"), "_sha", "_none")
    n, *sums = placed.agg(F.count("*"), *[F.sum(mark(i).cast("decimal(38,0)")) for i in (1, 2)]).first()
    return hashlib.sha256("|".join(map(str, (model, n, *sums))).encode()).hexdigest()


def embed_table(df: DataFrame, id_col: str, text: str, order: list[str], make_backend: Callable[[], EmbeddingBackend], cache: str, model: str = "default", force: bool = False) -> DataFrame:
    """(id_col, embedding) of every row, from the cache if it holds the vectors
    of this very table (``table_identity``), else embedded and kept there.
    ``order`` has to place all rows. Vectors count once a note of where they
    are is written, after them: runs that fail or meet leave nothing half done.
    A null text has no vector."""
    spark = df.sparkSession
    note = f"{cache}/{table_identity(df, id_col, text, order, model)}"
    if not force:
        try:
            return spark.read.parquet(load_json(spark, note)[0]["path"])
        except FileNotFoundError:
            pass
    path = f"{cache}/vectors-{uuid.uuid4().hex}"
    keyed = df.select(id_col, F.sha2(text, 256).alias("text_sha"))
    keyed.join(embed(df, text, make_backend), "text_sha", "left").select(id_col, "embedding").write.parquet(path)
    save_json(spark, {"path": path, "model": model}, note)
    return spark.read.parquet(path)


class OverlapReranker:
    """Share of the words of either text that both have."""

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in pairs]
        return np.array([len(a & b) / max(1, len(a | b)) for a, b in sets], dtype=float)


def score_pairs(pairs: DataFrame, left: str, right: str, make_backend: Callable[[], RerankerBackend], batch: int = 64) -> DataFrame:
    """``pairs`` with the backend's score of two text columns, in batches; the
    backend is made once for each task, and a null text counts as empty."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = make_backend()
        for rows in batches:
            texts = [[t or "" for t in rows.column(rows.schema.get_field_index(c)).to_pylist()] for c in (left, right)]
            both = list(zip(*texts))
            scores = [np.asarray(backend.score(both[i : i + batch]), dtype=float) for i in range(0, len(both), batch)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.concatenate(scores) if scores else np.empty(0))], [*rows.schema.names, "score"])

    return pairs.mapInArrow(run, schema)
