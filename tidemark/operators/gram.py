"""Sums of products of many columns: correlations and ridge from block matrices.

Rows are multiplied in Arrow batches, a matrix product for each group in them;
what leaves a task is a row of sums for each group and column, added up by
shuffle. The plan does not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.boosting import MISSING, Layout, layout
from tidemark.sources.scratch import written

_SUMS = "key int, i int, sums array<double>"
_SUMS_ARROW = pa.schema([("key", pa.int32()), ("i", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _emitted(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [{"key": key, "i": i, "sums": row} for key, total in held.items() for i, row in enumerate(total)]
    return pa.RecordBatch.from_pylist(rows, _SUMS_ARROW)


def _added(table: pa.Table) -> pa.Table:
    """Sums of one group and column over all tasks, in order of size, so that
    they do not depend on the order of the tasks."""
    rows = np.stack([np.asarray(v.values) for v in table["sums"]])
    return pa.Table.from_pylist([{"key": table["key"][0].as_py(), "i": table["i"][0].as_py(), "sums": np.sort(rows, axis=0).sum(axis=0)}], _SUMS_ARROW)


def _totals(parts: DataFrame) -> dict[int, np.ndarray]:
    """Matrices of sums by group: a row for each group and column."""
    found: dict[int, dict[int, list]] = {}
    for r in parts.groupBy("key", "i").applyInArrow(_added, _SUMS).collect():
        found.setdefault(r["key"], {})[r["i"]] = r["sums"]
    return {key: np.array([rows[i] for i in sorted(rows)]) for key, rows in found.items()}


# ---- correlations -------------------------------------------------------------------------------------------


def _pairwise(batches: Iterator[pa.RecordBatch], columns: list[str], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each column i, and each j, over the rows where both are known: how
    many there are, sums of i and j, of their squares and of their products."""
    k = len(columns)
    total = np.zeros((k, 6 * k))
    for batch in batches:
        x = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in columns], axis=1) - shift
        known = ~np.isnan(x)
        x, mask = np.where(known, x, 0.0), known.astype(float)
        square = x * x
        total += np.concatenate([mask.T @ mask, x.T @ mask, mask.T @ x, square.T @ mask, mask.T @ square, x.T @ x], axis=1)
    yield _emitted({0: total})


_PAIRS_ARROW = pa.schema([("left", pa.string()), ("right", pa.string()), ("corr", pa.float64())])


def _correlated(columns: list[str]):
    def task(table: pa.Table) -> pa.Table:
        added = _added(table)
        i, sums = added["i"][0].as_py(), np.asarray(added["sums"][0].values)
        n, si, sj, qi, qj, p = sums.reshape(6, -1)
        # What differs from 0 by rounding is the spread of a column that does not vary.
        spread = [np.where(v > 1e-12 * n * q, v, 0.0) for v, q in ((n * qi - si * si, qi), (n * qj - sj * sj, qj))]
        both = np.sqrt(spread[0] * spread[1])
        corr = np.divide(n * p - si * sj, both, out=np.full(len(n), np.nan), where=both > 0)
        later = range(i + 1, len(columns))
        return pa.table([[columns[i]] * len(later), [columns[j] for j in later], pa.array([None if np.isnan(corr[j]) else float(corr[j]) for j in later], pa.float64())], schema=_PAIRS_ARROW)

    return task


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, corr): Pearson correlations of all pairs of columns, each
    over the rows where both are known (null and NaN are unknown); null where a
    side does not vary."""
    slim = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    means = slim.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(columns)]).first()
    shift = np.array([m or 0.0 for m in means])
    parts = slim.mapInArrow(partial(_pairwise, columns=list(columns), shift=shift), _SUMS)
    return parts.groupBy("key", "i").applyInArrow(_correlated(list(columns)), "left string, right string, corr double")


# ---- ridge --------------------------------------------------------------------------------------------------


def _design(batch: pa.RecordBatch, lay: Layout, fold: int, at: np.ndarray, medians: np.ndarray) -> np.ndarray:
    """Numbers less the fold's medians (0 where missing), then a column for each level."""
    n, k = len(at), len(lay.numeric)
    sizes = [len(x) for x in lay.levels]
    x = np.zeros((n, k + sum(sizes)))
    for i, c in enumerate(lay.numeric):
        x[:, i] = np.nan_to_num(batch[f"_n_{c}"].to_numpy(zero_copy_only=False)[at] - medians[i], nan=0.0)
    start = k
    for j, (c, levels) in enumerate(zip(lay.categorical, lay.levels, strict=True)):
        place = {level: i for i, level in enumerate(levels)}
        fill = int(lay.fill[fold][k + j])
        codes = np.array([fill if v is None else place.get(v, MISSING) for v in batch[f"_c_{c}"].take(pa.array(at)).to_pylist()], np.int64)
        seen = np.flatnonzero(codes < len(levels))
        x[seen, start + codes[seen]] = 1.0
        start += len(levels)
    return x


def _folds(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    folds = np.asarray(batch["fold_id"])
    for fold in np.unique(folds):
        yield int(fold), np.flatnonzero(folds == fold)


def _normal(batches: Iterator[pa.RecordBatch], lay: Layout, medians: dict[int, np.ndarray], starts: dict[int, float]) -> Iterator[pa.RecordBatch]:
    """By fold the products of design, label less its mean, and 1."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        y = np.asarray(batch["_y"])
        for fold, at in _folds(batch):
            x = np.column_stack([_design(batch, lay, fold, at, medians[fold]), y[at] - starts[fold], np.ones(len(at))])
            held[fold] = held.get(fold, 0.0) + x.T @ x
    yield _emitted(held)


def _predicted(batches: Iterator[pa.RecordBatch], lay: Layout, medians: dict[int, np.ndarray], weights: dict[int, tuple[np.ndarray, np.ndarray]], alphas: list[float], keep: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fold, at in _folds(batch):
            if fold not in weights:
                continue
            w, b = weights[fold]
            p = _design(batch, lay, fold, at, medians[fold]) @ w + b
            own = batch.select(keep).take(pa.array(at))
            for j, alpha in enumerate(alphas):
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*own.columns, pa.array(np.full(len(at), alpha)), pa.array(p[:, j])], schema.types, strict=True)], schema=schema)


def ridge_by_fold(members: DataFrame, features: list[str], label: str, alphas: list[float], categorical: list[str] = ()) -> DataFrame:
    """Ridge models of all folds and penalties at once: the rows of ``members``
    that are not for training, with alpha and prediction.

    Numbers take the training median where missing and are standardised;
    missing levels are the most frequent one, each level of training is a
    column, and others are none of them. The penalty is on all columns but the
    intercept. By fold one matrix of sums comes to the driver to be solved.
    """
    members = members.withColumn("fold_id", F.col("fold_id").cast("int"))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    named = {f"_n_{c}": number(c) for c in features} | {f"_c_{c}": F.col(c).cast("string") for c in categorical} | {"_y": number(label)}
    rows = written(members.withColumns(named), "ridge")
    train = rows.filter("split = 'train' AND _y IS NOT NULL")
    lay, medians = layout(rows.withColumns({c: F.col(f"_n_{c}") for c in features}), list(features), list(categorical), bins=1)
    medians = {fold: np.array([medians.get(fold, {}).get(c, 0.0) for c in features]) for fold in lay.fill}
    starts = {r["fold_id"]: r["y"] for r in train.groupBy("fold_id").agg(F.avg("_y").alias("y")).collect()}  # folds
    slim = train.select("fold_id", "_y", *[c for c in named if c != "_y"])
    k, weights = len(features), {}
    for fold, sums in _totals(slim.mapInArrow(partial(_normal, lay=lay, medians=medians, starts=starts), _SUMS)).items():
        gram, n = sums[:-1, :-1], sums[-1, -1]
        mean = sums[-1, :-1] / n
        gram = gram - n * np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(gram)[:k] / n, 0.0))
        spread = np.where(spread > 1e-9 * (1 + np.abs(mean[:k])), spread, np.inf)  # what does not vary has no weight
        scale = np.concatenate([1 / spread, np.ones(len(mean) - 1 - k)])
        z = gram[:-1, :-1] * np.outer(scale, scale)
        w = np.stack([np.linalg.lstsq(z + a * np.eye(len(z)), gram[:-1, -1] * scale, rcond=None)[0] * scale for a in alphas], axis=1)
        weights[fold] = (w, starts[fold] + mean[-1] - mean[:-1] @ w)
    schema = T.StructType([*[rows.schema[c] for c in members.columns], T.StructField("alpha", T.DoubleType()), T.StructField("prediction", T.DoubleType())])
    return rows.filter("split <> 'train'").mapInArrow(partial(_predicted, lay=lay, medians=medians, weights=weights, alphas=[float(a) for a in alphas], keep=members.columns, schema=to_arrow_schema(schema)), schema)
