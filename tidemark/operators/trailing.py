"""Strictly-past statistics over day ranges, and similarity search in them.

Rows are dealt by group and by slices of time as wide as the longest window: a
row looks back into its own slice and the one before, so each row is sent to
its own slice and to the next. A large group is thus many tasks, and what is too
much for one is counted first (``range_medians``). Searches are pairs of blocks of rows
(``nearest``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalars as S
from tidemark.operators.nearest import Finish, cosine, nearest, nearest_lists, sliced, weighted_distance
from tidemark.operators.ordering import joined_by
from tidemark.operators.range_medians import range_medians
from tidemark.schema import group_key, require_columns
from tidemark.sources.scratch import written

EPSILON = 1e-6
#: Rows of a slice that a task takes as they are.
LARGE = 65_536


def trailing_stats(df: DataFrame, keys: list[str], id_col: str, day: str, value: str, windows: list[int], prefix: str) -> DataFrame:
    """(id_col, and for each window of N days median and count) of finite
    values in [t - N, t) in the same group; same-day rows are left out. No
    row in the range, or no date: count 0, median null. Null keys are a group.
    Groups with a slice of more than ``LARGE`` rows are counted by day and
    bucket of values instead (``range_medians``), and looked up by day."""
    require_columns(df, [*keys, id_col, day, value])
    width = max(windows)
    rows = sliced(df.select(id_col, day, group_key(*keys).alias("_g"), F.col(value).cast("double").alias("_v")), day, width)
    sizes = rows.filter("_day IS NOT NULL").groupBy("_g", "_own").agg(F.count("*").alias("_rows"))
    large = written(sizes.filter(F.col("_rows") > LARGE).select("_g").distinct(), "large")
    counted = None
    if not large.isEmpty():
        own = rows.filter("_day IS NOT NULL").join(large, "_g", "left_semi")
        medians = range_medians(own.select("_g", "_day", "_v"), windows, width).groupBy("_g", "_day")
        medians = medians.agg(*[F.max(F.when(F.col("days") == n, F.col(what))).alias(f"{prefix}_{what}_{n}d") for n in windows for what in ("median", "count")])
        counted = joined_by(own.select(id_col, "_g", "_day"), medians, ["_g", "_day"]).select(id_col, *[(F.coalesce(f"{prefix}_count_{n}d", F.lit(0).cast("long")) if what == "count" else F.col(f"{prefix}_median_{n}d")).alias(f"{prefix}_{what}_{n}d") for n in windows for what in ("median", "count")])
        rows = rows.join(large, "_g", "left_anti")
    dealt = rows.withColumn("_slice", F.explode(F.array("_own", F.col("_own") + 1)))
    names = [f"{prefix}_{what}_{n}d" for n in windows for what in ("median", "count")]
    schema = T.StructType([df.schema[id_col], *[T.StructField(n, T.DoubleType() if "_median_" in n else T.LongType()) for n in names]])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_day", kind="stable")
        ask = group[group["_own"] == group["_slice"]]
        good = group[np.isfinite(group["_v"].to_numpy(float))]
        days, values = good["_day"].to_numpy(), good["_v"].to_numpy(float)
        each, place = np.unique(ask["_day"].to_numpy(), return_inverse=True)
        out = {id_col: ask[id_col].to_numpy()}
        for n in windows:
            low, high = np.searchsorted(days, each - n), np.searchsorted(days, each)
            median = np.array([np.median(values[a:b]) if b > a else np.nan for a, b in zip(low, high)])
            out[f"{prefix}_median_{n}d"] = pd.Series(median[place]).astype("Float64").where(~np.isnan(median[place]), None) if len(place) else []
            out[f"{prefix}_count_{n}d"] = (high - low)[place]
        return pd.DataFrame(out, columns=schema.names)

    undated = df.filter(F.col(day).isNull()).select(id_col, *[F.lit(0 if "_count_" in n else None).cast(schema[n].dataType).alias(n) for n in names])
    out = dealt.filter(F.col("_day").isNotNull()).groupBy("_g", "_slice").applyInPandas(run, schema).unionByName(undated)
    return out if counted is None else out.unionByName(counted)


def trailing_stats_window(df: DataFrame, keys: list[str], id_col: str, day: str, value: str, windows: list[int], prefix: str) -> DataFrame:
    """The same by window frames: plain SQL, for groups of moderate size."""
    rows = df.withColumn("_day", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    out = [F.col(id_col)]
    for n in windows:
        w = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-n, -1)
        out += [F.percentile(value, F.lit(0.5)).over(w).alias(f"{prefix}_median_{n}d"), F.count(value).over(w).alias(f"{prefix}_count_{n}d")]
    return rows.select(*out)


_ALIKE = ["area", "age", "floor_ratio", "has_parking"]


def _comparables(sales: DataFrame, keys: list[str], window: int, k: int, wanted: list[str], finish: Finish | None = None) -> tuple[DataFrame, DataFrame]:
    """The sales with their day and ``_class``, and of each class of them the k
    nearest (``near``: distance, c_day and the wanted columns). Sales of one
    group and day that are alike in all that the distance knows have the same
    comparables: one of them asks. Of candidates that are alike only the k of
    smallest id can be among k."""
    columns = ["sale_id", "price", *_ALIKE]
    require_columns(sales, [*keys, "trade_date", *columns])
    days = sliced(sales.select(*dict.fromkeys([*keys, "trade_date", *columns])), "trade_date", window).drop("_own")
    usable = F.col("price").isNotNull() & ~F.isnan(F.col("price").cast("double"))
    first = Window.partitionBy(*keys, "_day", *_ALIKE).orderBy(F.when(usable, 0).otherwise(1), F.asc_nulls_last("sale_id"))
    # Rows of a class stand one after the other: the place of its first one names it.
    placed = days.withColumn("_n", F.row_number().over(first)).withColumn("_class", F.monotonically_increasing_id() - F.col("_n") + 1)
    # Written: read for those who ask, for the candidates and for the join with the result.
    rows = written(placed, "comparables")
    few = rows.filter("_day IS NOT NULL").filter((F.col("_n") == 1) | usable & (F.col("_n") <= k))
    found = nearest_lists(few, keys, "sale_id", "trade_date", window, ["_class", *columns], k, usable, weighted_distance(window), F.col("_n") == 1, wanted, finish)
    return rows.drop("_n"), found


def comparable_pairs(sales: DataFrame, keys: list[str], window: int, k: int = 10, also: tuple[str, ...] = ("price", *_ALIKE)) -> DataFrame:
    """The k nearest earlier sales of each sale within ``window`` days, by
    weighted distance, then latest date, then smallest id. Candidates without
    a finite price are left out before ranking. ``also`` names the columns of
    the candidates (``c_``) that are wanted beside their id and day."""
    rows, found = _comparables(sales, keys, window, k, ["sale_id", *also])
    pairs = rows.join(found.select("_class", "near"), "_class").drop("_class").select(*[c for c in rows.columns if c != "_class"], F.posexplode("near").alias("rank", "_near"))
    pairs = pairs.select(*[c for c in pairs.columns if c != "_near"], "_near.*")
    return pairs.withColumns({"rank": F.col("rank") + 1, "days_diff": F.col("_day") - F.col("c_day")})


_STATISTICS = ["median_price", "mean_price", "weighted_mean_price", "std_price", "nearest_price", "nearest_distance", "median_distance", "median_days_diff", "median_area_diff_pct", "median_age_diff"]


def _row_medians(values: np.ndarray, known: np.ndarray) -> pa.Array:
    """The median of the known values of each row, null if there are none; a
    NaN among them is greater than all."""
    rows, n = np.sort(np.where(known, values, np.nan), axis=1), known.sum(axis=1)
    low, high = (rows[np.arange(len(rows)), np.maximum(place, 0)] for place in ((n - 1) // 2, n // 2))
    return pa.array(low + (high - low) / 2, mask=n == 0)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statistics of the lists of comparables of each row."""
    for batch in batches:
        near, n = batch["near"].flatten(), np.asarray(batch["near"].value_lengths().fill_null(0)).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        there = (row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))

        def laid(column: pa.Array, shape=(len(n), int(n.max(initial=1))), there=there) -> tuple[np.ndarray, np.ndarray]:
            values, known = np.full(shape, np.nan), np.zeros(shape, bool)
            values[there], known[there] = column.cast(pa.float64()).to_numpy(zero_copy_only=False), np.asarray(column.is_valid())
            return values, known

        (price, _), (distance, known), (day, _) = (laid(near.field(c)) for c in ("c_price", "distance", "c_day"))
        own = {c: (batch[c].cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None], np.asarray(batch[c].is_valid())[:, None]) for c in ("_day", "area", "age")}
        apart = {c: (np.abs(v - own[c][0]), k & own[c][1]) for c in ("area", "age") for v, k in [laid(near.field(f"c_{c}"))]}
        weight = np.where(known, 1.0 / (distance + EPSILON), 0.0)
        added = lambda x, known=known: np.where(known, x, 0.0).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = added(price) / n
            each = [mean, added(weight * price) / added(weight), np.sqrt(added((price - mean[:, None]) ** 2) / n), price[:, 0], distance[:, 0]]
            by_area = apart["area"][0] / np.maximum(own["area"][0], 1.0)
        columns = [_row_medians(price, known), *[pa.array(v, mask=n == 0) for v in each], _row_medians(distance, known), _row_medians(own["_day"][0] - day, known), _row_medians(by_area, apart["area"][1]), _row_medians(*apart["age"])]
        yield pa.RecordBatch.from_arrays([batch["_class"], pa.array(n), *columns], ["_class", "comp_count", *[f"comp_{c}" for c in _STATISTICS]])


def comparable_summary(sales: DataFrame, keys: list[str], window: int, k: int = 10) -> DataFrame:
    """One row per sale: eleven statistics of its k comparables."""
    schema = T.StructType([T.StructField("_class", T.LongType()), T.StructField("comp_count", T.LongType()), *[T.StructField(f"comp_{c}", T.DoubleType()) for c in _STATISTICS]])
    rows, stats = _comparables(sales, keys, window, k, ["sale_id", "price", "area", "age"], (_summaries, schema))
    found = rows.select("_class", "sale_id").join(stats, "_class", "left").drop("_class")
    return found.withColumn("comp_count", F.coalesce("comp_count", F.lit(0)))


def without_comparables(sales: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(sales, missing): how many sales there are, and how many have no
    candidate in the ``window`` days before them. Sales are counted by group
    and day first; each such day looks for the last day before it that has one."""
    require_columns(sales, [*keys, "trade_date", "price"])
    usable = F.col("price").isNotNull() & ~F.isnan(F.col("price").cast("double"))
    number = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    days = sales.groupBy(*keys, number.alias("_day")).agg(F.count("*").alias("n"), F.max(usable).alias("_usable"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("_day")).rowsBetween(Window.unboundedPreceding, -1)  # no more rows than days
    last = F.max(F.when(F.col("_usable"), F.col("_day"))).over(before)
    lacks = F.coalesce(F.col("_day") - last > window, F.lit(True))
    return days.select("n", lacks.alias("_lacks")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sales"), F.coalesce(F.sum(F.when(F.col("_lacks"), F.col("n"))), F.lit(0)).alias("missing"))


def vector_pairs(df: DataFrame, keys: list[str], id_col: str, day: str, vector: str, window: int, k: int, extra: list[str] = ()) -> DataFrame:
    """The k most similar earlier rows by cosine, then earliest, then smallest
    id. Pairs without a cosine (no vector, other lengths, unknown parts) come last."""
    pairs = nearest(df, keys, id_col, day, window, [id_col, vector, *extra], k, F.lit(True), cosine(vector))
    similarity = S.cosine(F.col(vector), F.col(f"c_{vector}"))
    pairs = pairs.withColumn("similarity", F.round(F.when(~F.isnan(similarity), similarity), 9)).drop(vector, f"c_{vector}")
    w = Window.partitionBy("_g", "_slice", id_col).orderBy(F.col("similarity").desc(), "c_day", f"c_{id_col}")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rerank(pairs: DataFrame, id_col: str, score, k: int) -> DataFrame:
    """The k best of candidate pairs by another score, then by their first rank."""
    w = Window.partitionBy("_g", "_slice", id_col).orderBy(F.col("score").desc(), "rank")
    return pairs.withColumn("score", score).withColumn("score_rank", F.row_number().over(w)).filter(F.col("score_rank") <= k)


def softmax(score: str, *keys: str):
    """Shifted softmax of a column within its group."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)


def vector_summary(pairs: DataFrame, id_col: str, price: str, reranked: bool = False) -> DataFrame:
    """Fourteen statistics of each row's selected candidates; candidates without
    a finite price are left out only now. ``pairs`` also has area, age and those
    of the candidates. Weights: softmax of the scores if
    reranked, else similarities from 0 up."""
    good = pairs.filter(F.col(price).isNotNull() & ~F.isnan(price))
    keys = ["_g", "_slice", id_col]
    good = good.withColumn("_w", softmax("score", *keys) if reranked else F.greatest("similarity", F.lit(0.0)) + EPSILON)
    order = "score_rank" if reranked else "rank"
    score = (F.avg("score"), F.max("score")) if reranked else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    area = F.when(F.col("area").isNotNull() & F.col("c_area").isNotNull(), F.abs(F.col("c_area") - F.col("area")) / F.greatest("area", F.lit(1.0)))
    return good.groupBy(*keys).agg(
        F.count("*").alias("emb_count"), F.median(price).alias("emb_median_price"), F.avg(price).alias("emb_mean_price"), (F.sum(F.col("_w") * F.col(price)) / F.sum("_w")).alias("emb_weighted_mean_price"), F.stddev_pop(price).alias("emb_std_price"),
        F.min_by(price, order).alias("emb_nearest_price"), F.max("similarity").alias("emb_max_similarity"), F.avg("similarity").alias("emb_mean_similarity"), F.median("similarity").alias("emb_median_similarity"),
        score[0].alias("emb_mean_reranker_score"), score[1].alias("emb_max_reranker_score"), F.median("days_diff").alias("emb_median_days_diff"), F.median(area).alias("emb_median_area_diff_pct"), F.median(F.abs(F.col("c_age") - F.col("age"))).alias("emb_median_age_diff"),
    ).drop("_g", "_slice")
