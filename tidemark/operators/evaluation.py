"""Median baselines for all folds at once, and relations that judge predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators.gram import correlations
from tidemark.operators.ordering import counted_before, joined_by, quantiles
from tidemark.sources.scratch import written

PRICE_EDGES = (0, 50, 80, 120)
PRICE_LABELS = ("0-50", "50-80", "80-120", "120+")


def median_baselines(members: DataFrame, levels: dict[str, list[str]], target: str, keep: list[str], train: DataFrame | None = None, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fold_id, split, keep..., y_true, y_pred, model_name): for each named
    level the training median of its keys, with the medians of ever fewer keys
    and at last of all rows where a group was not seen. No loop over folds.
    ``train`` are the training rows (fold_id, keys, target and how many times a
    row counts, _n) if they are known already. With ``deal`` they have not yet a
    fold_id: it repeats rows, or counts of them, for the folds that they are in.
    They are then read three times, so they should come from a table."""
    prefixes: dict[tuple, str] = {(): "m_all"}
    for keys in levels.values():
        for n in range(1, len(keys) + 1):
            prefixes.setdefault(tuple(keys[:n]), "m_" + "_".join(keys[:n]))
    # All levels are groups of one pass: a row stands in each with the keys of that level.
    every = list(dict.fromkeys(k for own in prefixes for k in own))
    grouped = F.array(*[F.struct(F.lit(name).alias("_level"), *[(F.col(k) if k in own else F.lit(None).cast(members.schema[k].dataType)).alias(k) for k in every]) for own, name in prefixes.items()])
    if train is None:
        train = members.filter("split = 'train'").select("fold_id", *every, target, F.lit(1).alias("_n"))

    def spread(rows: DataFrame) -> DataFrame:
        rows = deal(rows) if deal else rows
        return rows.select(*[c for c in rows.columns if c not in every], F.inline(grouped))

    found = quantiles(train, target, [0.5], "fold_id", "_level", *every, weight="_n", spread=spread, kept=deal is not None)
    found = written(found, "medians")
    out = members
    for own, name in prefixes.items():
        level = found.filter(F.col("_level") == name).select("fold_id", *own, F.col("q0").alias(name))
        out = joined_by(out, level, ["fold_id", *own], "left" if own else "inner")
    models = [F.struct(F.lit(name).alias("model_name"), F.coalesce(*[F.col(prefixes[tuple(keys[:n])]) for n in range(len(keys), 0, -1)], "m_all").alias("y_pred")) for name, keys in levels.items()]
    return out.select("fold_id", "split", *keep, F.col(target).alias("y_true"), F.inline(F.array(*models)))


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("y_pred") - F.col("y_true")
    return predictions.withColumns({"error": error, "abs_error": F.abs(error), "ape": F.when(F.col("y_true") != 0, F.abs(error / F.col("y_true")) * 100)})


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) != float("inf"))


def regression_metrics(predictions: DataFrame, *groups: str, median: bool = True) -> DataFrame:
    """n, mae, rmse, mape, median_ae, r2, bias by group over finite pairs; mape
    leaves out zeros, r2 is null where the truth does not vary. Without
    ``median`` no median_ae, which takes passes of its own: the rest is one
    aggregate."""
    good = with_errors(predictions.filter(_finite("y_true") & _finite("y_pred"))).select(*groups, "y_true", "error", "abs_error", "ape")
    square = F.sum(F.pow("error", F.lit(2)))
    spread = F.var_pop("y_true") * F.count("*")
    sums = good.groupBy(*groups).agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.pow("error", F.lit(2)))).alias("rmse"), F.avg("ape").alias("mape"), F.when(spread > 0, 1 - square / spread).alias("r2"), F.avg("error").alias("bias"))
    if not median:
        return sums
    out = joined_by(sums, quantiles(good, "abs_error", [0.5], *groups).withColumnRenamed("q0", "median_ae"), list(groups))
    return out.select(*groups, "n", "mae", "rmse", "mape", "median_ae", "r2", "bias")


def rollup(metrics: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Folds, and mean and sample deviation of each metric over them."""
    return metrics.groupBy(*keys).agg(F.countDistinct("fold_id").alias("folds"), *[f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def segment_metrics(predictions: DataFrame, value: str = "y_true") -> DataFrame:
    """Metrics by price segment; segments without rows have n = 0."""
    found = regression_metrics(predictions.withColumn("segment", S.segment(F.col(value), PRICE_EDGES, PRICE_LABELS)), "segment")
    names = predictions.sparkSession.createDataFrame([(i, s) for i, s in enumerate(PRICE_LABELS)], "segment_order int, segment string")
    return names.join(found, "segment", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rank_correlation(df: DataFrame, x: str, y: str, *groups: str) -> DataFrame:
    """n, pearson, spearman (average ranks) by group; null for n < 2 and where
    one of the two does not vary."""
    # Written: the pairs are read for the sums, for each rank and for the join with one of them.
    good = written(df.filter(_finite(x) & _finite(y)).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(x).alias("_x"), F.col(y).alias("_y")), "pairs")
    keys = [f"_g{i}" for i in range(len(groups))]
    within = lambda r: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))  # noqa: E731  not above 1 by rounding
    spread = F.var_pop("_x") * F.var_pop("_y")
    out = good.groupBy(*keys).agg(F.count("*").alias("n"), F.when(spread > 0, within(F.covar_pop("_x", "_y") / F.sqrt(spread))).alias("pearson"))
    # The mean rank of a value, less the mean of all ranks, from counts: no task sorts a whole group.
    from_mean = F.col("before") + (F.col("n") - F.col("total")) / 2
    own = written(counted_before(good, keys, "_y").select(*keys, F.col("_y").alias("_v"), "n", from_mean.alias("_ry")), "ranks")
    match = good["_y"] == own["_v"]
    for k in keys:
        match &= good[k].eqNullSafe(own[k])
    ranked = good.join(own, match).select(*[good[k] for k in keys], "_x", "_ry")
    # Pairs of equal x have one rank there, so the sum of their other ranks is enough: they are not joined with it.
    values = counted_before(ranked, keys, "_x", also={"_sum": F.sum("_ry")}).withColumn("_rx", from_mean)
    out = joined_by(out, values.groupBy(*keys).agg(F.sum(F.col("_rx") * F.col("_sum")).alias("_xy"), F.sum(F.col("n") * F.col("_rx") * F.col("_rx")).alias("_xx")), keys)
    out = joined_by(out, own.groupBy(*keys).agg(F.sum(F.col("n") * F.col("_ry") * F.col("_ry")).alias("_yy")), keys)
    spread = F.col("_xx") * F.col("_yy")
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], "n", "pearson", F.when(spread > 0, within(F.col("_xy") / F.sqrt(spread))).alias("spearman"))


def correlation_pairs(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(left, right, corr) of column pairs over rows where both are known, from
    one pass of matrix products; pairs with a smaller absolute value are left out."""
    return correlations(df, columns).filter(F.abs("corr") >= least)


def shares(df: DataFrame, group: str, value: str) -> DataFrame:
    """Total by group, its share of all, and its competition rank."""
    every = Window.partitionBy(F.lit(1))
    totals = df.groupBy(group).agg(F.sum(value).alias("total"))
    return totals.withColumns({"share": F.col("total") / F.sum("total").over(every), "rank": F.rank().over(every.orderBy(F.col("total").desc()))})


def top_errors(predictions: DataFrame, n: int, id_col: str, *groups: str) -> DataFrame:
    """The n worst predictions below and above the truth, of each group."""
    rows = with_errors(predictions)

    def worst(side: str, *order) -> DataFrame:
        if not groups:
            return rows.orderBy(*order).limit(n).withColumn("side", F.lit(side))
        # Spark keeps the first n of each group in each task before it exchanges them.
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return rows.withColumn("_n", place).filter(F.col("_n") <= n).drop("_n").withColumn("side", F.lit(side))

    return worst("under", "error", id_col).unionByName(worst("over", F.col("error").desc(), id_col))


def compare(one: DataFrame, two: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer join of two metric tables with _1, _2 and _delta columns."""
    a = one.select(*keys, *[F.col(v).alias(f"{v}_1") for v in values])
    b = two.select(*keys, *[F.col(v).alias(f"{v}_2") for v in values])
    return a.join(b, keys, "full_outer").withColumns({f"{v}_delta": F.col(f"{v}_2") - F.col(f"{v}_1") for v in values})


def prediction_table(predictions: DataFrame) -> DataFrame:
    """Predictions with abs_error and ape. A truth of zero is not guarded
    against: the percentage is infinite, or NaN where the error is zero too."""
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    endless = F.when(error > 0, F.lit(float("inf"))).when(error == 0, F.lit(float("nan")))
    return predictions.withColumns({"abs_error": error, "ape": F.when(F.col("y_true") == 0, endless).otherwise(F.try_divide(error, F.abs("y_true")) * 100)})


def round_half_even(df: DataFrame, columns: list[str], places: int = 4) -> DataFrame:
    """Some columns rounded, halves to the even neighbour."""
    return df.withColumns({c: F.bround(c, places) for c in columns})


def select_predictions(predictions: DataFrame, model_name: str, split: str) -> DataFrame:
    """The rows of one model and split; ValueError if there are none."""
    found = predictions.filter((F.col("model_name") == model_name) & (F.col("split") == split))
    if found.isEmpty():
        raise ValueError(f"no predictions of {model_name} on {split}")
    return found
