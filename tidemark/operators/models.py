"""Train-only preprocessing, ridge, boosted trees and grid search on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.gram import ridge_by_fold
from tidemark.operators.ordering import joined_by, quantiles_of
from tidemark.sources.scratch import written


class Preprocessor:
    """Median imputation and standardisation (population deviation) of numeric
    columns, most frequent level and one-hot of categories; all learned from the
    training rows, unseen levels all zero."""

    def __init__(self, numeric: list[str], categorical: list[str] = ()):
        self.numeric, self.categorical = list(numeric), list(categorical)

    def fit(self, train: DataFrame) -> Preprocessor:
        found = {r["column"]: r["q0"] for r in quantiles_of(train, self.numeric, [0.5]).collect()} if self.numeric else {}  # one row a column
        self.medians = {c: found.get(c, 0.0) for c in self.numeric}
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c]))).alias(c) for c in self.numeric])
        stats = filled.agg(*[f(c).alias(f"{n}_{c}") for c in self.numeric for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first() if self.numeric else None
        self.scale = {c: (stats[f"mean_{c}"], stats[f"std_{c}"] or 1.0) for c in self.numeric}
        self.modes = {}
        for c in self.categorical:
            top = train.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).first()
            self.modes[c] = top[c] if top else ""
        stages = [StringIndexer(inputCol=f"_f_{c}", outputCol=f"_i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in self.categorical]
        # The slot for unseen levels is the last one, and dropped: such a row is all zero.
        stages += [OneHotEncoder(inputCol=f"_i_{c}", outputCol=f"_o_{c}", dropLast=True) for c in self.categorical]
        stages.append(VectorAssembler(inputCols=[*[f"_f_{c}" for c in self.numeric], *[f"_o_{c}" for c in self.categorical]], outputCol="features"))
        self.model: PipelineModel = Pipeline(stages=stages).fit(self._filled(train))
        return self

    def _filled(self, df: DataFrame) -> DataFrame:
        numbers = {f"_f_{c}": (F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c]))) - F.lit(float(self.scale[c][0]))) / F.lit(float(self.scale[c][1])) for c in self.numeric}
        return df.withColumns(numbers | {f"_f_{c}": F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c])) for c in self.categorical})

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._filled(df))
        return out.drop(*[c for c in out.columns if c.startswith(("_f_", "_i_", "_o_"))])

    def feature_names(self, df: DataFrame) -> list[str]:
        attrs = self.transform(df.limit(0)).schema["features"].metadata["ml_attr"]["attrs"]
        return [a["name"].removeprefix("_f_").removeprefix("_o_") for a in sorted((a for group in attrs.values() for a in group), key=lambda a: a["idx"])]


def prepared_by_fold(members: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``members`` with z_<name> of numbers and code_<name> of categories, as
    each fold's training rows have it: numbers with the training median where
    missing, less their mean and by their deviation (of all, 0 where they do
    not vary); of categories, with the most frequent level where missing (the
    smallest of ties), the place of the level in order, null for a level that
    training lacks. All folds and columns in the same passes."""
    train = members.filter("split = 'train'")
    out = members
    if numeric:
        found = quantiles_of(train, numeric, [0.5], "fold_id")
        medians = found.groupBy("fold_id").agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(f"_m_{c}") for c in numeric])
        out = joined_by(out, medians, ["fold_id"])
        out = out.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in numeric}).drop(*[f"_m_{c}" for c in numeric])
        scales = out.filter("split = 'train'").groupBy("fold_id").agg(*[f(f"_f_{c}").alias(f"{n}_{c}") for c in numeric for n, f in (("_a", F.avg), ("_s", F.stddev_pop))])
        out = joined_by(out, scales, ["fold_id"])
        out = out.withColumns({f"z_{c}": F.when(F.col(f"_s_{c}") > 0, (F.col(f"_f_{c}") - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in numeric}).drop(*[f"{n}_{c}" for n in ("_f", "_a", "_s") for c in numeric])
    if categorical:
        long = train.select("fold_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("f")).select("fold_id", "f.*").filter("level IS NOT NULL")
        levels = written(long.groupBy("fold_id", "column", "level").agg(F.count("*").alias("n")), "levels")
        levels = levels.withColumn("code", F.row_number().over(Window.partitionBy("fold_id", "column").orderBy("level")) - 1)
        modes = levels.groupBy("fold_id").agg(*[F.min(F.when(F.col("column") == c, F.struct(-F.col("n"), "level")))["level"].alias(f"_m_{c}") for c in categorical])
        out = joined_by(out, modes, ["fold_id"])
        for c in categorical:
            own = levels.filter(F.col("column") == c).select("fold_id", F.col("level").alias(f"_f_{c}"), F.col("code").alias(f"code_{c}"))
            out = joined_by(out.withColumn(f"_f_{c}", F.coalesce(F.col(c).cast("string"), F.col(f"_m_{c}"))), own, ["fold_id", f"_f_{c}"]).drop(f"_f_{c}", f"_m_{c}")
    return out


def ridge(train: DataFrame, label: str, alpha: float = 1.0):
    """Least squares with ``alpha * |w|^2`` and a free intercept. Spark's
    penalty is a mean over rows and relative to the label's deviation."""
    n, spread = train.agg(F.count("*"), F.stddev_pop(label)).first()
    return LinearRegression(labelCol=label, solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * (spread or 0.0) / max(n, 1)).fit(train)


def ridge_grid(members: DataFrame, features: list[str], label: str, alphas: list[float]) -> DataFrame:
    """(alpha, mean_mae, rank): penalties by their validation error, averaged
    over folds, best first."""
    valid = ridge_by_fold(members, features, label, alphas).filter("split = 'valid'")
    by_fold = valid.groupBy("alpha", "fold_id").agg(F.avg(F.abs(F.col("prediction") - F.col(label))).alias("mae"))
    means = by_fold.groupBy("alpha").agg(F.avg("mae").alias("mean_mae"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy("mean_mae", "alpha")))  # one row for each penalty


def boosted_trees(train: DataFrame, label: str, **params):
    return GBTRegressor(labelCol=label, seed=42, **params).fit(train)


def first_that_fits(attempts: list[tuple[str, Callable]]):
    """(name, model) of the first attempt that does not fail."""
    failures = []
    for name, fit in attempts:
        try:
            return name, fit()
        except Exception as e:  # noqa: BLE001
            failures.append(f"{name}: {e}")
    raise RuntimeError("no backend could be fitted: " + "; ".join(failures))


def grid_search(folds: list[tuple[DataFrame, DataFrame]], label: str, fit: Callable, grid: dict[str, list]) -> list[dict]:
    """Parameters with their mean absolute error over (train, held-out) folds,
    best first and ranked."""
    out = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values))
        errors = [fit(train, label, **params).transform(held).agg(F.avg(F.abs(F.col(label) - F.col("prediction")))).first()[0] for train, held in folds]
        out.append(params | {"mean_mae": sum(errors) / len(errors)})
    return [row | {"rank": i} for i, row in enumerate(sorted(out, key=lambda r: r["mean_mae"]), 1)]


def importances(spark, model, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())], "feature string, importance double")


def save_model(stages: list, path: str) -> None:
    """Fitted stages as one pipeline, in a folder of any store."""
    PipelineModel(stages).write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
