"""Walk-forward model fitting: folds by date positions, one group per fold."""

from __future__ import annotations

from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.operators.panel import positions
from panelmill.session import fetched, let_workers_import


class ModelWrapper(ABC):
    """A model of the user's; runs inside an executor on one fold's rows."""

    @abstractmethod
    def fit_model(self, train_features: pd.DataFrame, train_target: pd.Series):
        """Return a fitted object with predict(features)."""

    def transform_data(self, train_features, train_target, predict_features):
        """Optionally change the data before fitting."""
        return train_features, train_target, predict_features

    def predict(self, train_features: pd.DataFrame, train_target: pd.Series, predict_features: pd.DataFrame) -> pd.Series:
        x, y, p = self.transform_data(train_features, train_target, predict_features)
        return pd.Series(self.fit_model(x, y).predict(p), index=predict_features.index)


def check_parameters(eval_days: int, refit_every: int, expanding: int | None, rolling: int | None) -> None:
    if eval_days <= 0 or refit_every <= 0:
        raise ValueError("eval_days and/or refit_every must be greater than zero")
    if rolling is not None and rolling <= 0:
        raise ValueError("rolling must be greater than zero")
    if expanding is not None and expanding <= 0:
        raise ValueError("expanding must be greater than zero")
    if expanding is None and rolling is None:
        raise ValueError("minTrainDays or rollingDays must be defined")
    if expanding is not None and rolling is not None:
        raise ValueError("minTrainDays and rollingDays can not both be defined")


def fold_table(dates: DataFrame, eval_days: int, refit_every: int, expanding: int | None = None, rolling: int | None = None) -> DataFrame:
    """(fold, train_start, train_end, pred_start, pred_end), inclusive dates.

    Fold i trains up to the position before start + i * refit_every and predicts the refit_every dates that
    follow eval_days later; the last fold may be short. Positions are numbered over the distinct dates; the
    number of dates is read once, the folds are arithmetic on a range.
    """
    check_parameters(eval_days, refit_every, expanding, rolling)
    spark = dates.sparkSession
    pos = fetched(positions(dates).withColumn("pos", F.col("pos") - 1))
    n, start = pos.count(), expanding or rolling
    folds = spark.range(fold_count(n, eval_days, refit_every, start)).select(F.col("id").alias("fold"), (F.col("id") * refit_every + start - 1).alias("te"))
    folds = folds.withColumn("ts", F.col("te") - rolling + 1 if rolling else F.lit(0)).withColumn("ps", F.col("te") + eval_days + 1)
    folds = folds.withColumn("pe", F.least(F.col("ps") + refit_every - 1, F.lit(n - 1)))
    for c, name in (("ts", "train_start"), ("te", "train_end"), ("ps", "pred_start"), ("pe", "pred_end")):
        folds = folds.join(pos.select(F.col("pos").alias(c), F.col("date").alias(name)), c)
    return folds.select("fold", "train_start", "train_end", "pred_start", "pred_end")


def fold_count(dates: int, eval_days: int, refit_every: int, start: int) -> int:
    return max(0, -(-(dates - start - eval_days) // refit_every))


def fold_rows(panel: DataFrame, folds: int, eval_days: int, refit_every: int, start: int, rolling: int | None) -> tuple[DataFrame, DataFrame]:
    """(training rows, rows to predict) with their fold. panel has pos, from 0.

    Which folds a position belongs to is arithmetic: it is in the training of the folds from the first that ends at or after
    it up to, in rolling windows, the last that starts at or before it, and is predicted by one fold at most. So rows are
    exploded by their position alone, without a join to the folds.
    """
    reach = lambda c: F.floor(c / F.lit(refit_every)).cast("long")
    first = F.greatest(reach(F.col("pos") - start + refit_every), F.lit(0).cast("long"))
    last = F.least(reach(F.col("pos") - start + rolling), F.lit(folds - 1).cast("long")) if rolling else F.lit(folds - 1).cast("long")
    train = panel.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    asks = reach(F.col("pos") - start - eval_days)
    return train, panel.withColumn("fold", asks).where((F.col("fold") >= 0) & (F.col("fold") < folds))


def walk_forward(
    model: ModelWrapper, panel: DataFrame, features: list[str], target: str, eval_days: int, refit_every: int,
    expanding: int | None = None, rolling: int | None = None, id: str = "id",
) -> DataFrame:
    """(date, id, fold, prediction) of a model refitted along time; NaN, infinite and null inputs are errors.

    panel: date, id, features, target. Each fold's training and prediction rows are co-grouped, so folds run in
    parallel and nothing reaches the driver. A fold must fit in a task, as the user's model sees it whole.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == F.lit(float("inf")))
    any_bad = lambda cs: F.coalesce(F.max(F.greatest(F.lit(0), *[bad(c).cast("int") for c in cs])), F.lit(0))
    r = panel.agg(any_bad(features).alias("f"), any_bad([target]).alias("t")).first()
    if r["f"]:
        raise ValueError("There are nan or inf values in the features")
    if r["t"]:
        raise ValueError("There are nan or inf values in the target")
    check_parameters(eval_days, refit_every, expanding, rolling)
    pos = fetched(positions(panel).withColumn("pos", F.col("pos") - 1))
    start = expanding or rolling
    folds = fold_count(pos.count(), eval_days, refit_every, start)
    placed = panel.select("date", id, *features, target).join(pos, "date")
    train, ask = fold_rows(placed, folds, eval_days, refit_every, start, rolling)
    train, ask = train.select("date", id, *features, target, "fold"), ask.select("date", id, *features, "fold")
    schema = T.StructType([T.StructField("date", T.DateType()), panel.schema[id], T.StructField("fold", T.LongType()), T.StructField("prediction", T.DoubleType())])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"date": [], id: [], "fold": [], "prediction": []})
        left, right = left.sort_values(["date", id]), right.sort_values(["date", id]).reset_index(drop=True)
        p = model.predict(left[features], left[target], right[features])
        return pd.DataFrame({"date": right["date"], id: right[id], "fold": right["fold"], "prediction": pd.Series(p).astype(float).to_numpy()})

    # both sides come from one panel: new column identities, or the co-group is ambiguous
    train, ask = train.toDF(*train.columns), ask.toDF(*ask.columns)
    let_workers_import(panel.sparkSession)
    return train.groupBy("fold").cogroup(ask.groupBy("fold")).applyInPandas(run, schema)


class LeastSquares(ModelWrapper):
    """Ordinary least squares with an intercept, in closed form."""

    def fit_model(self, train_features, train_target):
        import numpy as np

        x = np.c_[np.ones(len(train_features)), train_features.to_numpy(float)]
        beta, *_ = np.linalg.lstsq(x, train_target.to_numpy(float), rcond=None)

        class Fitted:
            def predict(self, f):
                return np.c_[np.ones(len(f)), f.to_numpy(float)] @ beta

        return Fitted()
