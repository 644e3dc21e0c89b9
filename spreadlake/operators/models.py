"""MLlib models on feature tables: regressors, signal filter, ensemble, diagnostics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spreadlake.series import join_small


def assembled(df: DataFrame, features: list[str], fill: float | None = None) -> DataFrame:
    if fill is not None:
        df = df.fillna(fill, features)
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def fit_linear(df: DataFrame, features: list[str], label: str, pred: str = "ols_pred") -> PipelineModel:
    """Ordinary least squares by the normal equations."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    lr = LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0, predictionCol=pred)
    return Pipeline(stages=[va, lr]).fit(df)


def two_factor_ols(df: DataFrame, label: str, a: str, b: str, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Slopes of ordinary least squares on two features, per series, from one aggregate of moments."""
    cov = lambda x, y: F.covar_pop(x, y)
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), cov(label, a).alias("_ya"), cov(label, b).alias("_yb"), cov(a, a).alias("_aa"), cov(b, b).alias("_bb"), cov(a, b).alias("_ab"),
    )
    c = F.col
    det = c("_aa") * c("_bb") - c("_ab") * c("_ab")
    return m.select(
        *keys, "n", F.try_divide(c("_ya") * c("_bb") - c("_yb") * c("_ab"), det).alias(f"b_{a}"), F.try_divide(c("_yb") * c("_aa") - c("_ya") * c("_ab"), det).alias(f"b_{b}")
    )


def last_window_ols(df: DataFrame, features: list[str], label: str, window: int, position: str, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Intercept and slopes of each series' last ``window`` rows: ``coef``, intercept first.

    The moments are one aggregate; only their small matrix, one row per series,
    is solved in Python.  A singular matrix gives zeros.
    """
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    sums = [F.sum(a * b) for i, a in enumerate(names) for b in names[i:]]
    right = [F.sum(a * F.col(label)) for a in names]
    rows = last_rows(df, position, window, keys).dropna(subset=[*features, label])
    moments = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("_xx"), F.array(*right).alias("_xy"))
    k = len(names)

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        out = []
        for upper, y in zip(xx, xy):
            m = np.zeros((k, k))
            m[np.triu_indices(k)] = upper
            m = m + np.triu(m, 1).T
            try:
                out.append(np.linalg.solve(m, np.asarray(y, float)))
            except np.linalg.LinAlgError:
                out.append(np.zeros(k))
        return pd.Series(out)

    return moments.select(*keys, "n", solve("_xx", "_xy").alias("coef"))


def fit_boosted(df: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 3, rate: float = 0.1) -> PipelineModel:
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=42, predictionCol="gbt_pred")
    return Pipeline(stages=[va, gbt]).fit(df.fillna(0.0, features))


def last_rows(df: DataFrame, position: str, n: int, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """The last ``n`` rows per series by a global row position, without sorting any series."""
    top = df.groupBy(*keys).agg(F.max(position).alias("_top"))
    return join_small(df, top, list(keys)).filter(F.col(position) > F.col("_top") - n).drop("_top")


def rolling_corr_prediction(df: DataFrame, x: str, last_corr: DataFrame, out: str = "corr_pred") -> DataFrame:
    """Final rolling correlation of each series times the predictor."""
    return join_small(df, last_corr, ["pair"]).withColumn(out, F.col("last_corr") * F.col(x)).drop("last_corr")


def weighted(predictions: dict[str, float]) -> Column:
    """Weighted mean over the available models; a missing prediction counts as zero."""
    total = sum(predictions.values())
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in predictions.items()]
    return reduce(lambda a, b: a + b, parts) / total


def fit_filter(df: DataFrame, features: list[str], label: str = "label") -> PipelineModel:
    """Logistic signal filter on standardised features."""
    va = VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="skip")
    sc = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=25, regParam=0.01)
    return Pipeline(stages=[va, sc, lr]).fit(df)


def apply_filter(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Zero signals whose predicted class is not 1 with enough probability."""
    p = vector_to_array("probability")[1]
    scored = model.transform(df).withColumn("p_win", p)
    keep = (F.col("prediction") == 1.0) & (F.col("p_win") >= threshold)
    return scored.withColumn("filtered_signal", F.when(keep, F.col("signal")).otherwise(0)).drop(
        "raw_features", "features", "rawPrediction", "probability", "prediction"
    )


def importance(model: PipelineModel, features: list[str], df: DataFrame, name: str) -> DataFrame:
    """Coefficient magnitudes or tree importances as rows."""
    fitted = model.stages[-1]
    vec = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
    rows = [(name, f, abs(float(vec[i]))) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "model string, feature string, importance double")


def mean_importance(models: list[PipelineModel], features: list[str], df: DataFrame, name: str) -> DataFrame:
    """Importances averaged over the models of several folds."""
    rows = reduce(DataFrame.unionByName, [importance(m, features, df, name) for m in models])
    return rows.groupBy("model", "feature").agg(F.avg("importance").alias("importance"))


def report(df: DataFrame, label: str, preds: list[str], importances: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Scores of all models from one aggregate, beside each model's importances (``model, feature, importance``)."""
    y = F.col(label)
    errors = [F.struct(F.lit(p).alias("model"), F.avg((y - F.col(p)) * (y - F.col(p))).alias("mse"), F.avg(F.abs(y - F.col(p))).alias("mae")) for p in preds]
    t = df.groupBy(*keys).agg(F.count(y).alias("n"), F.var_pop(y).alias("_v"), F.array(*errors).alias("_m")).select(*keys, "n", "_v", F.explode("_m").alias("_m"))
    t = t.select(*keys, "n", "_m.*", (1 - F.try_divide(F.col("_m.mse"), F.col("_v"))).alias("r2"))
    return t.join(importances, "model", "left")


def regression_scores(df: DataFrame, label: str, pred: str, keys: tuple[str, ...] = ()) -> DataFrame:
    y, e = F.col(label), F.col(label) - F.col(pred)
    a = df.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v"), F.count(y).alias("n")
    )
    return a.withColumn("r2", 1 - F.try_divide(F.col("mse"), F.col("_v"))).drop("_v")


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: list[str], label: str, pred: str, row_id: str,
    permuted: list[str] | None = None, repeats: int = 5, seed: int = 42, buckets: int = 64,
) -> DataFrame:
    """Mean loss of r2 when one feature is shuffled.

    A shuffle is a hash order per (feature, repeat): the value of the row at
    place ``k`` of one random order goes to the row at place ``k`` of another.
    Places are taken inside ``buckets`` hash buckets, the same rule at every
    size; raise it with the table so that a bucket stays a task's work.
    """
    base = df.select(row_id, *features, label)
    out = []
    for feature in permuted or features:
        for r in range(repeats):
            def placed(d: DataFrame, salt: int) -> DataFrame:
                h = F.xxhash64(F.col(row_id), F.lit(feature), F.lit(r), F.lit(seed + salt))
                d = d.withColumns({"_h": h, "_b": F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(buckets))})
                return d.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_h", row_id)))

            a = placed(base, 1).drop(feature, "_h")
            b = placed(base.select(row_id, feature), 2).select("_b", "_k", feature)
            mixed = a.join(b, ["_b", "_k"])
            out.append(
                regression_scores(model.transform(mixed), label, pred).select(
                    F.lit(feature).alias("feature"), F.lit(r).alias("repeat"), "r2"
                )
            )
    whole = regression_scores(model.transform(base), label, pred).select(F.col("r2").alias("base_r2"))
    drops = reduce(DataFrame.unionByName, out).groupBy("feature").agg(F.avg("r2").alias("shuffled_r2"))
    # one row on the right: the unshuffled score
    return drops.withColumn("_k", F.lit(1)).join(whole.withColumn("_k", F.lit(1)), "_k").select(
        "feature", (F.col("base_r2") - F.col("shuffled_r2")).alias("importance")
    )
