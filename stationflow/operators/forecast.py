"""Hourly net-outflow forecast: features, baselines, boosted trees, scores."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ratio, round_even
from ..functions.timecols import cyclical, dow, is_weekend

LAGS = (1, 2, 3, 24, 168)
ROLLS = (3, 24, 168)
HOLDOUT_WEEKS = 4
SEASONAL_WEEKS = 8
# Feature names of the published model.
FEATURES = ([f"lag_{k}" for k in LAGS] + [f"roll_mean_{r}" for r in ROLLS]
            + [f"roll_std_{r}" for r in ROLLS]
            + ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend"])


def add_features(panel: DataFrame, lags=LAGS, rolls=ROLLS, y: str = "net_out") -> DataFrame:
    """Lags, rolling moments and cyclical time columns; one shuffle by station.

    Valid because the hourly axis has no holes: k rows back is k hours back. A rolling value
    covers the hours before the current one and needs a third of them (two at least).
    """
    w = Window.partitionBy("station_id").orderBy("ts")
    columns = {f"lag_{k}": F.lag(y, k).over(w) for k in lags}
    for r in rolls:
        back = w.rowsBetween(-r, -1)
        enough = F.count(y).over(back) >= max(2, r // 3)
        columns[f"roll_mean_{r}"] = F.when(enough, F.avg(y).over(back))
        columns[f"roll_std_{r}"] = F.when(enough, F.stddev_samp(y).over(back))
    return add_time_features(panel.withColumns(columns))


def add_time_features(df: DataFrame) -> DataFrame:
    df = df.withColumns({"hh": F.hour("ts"), "dw": dow("ts")})
    hour_sin, hour_cos = cyclical("hh", 24)
    dow_sin, dow_cos = cyclical("dw", 7)
    return df.withColumns({"hour_sin": hour_sin, "hour_cos": hour_cos, "dow_sin": dow_sin,
                           "dow_cos": dow_cos, "is_weekend": is_weekend("ts").cast("int")})


def with_split(features: DataFrame, holdout_days: int = 7 * HOLDOUT_WEEKS) -> DataFrame:
    """Adds the split time: the last ``holdout_days`` are the test period."""
    back = F.make_dt_interval(F.lit(holdout_days), F.lit(0), F.lit(0), F.lit(0))
    split = features.agg((F.max("ts") - back).alias("split"))
    return features.crossJoin(F.broadcast(split))


def seasonal_mean(features: DataFrame, days: int = 7 * SEASONAL_WEEKS, y: str = "net_out") -> DataFrame:
    """B1: mean per (station, weekday, hour) over the last weeks before the split."""
    start = F.col("split") - F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(0))
    recent = features.where((F.col("ts") <= F.col("split")) & (F.col("ts") > start))
    return recent.groupBy("station_id", "dw", "hh").agg(F.avg(y).alias("b1_pred"))


def add_baselines(features: DataFrame, seasonal_days: int = 7 * SEASONAL_WEEKS) -> DataFrame:
    """B0 (a week earlier), B1 (seasonal mean) and the always-zero forecast."""
    return (features.join(seasonal_mean(features, seasonal_days), ["station_id", "dw", "hh"], "left")
            .withColumn("b0_pred", F.col("lag_168").cast("double"))
            .withColumn("zero_pred", F.lit(0.0)))


def train_rows(features: DataFrame, y: str = "net_out") -> DataFrame:
    return features.where((F.col("ts") <= F.col("split")) & F.col(y).isNotNull() & F.col("lag_168").isNotNull())


def test_rows(features: DataFrame, y: str = "net_out") -> DataFrame:
    return features.where((F.col("ts") > F.col("split")) & F.col(y).isNotNull())


def _vectors(df: DataFrame) -> DataFrame:
    """Spark trees have no missing value: fill with 0 and add an indicator per feature."""
    filled = df.withColumns({
        **{f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FEATURES},
        **{f"_na_{c}": F.col(c).isNull().cast("double") for c in FEATURES if c.startswith(("lag", "roll"))},
    })
    inputs = [c for c in filled.columns if c.startswith(("_x_", "_na_"))]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(filled).drop(*inputs)


def fit_trees(features: DataFrame, y: str = "net_out", iterations: int = 300, rate: float = 0.06,
              depth: int = 6, validation: float = 0.15, seed: int = 42) -> GBTRegressionModel:
    """One boosted model over all chosen stations, without the station id as a feature.

    The validation share is chosen by a hash of the row key, so it is the same on every run.
    """
    held_out = F.pmod(F.xxhash64("station_id", "ts"), F.lit(1000)) < int(validation * 1000)
    data = (_vectors(train_rows(features, y)).withColumn("label", F.col(y).cast("double"))
            .withColumn("held_out", held_out).select("features", "label", "held_out"))
    return GBTRegressor(maxIter=iterations, stepSize=rate, maxDepth=depth, minInstancesPerNode=20,
                        validationIndicatorCol="held_out", validationTol=1e-7, seed=seed).fit(data)


def predict_trees(model: GBTRegressionModel, features: DataFrame) -> DataFrame:
    return model.transform(_vectors(features)).withColumnRenamed("prediction", "b2_pred").drop("features")


def score(predicted: DataFrame, models: dict[str, str], y: str = "net_out", base: str | None = None) -> DataFrame:
    """n, MAE and RMSE per model over the rows where truth and forecast exist.

    With ``base`` the improvement of the (rounded) MAE over that model, in percent.
    """
    stacked = predicted.select(F.col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("p"))
        for name, c in models.items()])).alias("m")).select("y", "m.model", "m.p")
    error = F.col("y") - F.col("p")
    scores = (stacked.where(F.col("y").isNotNull() & F.col("p").isNotNull()).groupBy("model")
              .agg(F.count(F.lit(1)).alias("n"), round_even(F.avg(F.abs(error)), 4).alias("mae"),
                   round_even(F.sqrt(F.avg(error * error)), 4).alias("rmse")))
    if base is None:
        return scores
    # One row per model.
    reference = scores.where(F.col("model") == base).select(F.col("mae").alias("_base"))
    return (scores.crossJoin(F.broadcast(reference))
            .withColumn("improvement_pct", round_even(ratio(F.col("_base") - F.col("mae"), "_base") * 100, 1))
            .drop("_base"))


def last_days(predicted: DataFrame, station: DataFrame, days: int = 7) -> DataFrame:
    """Truth and forecasts of one station (a one-row table) over its last days."""
    back = F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(0))
    rows = predicted.join(F.broadcast(station.select("station_id").limit(1)), "station_id", "left_semi")
    end = rows.agg((F.max("ts") - back).alias("_from"))
    shown = [c for c in ("net_out", "b0_pred", "b1_pred", "b2_pred") if c in predicted.columns]
    return (rows.crossJoin(F.broadcast(end)).where(F.col("ts") >= F.col("_from"))
            .select("station_id", "ts", *shown))

