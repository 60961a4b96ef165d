"""Feature matrices, forests, forecasts and text search."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.rolling import clip, last_row, ratio, series
from brindle.operators import indicators as ind
from brindle.operators.evaluation import asof

#: Weights of the forecast's features: fixed values.
FORECAST_WEIGHTS = {"tech_rsi": 0.2, "tech_sma_dist": 0.2, "sent_composite": 0.3, "onchain_whale": 0.3}


def flatten_context(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """df with one double for each name, read from a dotted path; 0 where it is missing or no number."""
    return df.withColumns({name: F.coalesce(F.col(path).cast("string").try_cast("double"), F.lit(0.0)) for name, path in paths.items()})


def dataset(bars: DataFrame, context: DataFrame | None = None, columns: tuple[str, ...] = ("sent_composite",), lookahead: int = 6, tolerance: str | None = None) -> DataFrame:
    """Technical features, the context as it was at each bar (an as-of join of its history by time), and the return lookahead bars later.

    Context of any age counts, unless a tolerance (an interval) is given; 0 before its first row.
    """
    df = ind.ml_features(bars)
    df = df.withColumn("target", ratio(F.lead("close", lookahead).over(series()), F.col("close")) - 1)
    for c in columns if context is not None else ():
        df = asof(df, context, c, tolerance=tolerance).withColumnRenamed(f"asof_{c}", c).fillna(0.0, [c])
    return df


def ordered_split(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first share of each symbol's rows with a target, and the rest."""
    w = Window.partitionBy("symbol")
    df = df.filter(F.col("target").isNotNull()).withColumns({"_i": F.row_number().over(series()), "_n": F.count(F.lit(1)).over(w)})
    first = F.col("_i") <= F.floor(F.col("_n") * share)
    return df.filter(first).drop("_i", "_n"), df.filter(~first).drop("_i", "_n")


class Forest:
    """A random forest that remembers its features."""

    def __init__(self, features: list[str], model: RandomForestRegressionModel):
        self.features, self.model = features, model

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], target: str = "target", trees: int = 100, depth: int = 30, seed: int = 42) -> Forest:
        """depth: 30, the deepest that the forest can grow."""
        rows = VectorAssembler(inputCols=features, outputCol="_x").transform(df.fillna(0.0, features))
        return cls(features, RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(rows))

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prediction; features that df lacks count as 0."""
        for c in self.features:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(0.0))
        rows = VectorAssembler(inputCols=self.features, outputCol="_x").transform(df.fillna(0.0, self.features))
        return self.model.transform(rows).drop("_x")

    def predict_with_confidence(self, rows: list[list[float]]) -> list[tuple[float, float]]:
        """Mean of the trees and 1 / (1 + their deviation) for a few vectors on the driver."""
        from pyspark.ml.linalg import Vectors

        out = []
        for r in rows:
            votes = [t.predict(Vectors.dense(r)) for t in self.model.trees]
            mean = sum(votes) / len(votes)
            out.append((mean, 1 / (1 + (sum((v - mean) ** 2 for v in votes) / len(votes)) ** 0.5)))
        return out

    def rmse(self, df: DataFrame, target: str = "target") -> float:
        return self.predict(df).agg(F.sqrt(F.avg((F.col("prediction") - F.col(target)) ** 2))).first()[0]

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        SparkSession.active().createDataFrame([(json.dumps(self.features),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/features")

    @classmethod
    def load(cls, spark, path: str) -> Forest:
        return cls(json.loads(spark.read.text(f"{path}/features").first()[0]), RandomForestRegressionModel.load(f"{path}/model"))


def promote(new_rmse: float, old_rmse: float | None, same_features: bool, least_gain: float = 0.02) -> bool:
    """Whether a new model replaces the old: always without one or with other features, else for a gain of 2 %."""
    return old_rmse is None or not same_features or old_rmse <= 0 or (old_rmse - new_rmse) / old_rmse >= least_gain


def same_names(a: str, b: str) -> Column:
    """Whether two arrays of names are the same set."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def promoted(new_rmse: Column, old_rmse: Column, same_features: Column, least_gain: float = 0.02) -> Column:
    """promote() for a table of models."""
    fresh = old_rmse.isNull() | ~F.coalesce(same_features, F.lit(False)) | (old_rmse <= 0)
    return F.coalesce(fresh | (ratio(old_rmse - new_rmse, old_rmse) >= least_gain), F.lit(True))


def forecast(df: DataFrame, price: str = "close", volatility: str = "tech_volatility") -> DataFrame:
    """df with score, direction, confidence, price_target from weighted features; missing features count 0."""
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)) * w for c, w in FORECAST_WEIGHTS.items())
    s = F.col("score")
    return df.withColumn("score", score).withColumns({"direction": F.when(s > 0.1, "BULLISH").when(s < -0.1, "BEARISH").otherwise("NEUTRAL"), "confidence": F.least(2 * F.abs(s), F.lit(1.0)), "price_target": F.col(price) * (1 + 2 * s * F.col(volatility))})


def forecast_latest(bars: DataFrame) -> DataFrame:
    """The forecast on each symbol's last bar, for symbols with 50 bars or more."""
    df = ind.ml_features(bars).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    return forecast(last_row(df).filter("_n >= 50")).select("symbol", "ts", "close", "score", "direction", "confidence", "price_target")


# ---------------------------------------------------------------- text search


def terms(df: DataFrame, key: str, text: str = "text", stop: tuple[str, ...] = ("the", "a", "an", "and", "of", "in", "to", "is", "for", "on")) -> DataFrame:
    """key, term: lower-case words of two letters or more and pairs of neighbours, without stop words; one row for each occurrence."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), 0), lambda w: ~w.isin(*stop))
    df = df.select(key, words.alias("_w"))
    pairs = F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return df.select(key, F.explode(F.concat("_w", pairs)).alias("term"))


def tfidf(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, weight: counts times ln((1 + n) / (1 + df)) + 1, each key's vector of length 1."""
    tf = terms(docs, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = docs.count()
    x = tf.join(df, "term").withColumn("_x", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_n"))
    return x.join(norm, key).select(key, "term", (F.col("_x") / F.col("_n")).alias("weight"))


def search(index: DataFrame, query: DataFrame, key: str, top: int = 5, least: float = 0.1) -> DataFrame:
    """key, score: the keys whose vectors are nearest to the one query's terms (term, weight), above `least`."""
    return index.join(query.select("term", F.col("weight").alias("_q")), "term").groupBy(key).agg(F.sum(F.col("weight") * F.col("_q")).alias("score")).filter(F.col("score") > least).orderBy(F.col("score").desc(), key).limit(top)


def bounded(x: Column) -> Column:
    """x between -1 and 1."""
    return clip(x, -1.0, 1.0)
