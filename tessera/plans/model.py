"""Classifiers of pairs: boosted trees by Spark ML, seeds averaged, out-of-fold scores, saving and loading."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config
from tessera.operators.sampling import fold


def fit(rows: DataFrame, features: list[str], cfg: Config = CURRENT, seed: int | None = None, validation: str | None = None) -> PipelineModel:
    """Trees on rows (features, y). validation: a boolean column of the rows that stop the boosting early."""
    trees = GBTClassifier(featuresCol="__x", labelCol="y", maxIter=cfg.trees, maxDepth=cfg.depth, stepSize=cfg.learning_rate, subsamplingRate=0.85, seed=cfg.seed if seed is None else seed)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__x"), trees]).fit(rows)


def logit(raw: Column) -> Column:
    """The log-odds of Spark's boosted trees: twice the margin."""
    return 2 * vector_to_array(raw)[1]


def score(models: list[PipelineModel], rows: DataFrame, name: str) -> DataFrame:
    """rows with the models' mean probability, and its log-odds as <name>_logit."""
    for i, m in enumerate(models):
        kept = m.transform(rows).withColumn(f"__p{i}", 1 / (1 + F.exp(-logit(F.col("rawPrediction")))))
        rows = kept.drop("__x", "rawPrediction", "probability", "prediction")
    p = reduce(lambda a, b: a + b, [F.col(f"__p{i}") for i in range(len(models))]) / len(models)
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.withColumn(name, p).withColumn(f"{name}_logit", F.log(F.col(name) / (1 - F.col(name)))).drop(*[f"__p{i}" for i in range(len(models))])


def bag(rows: DataFrame, features: list[str], cfg: Config = CURRENT) -> list[PipelineModel]:
    """cfg.bags models of different seeds. With early_stop a tenth of the query records (by hash) tells each when to stop."""
    if cfg.early_stop and "q_id" in rows.columns:
        marked = rows.withColumn("__stop", fold("q_id", 10) == 0)
        both = marked.groupBy("__stop").agg(F.count_distinct("y").alias("n")).where("n > 1").count()
        if both == 2:
            return [fit(marked, features, cfg, cfg.seed + 58 * i, "__stop") for i in range(max(1, cfg.bags))]
    return [fit(rows, features, cfg, cfg.seed + 58 * i) for i in range(max(1, cfg.bags))]


def bag_by(rows: DataFrame, features: list[str], cfg: Config = CURRENT) -> dict[str, list[PipelineModel]]:
    """Models of all rows under the empty name and, with cfg.by_country, of each country whose rows have both classes."""
    models = {"": bag(rows, features, cfg)}
    if cfg.by_country:
        both = rows.where("country <> ''").groupBy("country").agg(F.count_distinct("y").alias("n")).where("n > 1")
        models |= {c: bag(rows.where(F.col("country") == c), features, cfg) for c in sorted(r.country for r in both.collect())}
    return models


def score_by(models: dict[str, list[PipelineModel]], rows: DataFrame, name: str) -> DataFrame:
    """rows scored by the models of their country, those of other countries by the models of all."""
    own = [c for c in models if c]
    rest = rows.where(~F.coalesce("country", F.lit("")).isin(own)) if own else rows
    parts = [score(models[""], rest, name), *(score(models[c], rows.where(F.col("country") == c), name) for c in own)]
    return reduce(DataFrame.unionByName, parts)


def out_of_fold(rows: DataFrame, features: list[str], cfg: Config = CURRENT, name: str = "p1") -> DataFrame:
    """rows (q_id, y) scored by models that didn't see their fold; with one class only, by its share."""
    if rows.select("y").distinct().count() < 2:
        return rows.withColumn(name, F.lit(0.0) + F.col("y")).withColumn(f"{name}_logit", F.col("y") * 20.0 - 10)
    folded = rows.withColumn("__fold", fold("q_id", cfg.folds))
    parts = []
    for k in range(cfg.folds):
        rest = folded.where(F.col("__fold") != k)
        models = bag_by(rest if rest.select("y").distinct().count() > 1 else folded, features, cfg)
        parts.append(score_by(models, folded.where(F.col("__fold") == k), name))
    return reduce(DataFrame.unionByName, parts).drop("__fold")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel, features: list[str], n: int = 15) -> list[tuple[str, float]]:
    """The n features of highest gain."""
    gain = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, gain), strict=True), key=lambda x: (-x[1], x[0]))[:n]
