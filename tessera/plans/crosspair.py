"""A second opinion on pairs that the models are unsure of, from both records' texts together.

The scorer is a logistic regression on words that a pair shares and words that only one side has, by Spark ML on
hashed counts. `rescored` takes any fitted pipeline over (a_raw, b_raw) that gives rawPrediction, as a neural one would.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config
from tessera.operators import sampling
from tessera.operators.features import gather

SIZE = 1 << 16
_WORDS = {side: f"filter(split(lower({side}_raw), '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> t <> '')" for side in "ab"}
#: Words of both records, marked by where they are; one of the pair's own is never empty.
_MARKED = f"concat(array('*'), transform(array_intersect({_WORDS['a']}, {_WORDS['b']}), t -> concat('=', t)), transform(array_except({_WORDS['a']}, {_WORDS['b']}), t -> concat('-', t)), transform(array_except({_WORDS['b']}, {_WORDS['a']}), t -> concat('+', t)))"


def texts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with a_raw and b_raw, the texts of the S1 and the query record (prepared with keep_raw)."""
    return gather(pairs, records, ["raw"])


def fit(pairs: DataFrame, cfg: Config = CURRENT) -> PipelineModel:
    """The scorer, from pairs (s1_id, q_id, p1, y, a_raw, b_raw): cfg.ce_train_pairs of them, unsure ones likelier."""
    keyed = pairs.withColumn("__pair", F.concat_ws("|", "s1_id", "q_id"))
    sample = sampling.weighted(keyed, cfg.ce_train_pairs, sampling.uncertainty(F.col("p1")), cfg.seed, "__pair")
    words = SQLTransformer(statement=f"SELECT *, {_MARKED} AS __words FROM __THIS__")
    stages = [words, HashingTF(inputCol="__words", outputCol="__x", numFeatures=SIZE, binary=True), LogisticRegression(featuresCol="__x", labelCol="y", regParam=1e-3, maxIter=50)]
    return Pipeline(stages=stages).fit(sample)


def zone(scored: DataFrame, margin: float, most: int) -> DataFrame:
    """Pairs (country, s1_id, q_id, logit) with |logit| below the margin, of each country at most `most`, the least sure first."""
    return sampling.most_uncertain(scored.where(F.abs("logit") < margin), most, "country", "logit", ["q_id", "s1_id"])


def rescored(scored: DataFrame, records: DataFrame, scorer: PipelineModel, cfg: Config = CURRENT, most: int | None = None) -> DataFrame:
    """scored (country, s1_id, q_id, logit) with ce: the scorer's log-odds in the zone, 0 elsewhere."""
    key = ["country", "s1_id", "q_id"]
    inside = zone(scored, cfg.ce_margin, cfg.ce_max_rows if most is None else most).select(*key)
    ce = scorer.transform(texts(inside, records)).select(*key, vector_to_array("rawPrediction")[1].alias("ce"))
    return scored.join(ce, key, "left").fillna(0.0, ["ce"])
