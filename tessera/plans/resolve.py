"""Resolution from prepared records to matches: candidates, first model, pruning, second model, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config
from tessera.operators import blocking, decode, embedding, features, metrics
from tessera.plans import model
from tessera.sources.scratch import written


def first_stage(records: DataFrame, cfg: Config = CURRENT) -> DataFrame:
    """Candidates with the first stage's features. records: prepared, with rarity and keys."""
    found = written(blocking.candidates(records, cfg), "candidates")
    if cfg.use_emb:
        found = written(embedding.name_cosines(found, records, folder=f"{cfg.model_dir}/vectors"), "embedded")
    return features.stage1(found, records)


def second_stage(pruned: DataFrame, records: DataFrame) -> DataFrame:
    """Pruned pairs with string and context features; the Python similarities run on what pruning left."""
    kept = written(pruned, "pruned")
    return features.context(features.strings(kept, records), records)


def resolve(records: DataFrame, truth: DataFrame, cfg: Config = CURRENT, rule: decode.Rule = decode.Rule()) -> DataFrame:
    """(s1_id, q_id, p): matches by out-of-fold models of both stages."""
    y = truth.select("s1_id", "q_id").distinct().withColumn("y", F.lit(1))
    rows = written(first_stage(records, cfg).join(y, ["s1_id", "q_id"], "left").fillna(0, ["y"]), "stage1")
    names = features.feature_lists(cfg.use_emb)
    one = written(model.out_of_fold(rows, names[0], cfg).drop("p1_logit"), "p1")
    tau = metrics.prune_threshold(one, cfg.prune_recall).first()["tau"]
    two = written(second_stage(decode.prune(one, tau, cfg), records), "stage2")
    final = model.out_of_fold(two, names[1], cfg, "p2")
    return decode.select_matches(final.withColumn("logit", F.col("p2_logit")), rule)
