"""From scores to matches: calibration, one owner for each query record, the best set for each S1 record."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config
from tessera.operators.windows import rank


@dataclass(frozen=True)
class Rule:
    """Parameters of the decision; bounds are those of its tuning."""

    temperature: float = 1.0
    bias: float = 0.0
    prior: float = 0.0
    tau_min: float = 0.40
    p_empty_mult: float = 1.05
    floor: float = CURRENT.noise_floor
    ce_weight: float = 0.0


BOUNDS = {"temperature": (0.3, 4.0), "bias": (-3.0, 3.0), "prior": (0.0, 2.5), "tau_min": (0.3, 0.7), "p_empty_mult": (0.8, 1.4), "ce_weight": (0.0, 3.0)}
EARLIER_BOUNDS = {"temperature": (0.2, 10.0), "bias": (-4.0, 4.0), "prior": (0.0, 3.0)}
EARLIER_RULE = Rule(tau_min=0.0, p_empty_mult=1.0, floor=0.0)


def calibrated(logit: Column, temperature: float, bias: float) -> Column:
    return 1 / (1 + F.exp(-(logit / temperature + bias)))


def fused(logit: Column, ce: Column, weight: float) -> Column:
    """The logit with a second model's score where it has one."""
    return logit + weight * F.coalesce(ce, F.lit(0.0))


def one_owner(scored: DataFrame) -> DataFrame:
    """Each query record's best pair: higher p, then smaller s1_id."""
    order = Window.partitionBy("q_id").orderBy(F.desc("p"), "s1_id")
    return scored.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def expected_sets(owned: DataFrame, prior: float) -> DataFrame:
    """owned (s1_id, q_id, p) with j (place by p, then q_id), ef (expected F0.5 of the first j), best, best_j,
    p_empty (chance that no pair is right) and max_p."""
    group = Window.partitionBy("s1_id")
    order = group.orderBy(F.desc("p"), "q_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    steps = owned.withColumns({"j": F.row_number().over(order), "cs": F.sum("p").over(upto), "tot": F.sum("p").over(group), "max_p": F.max("p").over(group), "p_empty": F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))).over(group))})
    steps = steps.withColumn("ef", F.round(1.25 * F.col("cs") / (F.col("j") + 0.25 * (F.col("tot") + prior)), 12))
    steps = steps.withColumn("best", F.max("ef").over(group))
    return steps.withColumn("best_j", F.min(F.when(F.col("ef") >= F.col("best"), F.col("j"))).over(group))


def select_matches(scored: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(s1_id, q_id, p) of scored (s1_id, q_id, logit): pairs below the floor go, each query record keeps one owner, and
    each S1 record the prefix of highest expected F0.5, or nothing if emptiness is likelier or no pair is strong.
    Two shuffles, by q_id and by s1_id."""
    p = scored.select("s1_id", "q_id", calibrated(F.col("logit"), rule.temperature, rule.bias).alias("p"))
    sets = expected_sets(one_owner(p.where(F.col("p") >= rule.floor)), rule.prior)
    active = (F.col("p_empty") * rule.p_empty_mult < F.col("best")) & (F.col("max_p") >= rule.tau_min)
    return sets.where((F.col("j") <= F.col("best_j")) & active).select("s1_id", "q_id", "p")


def select_by(scored: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """select_matches of scored (country, s1_id, q_id, logit, ce) by the rule of the pairs' country, that of the empty name
    for others, on fused logits. Pairs never cross countries, so that each country's matches are found on their own."""
    own = [c for c in rules if c]
    parts = [(rules[""], ~F.coalesce("country", F.lit("")).isin(own) if own else F.lit(True)), *((rules[c], F.col("country") == c) for c in own)]
    return reduce(DataFrame.unionByName, [select_matches(scored.where(rows).withColumn("logit", fused(F.col("logit"), F.col("ce"), rule.ce_weight)), rule) for rule, rows in parts])


def safety_net(cfg: Config = CURRENT) -> Column:
    """Pairs that pruning must never drop, over the first stage's features."""
    c = F.col
    return (c("q_rank") == 1) | (c("skel_eq") == 1) & (c("cos_name") >= cfg.safe_cos_name) | (c("k_skel") == 1) | (c("k_name_sort") == 1) | (c("k_nm_hn") == 1) | (c("hn_eq") == 1) & (c("ra1_eq") == 1) | (c("cos_all") >= cfg.safe_cos_all)


def prune(pairs: DataFrame, tau: float, cfg: Config = CURRENT) -> DataFrame:
    """Pairs whose p1 is tau or more, that the safety net holds, or that are among the cfg.keep_q best of their query record
    or the cfg.keep_s best of their S1 record (0: this net is off)."""
    keep = F.col("p1") >= tau
    if cfg.safety_net:
        keep = keep | safety_net(cfg)
    for key, tie, n in (("q_id", "s1_id", cfg.keep_q), ("s1_id", "q_id", cfg.keep_s)):
        if n > 0:
            pairs = pairs.withColumn(f"__{key}", rank(["country", key], "p1", tie))
            keep = keep | (F.col(f"__{key}") <= n)
    return pairs.where(keep).drop("__q_id", "__s1_id")
