"""python -m tessera.plans.cli train|predict|all|validate|package [--flag value]...: resolution of TSV files.

train fits both models, tunes the decision on a validation sample and writes models and parameters; predict writes
matching_results.tsv and candidate_pairs.tsv for every S1 record of the test split, in its order, and the same pairs
in long form. validate checks both files and ends with 1 if anything is wrong; matches outside the candidates are a
warning only. package validates and puts both files into submission.zip.
"""

from __future__ import annotations

import sys
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config
from tessera.operators import decode, features, metrics, rarity, validate
from tessera.operators.records import prepare
from tessera.operators.sampling import exact_fraction
from tessera.plans import crosspair, model, resolve, tune
from tessera.sources.records import cached, load_split, purge, read_lines, read_params, truth_pairs, write_id_lists, write_pairs, write_params, write_zip
from tessera.sources.scratch import written


#: Settings that prediction takes from training.
LEARNED = "knn_k knn_k_name knn_k_addr knn_min knn_min_name knn_min_addr w_name knn_max_df knn_df_floor key_cap_s1 key_cap_q min_key_len keys safety_net safe_cos_name safe_cos_all keep_q keep_s use_emb use_ce ce_margin".split()


def keyed(s1: DataFrame, others: DataFrame, cfg: Config) -> DataFrame:
    rows = s1.withColumn("source", F.lit("S1")).unionByName(others)
    named = rows.select(F.col("entity_id").alias("id"), "source", "country", F.col("business_name").alias("name"), F.col("business_address").alias("addr"))
    return written(rarity.add_keys(rarity.add_rarity(written(prepare(named, cfg.use_ce), "prepared")), cfg.min_key_len), "keyed")


def train(spark: SparkSession, cfg: Config) -> dict:
    s1, others, truth = load_split(spark, cfg.data_dir, "train")
    records, pairs = keyed(s1, others, cfg), written(truth_pairs(truth), "truth")
    own = s1.select(F.col("entity_id").alias("s1_id"), "country")
    chosen = written(exact_fraction(own, cfg.train_s1_frac, cfg.seed, "s1_id", "country"), "sample")
    # At most about val_max S1 records validate, so that what the tuner collects doesn't grow with the data.
    frac = min(cfg.val_frac, cfg.val_max / max(1, chosen.count()))
    held = written(exact_fraction(chosen, frac, cfg.seed + 1, "s1_id", "country").select("s1_id"), "held")
    y = pairs.distinct().withColumn("y", F.lit(1))
    rows = resolve.first_stage(records, cfg).join(chosen.select("s1_id"), "s1_id", "left_semi").join(y, ["s1_id", "q_id"], "left").fillna(0, ["y"])
    rows = written(rows, "stage1")
    learn = rows.join(held, "s1_id", "left_anti")
    first, names = features.feature_lists(cfg.use_emb)
    one = model.bag_by(learn, first, cfg)
    scored = written(model.out_of_fold(learn, first, cfg).unionByName(model.score_by(one, rows.join(held, "s1_id", "left_semi"), "p1")).drop("p1_logit"), "p1")
    tau = metrics.prune_threshold(scored.join(held, "s1_id", "left_anti"), cfg.prune_recall).first()["tau"]
    two = written(resolve.second_stage(decode.prune(scored, tau, cfg), records), "stage2")
    second = model.bag_by(two.join(held, "s1_id", "left_anti"), names, cfg)
    final = written(model.score_by(second, two, "p2").select("country", "s1_id", "q_id", F.col("p2_logit").alias("logit")), "scored")
    # Only the validation pairs come here, and of the contestants of a query record those that can win it: the best one,
    # and with a second score those that are better by it than any of a higher logit.
    if cfg.use_ce:
        scorer = crosspair.fit(crosspair.texts(two.join(held, "s1_id", "left_anti").select("country", "s1_id", "q_id", "p1", "y"), records), cfg)
        model.save(scorer, f"{cfg.model_dir}/pairs")
        judged = final.join(final.join(held, "s1_id", "left_semi").select("q_id").distinct(), "q_id", "left_semi")
        final = written(crosspair.rescored(judged, records, scorer, cfg), "rescored")
    else:
        final = final.withColumn("ce", F.lit(0.0))
    inside = final.join(held, "s1_id", "left_semi")
    contest = final.join(held, "s1_id", "left_anti").join(inside.select("q_id").distinct(), "q_id", "left_semi")
    higher = Window.partitionBy("q_id").orderBy(F.desc("logit"), F.desc("ce"), "s1_id").rowsBetween(Window.unboundedPreceding, -1)
    contest = contest.withColumn("__ce", F.max("ce").over(higher)).where("__ce is null or ce > __ce").drop("__ce")
    local = [df.toPandas() for df in (inside, pairs.join(held, "s1_id", "left_semi"), chosen.join(held, "s1_id", "left_semi"), contest)]
    if not cfg.use_ce:
        local = [df.drop(columns="ce", errors="ignore") for df in local]
    rule, best = tune.tune(*local[:3], competitors=local[3])
    rules = {"": rule}
    for country in [c for c in one if c]:
        of = lambda df: df[df["country"] == country]  # noqa: B023, E731
        ids = of(local[2])
        rules[country] = tune.tune(of(local[0]), local[1][local[1]["s1_id"].isin(ids["s1_id"])], ids, rule, competitors=of(local[3]))[0]
    for stage, models in (("one", one), ("two", second)):
        for g, own in enumerate(models.values()):
            for i, m in enumerate(own):
                model.save(m, f"{cfg.model_dir}/{stage}-{g}-{i}")
    decisions = {c: asdict(r) for c, r in rules.items()}
    groups = {"one": list(one), "two": list(second)}
    params = {"tau": tau, "decisions": decisions, "val_f05": best, "s1_feats": first, "s2_feats": names, "groups": groups, "bags": max(1, cfg.bags), "config": asdict(cfg)}
    write_params(spark, params, f"{cfg.model_dir}/params")
    purge(spark, f"{cfg.model_dir}/predictions")
    return params


def predict(spark: SparkSession, cfg: Config) -> DataFrame:
    """Matches of the test split by what training has left, with training's settings. With cfg.cache its scored pairs are kept
    for the next prediction from the same data folder, until the next training; changed files need another folder."""
    params = read_params(spark, f"{cfg.model_dir}/params")
    cfg = replace(cfg, **{k: tuple(v) if isinstance(v, list) else v for k, v in params["config"].items() if k in LEARNED})
    s1, others, _ = load_split(spark, cfg.data_dir, "test")

    def scored() -> DataFrame:
        records = keyed(s1, others, cfg)
        one, two = ({c: [model.load(f"{cfg.model_dir}/{k}-{g}-{i}") for i in range(params["bags"])] for g, c in enumerate(params["groups"][k])} for k in ("one", "two"))
        rows = model.score_by(one, resolve.first_stage(records, cfg), "p1").drop("p1_logit")
        pruned = written(resolve.second_stage(decode.prune(rows, params["tau"], cfg), records), "stage2")
        final = model.score_by(two, pruned, "p2").select("country", "s1_id", "q_id", F.col("p2_logit").alias("logit"))
        if cfg.use_ce:
            return crosspair.rescored(written(final, "scored"), records, model.load(f"{cfg.model_dir}/pairs"), cfg)
        return final.withColumn("ce", F.lit(0.0))

    pruned = cached(spark, f"{cfg.model_dir}/predictions", {"params": params, "data": cfg.data_dir}, scored) if cfg.cache else written(scored(), "final")
    matches = written(decode.select_by(pruned, {c: decode.Rule(**r) for c, r in params["decisions"].items()}), "matches")
    ids = s1.select(F.col("entity_id").alias("s1_id"), F.monotonically_increasing_id().alias("nth"))
    write_id_lists(ids, matches, "matched_entity_ids", f"{cfg.out_dir}/matching_results.tsv", "nth", True)
    write_id_lists(ids, pruned.select("s1_id", "q_id"), "candidate_entity_ids", f"{cfg.out_dir}/candidate_pairs.tsv", "nth", True)
    country = pruned.select("country", "s1_id", "q_id")
    write_pairs(country.join(matches, ["s1_id", "q_id"], "left_semi"), f"{cfg.out_dir}/matches_long")
    write_pairs(country, f"{cfg.out_dir}/candidates_long")
    return matches


def check(spark: SparkSession, cfg: Config) -> bool:
    """Whether both files of cfg.out_dir are right; prints what was found."""
    s1, others, _ = load_split(spark, cfg.data_dir, "test")
    required, known = s1.select(F.col("entity_id").alias("id")), others.select(F.col("entity_id").alias("id")).distinct()
    lists, errors = {}, 0
    for name, column in (("matching_results", "matched_entity_ids"), ("candidate_pairs", "candidate_entity_ids")):
        header = ("source1_entity_id", column)
        lines = written(read_lines(spark, f"{cfg.out_dir}/{name}.tsv"), "lines")
        lists[name] = validate.split_lists(lines.where(F.lower(F.trim("line")) != "\t".join(header)))
        for row in validate.line_findings(lines, header).unionByName(validate.findings(lists[name], required, known)).collect():
            print(f"{name}: {row.code}: {row.n} ({row.examples})")
            errors += 1
    for row in validate.not_candidates(lists["matching_results"], lists["candidate_pairs"]).collect():
        print(f"warning: {row.code}: {row.n} ({row.examples})")
    return not errors


def main(args: list[str]) -> None:
    if not args or args[0] not in ("train", "predict", "all", "validate", "package"):
        sys.exit(__doc__)
    cfg = CURRENT.parse(args[1:])
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args[0] in ("train", "all"):
        print(train(spark, cfg)["val_f05"])
    if args[0] in ("predict", "all"):
        print(predict(spark, cfg).count())
    if args[0] in ("validate", "package"):
        right = check(spark, cfg)
        if right and args[0] == "package":
            write_zip(spark, [f"{cfg.out_dir}/{name}.tsv" for name in ("matching_results", "candidate_pairs")], f"{cfg.out_dir}/submission.zip")
        sys.exit(0 if right else 1)


if __name__ == "__main__":
    main(sys.argv[1:])
