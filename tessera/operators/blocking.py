"""Candidate pairs: three nearest-neighbour channels and the key joins, as one table of flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config
from tessera.operators import rarity, tfidf
from tessera.sources.scratch import written

CHANNELS = ("in_knn", "in_knn_name", "in_knn_addr")


def key_pairs(records: DataFrame, cfg: Config = CURRENT) -> DataFrame:
    """(country, q_id, s1_id, key_name): records of both sides that share a key within its caps; one join for all keys."""
    keys = rarity.long_keys(records, cfg.keys)
    fine = keys.join(rarity.capped_blocks(keys, cfg).select("country", "key_name", "key"), ["country", "key_name", "key"])
    s = fine.where("side = 's'").select("country", "key_name", "key", F.col("id").alias("s1_id"))
    q = fine.where("side = 'q'").select("country", "key_name", "key", F.col("id").alias("q_id"))
    return q.join(s, ["country", "key_name", "key"]).select("country", "q_id", "s1_id", "key_name")


def candidates(records: DataFrame, cfg: Config = CURRENT) -> DataFrame:
    """(country, q_id, s1_id, a 0/1 flag for each channel and key, cos_all, cos_name, cos_addr), one row a pair.
    records: prepared, with rarity and keys."""
    # Each space is read by several branches, so it is written once.
    names, addresses = written(tfidf.name_space(records), "names"), written(tfidf.address_space(records), "addresses")
    joint = written(tfidf.joint_space(names, addresses, cfg.w_name), "joint")
    spaces = zip(CHANNELS, (joint, names, addresses), (cfg.knn_k, cfg.knn_k_name, cfg.knn_k_addr), (cfg.knn_min, cfg.knn_min_name, cfg.knn_min_addr), strict=True)
    found = [tfidf.nearest(written(tfidf.retrieval(space, records, cfg), "retrieval"), k, least).select("country", "q_id", "s1_id", F.lit(flag).alias("key_name")) for flag, space, k, least in spaces if k > 0]
    rows = reduce(DataFrame.unionByName, [*found, key_pairs(records, cfg)])
    flags = [F.max(F.when(F.col("key_name") == f, 1).otherwise(0)).alias(f) for f in (*CHANNELS, *cfg.keys)]
    pairs = written(rows.groupBy("country", "q_id", "s1_id").agg(*flags), "pairs")
    return tfidf.pair_cosines(pairs, written(tfidf.vectors(names, addresses), "vectors"), cfg.w_name)
