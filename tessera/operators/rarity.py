"""Rare tokens of records, blocking keys and their caps. All counts are per country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config


def doc_frequency(records: DataFrame, tokens: str) -> DataFrame:
    """(country, token, df): records of all sources that hold the token."""
    return records.select("country", F.explode(F.array_distinct(tokens)).alias("token")).groupBy("country", "token").agg(F.count("*").alias("df"))


def two_rarest(records: DataFrame, tokens: str, names: tuple[str, str]) -> DataFrame:
    """(country, id, first, second): each record's rarest tokens, ties by alphabet; only records that have a token."""
    long = records.select("country", "id", F.explode(F.array_distinct(tokens)).alias("token"))
    ranked = long.join(doc_frequency(records, tokens), ["country", "token"]).groupBy("country", "id")
    # A record's own tokens are few, so that sorting them within its row beats a window.
    best = ranked.agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "token"))), 1, 2).alias("best"))
    return best.select("country", "id", *[F.coalesce(F.get("best", F.lit(i))["token"], F.lit("")).alias(c) for i, c in enumerate(names)])


def add_rarity(records: DataFrame) -> DataFrame:
    """records with rn1 (rarest name token) and ra1, ra2 (rarest address tokens), empty where there is none."""
    out = records.join(two_rarest(records, "ntok", ("rn1", "rn2")).drop("rn2"), ["country", "id"], "left").join(two_rarest(records, "atok", ("ra1", "ra2")), ["country", "id"], "left")
    return out.fillna("", ["rn1", "ra1", "ra2"])


def _both(a: str, b: str, second: Column | None = None) -> Column:
    return F.when((F.col(a) != "") & (F.col(b) != ""), F.concat(F.col(a), F.lit("|"), F.col(b) if second is None else second)).otherwise("")


def add_keys(records: DataFrame, min_len: int = CURRENT.min_key_len) -> DataFrame:
    """records (with rarity) with the ten blocking keys, empty where a part is missing."""
    long = lambda c: F.when(F.length(c) >= min_len, F.col(c)).otherwise("")
    return records.withColumns(
        {
            "k_skel": long("skel"),
            "k_name_sort": long("name_sort"),
            "k_name_clean": long("nname"),
            "k_hn_st": _both("hn", "ra1"),
            "k_st2": F.when((F.col("ra1") != "") & (F.col("ra2") != ""), F.concat(F.least("ra1", "ra2"), F.lit("|"), F.greatest("ra1", "ra2"))).otherwise(""),
            "k_nm_st": _both("rn1", "ra1"),
            "k_nm_hn": _both("rn1", "hn"),
            "k_post_nm": _both("postal", "skel", F.substring("skel", 1, 3)),
            "k_post_ra1": _both("postal", "ra1"),
            "k_first_hn": _both("first_w", "hn"),
        }
    )


def long_keys(records: DataFrame, keys: tuple[str, ...] = CURRENT.keys) -> DataFrame:
    """(country, id, side, key_name, key): one row for each key that a record has; side is s for S1, else q."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(k).alias("key")) for k in keys])
    side = F.when(F.col("source") == "S1", "s").otherwise("q").alias("side")
    return records.select("country", "id", side, F.inline(pairs)).where("key <> ''")


def capped_blocks(keys: DataFrame, cfg: Config = CURRENT) -> DataFrame:
    """(country, key_name, key, n_s, n_q) of the keys that both sides have and neither more often than its cap."""
    sizes = keys.groupBy("country", "key_name", "key").agg(F.count_if(F.col("side") == "s").alias("n_s"), F.count_if(F.col("side") == "q").alias("n_q"))
    return sizes.where((F.col("n_s").between(1, cfg.key_cap_s1)) & (F.col("n_q").between(1, cfg.key_cap_q)))
