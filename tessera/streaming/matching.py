"""New query records, as a stream, against the S1 records of a table.

The join is between a stream and a static table, so that nothing is kept between batches: prepared query records meet
the S1 records that share a key. Only keys that need no counts over the corpus take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import CURRENT
from tessera.operators.rarity import add_keys, long_keys
from tessera.operators.records import prepare

KEYS = ("k_skel", "k_name_sort", "k_name_clean", "k_first_hn")


def _keys(records: DataFrame) -> DataFrame:
    bare = prepare(records).withColumns({c: F.lit("") for c in ("rn1", "ra1", "ra2")})
    return long_keys(add_keys(bare), KEYS)


def index(records: DataFrame, cap: int = CURRENT.key_cap_s1) -> DataFrame:
    """(country, key_name, key, s1_id) of the S1 records (id, source, country, name, addr), without keys that more than
    `cap` of them share."""
    keys = _keys(records.where("source = 'S1'")).select("country", "key_name", "key", F.col("id").alias("s1_id"))
    fine = keys.groupBy("country", "key_name", "key").agg(F.count("*").alias("n")).where(F.col("n") <= cap)
    return keys.join(fine.drop("n"), ["country", "key_name", "key"])


def matches(stream: DataFrame, s1: DataFrame) -> DataFrame:
    """(country, q_id, s1_id, key_name) of a stream of query records and an index; works on tables too."""
    keys = _keys(stream).select("country", "key_name", "key", F.col("id").alias("q_id"))
    return keys.join(s1, ["country", "key_name", "key"]).select("country", "q_id", "s1_id", "key_name")


def late_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events (ts, event_type, value) of each type in tumbling windows; rows later than `late` behind the newest are dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
