"""TF-IDF vectors as postings (country, id, side, feature, w), one row a nonzero weight.

tf = 1 + ln(count), idf = ln((1 + n) / (1 + df)) + 1 over the records of all sources of a country, features of
fewer than two records left out, vectors of length 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import CURRENT, Config


def char_grams(c: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """All character n-grams of a string, repeated ones too."""
    grams = [F.when(F.length(c) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>")) for k in sizes]
    return F.concat(*grams)


def unit(postings: DataFrame) -> DataFrame:
    """The postings with each record's weights scaled to length 1; without weights there is no row."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("country", "id", "side")))
    return postings.withColumn("w", F.col("w") / norm)


def tfidf(records: DataFrame, features: Column, min_df: int = 2) -> DataFrame:
    """Unit TF-IDF postings of an array column's elements."""
    side = F.when(F.col("source") == "S1", "s").otherwise("q").alias("side")
    counts = records.select("country", "id", side, F.explode(features).alias("feature")).groupBy("country", "id", "side", "feature").agg(F.count("*").alias("c"))
    df = counts.groupBy("country", "feature").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    total = records.groupBy("country").agg(F.count("*").alias("n"))
    idf = df.join(total, "country").select("country", "feature", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return unit(counts.join(idf, ["country", "feature"]).select("country", "id", "side", "feature", ((1 + F.log("c")) * F.col("idf")).alias("w")))


def name_space(records: DataFrame) -> DataFrame:
    return tfidf(records, char_grams(F.col("skel")))


def address_space(records: DataFrame) -> DataFrame:
    return tfidf(records, F.filter(F.split("naddr", " "), lambda t: t != ""))


def joint_space(names: DataFrame, addresses: DataFrame, w_name: float = CURRENT.w_name) -> DataFrame:
    """Both spaces side by side, weighted, of length 1 again."""
    part = lambda df, tag, w: df.withColumns({"feature": F.concat(F.lit(tag), F.col("feature")), "w": F.col("w") * w})
    return unit(part(names, "n:", w_name).unionByName(part(addresses, "a:", 1 - w_name)))


def retrieval(space: DataFrame, records: DataFrame, cfg: Config = CURRENT) -> DataFrame:
    """The space without features that too many S1 records have, of length 1 again; this is what keeps the
    postings join from growing with the square of common features."""
    df = space.where("side = 's'").groupBy("country", "feature").agg(F.count("*").alias("df"))
    total = records.where("source = 'S1'").groupBy("country").agg(F.count("*").alias("n"))
    common = df.join(total, "country").where(F.col("df") > F.greatest(F.col("n") * cfg.knn_max_df, F.lit(float(cfg.knn_df_floor))))
    return unit(space.join(common.select("country", "feature"), ["country", "feature"], "left_anti"))


def nearest(space: DataFrame, k: int, least: float) -> DataFrame:
    """(country, q_id, s1_id, sim, rank): each query record's k most similar S1 records above `least`; ties, at six
    decimals, to the smaller id."""
    q = space.where("side = 'q'").select("country", "feature", F.col("id").alias("q_id"), F.col("w").alias("wq"))
    s = space.where("side = 's'").select("country", "feature", F.col("id").alias("s1_id"), F.col("w").alias("ws"))
    sims = q.join(s, ["country", "feature"]).groupBy("country", "q_id", "s1_id").agg(F.round(F.sum(F.col("wq") * F.col("ws")), 6).alias("sim"))
    order = Window.partitionBy("country", "q_id").orderBy(F.desc("sim"), "s1_id")
    return sims.where(F.col("sim") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vectors(names: DataFrame, addresses: DataFrame) -> DataFrame:
    """(country, id, side, names, addresses): a record's vectors as maps, null where a space has none of it."""
    whole = lambda df, name: df.groupBy("country", "id", "side").agg(F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias(name))
    return whole(names, "names").join(whole(addresses, "addresses"), ["country", "id", "side"], "full")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two maps, 0 without a common feature."""
    shared = F.transform(F.map_entries(a), lambda e: e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))
    return F.coalesce(F.aggregate(shared, F.lit(0.0), lambda x, y: x + y), F.lit(0.0))


def pair_cosines(pairs: DataFrame, own: DataFrame, w_name: float = CURRENT.w_name) -> DataFrame:
    """pairs (country, q_id, s1_id) with cos_all, cos_name and cos_addr of their full vectors (as `vectors` gives them).
    Each record's row meets its pairs once a side; the joint space's cosine follows from the other two, as its
    parts are vectors of length 1 or none."""
    side = lambda tag, key: own.where(F.col("side") == tag).select("country", F.col("id").alias(key), F.col("names").alias(f"__n{tag}"), F.col("addresses").alias(f"__a{tag}"))
    both = pairs.join(side("q", "q_id"), ["country", "q_id"], "left").join(side("s", "s1_id"), ["country", "s1_id"], "left")
    length = lambda tag: F.sqrt(F.when(F.col(f"__n{tag}").isNotNull(), w_name**2).otherwise(0.0) + F.when(F.col(f"__a{tag}").isNotNull(), (1 - w_name) ** 2).otherwise(0.0))
    both = both.withColumns({"__name": dot(F.col("__nq"), F.col("__ns")), "__addr": dot(F.col("__aq"), F.col("__as")), "__length": length("q") * length("s")})
    joint = F.when(F.col("__length") > 0, (w_name**2 * F.col("__name") + (1 - w_name) ** 2 * F.col("__addr")) / F.col("__length")).otherwise(0.0)
    cosines = {"cos_all": F.round(joint, 6), "cos_name": F.round("__name", 6), "cos_addr": F.round("__addr", 6)}
    return both.withColumns(cosines).drop("__nq", "__aq", "__ns", "__as", "__name", "__addr", "__length")
