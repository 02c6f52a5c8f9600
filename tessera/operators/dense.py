"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def pair_cosine(pairs: DataFrame, vectors: DataFrame, left: str, right: str, name: str = "emb_cos") -> DataFrame:
    """pairs with the cosine of the vectors (vec_id, embedding) that their two columns name."""
    side = lambda c, tag: vectors.select(F.col("vec_id").alias(c), F.col("embedding").alias(tag))
    both = pairs.join(side(left, "__a"), left).join(side(right, "__b"), right)
    return both.withColumn(name, cosine(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def mean_pool(vectors: DataFrame, group: str) -> DataFrame:
    """(group, vector): the component-wise mean of each group's vectors."""
    parts = vectors.select(group, F.posexplode("embedding").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
