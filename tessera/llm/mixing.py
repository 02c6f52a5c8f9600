"""Mixing sources to target weights by capped water-filling.

Targets are min(cap, level * weight), where cap = max epochs * the source's size and the level makes them sum to
the wanted total: sources below it are clamped and their excess goes to the others in proportion to weight. As a
source is clamped if and only if its cap / weight is below the level, one pass over the sources in that order
finds it. Each source then takes whole repetitions of all its documents and a seeded fraction of them once more:
documents in hash order until the target is reached, the last one with a part of its words. The order is walked
over hash buckets first, so that only one bucket of a source is ever sorted, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fitting, materialise

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2, 17
#: Hash buckets of a source: three hex digits.
DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes (source, weight, source_size) with target. One row a source: sources are few beside documents, and
    only these rows meet in one task."""
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(epochs))
    ranked = (
        sizes.withColumn("cap", cap)
        .withColumn("ratio", cap / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)
    return ranked.withColumn("level", first["level"]).select("source", "weight", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size (words), source_size, target, taken (words the mix
    takes, repeats counted). Sources sorted by code point, null last, get the weights in turn. Null texts have no
    words; documents of equal id and repeated rows are taken one by one; no document is taken more than `epochs`
    times; sources without words have target 0; an empty table gives an empty result. Sources of equal cap a weight go by
    code point. Extra columns, whatever their names, are left out. Reruns agree, however the rows are partitioned."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Rows without a doc_id spread by their texts. Rows equal in id, size and text hash are interchangeable.
    named = F.when(F.col("doc_id").isNull(), F.md5(text.cast("binary"))).otherwise(F.col("doc_id").cast("string"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary"))
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key"), F.xxhash64(text).alias("text_hash"))
    sized = materialise(sized, "sizes")
    bucket = F.conv(F.substring("key", 1, DIGITS), 16, 10).cast("int")
    by_bucket = materialise(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size")), "buckets")
    turn = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    nth = F.pmod(F.row_number().over(turn) - 1, F.lit(len(weights)))
    weight = F.get(F.array(*map(F.lit, weights)), nth)
    sizes = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size")).withColumn("weight", weight)
    aim = materialise(targets(sizes, share, epochs), "targets").withColumnRenamed("source", "__source")
    # What is left of the target after whole repetitions is taken in hash order: whole buckets, then documents of one.
    # One row a source says how: how often all of it, the bucket that is cut, and what is left for that.
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    reached = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    walked = by_bucket.withColumn("reached", F.coalesce(F.sum("bucket_size").over(reached), F.lit(0)))
    walked = walked.join(fitting(aim), F.col("source").eqNullSafe(F.col("__source")))
    walked = walked.withColumn("whole", whole).withColumn("left", F.round("target").cast("long") - F.col("whole") * F.col("source_size") - F.col("reached"))
    cut = F.when((F.col("left") > 0) & (F.col("left") < F.col("bucket_size")), F.struct("bucket", "left"))
    full = F.max(F.when(F.col("left") >= F.col("bucket_size"), F.col("bucket")))
    plan = walked.groupBy("__source").agg(*(F.first(c).alias(c) for c in ("source_size", "target", "whole")), full.alias("__full"), F.max(cut).alias("__cut"))
    plan = materialise(plan, "plan")
    dealt = sized.withColumn("__bucket", bucket).join(fitting(plan), F.col("source").eqNullSafe(F.col("__source")))
    split = F.coalesce(F.col("__bucket") == F.col("__cut.bucket"), F.lit(False))
    even = dealt.where(~split).withColumn("extra", F.when(F.col("__bucket") <= F.col("__full"), F.col("size")).otherwise(F.lit(0)))
    walk = Window.partitionBy("__source").orderBy("key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where(split).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("__cut.left") - F.coalesce(F.sum("size").over(walk), F.lit(0)))))
    return even.unionByName(last).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('{SEED}:' || CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) ELSE CAST(doc_id AS VARCHAR) END) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM f) * weight), cap) AS target FROM l),
w AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(round(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - reached)) AS BIGINT) AS taken FROM w"""


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each row as often as its whole repetitions, a part of one counting from one half.
    All columns stay; documents without words and rows without a doc_id, which weigh nothing or can't be named, stay once."""
    mixed = mix_documents(docs.select("doc_id", "text", "source"), **how).where("doc_id is not null").groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = mixed.select(F.col("doc_id").alias("__doc_id"), F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int").alias("__times"))
    times = materialise(times, "times")
    # The row travels as one struct, so that its columns can't clash with the counts'.
    rows = docs.select(F.col("doc_id").alias("__of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    joined = rows.join(fitting(times, 1_000_000), F.col("__of") == F.col("__doc_id"), "left")
    repeated = joined.select("__row", F.explode(F.array_repeat(F.lit(0), F.coalesce("__times", F.lit(1)))).alias("__copy"))
    return repeated.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
