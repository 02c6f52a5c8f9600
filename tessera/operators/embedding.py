"""Vectors of texts by any encoder, computed once a text and kept; cosines of pairs of records by them.

An encoder is a function from a list of texts to rows of numbers. Its name stands for it in the cache, so that
another encoder needs another name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.dense import dot
from tessera.sources.records import exists

SCHEMA = "key string, vector array<double>"
#: Length of the vectors of `hashed_grams`, and texts of one call of an encoder.
DIMENSIONS, BATCH = 64, 1024


@lru_cache(100_000)
def _place(gram: str) -> int:
    return int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) % DIMENSIONS


def hashed_grams(texts: list[str]) -> np.ndarray:
    """Counts of a text's character trigrams by a hash of them: an encoder that needs no model."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        for i in range(len(text) - 2):
            row[_place(text[i : i + 3])] += 1
    return out


def text_vectors(texts: DataFrame, encode: Callable = hashed_grams, name: str = "hashed_grams", folder: str = "") -> DataFrame:
    """(text, vector) of the distinct texts of `texts` (text), vectors of length 1, or 0 if the encoder gives only zeros; null
    is no text. The vectors are kept in `folder` by the MD5 of the whole text: only texts that it lacks are encoded. It must
    be a folder that all executors share. Two runs at a time may write a text twice, with equal vectors; one is read."""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                rows = np.asarray(encode(part["text"].tolist()), float)
                length = np.linalg.norm(rows, axis=1, keepdims=True)
                yield pd.DataFrame({"key": part["key"], "vector": list(np.divide(rows, length, out=np.zeros_like(rows), where=length > 0))})

    spark = texts.sparkSession
    place = f"{folder.rstrip('/')}/vectors-{hashlib.md5(name.encode()).hexdigest()[:16]}"
    own = texts.select("text").where("text is not null").distinct().withColumn("key", F.md5(F.col("text").cast("binary")))
    kept = lambda: spark.read.schema(SCHEMA).parquet(place)
    new = own.join(kept().select("key"), "key", "left_anti") if exists(spark, place) else own
    new.select("key", "text").mapInPandas(encoded, SCHEMA).write.mode("append").parquet(place)
    return own.join(kept().groupBy("key").agg(F.first("vector").alias("vector")), "key").select("text", "vector")


def name_cosines(pairs: DataFrame, records: DataFrame, column: str = "name", folder: str = "", encode: Callable = hashed_grams, name: str = "hashed_grams") -> DataFrame:
    """pairs (country, s1_id, q_id) with emb_cos, the cosine of both records' trimmed names; a missing name is the empty text."""
    texts = records.select("country", "id", F.col("source").alias("__source"), F.trim(F.coalesce(column, F.lit(""))).alias("text"))
    vectors = texts.join(text_vectors(texts, encode, name, folder), "text")
    side = lambda rows, key, tag: vectors.where(rows).select("country", F.col("id").alias(key), F.col("vector").alias(tag))
    both = pairs.join(side("__source = 'S1'", "s1_id", "__a"), ["country", "s1_id"]).join(side("__source <> 'S1'", "q_id", "__b"), ["country", "q_id"])
    return both.withColumn("emb_cos", dot(F.col("__a"), F.col("__b"))).drop("__a", "__b")
