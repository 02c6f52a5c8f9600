"""A corpus from raw documents to mixed and encoded training data, in five stages.

Each stage works on all that its predecessor kept. A stage's rows are written as Parquet and read again as the
next one's input, so that a lost executor costs no more than the stage at hand.

All stages but the last return the columns of their input, whatever their names, and rows of them: a null text is an empty
one, rows without a doc_id can't be named by a result and stay, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality
from tessera.llm.common import scratch_dir, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels, doesn't reject. Repeated rows are judged alike;
    without labels none is rejected; a score at the threshold stays."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one of the largest doc_id; of rows that repeat that too, one."""
    return exact_dedup.drop_copies(docs)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by similar shingle sets, the one of the smallest doc_id. Texts without words link with
    nothing and stay; rows that repeat a doc_id stay together."""
    return ngram_join.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, a part counting from one half on; null is a source of
    its own; documents without words stay once. Ties go by hash, so that reruns agree."""
    return mixing.repeat_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the tokens and of the text that they decode to, for each row of the mix, repeated ones
    too; a null text has no tokens."""
    return byte_bpe.digests(docs)


#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_texts),
    ("n-gram Jaccard join", no_near_duplicates),
    ("mixing sources", mixed_sources),
    ("byte-level BPE", encoded),
]

#: SQL can't express the classifier, the tokenizer and, on whole tables, the near-duplicate join.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        docs = spark.read.parquet(path)
    return docs
