"""Reading and writing of records, truth, id lists and parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All columns as strings, missing as the empty string; quotes are doubled inside quotes, lines may break there."""
    reader = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)
    return df.fillna("")


def load_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(S1, S2 and S3 together with their source, truth or None) of the split train or test."""
    s1, s2, s3 = (read_tsv(spark, f"{folder}/{split}_source{i}.tsv", RECORD) for i in (1, 2, 3))
    truth = read_tsv(spark, f"{folder}/{split}_ground_truth.tsv") if split == "train" else None
    both = s2.withColumn("source", F.lit("S2")).unionByName(s3.withColumn("source", F.lit("S3")))
    return s1, both, truth


def truth_pairs(truth: DataFrame, ids: str = "source1_entity_id", matches: str = "matched_entity_ids") -> DataFrame:
    """(s1_id, q_id) of comma lists; nulls and empty entries give nothing."""
    return truth.select(F.col(ids).alias("s1_id"), F.explode(F.split(matches, ",")).alias("q_id")).where("q_id is not null and q_id <> ''")


def id_lists(ids: DataFrame, pairs: DataFrame, header: str) -> DataFrame:
    """One row for each id of `ids` (s1_id): source1_entity_id and the sorted distinct q_ids of `pairs`, comma-joined."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("q_id")), ",").alias(header))
    return ids.join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(header, F.lit("")).alias(header))


def write_id_lists(ids: DataFrame, pairs: DataFrame, header: str, path: str, order: str | None = None, one_file: bool = False) -> None:
    """The lists as a TSV folder with a header, in the order of a column of `ids` where one is named; with one_file
    as one file at that path, which one task writes."""
    out = id_lists(ids, pairs, header)
    if order:
        out = out.join(ids.select(F.col("s1_id").alias("source1_entity_id"), F.col(order).alias("__order")), "source1_entity_id").orderBy("__order").drop("__order")
    if not one_file:
        out.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", quote="").csv(path)
        return
    folder = f"{path}.parts"
    out.coalesce(1).write.mode("overwrite").options(sep="\t", header=True, emptyValue="", quote="").csv(folder)
    fs, place = file_system(out.sparkSession, folder)
    part = next(f.getPath() for f in fs.listStatus(place(folder)) if f.getPath().getName().startswith("part-"))
    fs.delete(place(path), True)
    fs.rename(part, place(path))
    fs.delete(place(folder), True)


def file_system(spark: SparkSession, path: str):
    """(the Hadoop file system of a path, the function from a string to its path)."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table that was written to its end."""
    fs, place = file_system(spark, path)
    return fs.exists(place(f"{path}/_SUCCESS"))


def purge(spark: SparkSession, path: str) -> None:
    fs, place = file_system(spark, path)
    fs.delete(place(path), True)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Long form: a TSV folder of source1_id, source2_or_source3_id and country, one row a pair."""
    rows = pairs.select(F.col("s1_id").alias("source1_id"), F.col("q_id").alias("source2_or_source3_id"), "country")
    rows.write.mode("overwrite").options(sep="\t", header=True).csv(path)


def write_zip(spark: SparkSession, files: list[str], path: str) -> None:
    """An archive of single files under their names, streamed by the driver from and to any file system."""
    jvm = spark._jvm
    fs, place = file_system(spark, path)
    out = jvm.java.util.zip.ZipOutputStream(fs.create(place(path), True))
    for file in files:
        source = file_system(spark, file)[0].open(place(file))
        out.putNextEntry(jvm.java.util.zip.ZipEntry(place(file).getName()))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        source.close()
        out.closeEntry()
    out.close()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct trimmed ids of a table's first column."""
    df = read_tsv(spark, path)
    return df.select(F.trim(df.columns[0]).alias("id")).where("id <> ''").distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, left, right, has_tab) of a file as it is, without quoting rules."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    parts = F.split("line", "\t", 2)
    return lines.select("line", F.get(parts, 0).alias("left"), F.coalesce(F.get(parts, 1), F.lit("")).alias("right"), F.contains("line", F.lit("\t")).alias("has_tab"))


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def cached(spark: SparkSession, path: str, config: dict, make) -> DataFrame:
    """The table at a path that names its configuration, made once: a changed configuration is another path."""
    place = f"{path}/{hash_text(json.dumps(config, sort_keys=True, default=str))}"
    if not exists(spark, place):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def hash_text(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def records_of_documents(docs: DataFrame) -> DataFrame:
    """Business-like records from documents: country = lang, source by doc_id modulo 3, the first four words as the name,
    the next six and n_chars as the address. S1 keeps one record of equal texts in a country, the smallest doc_id's."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+", " "), " "), lambda t: t != "")
    source = F.concat(F.lit("S"), F.pmod("doc_id", F.lit(3)) + 1)
    rows = docs.select(
        F.concat(source, F.lit("-"), F.col("doc_id")).alias("id"),
        source.alias("source"),
        F.coalesce("lang", F.lit("")).alias("country"),
        F.array_join(F.slice(words, 1, 4), " ").alias("name"),
        F.concat_ws(" ", F.array_join(F.slice(words, 5, 6), " "), F.col("n_chars").cast("string")).alias("addr"),
        "doc_id",
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("body"),
    )
    first = rows.where("source = 'S1'").groupBy("country", "body").agg(F.min("doc_id").alias("doc_id"))
    return rows.where("source <> 'S1'").unionByName(rows.join(first, ["country", "body", "doc_id"], "left_semi"))
