"""From raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps; between stages the
documents are written as Parquet and read again. All stages but the last return the
columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.entropy_mix import entropy_mix, source_key, weighted_targets, words
from tidemill.llm.jaccard_join import BROADCAST_IDS, near_duplicates
from tidemill.llm.kneser_ney import quality
from tidemill.llm.linear_packing import linear_packing
from tidemill.llm.pii_votes import pii_spans, redacted
from tidemill.llm.stages import staged
from tidemill.session import workspace

#: Some stages depend on models made from the documents, which SQL can't express.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the perplexity bands reject."""
    return quality(docs).where("kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and of
    rows that share an id the smallest. Documents without an id or without words are in no
    group and stay."""
    found = staged(near_duplicates(docs), "pipeline-classes")
    rows = found.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max(F.col("component") == F.col("id")).alias("first"))
    rows = staged(rows, "pipeline-ids").withColumnRenamed("id", "doc_id")
    others = rows.where("not first").select("doc_id")
    others = F.broadcast(others) if others.count() <= BROADCAST_IDS else others
    repeated = rows.where("first and n > 1").select("doc_id")
    repeated = F.broadcast(repeated) if repeated.count() <= BROADCAST_IDS else repeated
    kept = docs.join(others, "doc_id", "left_anti")
    once = kept.join(repeated, "doc_id", "left_anti")
    least = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return once.select(*docs.columns).unionByName(least.select("row.*"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by the name of its kind."""
    found = pii_spans(docs)
    if "spans" in docs.columns:
        raise ValueError("the documents have a column named spans")
    clean = found.withColumn("text", redacted(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes to its target size."""
    slim = staged(docs.select("source", words(F.col("text")).alias("size")), "pipeline-sizes")
    totals = slim.groupBy(source_key(F.col("source")).alias("key")).agg(F.sum("size").alias("words"))
    targets = staged(weighted_targets(totals), "pipeline-targets")
    sized = docs.withColumn("_words", words(F.col("text")))
    copies = entropy_mix(sized, targets, size_column="_words").where("copies > 0")
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in sequences of the training length."""
    found = linear_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.toDF("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = workspace(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
