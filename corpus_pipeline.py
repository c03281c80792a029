"""A corpus pipeline of five stages, each one operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of documents; the last one
returns the packing. What a stage leaves out is gone for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality
from tidemark.llm.queries import TOKENIZER
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.suffix import remove_repeats
from tidemark.llm.toxicity import toxicity
from tidemark.session import materialize


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The documents whose doc_id is among the kept ones; ids are distinct there."""
    ids = kept.select(F.col("doc_id").alias("kept_id"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; of rows with one id, all or none (a row that fails takes them all)."""
    verdict = quality(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"))
    return _only(docs, verdict.where("kept"))


def toxicity_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by a lexicon learned from the labels of documents that are still here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = toxicity(docs, labels).groupBy("doc_id").agg(F.max("predicted").alias("predicted"))
    return _only(docs, verdict.where("predicted = 0"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id."""
    groups = near_duplicates(docs).select("doc_id", "component_id")
    return _only(docs, groups.where("doc_id <=> component_id").select("doc_id").distinct())


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id holds; n_chars follows.

    A cut inside a character leaves bytes of it; those are dropped.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = remove_repeats(docs, as_text=True, carry=others)
    return left.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces, packed into as few sequences as can be."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_lexicon),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
