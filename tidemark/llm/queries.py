"""The queries of this package, for the driver's entry file: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ann import nearest
from tidemark.llm.bpe import encode_decode
from tidemark.llm.common import table
from tidemark.llm.fingerprints import document_fingerprints
from tidemark.llm.gru import language_scores
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.suffix import remove_repeats
from tidemark.llm.template import TemplateRules, main_text
from tidemark.llm.tokenbin import packed_rows
from tidemark.llm.toxicity import toxicity
from tidemark.llm.whitening import whiten

TOKENIZER = "word_bpe_49k.json"


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)


def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op5_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"), TemplateRules(by_position=True))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_packed_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_rows(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_parity_mask_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_divergence": op1_quality_divergence,
        "op2_bpe_forced_boundaries": op2_bpe_forced_boundaries,
        "op3_projected_neighbours": op3_projected_neighbours,
        "op4_gru_language_model": op4_gru_language_model,
        "op5_toxicity_lexicon": op5_toxicity_lexicon,
        "op6_template_extraction": op6_template_extraction,
        "op7_simhash_pigeonring": op7_simhash_pigeonring,
        "op8_packed_token_rows": op8_packed_token_rows,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_certified_packing": op10_certified_packing,
        "op11_parity_mask_spelling": op11_parity_mask_spelling,
        "op12_exact_whitening": op12_exact_whitening,
        "op13_one_permutation_minhash": op13_one_permutation_minhash,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator: none of these can be, so tests hold them against brute force."""
    return {}
