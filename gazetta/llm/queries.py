"""The queries of this folder, with the tables they run over whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_digests
from .common import table
from .exact_dedup import exact_duplicates
from .html import extract_text
from .packing import pack_documents
from .pii import replace_personal_data
from .quality import quality_measures
from .secrets import scan_secrets
from .sharding import stratified_shards
from .simhash import simhash_components
from .sql import ORACLES
from .warc import warc_round_trip


def tokenizer_path(name: str) -> str:
    """The place of an installed public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(table(spark, sf_dir, "documents"))


def op3_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op7_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(table(spark, sf_dir, "documents"))


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents"))


def op10_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing, op2_pii_surrogates, op3_speculative_bpe, op4_warc_bundles, op5_content_sort_dedup,
        op6_secret_ledger, op7_stratified_shards, op8_wrapper_induction, op9_quality_cascade, op10_simhash_bk_trees,
    )
}

__all__ = ["ORACLES", "QUERIES"]
