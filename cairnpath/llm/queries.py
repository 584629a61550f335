"""The queries of this subpackage, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnpath.llm import byte_bpe, exact_dedup, hd_language, html_text, jaccard_join, license_scan, merkle_manifest, mixing, oracle, pii, prefix_trie, simhash, spotsigs, toxicity
from cairnpath.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, by block naming."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot signatures of every text and its edited text."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and the components that they link."""
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and secrets in every text."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text."""
    return hd_language.languages(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and licences in every text."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of shingles are alike."""
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document in a Merkle manifest."""
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_spotsigs": op2_spotsigs,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_pii": op6_pii,
    "op7_language_id": op7_language_id,
    "op8_license_scan": op8_license_scan,
    "op9_mix_sources": op9_mix_sources,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op12_prefix_trie": oracle.PREFIX_NODES,
    "op13_merkle_manifest": oracle.manifest(),
}
