"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from inkveil.llm import bpe, embedding_dedup, hard_negatives, kd_shards, line_dedup, multiset_hash, packing, simhash, spelling, substring_dedup, token_store, toxicity, url_filter
from inkveil.llm.common import read_table, scratch_path


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as Huffman code, reads them back and digests each document."""
    path, vocab = scratch_path(spark, "store"), 49408
    token_store.store_documents(read_table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), 1, vocab)
    return token_store.store_digest(spark, path, vocab)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 3-word shingles, links of at most 2 bits."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, tau=2)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label with a cosine of at least 0.98."""
    return embedding_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-word windows of documents before it."""
    return substring_dedup.substring_report(read_table(spark, sf_dir, "documents"), 50)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE ids and of the text that they decode to."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judged(read_table(spark, sf_dir, "pages"), url_filter.labelled_urls(spark))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of 40, and the slot in it, of every document."""
    return kd_shards.sharded(read_table(spark, sf_dir, "documents"), 40)


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return multiset_hash.compared(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of two thirds of the doc_ids."""
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op6_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 words, no two of a source or cluster in one."""
    return packing.packed(packing.document_items(read_table(spark, sf_dir, "documents")), 1024)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form, root and near words of every word that all documents hold three times or more."""
    return spelling.spelling_report(read_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that ten documents or more share."""
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, from all vectors of another label."""
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline: toxicity, near-duplicates, repeated passages, packing."""
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_token_store, op2_toxicity, op3_simhash, op4_multiset_hash, op5_embedding_dedup, op6_best_fit, op7_substring_dedup, op8_bpe, op9_url_filter, op10_kd_shards, op11_spelling, op12_line_dedup, op13_hard_negatives, pipeline)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_embedding_dedup": embedding_dedup.ORACLE_SQL, "op7_substring_dedup": substring_dedup.ORACLE_SQL, "op11_spelling": spelling.ORACLE_SQL, "op12_line_dedup": line_dedup.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
