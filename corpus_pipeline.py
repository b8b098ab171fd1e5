"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets the documents that the one before it kept, and its decisions take effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import packing, simhash, substring_dedup, toxicity
from inkveil.llm.common import read_table, written

CAPACITY = 1024


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the toxicity field, learnt from `labels`, scores 0.7 or more.

    Null and empty texts score low and stay; rows that repeat are judged alike; without usable
    labels all stay.
    """
    return toxicity.accepted(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near-duplicates.

    Operator 3 links texts whose SimHash fingerprints of 3-word shingles differ in 2 bits or fewer, by the
    generalised pigeonhole principle. Those that are alike in 0.8 or more of 5-word shingles are linked
    too, as fingerprints tell many of these apart. Texts without words, null ones too, are one group; a
    null doc_id comes last.
    """
    return simhash.one_of_each(docs, words=5, similarity=0.8, tau=2, print_words=3)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out the 50-word windows that a document before has too.

    A text that loses all words leaves its row out; null and empty texts stay as they are.
    """
    return substring_dedup.without_repeats(docs, 50)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of CAPACITY words, an end mark for each document.

    A null or empty text is its end mark alone; an empty table gives no rows.
    """
    return packing.packed(packing.document_items(docs), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", cut_repeats), ("packing", pack)]

#: SQL can't express the toxicity field or the packing; tests hold near-duplicates, repeats and
#: packing against brute force, and the field against held-out labels and enumeration, instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table `documents`; each stage is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
