"""A corpus pipeline: five stages over `documents`, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkdom.llm import bpe, decontaminate, jaccard, suffix_dedup, toxicity
from sparkdom.llm.common import drop_table, fold, leftovers, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.7 or more go; it learns from the same labels as op3."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a Jaccard similarity of 0.8 or more (5-word shingles) one document stays, that with the smallest doc_id.

    Candidates come from SimHash as in op8, and from MinHash what lies over 4 bits apart; an exact check follows.
    """
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too are taken out of every text."""
    return suffix_dedup.remove(docs, keep_text=True)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item leaks into go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, with digests of them and of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("benchmark leaks", drop_leaks),
    ("encoding", encode),
]

#: No stage but the last could be written in SQL, and that needs the one before.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables of a stage are deleted once the next has been written; what the result reads stays until common.clean()."""
    docs = table(spark, sf_dir, "documents")
    mine = set(leftovers(spark))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, path = materialize(spark, docs, f"stage-{k + 1}")
            for p in set(leftovers(spark)) - mine - {path}:
                drop_table(spark, p)
    return docs
