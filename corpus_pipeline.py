"""A training corpus from raw documents: five operators of ``subscope.llm``, one after the other.

Each stage takes (spark, docs, sf_dir). It is written as Parquet and read again before the
next, so a lost executor repeats one stage at most. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from subscope.llm import langid, toxicity
from subscope.llm.common import fold, table
from subscope.llm.exact_dedup import drop_copies
from subscope.llm.packing import pack, pieces
from subscope.llm.queries import tokenizer_file
from subscope.llm.simhash import drop_near_copies
from subscope.session import checkpoint_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, learned from the labelled ones, does not reject."""
    model = toxicity.learn(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their ``lang`` teaches."""
    return langid.keep_language(docs, langid.learn(docs.where(fold("doc_id", 3) != 1)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: three-word shingles, three differing bits at most."""
    return drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces in sequences of at most 2048 tokens."""
    return pack(pieces(docs, tokenizer_file("word_bpe_49k.json"), with_ids=False))


STAGES = [
    ("toxicity", without_toxic),
    ("language_id", in_a_language),
    ("exact_dedup", without_copies),
    ("simhash", without_near_copies),
    ("best_fit_packing", packed),
]

#: no SQL expresses the classifiers, the fingerprints or the packing
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; their tables go to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
