"""A corpus pipeline: five stages over documents, each by one operator of quern.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents as they are.

    language         rejects texts without an identified language (no letter, a score under one half, or letters that fit none)
    toxicity         rejects texts that score one half or more
    near_duplicates  keeps one row of each component of texts with 5-word similarity 0.8 or more, the smallest doc_id (SimHash anchors first)
    decontamination  rejects texts that cover at least half of a benchmark item
    encoding         gives each text's SentencePiece ids

Null texts count as empty, which has no language, so they go in the first stage.
Repeated rows are copies, of which one stays.  Rows with a null doc_id are
judged like others.  Texts of any length are judged whole; of ties the smallest
doc_id stays.  Columns beyond those of documents pass through the first four
stages, whatever their names.  An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontaminate, langid, sentencepiece, simhash, toxicity
from quern.llm.common import TOKENIZERS, held_out, remove, shared_dir, table

VOCABULARY = f"{TOKENIZERS}/piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.train(docs, ~held_out("doc_id", 3, 1), VOCABULARY))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(docs, VOCABULARY)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can express neither the learned stages nor those that follow them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(folder := shared_dir(spark, name))
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
