"""A corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage is a function of (spark, docs, sf_dir) that calls one operator on all documents its
predecessor kept. A stage's result is written as Parquet and read again as the next one's docs; all
but the last return the columns of documents.

Defined cases, for every stage: columns beyond those of documents are ignored, whatever their names; an
empty table gives no rows. A null or empty text fails the quality rules; given to a later stage it is not in a
learned language (so it goes there), is nobody's near duplicate, and packs to the end id alone. A null lang
teaches nothing. A null doc_id stays; of rows that repeat a doc_id the third stage keeps one.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, ngram_join, packing, quality
from tidemark.llm.common import dropped, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs.select(*COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.filtered(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.representatives(docs.select(*COLUMNS), width=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("packing", pack)]

#: Packing depends on tokenizers, and language ID on a trained model; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage read is deleted once its own result is written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/tidemark/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            dropped(spark, f"{folder}/{k - 1}")
    return docs
