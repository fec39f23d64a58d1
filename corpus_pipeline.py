"""A corpus pipeline: quality rules, line deduplication, near-duplicates, benchmark decontamination, BPE encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before has kept; its result is written as
Parquet and read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe_codec, decontamination, line_dedup, ngram_join, quality_ledger
from palimpsest.llm.common import saved, table
from palimpsest.sinks.scratch import temporary_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy with toxic terms, learnt from the labels, keeps and no base rule fails.

    Null and empty texts have too few words and go; repeated rows and null ids are judged each on its own.
    """
    done = quality_ledger.ledger(docs, keep=("text", *OTHERS), terms=quality_ledger.toxic_terms(docs, table(spark, sf_dir, "labels")))
    bits = F.col("fail_bits")
    return done.where(~quality_ledger.base_failed(bits) & quality_ledger.LABELLED.keeps(bits)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words or more that an earlier place has; those of which nothing is left go.

    Null, empty and blank texts are such; rows equal in id and text stay, each.
    """
    done = line_dedup.dedup_lines(docs, keep=OTHERS)
    left = F.trim(F.col("text"), F.lit(line_dedup.SPACES)) != ""
    length = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.where(left).withColumn("n_chars", length).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one of least id; documents of one id with different texts are told apart.

    Null and wordless texts are each a class of its own by id; of rows equal in id and text, null ones too, one stays.
    """
    keyed = docs.withColumn("__key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    classes = ngram_join.jaccard_classes(keyed, doc_id="__key")
    heads = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__head"))
    return keyed.dropDuplicates(["__key"]).join(heads, F.col("__key").eqNullSafe(F.col("__head")), "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; null and empty texts have none and stay, as repeated rows and null ids do."""
    done = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=("text", *OTHERS))
    return done.where(F.size("items") == 0).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, n_tokens)``: what is left, as token ids; null and empty texts have none, repeated rows and null ids stay."""
    return bpe_codec.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("BPE encoding and decoding", encode)]

#: SQL has no byte-pair merges; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables that a stage writes on its way go when it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
