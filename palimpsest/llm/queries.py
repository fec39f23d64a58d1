"""The registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, brown_lm, decontamination, html_text, line_dedup, ngram_join, pii, quality_ledger, token_counts, url_reputation
from .common import table

#: The URL rules that the query applies.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: More tokens than this are over the limit.
TOKEN_LIMIT = 2048


def _judged(spark: SparkSession, sf_dir: str, labels: DataFrame) -> DataFrame:
    done = url_reputation.judge_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)
    return done.select("page_id", "host", "path", "rule", "verdict", "rate")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels name pages by their id; a page is bad if its quality is 0 or it is toxic."""
    return _judged(spark, sf_dir, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")))


def op1_planted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With outcomes that differ by host, so that the bound blocks: pages of hosts with an even number of characters are bad."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return _judged(spark, sf_dir, table(spark, sf_dir, "pages").select("page_id", (F.length(host) % 2 == 0).alias("bad")))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, docs = brown_lm.fit(table(spark, sf_dir, "documents"), ~brown_lm.held_out(F.col("doc_id")))
    return brown_lm.scores(docs, model).select("doc_id", brown_lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the terms of toxic texts in each language, learnt from the labels."""
    docs = table(spark, sf_dir, "documents")
    return quality_ledger.ledger(docs, terms=quality_ledger.toxic_terms(docs, table(spark, sf_dir, "labels")))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept means: not failed by the base rules, and kept by the newest policy."""
    failed = quality_ledger.base_failed(F.col("fail_bits"))
    return _ledger(spark, sf_dir).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & quality_ledger.LABELLED.keeps(F.col("fail_bits"))).alias("kept"), "n_toxic_terms", "fail_bits"
    )


def op6_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy costs, from counts by bit pattern."""
    return quality_ledger.ablations(_ledger(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are written as kind:start:end; those of the four base kinds come first in every list."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(write(base), 256).alias("base_sha256"), write(F.col("spans")).alias("spans"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def op9_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which two of the three rarest terms of an item lie within 20 words."""
    return decontamination.proximity_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_codec.round_trip(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_reputation, op1_planted_hosts, op2_html_text, op3_brown_lm, op4_ngram_jaccard, op5_token_counts, op6_quality_ledger, op6_ablations, op7_line_dedup, op8_personal_data, op9_decontamination, op9_proximity, op10_bpe_codec)}


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as sql

    return sql()
