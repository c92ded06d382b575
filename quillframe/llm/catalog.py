"""Queries of this subpackage, one an operator, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, line_dedup, packing, quality_rules, substring_dedup, suffix_dedup, training_order, url_filter
from .common import table
from .sql import ORACLE_SQL  # noqa: F401


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, url_filter.repeated_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["length"], x["keeper"])), ",")
    return done.select("doc_id", "n_removed_words", "n_removed", "n_removed_chars", "n_units", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), spans.alias("removed_spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.where("not held_out").select("doc_id", "text", "lang"))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = quality_rules.apply_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {
    f.__name__: f
    for f in (op2_url_filters, op3_substring_dedup, op5_language_id, op6_ngram_jaccard_join, op7_decontamination, op8_best_fit_packing, op9_line_dedup, op10_quality_rules)
}


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = training_order.materialise(docs, training_order.default_dir(spark))
    return made.select("seq", "slot", "shard", "record", "n_tokens", "sha256", "doc_ids")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeated_strings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES |= {f.__name__: f for f in (op1_training_order, op4_suffix_array_dedup)}
