"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import mixing, packing, pii, simhash, sitetree, substrings, topk, toxicity, urlfilter, versions
from kinfold.runtime import table


def op1_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.op1_query(table(spark, sf_dir, "pages"), table(spark, sf_dir, "events"))


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.op2_query(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3_query(table(spark, sf_dir, "documents"))


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4_query(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_query(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op6_query(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7_query(table(spark, sf_dir, "documents"))


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.op8_query(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op10_query(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_temporal_list_join": op1_temporal_list_join,
    "op2_site_style_tree": op2_site_style_tree,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_surrogates": op4_surrogates,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_exact_top_k": op10_exact_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op1_temporal_list_join": urlfilter.OP1_SQL,
    "op5_source_mixing": mixing.OP5_SQL,
    "op6_substring_dedup": substrings.OP6_SQL,
    "op10_exact_top_k": topk.OP10_SQL,
}
