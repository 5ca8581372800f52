"""The queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import cover_tree, decontaminate, filter_audit, langid, merkle, minhash, packing, pii, quality, sql, substring_dedup, token_counts, toxicity, url_filter
from lumenloom.llm.common import fold, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, similarity=0.85)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.linked_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(table(spark, sf_dir, "documents"), received=(fold("doc_id", 5, 0), {"text": small}))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_minhash": op5_minhash,
    "op6_embeddings": op6_embeddings,
    "op7_langid": op7_langid,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": sql.DECONTAMINATE,
    "op2_substring_dedup": sql.SUBSTRING_DEDUP,
    "op4_url_filter": sql.URL_FILTER,
    "op6_embeddings": sql.EMBEDDINGS,
    "op9_pii": sql.PII,
    "op12_merkle_manifest": sql.MERKLE,
    "op13_filter_audit": sql.AUDIT,
}
