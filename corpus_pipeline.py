"""The training-data pipeline: five stages, each written as Parquet and read again by the next.

Every stage decides on rows, not on ids. A null text or one without a letter goes in the first stage, if
there is a language to learn; where no document has one, nothing can be told and all stay. Rows of one
id, or without an id, are documents of their own in every stage. Of equal documents, under one id too,
one row stays: that with the smallest id. An empty table gives an empty table; columns beyond those of
`documents` pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import decontaminate, langid, minhash, packing, pii
from lumenloom.llm.common import fold, materialize, table

#: Below this calibrated probability a document is taken to be in none of the languages.
LEAST_SCORE = 0.5
#: Id lists up to this length are broadcast (8 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 200_000
ROW = "__row_number"


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, written once so that the numbers stay."""
    return materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(numbered: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number isn't in `gone` (column doc_id)."""
    gone = materialize(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return numbered.join(gone, numbered[ROW] == gone["__gone"], "left_anti").drop(ROW)


def _by_row(numbered: DataFrame) -> DataFrame:
    return numbered.select(F.col(ROW).alias("doc_id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, without text, or of no learned language; none if no language is known."""
    model = langid.train(docs, ~fold("doc_id", *langid.HELD))
    if not model.langs:
        return docs
    judged = langid.predict(docs.withColumn("__read", F.col("text")), model, text_col="__read", prefix="__")
    return judged.where((F.col("__lang_pred") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    numbered = _numbered(docs)
    groups = minhash.near_duplicates(_by_row(numbered), size=5, similarity=0.8)
    groups = materialize(groups.where("n_shingles > 0").select("doc_id", "component_id"), "groups")
    ids = numbered.select(F.col(ROW).alias("doc_id"), F.col("doc_id").alias("id"))
    first = groups.join(ids, "doc_id").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "doc_id"))["doc_id"].alias("first"), F.count("*").alias("n"))
    gone = groups.join(first.where("n > 1"), "component_id").where("doc_id <> first")
    return _without(numbered, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    numbered = _numbered(docs)
    return _without(numbered, decontaminate.contaminated(_by_row(numbered), table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind and counts their characters anew."""
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their windows."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: A learned model and a tokenizer are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
