"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last
returns ids. Between stages rows are written, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.llm import decontaminate, language_id, near_dedup, piece_codec, quality_rules
from gapline.llm.queries import piece_model
from gapline.sources.scratch import written

#: Least share of a document's letters in its main language.
LANGUAGE_SHARE = 0.5


def rule_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no base rule and whose source is not rejected."""
    return quality_rules.judge(docs).where("kept").select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have letters and mostly one language, as learned from the labelled ones.

    If none is labelled there is nothing to judge by, and all stay.
    """
    model = language_id.train(docs)
    if not model.langs:
        return docs
    found = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return found.where(f"lang_pred <> '{language_id.UNKNOWN}' AND score >= {LANGUAGE_SHARE}").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages they share with benchmark items, unless these are half of the words.

    Spans of fewer words than a window are whole items, and are cut as well.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontaminate.decontaminate(docs, items, max_span=0)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    encoded = piece_codec.encode(docs.select("doc_id", "lang", "source", "text"), piece_model())
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", rule_quality),
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("piece_codec", encode_pieces),
]
#: No stage but the first can be stated in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
