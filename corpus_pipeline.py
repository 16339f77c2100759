"""The document pipeline: stages over `documents`, each written as Parquet and read again.

Rows that are null, empty or repeated pass through the stages as their operators say: a text
without words fails the quality rules, repeated rows are near copies of each other, and a
null doc_id stays null. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tilescape.llm import line_runs, mixing, packing, quality_rules, shingle_forest
from tilescape.llm._common import DOC, cut, keyed, read
from tilescape.llm.queries import MIX, domain_labels, quality_verdicts, tokenizer_path

#: SQL cannot express the tokenizer and the trained classifier: tested against brute force instead.
ORACLE_SQL = None


def _extracts(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({"doc_id": "extract_id", "lang": "area"})


def _documents(extracts: DataFrame, docs: DataFrame) -> DataFrame:
    return extracts.withColumnsRenamed({"extract_id": "doc_id", "area": "lang"}).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. The measures are taken twice, so that no text is shuffled."""
    extracts = _extracts(docs)
    measured = cut(quality_rules.with_measures(extracts.select("extract_id", "area", "text")).drop("text"))
    cutoffs = cut(quality_rules.risk_cutoffs(measured, quality_verdicts(spark, sf_dir), "area"))
    judged = quality_rules.with_verdict(quality_rules.with_measures(extracts), cutoffs, "area")
    return _documents(judged.filter("kept"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that repeat earlier ones; those with nothing left go."""
    short = line_runs.drop_repeated_runs(_extracts(docs))
    left = short.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _documents(left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies."""
    return _documents(shingle_forest.drop_near_extracts(_extracts(docs)), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    extracts = _extracts(docs)
    mixed = mixing.mix_extracts(extracts, domain_labels(spark, sf_dir), MIX, max_rate=math.inf)
    often = mixed.filter("copies > 0").select(F.col("extract_id").isNull().alias("_null"), F.coalesce("extract_id", F.lit(0)).alias("_id"), "_hash", "copies").distinct()
    return _documents(keyed(extracts).join(often, DOC).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    return packing.pack_extracts(_extracts(docs), tokenizer_path(), 0, 1024).withColumnRenamed("extract_id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("mixing to target weights", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is a written table."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
