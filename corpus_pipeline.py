"""Training-data pipeline: documents in, packed token sequences out. Each stage is one corpus operator."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_templates, near_dup, packing, phrase_index, toxicity
from weftline.llm.common import crc_mod, in_files, stored, table
from weftline.llm.queries import MAX_TOKENS, tokenizer_path

#: Fitted models and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't reject. Labels of held-out ids are not learned from."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the lines of recurring templates; n_chars, where there is one, follows the text."""
    out = line_templates.drop_recurring_lines(docs, "__lines", "__dropped")
    if "n_chars" in docs.columns:
        chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, chars).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    extra = near_dup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return in_files(docs.join(extra, "doc_id", "left_anti").select(docs.columns), 4)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate."""
    return phrase_index.reject_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), MAX_TOKENS)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", reject_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again."""

    def apply(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        return stored(function(spark, docs, sf_dir), f"stage-{name}")

    return functools.reduce(apply, STAGES, table(spark, sf_dir, "documents"))
