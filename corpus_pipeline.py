"""A corpus pipeline of five training-data operators: each stage reads what the one before it kept.

Null and empty texts fail the quality rules and go there; null ids, sources and other columns pass every stage; ties go
as the stage's operator says, alike in each run; rows that repeat id and text are one document to line dedup and
near-duplicates; each stage takes an empty table and columns beyond documents' own, of any names, without reading them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, line_dedup, mixing, quality_rules, simhash
from weftline.llm.common import discard, read_table, stored
from weftline.llm.queries import bpe_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays in the corpus; documents left without any go."""
    return line_dedup.dedup_lines(docs).where("n_kept > 0").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their targets; a row for each copy, in order of training."""
    return mixing.mixed(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies' ids, little-endian unsigned 32-bit, and their digest."""
    return bpe.encode_documents(docs, bpe_path()).select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: Near-duplicate components cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return stored(STAGES[-1][1](spark, docs, sf_dir), "encoded")
