"""From raw documents to packed training sequences in five stages, each one operator over all that the stage before kept.

Every stage is written and read again before the next. All but the last return the columns of ``documents``.

Nulls and edges, stage by stage: rows with null ids are ordinary rows throughout. Null, empty and blank texts are rejected by
the quality rules. Repeated rows, rows that share an id and exact ties are separate rows until near-dedup keeps one row a group (the
smallest id, null last). Texts of any length are worked on whole. An empty table, or one of which no row is kept, goes through
every stage as an empty table. Columns beyond those of ``documents`` are dropped by the first stage, whatever their names; the columns of ``documents`` keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import mixing, packing, quality, simhash, substrings
from fieldglass.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _shape(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; of the rest, failing lines go."""
    judged = quality.judge(docs).filter("kept")
    return _shape(judged.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays, once."""
    return _shape(simhash.keep_one(docs, simhash.similar_texts(docs)))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier go; a document left without words goes."""
    left = substrings.dedup_substrings(docs, keep=("text", "lang", "source"))
    # an untouched text keeps its own white space
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return _shape(left.filter("n_words > n_removed").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the balanced sample takes it."""
    return mixing.mixed_rows(_shape(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing sources", mix_sources), ("packing", pack_sequences)]

#: SQL cannot express the fingerprints, the balanced sample or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
