"""From documents to training sequences: language ID, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestat.llm import language_id, mixing, packing, pii, simhash
from lodestat.llm.common import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without letters or with a narrow margin go. Learned from the labels that the documents carry.

    Null and empty texts have no letters and go; texts of any length are read whole; of equal languages the one of more
    labels wins; repeated rows stay repeated; an empty table and one without labels give no rows; all columns stay.
    """
    names = docs.columns
    known = language_id.learn(docs, F.lit(True))
    chosen = docs.select(F.struct("*").alias("row"))
    return language_id.identify(chosen, known, inside="row").where("not rejected").select(*[F.col("row").getField(c).alias(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, null last, then of the smallest digest of its text.

    Texts without words (null, empty, blanks) are one group like any other; rows that share an id but no text are
    decided each for itself; of rows equal in id and text one stays; an empty table gives no rows; all columns stay.
    """
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text.

    Null texts stay null, empty ones empty; texts of any length are read whole; of overlapping spans the first one
    names the kind; repeated rows stay repeated; an empty table gives no rows; all columns stay.
    """
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents, repeats included, in shuffled order.

    Null sources are one source; null and empty texts have no words and are drawn with their block; no row is taken
    more often than twice; repeated rows count each; an empty table gives no rows; all columns stay.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a sequence.

    Null and empty texts are one end id; texts of any length are cut into pieces; repeated rows are packed each; an
    empty table gives no rows; columns but doc_id and text are not looked at.
    """
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("simhash_dedup", drop_near_duplicates), ("pii", redact_personal_data), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Compression, hashing and tokenisation are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
