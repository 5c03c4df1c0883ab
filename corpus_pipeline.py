"""From raw documents to packed training sequences, each stage over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame. All but the last give the columns of `documents`, with
n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import dart_minhash, line_dedup, mixing, packing, toxicity
from palimpsest.llm.common import stage, table
from palimpsest.llm.queries import tokenizer_file

#: Scores of toxic documents begin here.
TOXIC = 0.5


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC."""
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).where(F.col("_score") < TOXIC).select(*docs.columns)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many share."""
    return _counted(line_dedup.drop_shared_lines(docs), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return dart_minhash.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes once for each pass that takes it."""
    return _counted(mixing.mixed(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of packing.CAPACITY tokens."""
    cut = packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The classifier, the near-copy classes and the packing are not SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return stage(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
