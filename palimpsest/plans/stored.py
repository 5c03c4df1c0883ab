"""Keyword indexes of the corpus, stored in the shared folder and read again by later queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.operators.segments import StoredIndex, open_index
from palimpsest.session import shared_folder


def _home(spark: SparkSession, folder: str, kind: str) -> str:
    """A folder named by the files that the documents are in, their sizes and times: other contents, another index."""
    files = model.table(spark, folder, "documents").select(
        *[F.col(f"_metadata.{c}").cast("string").alias(c) for c in ("file_path", "file_size", "file_modification_time")]
    )
    seen = files.distinct().select(F.concat_ws("|", *files.columns).alias("file"))
    digest = seen.agg(F.sum(F.xxhash64("file").cast("decimal(38,0)"))).first()[0]
    return f"{shared_folder(spark)}/keyword-blocks-{kind}-{hashlib.sha256(f'{folder} {digest}'.encode()).hexdigest()[:16]}"


def corpus_index(spark: SparkSession, folder: str) -> StoredIndex:
    """All documents, in two batches."""
    index = open_index(spark, _home(spark, folder, "corpus"))
    rows, first = model.corpus(spark, folder), F.col("id") % 3 > 0
    while index.version < 2:  # continues after a batch that was lost
        index = index.add(rows.where(first if index.version == 0 else ~first), "id", "content")
    return index


def changed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The documents after the changes that changed_index() makes one by one."""
    changed = F.when(F.col("id") % 6 == 0, F.concat("content", F.lit(" er tion"))).otherwise(F.col("content"))
    return model.corpus(spark, folder).where(F.col("id") % 5 != 3).withColumn("content", changed)


def changed_index(spark: SparkSession, folder: str) -> StoredIndex:
    """Even documents, some deleted, odd ones added, some replaced, some deleted: the segments as they are before updated_index()."""
    rows, id_ = model.corpus(spark, folder), F.col("id")
    changes = [
        lambda i: i.add(rows.where(id_ % 2 == 0), "id", "content"),
        lambda i: i.delete(rows.where((id_ % 2 == 0) & (id_ % 5 == 3)).select("id")),
        lambda i: i.add(rows.where(id_ % 2 != 0), "id", "content"),
        lambda i: i.add(changed_corpus(spark, folder).where(id_ % 6 == 0), "id", "content"),
        lambda i: i.delete(rows.where(id_ % 5 == 3).select("id")),
    ]
    index = open_index(spark, _home(spark, folder, "changes"), until=len(changes))
    while index.version < len(changes):  # each change is a version
        index = changes[index.version](index)
    return index


def updated_index(spark: SparkSession, folder: str) -> StoredIndex:
    """Even documents, some deleted, odd ones added, some replaced, some deleted, and all merged at last."""
    changed = changed_index(spark, folder)
    index = open_index(spark, changed.folder)
    return index if index.version > changed.version else changed.merge()
