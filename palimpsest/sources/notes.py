"""Markdown and text files of agent workspaces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed_values import NOTE_FILE_GLOBS
from palimpsest.functions.paths import in_skipped_directory, note_agent


def read_notes(spark: SparkSession, roots: Sequence[str], globs: Sequence[str] = NOTE_FILE_GLOBS) -> DataFrame:
    """(path, agent, content) of note files, one row each, for line search."""
    parts = [
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(list(roots), wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
        for glob in globs
    ]
    files = reduce(lambda a, b: a.unionByName(b), parts)
    plain = F.regexp_replace("path", r"\Afile:/*", "/")
    return (
        files.withColumn("path", plain)
        .where(~in_skipped_directory(F.col("path")))
        .select("path", note_agent(F.col("path")).alias("agent"), "content")
    )
