"""Redacting text that was stored before redaction existed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.secrets import family_counts, redact
from palimpsest.operators.once import computed_once


def changed_rows(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, before, after) of the rows that redaction changes."""
    texts = rows.select(row_id, F.col(text).alias("before")).where(F.col("before") != "")
    return computed_once(texts, {"after": redact(F.col("before"))}).where(
        F.col("before") != F.col("after")
    )


def redacted(rows: DataFrame, text: str) -> DataFrame:
    """The table with every secret of the text column replaced."""
    return rows.withColumn(text, redact(F.col(text)))


def family_totals(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(family, found) over the rows that redaction changes, absent ones left out."""
    counts = family_counts(F.col("before"), F.col("_lowered"))
    sums = computed_once(changed_rows(rows, row_id, text), {"_lowered": F.lower("before")}).agg(
        *[F.sum(c).alias(f"_{i}") for i, c in enumerate(counts.values())]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("family"), F.col(f"_{i}").alias("found"))
            for i, name in enumerate(counts)
        ]
    )
    return sums.select(F.inline(pairs)).where(F.col("found") > 0)


def redaction_report(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """Rows scanned and changed, one row."""
    scanned = rows.agg(F.count(F.lit(1))).scalar()
    return changed_rows(rows, row_id, text).agg(F.count(F.lit(1)).alias("redacted")).select(
        scanned.alias("scanned"), "redacted"
    )
