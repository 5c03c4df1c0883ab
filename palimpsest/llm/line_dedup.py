"""Lines that many documents share.

Each text is cut into lines and every line into a key. Keys are hashed, the distinct documents of each hash are
counted, and lines over the threshold go, except in the document with the largest id. What is left is put together
by position. All of it is DataFrame functions.

The line table is written once and holds no text: (hash, document, position) to count, and to find what goes.
Counting is combined before each shuffle, so a line that a third of all documents hold costs one row per document
in the first shuffle and one row per task in the second. The join of the lines with the shared hashes may be skewed;
adaptive execution splits it, as both sides are plain shuffles.

Defined results: a null text is the empty text, which is one empty line. Rows that repeat a doc_id count as one
document; each row keeps its own text. Rows with a null doc_id count as one document together, never the largest.
An empty table gives an empty table. Other columns pass unchanged, but
for ones named `_lines` or `_dropped`, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, SPACE, UPPER, stage, whole_text

MIN_CHARS = 40
MIN_DOCUMENTS = 5


def line_key(line: Column) -> Column:
    """Stripped and with A-Z in lower case. lower() is much the faster, and the same where all is ASCII."""
    line = F.btrim(line, F.lit(SPACE))
    return F.when(F.char_length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """(lines, shared): hashes of all long lines with their places; hashes in enough documents, with the keeper."""
    lines = (
        docs.select(F.col("doc_id").alias("_id"), whole_text().alias("_text"))
        .select("_id", F.xxhash64("_text").alias("_version"), F.posexplode(F.split("_text", "\n")).alias("_at", "_line"))
        .where(F.char_length("_line") >= min_chars)
        .withColumn("_key", line_key(F.col("_line")))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_version", "_at", F.unhex(F.md5("_key")).alias("_hash"))
    )
    lines = stage(lines, "lines")
    shared = (
        lines.select("_hash", "_id")
        .distinct()
        .groupBy("_hash")
        .agg(F.count(F.lit(1)).alias("_documents"), F.max("_id").alias("_keeper"))
        .where(F.col("_documents") >= min_documents)
    )
    # Kept, so that the join below has a plain shuffle on either side, which adaptive execution can split.
    return lines, stage(shared, "shared-lines")


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with their columns, the text without shared lines, and `_lines` and `_dropped`, the line counts."""
    lines, shared = shared_lines(docs, min_chars, min_documents)
    gone = (
        lines.join(shared, "_hash")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_version")
        .agg(F.collect_set("_at").alias("_gone"))
        .withColumnsRenamed({"_id": "_gone_id", "_version": "_gone_version"})
    )
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Lines are cut below the join: above it, the lambda would cut the text again for each line.
    whole = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64(whole_text()).alias("_version"),
        F.split(whole_text(), "\n").alias("_parts"),
        F.struct(*[docs[c] for c in rest]).alias("_rest") if rest else F.lit(None).alias("_rest"),
    )
    joined = whole.join(
        gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_version") == F.col("_gone_version")), "left"
    )
    places = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col("_parts")).otherwise(F.transform(places, lambda i: F.get("_parts", i)))
    columns = {"doc_id": F.col("_id"), "text": F.array_join(left, "\n")} | {c: F.col("_rest").getField(c) for c in rest}
    return joined.select(
        *[columns[c].alias(c) for c in docs.columns if c not in ("_lines", "_dropped")],
        F.size("_parts").cast("long").alias("_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_dropped"),
    )
