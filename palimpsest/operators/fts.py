"""Full-text search: phrases, AND of phrases, BM25 ranking.

Two ways lead to the same ranking. `search_rows` scans the texts and suits a
small or filtered corpus. `build_postings` stores an inverted index clustered by
term; `search_postings` then reads only the buckets of the query's terms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.fixed_values import BM25_B, BM25_IDF_FLOOR, BM25_K1, STOP_WORDS
from palimpsest.functions.text import folded, py_tokens, tokens_of_folded
from palimpsest.operators import blocks
from palimpsest.operators.once import computed_once

POSTING_BUCKETS = 256


def query_phrases(query: str) -> list[list[str]] | None:
    """The phrases of a query, each a list of adjacent tokens.

    Stop words are dropped. None means that nothing can match: no word is left,
    or a word holds no letter or digit.
    """
    words = [w for w in (raw.replace('"', "") for raw in query.split()) if w]
    words = [w for w in words if w.lower() not in STOP_WORDS]
    phrases = [py_tokens(w) for w in words]
    if not phrases or not all(phrases):
        return None
    return phrases


def _occurrences(columns: Sequence[Column], phrase: list[str]) -> Column:
    """How often a phrase occurs, never across two columns."""
    if len(phrase) == 1:
        counts = [F.size(c) - F.size(F.array_remove(c, phrase[0])) for c in columns]
    else:
        ahead = F.lit("(?= " + " ".join(phrase) + " )")
        counts = [
            F.regexp_count(F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" ")), ahead)
            for c in columns
        ]
    return reduce(lambda a, b: a + b, counts)


def _total_size(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.size(c) for c in columns])


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def bm25(
    frequencies: Sequence[Column],
    doc_frequencies: Sequence[Column],
    length: Column,
    rows: Column,
    total_length: Column,
) -> Column:
    """Negative BM25, so that the best row sorts first in ascending order."""
    average = total_length / rows
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * length / average)
    terms = []
    for f, df in zip(frequencies, doc_frequencies):
        idf = F.greatest(F.ln((rows - df + 0.5) / (df + 0.5)), F.lit(BM25_IDF_FLOOR))
        terms.append(idf * f * F.lit(BM25_K1 + 1) / (f + norm))
    return -reduce(lambda a, b: a + b, terms)


def _shifted(positions: Column, step: int) -> Column:
    return F.transform(positions, lambda p: p - step)


def _no_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", F.lit(None).cast("double")).where(F.lit(False))


def _with_folded(rows: DataFrame, texts: Sequence[str]) -> DataFrame:
    return computed_once(rows, {f"_folded_{t}": folded(F.col(t)) for t in texts})


def _with_words(rows: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Token arrays in place of the folded texts."""
    found = {f"_words_{t}": tokens_of_folded(F.col(f"_folded_{t}")) for t in texts}
    return computed_once(rows, found).drop(*[f"_folded_{t}" for t in texts])


def search_rows(rows: DataFrame, texts: Sequence[str], query: str) -> DataFrame:
    """Rows matching every phrase of the query, with their BM25 `score`.

    The statistics are one aggregate over all rows and reach the ranking as a
    scalar subquery. Ranking tokenises only rows that hold every word as a
    substring.
    """
    phrases = query_phrases(query)
    if phrases is None:
        return _no_rows(rows)
    names = [f"_words_{t}" for t in texts]

    words = [F.col(n) for n in names]
    hits = [_occurrences(words, p) for p in phrases]
    counted = _with_words(_with_folded(rows.select(*texts), texts), texts).agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.sum(_total_size(words)).alias("length"),
            *[F.count_if(h > 0).alias(f"df{i}") for i, h in enumerate(hits)],
        ).alias("stats")
    )
    stats = counted.scalar()
    haystack = F.concat_ws(" ", *[F.col(f"_folded_{t}") for t in texts])
    candidates = _with_folded(rows, texts).where(
        _all([F.contains(haystack, F.lit(w)) for w in sorted({w for p in phrases for w in p})])
    )
    frequency = [F.col(f"_f{i}") for i in range(len(phrases))]
    counts = {"_stats": stats, **{f"_f{i}": h for i, h in enumerate(hits)}, "_length": _total_size(words)}
    return (
        computed_once(_with_words(candidates, texts), counts)
        .drop(*names)
        .where(_all([f > 0 for f in frequency]))
        .withColumn(
            "score",
            bm25(
                frequency,
                [F.col(f"_stats.df{i}") for i in range(len(phrases))],
                F.col("_length"),
                F.col("_stats.rows"),
                F.col("_stats.length"),
            ),
        )
        .drop("_stats", "_length", *[f"_f{i}" for i in range(len(phrases))])
    )


def corpus_stats(rows: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Row count and summed token count of a corpus: one row."""
    words = _with_words(_with_folded(rows.select(*texts), texts), texts)
    return words.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(_total_size([F.col(f"_words_{t}") for t in texts])).alias("total_length"),
    )


def row_words(texts: DataFrame) -> DataFrame:
    """(row_id, words) of (row_id, text); NULL has no words."""
    words = _with_words(_with_folded(texts, ["text"]), ["text"])
    return words.select("row_id", F.coalesce("_words_text", F.array().cast("array<string>")).alias("words"))


def build_postings(rows: DataFrame, row_id: str, text: str, positions: bool = False) -> DataFrame:
    """One row per (term, row): frequency, first position and the row's length.

    All tokens of a row sit in one task, which counts them; nothing is shuffled. The length travels with each posting,
    which spares the ranking a join. Phrases need all `positions`.
    """
    texts = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    words = row_words(texts)
    fields = f"row_id {words.schema['row_id'].dataType.simpleString()}, length int, term string, tf int, first_pos int"
    return words.mapInArrow(blocks.row_postings(positions), f"{fields}, positions array<int>" if positions else fields)


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def write_index(rows: DataFrame, row_id: str, text: str, folder: str, writers_per_bucket: int = 4) -> None:
    """Store postings under one folder per term bucket, sorted by term.

    A bucket is written by several tasks, so a term found in a third of all rows
    does not end in one task.
    """
    postings = build_postings(rows, row_id, text, positions=True).withColumn("bucket", term_bucket(F.col("term")))
    lane = F.pmod(F.xxhash64("row_id"), F.lit(writers_per_bucket))
    (
        postings.repartition(F.col("bucket"), lane)
        .sortWithinPartitions("bucket", "term", "row_id")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{folder}/postings")
    )
    corpus_stats(rows, [text]).write.mode("overwrite").parquet(f"{folder}/stats")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/stats")


def search_postings(postings: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(row_id, score) of the rows matching every phrase, from an inverted index."""
    phrases = query_phrases(query)
    if phrases is None:
        return _no_rows(postings.select("row_id"))
    needed = sorted({word for phrase in phrases for word in phrase})
    wanted = postings.where(F.col("term").isin(needed))
    if "bucket" in postings.columns:
        buckets = F.array(*[term_bucket(F.lit(w)) for w in needed])
        wanted = wanted.where(F.array_contains(buckets, F.col("bucket")))
    has_phrases = any(len(p) > 1 for p in phrases)
    picks = []
    for i, word in enumerate(needed):
        of_word = F.col("term") == word
        picks.append(F.max(F.when(of_word, F.col("tf"))).alias(f"_tf{i}"))
        if has_phrases:
            picks.append(F.max(F.when(of_word, F.col("positions"))).alias(f"_at{i}"))
    by_row = wanted.groupBy("row_id").agg(F.max("length").alias("_length"), *picks)

    def frequency(phrase: list[str]) -> Column:
        where = [needed.index(w) for w in phrase]
        if len(where) == 1:
            return F.coalesce(F.col(f"_tf{where[0]}"), F.lit(0))
        # Where each word would have the phrase begin.
        begins = [_shifted(F.col(f"_at{w}"), step) for step, w in enumerate(where)]
        return F.coalesce(F.size(reduce(F.array_intersect, begins)), F.lit(0))

    counted = by_row.select(
        "row_id", "_length", *[frequency(p).alias(f"_f{i}") for i, p in enumerate(phrases)]
    )
    matched = counted.agg(
        F.struct(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    ).scalar()
    totals = stats.select(F.struct("rows", "total_length")).scalar()
    f_columns = [F.col(f"_f{i}") for i in range(len(phrases))]
    hits = counted.where(_all([f > 0 for f in f_columns]))
    return computed_once(hits, {"_matched": matched, "_totals": totals}).select(
        "row_id",
        bm25(
            f_columns,
            [F.col(f"_matched.df{i}") for i in range(len(phrases))],
            F.col("_length"),
            F.col("_totals.rows"),
            F.col("_totals.total_length"),
        ).alias("score"),
    )
