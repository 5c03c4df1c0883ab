"""Vector similarity search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed_values import (
    COSINE_EPSILON,
    EMBED_DIM,
    EMBED_INPUT_CHARS,
    EMBED_MODEL,
    MIN_EMBED_CHARS,
    MIN_SIMILARITY,
    VECTOR_FINGERPRINT_CHARS,
)
from palimpsest.operators.filters import in_period, same_name, with_session

# Vectors turned to double precision at a time, which bounds a task's memory.
_BLOCK = 2048


def _comparable(vectors: pa.Array, size: int) -> np.ndarray:
    """Which vectors have the queries' size and no NULL inside. The others have no similarity."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False).to_numpy(zero_copy_only=False)
    if pc.list_flatten(vectors).null_count:
        fits = fits & np.array([None not in v if ok else False for ok, v in zip(fits, vectors.to_pylist())])
    return fits


def _cosines(vectors: pa.Array, queries: np.ndarray) -> np.ndarray:
    """Similarities of vectors of the queries' size, one column per query."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    matrix = flat.reshape(-1, queries.shape[1])
    query_norms = np.linalg.norm(queries, axis=1)
    out = np.empty((len(matrix), len(queries)))
    for start in range(0, len(matrix), _BLOCK):
        block = matrix[start : start + _BLOCK].astype(np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", block, block))
        out[start : start + _BLOCK] = (block @ queries.T) / (
            np.outer(norms, query_norms) + COSINE_EPSILON
        )
    return out


def cosine_to(query: Sequence[float]) -> Callable[[str], Column]:
    """A column function: cosine of a vector column to one query vector.

    Vectors travel as Arrow lists and are scored by one matrix product per batch.
    The function counts as nondeterministic only so that a filter on the score
    does not make Spark compute it twice.
    """
    queries = np.asarray([query], dtype=np.float64)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        out = np.full(len(vectors), np.nan)
        valid = _comparable(vectors, queries.shape[1])
        if valid.any():
            out[valid] = _cosines(vectors.filter(pa.array(valid)), queries)[:, 0]
        return pa.array(out, mask=~valid)

    return score.asNondeterministic()


def cosine_to_each(queries: Mapping[str, Sequence[float]]) -> Callable[[str], Column]:
    """A column function: cosines of a vector to several queries, as an array."""
    matrix = np.asarray(list(queries.values()), dtype=np.float64)

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        valid = _comparable(vectors, matrix.shape[1])
        scores = _cosines(vectors.filter(pa.array(valid)), matrix) if valid.any() else np.empty(0)
        ends = np.cumsum(valid) * len(matrix)
        edges = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.concatenate([~valid, [False]]))
        return pa.ListArray.from_arrays(edges, pa.array(scores.ravel()))

    return score.asNondeterministic()


def similar(
    vectors: DataFrame, row_id: str, query: Sequence[float], floor: float = MIN_SIMILARITY
) -> DataFrame:
    """(row_id, score) of the vectors at or above the similarity floor.

    The vectors never leave the scan: what moves on is an id and a number.
    """
    return vectors.select(row_id, cosine_to(query)("embedding").alias("score")).where(
        F.col("score") >= floor
    )


def nearest_per_query(
    vectors: DataFrame,
    row_id: str,
    queries: Mapping[str, Sequence[float]],
    limit: int,
    floor: float = MIN_SIMILARITY,
) -> DataFrame:
    """Top rows for each of several queries in one pass over the vectors."""
    names = F.array(*[F.lit(q) for q in queries])
    scored = vectors.select(row_id, cosine_to_each(queries)("embedding").alias("scores")).select(
        row_id, F.explode(F.arrays_zip(names.alias("query"), F.col("scores").alias("score"))).alias("hit")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), row_id)
    return (
        scored.select(F.col("hit.query").alias("query"), row_id, F.col("hit.score").alias("score"))
        .where(F.col("score") >= floor)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
    )


def search_messages(
    vectors: DataFrame,
    messages: DataFrame,
    sessions: DataFrame,
    query: Sequence[float],
    limit: int = 20,
    agent: str | None = None,
    channel: str | None = None,
    days: float | None = None,
    now=None,
    date_from=None,
    date_to=None,
    floor: float = MIN_SIMILARITY,
) -> DataFrame:
    """Messages nearest to a query vector, near-identical texts shown once.

    Scoring comes first and drops all but similar rows; the filters, which commute
    with it, then join ids rather than vectors. Of equal texts only the best is
    ranked, by a digest, so the page is full; content is read for the page alone.
    """
    fingerprint = F.concat_ws(
        ":", "role", F.substring(F.coalesce("content", F.lit("")), 1, VECTOR_FINGERPRINT_CHARS)
    )
    keyed = in_period(
        messages.select("id", "session_id", "role", "timestamp", F.unhex(F.sha2(fingerprint, 256)).alias("_print")),
        "timestamp", days, now, date_from, date_to,
    )
    hits = similar(vectors, "message_id", query, floor)
    located = with_session(
        hits.join(keyed, F.col("message_id") == F.col("id")).drop("message_id"),
        sessions, "agent_id", "channel",
    ).drop("message_count")
    if agent:
        located = located.where(same_name(F.col("agent_id"), agent))
    if channel:
        located = located.where(F.col("channel") == channel)
    order = Window.partitionBy("_print").orderBy(F.desc("score"), "id")
    best = (
        located.withColumn("_copy", F.row_number().over(order))
        .where(F.col("_copy") == 1)
        .drop("_copy", "_print")
        .orderBy(F.desc("score"), "id")
        .limit(limit)
    )
    return messages.select("id", "content").join(best, "id").orderBy(F.desc("score"), "id")


def search_notes(
    vectors: DataFrame,
    notes: DataFrame,
    query: Sequence[float],
    limit: int = 10,
    agent: str | None = None,
    source: str | None = None,
    days: float | None = None,
    now=None,
    floor: float = MIN_SIMILARITY,
) -> DataFrame:
    """Notes nearest to a query vector."""
    keyed = in_period(notes.select("id", "source", "agent", "created_at"), "created_at", days, now)
    if agent:
        keyed = keyed.where(same_name(F.col("agent"), agent))
    if source:
        keyed = keyed.where(F.col("source") == source)
    hits = similar(vectors, "note_id", query, floor)
    best = (
        hits.join(keyed, F.col("note_id") == F.col("id"))
        .select("id", "score")
        .orderBy(F.desc("score"), "id")
        .limit(limit)
    )
    return notes.join(best, "id").orderBy(F.desc("score"), "id")


def without_vector(rows: DataFrame, row_id: str, vectors: DataFrame, vector_row_id: str) -> DataFrame:
    """Rows that have no vector yet."""
    return rows.join(
        vectors.select(F.col(vector_row_id).alias(row_id)), row_id, "left_anti"
    )


def embeddable(text: Column) -> Column:
    return F.char_length(text) >= MIN_EMBED_CHARS


def hashing_vectors(texts: pd.Series, size: int = EMBED_DIM) -> pd.Series:
    """Offline stand-in for an embedding service: signed word hashes, unit length."""
    def one(text: str) -> list[float]:
        vector = np.zeros(size, dtype=np.float32)
        for word in text.lower().split():
            digest = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            vector[digest % size] += 1 if digest >> 63 else -1
        norm = float(np.linalg.norm(vector))
        return (vector / norm if norm else vector).tolist()

    return texts.map(one)


def embed(
    rows: DataFrame,
    row_id: str,
    text: str,
    embedder: Callable[[pd.Series], pd.Series] = hashing_vectors,
    batch: int = 2048,
) -> DataFrame:
    """(row_id, embedding, model) for rows long enough to embed.

    `embedder` maps a series of texts to a series of vectors and is called once
    per batch, inside the tasks.
    """
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            pieces = [embedder(series[i : i + batch]) for i in range(0, len(series), batch)]
            yield pd.concat(pieces) if pieces else series

    return rows.where(embeddable(F.col(text))).select(
        row_id,
        vectors(F.substring(text, 1, EMBED_INPUT_CHARS)).alias("embedding"),
        F.lit(EMBED_MODEL).alias("model"),
    )
