"""Keyword, vector and line search behind one request."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed_values import RESULT_FINGERPRINT_CHARS
from palimpsest.functions.requests import resolve_agent, wants_semantic
from palimpsest.functions.text import deep_link, head, summary_sentence
from palimpsest.operators import fts, lines, vector
from palimpsest.operators.filters import in_period, same_name, with_session
from palimpsest.operators.segments import StoredIndex

NOTE_TEXTS = ["content", "metadata", "source", "agent"]


@dataclass(frozen=True)
class SearchRequest:
    query: str
    agent: str | None = None
    channel: str | None = None
    source: str | None = None
    semantic: bool | None = None
    files_only: bool = False
    conversations_only: bool = False
    limit: int = 10
    days: float | None = None
    now: datetime | None = None
    date_from: datetime | None = None
    date_to: datetime | None = None
    aliases: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Library:
    """The tables a search reads."""

    messages: DataFrame
    sessions: DataFrame
    message_vectors: DataFrame
    notes: DataFrame
    note_vectors: DataFrame
    files: DataFrame
    message_index: StoredIndex | None = None


def keyword_messages(
    messages: DataFrame,
    sessions: DataFrame,
    query: str,
    limit: int = 20,
    agent: str | None = None,
    channel: str | None = None,
    days: float | None = None,
    now=None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Messages matching every word, best first.

    The ranking statistics cover all messages; the filters act on its result.
    """
    hits = in_period(
        fts.search_rows(messages, ["content"], query), "timestamp", days, now, date_from, date_to
    )
    located = with_session(hits, sessions, "agent_id", "channel").drop("message_count")
    if agent:
        located = located.where(same_name(F.col("agent_id"), agent))
    if channel:
        located = located.where(F.col("channel") == channel)
    return located.orderBy("score", "id").limit(limit)


def stored_page(
    index: StoredIndex,
    messages: DataFrame,
    sessions: DataFrame,
    query: str,
    limit: int = 20,
    agent: str | None = None,
    channel: str | None = None,
    days: float | None = None,
    now=None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """id, session_id, timestamp, agent_id, channel and score of the best messages, from a stored index.

    No text is read: postings of the query's terms give the scores, and messages their times and sessions.
    """
    hits = index.search(query).withColumnRenamed("row_id", "id")
    keyed = hits.join(messages.select("id", "session_id", "timestamp"), "id")
    keyed = in_period(keyed, "timestamp", days, now, date_from, date_to)
    located = with_session(keyed, sessions, "agent_id", "channel").drop("message_count")
    if agent:
        located = located.where(same_name(F.col("agent_id"), agent))
    if channel:
        located = located.where(F.col("channel") == channel)
    return located.orderBy("score", "id").limit(limit)


def keyword_messages_indexed(index: StoredIndex, messages: DataFrame, sessions: DataFrame, query: str, limit: int = 20, **filters) -> DataFrame:
    """keyword_messages() from a stored index; content is read for the page only."""
    page = stored_page(index, messages, sessions, query, limit, **filters).select("id", "agent_id", "channel", "score")
    return messages.join(page, "id").orderBy("score", "id")


def keyword_notes(
    notes: DataFrame,
    query: str,
    limit: int = 10,
    agent: str | None = None,
    source: str | None = None,
    days: float | None = None,
    now=None,
) -> DataFrame:
    """Notes matching every word in any of their searchable columns."""
    hits = in_period(fts.search_rows(notes, NOTE_TEXTS, query), "created_at", days, now)
    if agent:
        hits = hits.where(same_name(F.col("agent"), agent))
    if source:
        hits = hits.where(F.col("source") == source)
    return hits.orderBy("score", "id").limit(limit)


def first_of_each(rows: DataFrame, *order) -> DataFrame:
    """The first row of each role and text beginning.

    The digest keeps text out of the shuffle key, and the rank limit drops
    repeats already before the shuffle.
    """
    fingerprint = F.sha2(
        F.concat_ws(":", "role", head(F.coalesce("content", F.lit("")), RESULT_FINGERPRINT_CHARS)), 256
    )
    window = Window.partitionBy("_fingerprint").orderBy(*order)
    return (
        rows.withColumn("_fingerprint", fingerprint)
        .withColumn("_copy", F.row_number().over(window))
        .where(F.col("_copy") == 1)
        .drop("_copy", "_fingerprint")
    )


def _or_else(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """The preferred rows, or the fallback's if there are none. Both are pages of a caller's limit."""
    ranked = preferred.withColumn("_arm", F.lit(0)).unionByName(fallback.withColumn("_arm", F.lit(1)))
    first = F.min("_arm").over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn("_first", first).where(F.col("_arm") == F.col("_first")).drop("_arm", "_first")


def unified_search(
    library: Library, request: SearchRequest, embed_query: Callable[[str], Sequence[float]] | None = None
) -> dict[str, DataFrame]:
    """Lazy results of each arm: conversations, thoughts, files, and a summary row.

    Without `embed_query` the vector arms fall back to keywords, as they do when
    the route was chosen automatically and nothing similar was found.
    """
    automatic = request.semantic is None
    semantic = wants_semantic(request.query) if automatic else request.semantic
    semantic = semantic and embed_query is not None
    vector_query = embed_query(request.query) if semantic else None
    agent = resolve_agent(request.agent, request.aliases)
    period = dict(
        days=request.days, now=request.now, date_from=request.date_from, date_to=request.date_to
    )
    arms: dict[str, DataFrame] = {}

    if not request.files_only:
        shown = ["agent_id", "channel", "role", "content", "timestamp", "score", "session_id", "id"]
        tables, filters = (library.messages, library.sessions), dict(agent=agent, channel=request.channel, **period)
        if library.message_index is None:
            found = keyword_messages(*tables, request.query, request.limit, **filters)
        else:
            found = keyword_messages_indexed(library.message_index, *tables, request.query, request.limit, **filters)
        found = found.select(*shown)
        best_first = F.asc("score")
        if semantic:
            near = vector.search_messages(
                library.message_vectors, library.messages, library.sessions, vector_query,
                request.limit, agent, request.channel, **period,
            ).select(*shown)
            found = _or_else(near, found) if automatic else near
            best_first = F.desc("score") if not automatic else F.desc(F.abs("score"))
        arms["conversations"] = first_of_each(found, best_first, "id").select(
            F.col("agent_id").alias("agent"), "channel", "role",
            head(F.col("content"), 500).alias("content"),
            deep_link(F.col("content")).alias("deep_link"),
            "timestamp", F.round("score", 3).alias("score"), "session_id",
            F.col("id").alias("message_id"),
        )

        source = request.source if request.source in ("gmail", "drive", "slack") else None
        note_days = int(request.days) if request.days else None
        columns = ["id", "content", "source", "agent", "metadata", "created_at", "score"]
        noted = keyword_notes(
            library.notes, request.query, request.limit, request.agent, source, note_days, request.now
        ).select(*columns)
        if semantic:
            near = vector.search_notes(
                library.note_vectors, library.notes, vector_query, request.limit, request.agent,
                source, note_days, request.now,
            ).select(*columns)
            noted = _or_else(near, noted) if automatic else near
        arms["thoughts"] = noted.select(
            "id", head(F.col("content"), 500).alias("content"), "source", "agent", "metadata",
            "created_at", F.round("score", 3).alias("score"),
        )

    if not request.conversations_only:
        arms["files"] = lines.document_hits(
            lines.search_files(library.files, request.query, request.agent, request.limit), 300
        )
    arms["summary"] = _summary(library.messages.sparkSession, arms)
    return arms


def _summary(spark, arms: Mapping[str, DataFrame]) -> DataFrame:
    def size(arm: str):
        return arms[arm].agg(F.count(F.lit(1))).scalar() if arm in arms else F.lit(0).cast("long")

    return spark.range(1).select(
        size("conversations").alias("conversations"),
        size("files").alias("files"),
        size("thoughts").alias("thoughts"),
    ).withColumn(
        "summary", summary_sentence(F.col("conversations"), F.col("files"), F.col("thoughts"))
    )
