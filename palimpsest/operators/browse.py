"""Transcripts, activity, context windows and roll-ups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.fixed_values import TRANSCRIPT_ROWS
from palimpsest.functions.text import head, shorten_by_role
from palimpsest.operators.filters import (
    as_time,
    days_before,
    first_rows,
    listed_agent,
    minutes_before,
    same_name,
    with_session,
)

# Characters shown per role on each surface.
WEB_LIMITS = {"tool_result": 500}
TOOL_LIMITS = {"tool_result": 300, "assistant": 2000}


def _listed(sessions: DataFrame, level: str, agent: str | None) -> DataFrame:
    kept = (
        sessions.withColumnRenamed("id", "session_id")
        .where(listed_agent(level))
        .withColumnRenamed("session_id", "id")
    )
    return kept.where(same_name(F.col("agent_id"), agent)) if agent else kept


def _last_seen():
    return F.coalesce("ended_at", "started_at")


def recent(
    messages: DataFrame,
    sessions: DataFrame,
    now,
    minutes: int = 30,
    agent: str | None = None,
    surface: str = "web",
    rows: int | None = TRANSCRIPT_ROWS,
    most_minutes: int | None = 120,
) -> DataFrame:
    """Transcript of the last minutes, oldest first; without `rows` and `most_minutes` it is whole."""
    minutes = max(1, minutes if most_minutes is None else min(minutes, most_minutes))
    level, limits = ("web", WEB_LIMITS) if surface == "web" else ("transcript", TOOL_LIMITS)
    window = messages.where(F.col("timestamp") >= minutes_before(now, minutes))
    joined = with_session(window, _listed(sessions, level, agent), "agent_id")
    return (
        first_rows(joined.orderBy("timestamp", "message_index", "id"), rows)
        .select(
            "session_id", "agent_id", "id", "role",
            shorten_by_role(F.col("role"), F.col("content"), limits).alias("content"),
            "timestamp", "message_index", "message_count",
        )
    )


def recent_headers(transcript: DataFrame) -> DataFrame:
    """One header per session of a transcript page: how much of it is shown."""
    shown, total = F.col("shown"), F.col("message_count")
    return (
        transcript.groupBy("session_id", "agent_id", "message_count")
        .agg(F.count(F.lit(1)).alias("shown"), F.min("timestamp").alias("first_at"))
        .withColumn(
            "note",
            F.when(shown < total, F.format_string(" (%d of %d msgs)", shown, total)).otherwise(
                F.format_string(" (%d msgs)", total)
            ),
        )
        .withColumn("label", F.concat(F.lit("session:"), F.substring("session_id", 1, 12)))
    )


def activity(
    messages: DataFrame,
    sessions: DataFrame,
    now,
    days: int = 14,
    limit: int = 30,
    agent: str | None = None,
    surface: str = "web",
) -> DataFrame:
    """Latest sessions with their first request and last answer.

    The page of sessions is cut first; the messages are then filtered by that
    list, which is never longer than `limit`.
    """
    web = surface == "web"
    seen = _last_seen() if web else F.col("started_at")
    kept = _listed(sessions, "web" if web else "activity", agent)
    if days > 0:
        kept = kept.where(seen >= days_before(now, days))
    page = (
        kept.select(F.col("id").alias("session_id"), "agent_id", "started_at", "ended_at", "message_count")
        .orderBy(seen.desc(), "session_id")
        .limit(limit)
    )
    first_user = F.when(F.col("role") == "user", F.col("message_index"))
    last_answer = F.when(F.col("role") == "assistant", F.col("message_index"))
    cut = 500 if web else 150
    ends = (
        messages.where(F.col("role").isin("user", "assistant"))
        .select("session_id", "role", "message_index", "id", head(F.col("content"), cut).alias("content"))
        .join(page.select("session_id"), "session_id", "left_semi")
        .groupBy("session_id")
        .agg(
            F.min_by("content", F.when(first_user.isNotNull(), F.struct(first_user, "id"))).alias("first_user_message"),
            F.max_by("content", F.when(last_answer.isNotNull(), F.struct(last_answer, -F.col("id")))).alias("last_assistant_message"),
        )
    )
    shown = page.join(ends, "session_id", "left").withColumns(
        {
            c: F.coalesce(c, F.lit(""))
            for c in ("first_user_message", "last_assistant_message")
        }
    )
    return shown if web else shown.drop("last_assistant_message", "ended_at")


def agent_counts(sessions: DataFrame, now, days: int = 14) -> DataFrame:
    """Listed sessions per agent, most first."""
    kept = _listed(sessions, "web", None)
    if days > 0:
        kept = kept.where(_last_seen() >= days_before(now, days))
    return (
        kept.groupBy("agent_id")
        .agg(F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.desc("sessions"), "agent_id")
    )


def session_bounds(messages: DataFrame) -> DataFrame:
    """First and last message index of each session."""
    return messages.groupBy("session_id").agg(
        F.min("message_index").alias("first_index"), F.max("message_index").alias("last_index")
    )


def context(requests: DataFrame, messages: DataFrame, radius: int = 5) -> DataFrame:
    """Messages around each requested (session_id, message_id).

    A request becomes one key per index in reach, so the range turns into an equality
    on (session, index) and the rows of a large session spread over all tasks.
    """
    targets = requests.join(
        messages.select(F.col("id").alias("message_id"), "session_id", F.coalesce("message_index", F.lit(0)).alias("target_index")),
        ["message_id", "session_id"],
    )
    reach = targets.withColumn(
        "message_index",
        F.explode(F.sequence(F.col("target_index") - radius, F.col("target_index") + radius)),
    )
    loaded = Window.partitionBy("message_id", "session_id")
    return (
        reach.join(messages, ["session_id", "message_index"])
        .withColumns(
            {
                "_low": F.min("message_index").over(loaded),
                "_high": F.max("message_index").over(loaded),
            }
        )
        .join(session_bounds(messages), "session_id")
        .select(
            "session_id", "message_id", "target_index", "id", "role",
            head(F.coalesce("content", F.lit("")), 1000).alias("content"),
            "message_index", "timestamp",
            (F.col("message_index") == F.col("target_index")).alias("is_match"),
            (F.col("_low") > F.coalesce("first_index", F.lit(0))).alias("has_more_before"),
            (F.col("_high") < F.coalesce("last_index", F.lit(0))).alias("has_more_after"),
        )
    )


def session_page(
    messages: DataFrame,
    around: int | None = None,
    window: int = 30,
    session_id: str | None = None,
) -> DataFrame:
    """Part of a session: indexes around a centre, or the first `window` rows.

    Without `session_id` every session is paged. The first-rows form keeps at most
    `window` rows per session already before the shuffle.
    """
    window = max(1, min(window, 60))
    rows = messages if session_id is None else messages.where(F.col("session_id") == session_id)
    bounds = session_bounds(rows)
    if around is not None:
        centre = max(0, around)
        low, high = max(0, centre - window // 2), centre + window // 2
        page = rows.where(F.col("message_index").between(low, high))
        flags = bounds.select(
            "session_id",
            (F.lit(low) > F.coalesce("first_index", F.lit(0))).alias("has_more_before"),
            (F.lit(high) < F.coalesce("last_index", F.lit(0))).alias("has_more_after"),
        )
    else:
        order = Window.partitionBy("session_id").orderBy("message_index", "id")
        page = (
            rows.withColumn("_at", F.row_number().over(order))
            .where(F.col("_at") <= window)
            .drop("_at")
        )
        loaded = page.groupBy("session_id").agg(F.max("message_index").alias("_loaded"))
        flags = bounds.join(loaded, "session_id").select(
            "session_id",
            F.lit(False).alias("has_more_before"),
            (F.col("_loaded") < F.coalesce("last_index", F.lit(0))).alias("has_more_after"),
        )
    return page.join(flags, "session_id").select(
        "session_id", "id", "role",
        shorten_by_role(F.col("role"), F.col("content"), WEB_LIMITS).alias("content"),
        "message_index", "timestamp", "has_more_before", "has_more_after",
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each table, one row."""
    spark = next(iter(tables.values())).sparkSession
    one = spark.range(1)
    return one.select(
        *[t.agg(F.count(F.lit(1))).scalar().alias(name) for name, t in tables.items()]
    )


def database_stats(tables: Mapping[str, DataFrame], sessions: DataFrame) -> DataFrame:
    """Row counts, number of agents and the latest session start, one row."""
    agents = sessions.agg(F.count_distinct("agent_id")).scalar()
    latest = sessions.agg(F.max("started_at")).scalar()
    return table_counts(tables).withColumns({"agents": agents, "last_indexed": latest})


def agent_names(sessions: DataFrame) -> DataFrame:
    return sessions.select("agent_id").distinct().orderBy("agent_id")


def note_counts(notes: DataFrame) -> DataFrame:
    """Notes per source and per agent; an absent agent is shown as 'none'."""
    by_source = notes.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("notes"))
    by_agent = notes.groupBy(F.coalesce("agent", F.lit("none")).alias("name")).agg(
        F.count(F.lit(1)).alias("notes")
    )
    return by_source.select(F.lit("source").alias("grouping"), "name", "notes").unionByName(
        by_agent.select(F.lit("agent").alias("grouping"), "name", "notes")
    )


def list_notes(
    notes: DataFrame,
    limit: int = 20,
    offset: int = 0,
    source: str | None = None,
    agent: str | None = None,
) -> DataFrame:
    """A page of notes, newest first."""
    if source:
        notes = notes.where(F.col("source") == source)
    if agent:
        notes = notes.where(F.col("agent") == agent)
    return notes.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def index_freshness(listing: DataFrame, log: DataFrame, now, hours: int = 2) -> DataFrame:
    """Files changed lately against files indexed lately, one row."""
    since = as_time(now) - F.make_dt_interval(hours=F.lit(hours))
    changed = listing.where(F.col("modified_at") >= since).agg(F.count(F.lit(1))).scalar()
    indexed = log.where(F.col("indexed_at") >= since).agg(F.count(F.lit(1))).scalar()
    return listing.sparkSession.range(1).select(
        changed.alias("changed_files"), indexed.alias("indexed_files"),
        (changed > 0).__and__(indexed == 0).alias("stale"),
    )


def author_activity(
    posts: DataFrame, now, min_messages: int, min_days: int
) -> DataFrame:
    """Human authors with enough messages who joined long enough ago."""
    return (
        posts.where(~F.col("is_bot"))
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("messages"), F.min("joined_at").alias("joined_at"))
        .where(F.col("messages") >= min_messages)
        .where(F.col("joined_at") <= days_before(now, min_days))
    )
