"""Row filters shared by search and browsing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.fixed_values import HIDDEN_AGENTS
from palimpsest.operators.skew import join_on_sized_key


def as_time(value: datetime | str | Column) -> Column:
    """A point in time as a column, without a time zone of its own."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime) and value.tzinfo is not None:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return F.lit(str(value)).cast("timestamp_ntz")


def same_name(column: Column, name: str) -> Column:
    """Equality that ignores ASCII case."""
    return F.lower(column) == F.lit(name.lower())


def days_before(anchor: datetime | str | Column, days: float) -> Column:
    return as_time(anchor) - F.make_dt_interval(secs=F.lit(float(days) * 86400))


def minutes_before(anchor: datetime | str | Column, minutes: int) -> Column:
    return as_time(anchor) - F.make_dt_interval(mins=F.lit(int(minutes)))


def in_period(
    df: DataFrame,
    time_column: str,
    days: float | None = None,
    now: datetime | str | Column | None = None,
    date_from: datetime | str | None = None,
    date_to: datetime | str | None = None,
) -> DataFrame:
    """Rows of the last `days` before `now`, and between two inclusive dates."""
    if days:
        if now is None:
            raise ValueError("a day limit needs the time it counts back from")
        df = df.where(F.col(time_column) >= days_before(now, days))
    if date_from is not None:
        df = df.where(F.col(time_column) >= as_time(date_from))
    if date_to is not None:
        df = df.where(F.col(time_column) <= as_time(date_to))
    return df


def listed_agent(level: str = "web") -> Column:
    """Sessions shown when browsing: real agents with more than two messages.

    `web` also hides boot sessions by id; `transcript` does not; `activity` is
    the shorter test of the tool interface.
    """
    agent = F.col("agent_id")
    keep = (
        (F.col("message_count") > 2)
        & F.char_length(agent).between(2, 14)
        & ~agent.rlike(r"\A[0-9a-fA-F]{5}")
    )
    if level == "activity":
        return keep
    keep = keep & ~F.startswith(F.lower(agent), F.lit("agent:")) & ~agent.isin(HIDDEN_AGENTS)
    if level == "transcript":
        return keep
    return keep & ~F.startswith(F.lower(F.col("session_id")), F.lit("boot-"))


def first_rows(ordered: DataFrame, limit: int | None) -> DataFrame:
    """A page of ordered rows; all of them for None."""
    return ordered if limit is None else ordered.limit(limit)


def sessions_keyed(sessions: DataFrame, *columns: str) -> DataFrame:
    """Sessions under the name messages use for them, with their size."""
    named = sessions.withColumnRenamed("id", "session_id")
    return named.select("session_id", "message_count", *[c for c in columns if c != "message_count"])


def with_session(messages: DataFrame, sessions: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Messages with columns of their session; large sessions are split."""
    keyed = sessions_keyed(sessions, *columns)
    return join_on_sized_key(messages, keyed, "session_id", None, "id", how)
