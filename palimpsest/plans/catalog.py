"""Every query of the engine on the given tables, by name.

A query takes (spark, folder) and returns a lazy DataFrame. Times are shown as
text and vectors as numbers, so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.fixed_values import MIN_EMBED_CHARS
from palimpsest.functions import noise as noise_tests
from palimpsest.functions import paths, requests, secrets, text
from palimpsest.operators import (
    browse,
    capture,
    clean,
    filters,
    fts,
    ingest,
    lines,
    search,
    secrets_history,
    vector,
)
from palimpsest.plans import derived, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MESSAGE_QUERY = "er of th"
NOTE_QUERY = "tion the er"
PHRASE_QUERY = "er-th"
LINE_QUERY = "tion er"
AGENT = "agent1"
SIMILAR_FLOOR = 0.1


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def shown_time(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def latest(df: DataFrame, column: str) -> Column:
    """The newest time of a table: the moment queries look back from."""
    return df.agg(F.max(column)).scalar()


def _scored(df: DataFrame, *columns) -> DataFrame:
    return df.select(*columns, F.round("score", 6).alias("score"))


# --- keyword search ----------------------------------------------------------


@query
def kw_messages(spark, folder):
    found = search.keyword_messages(
        model.messages(spark, folder), model.sessions(spark, folder), MESSAGE_QUERY
    )
    return _scored(found, "id", "session_id", "agent_id", "channel", "role", "content")


@query
def kw_documents(spark, folder):
    """All hits of a two-word query over all documents."""
    return _scored(fts.search_rows(model.corpus(spark, folder), ["content"], NOTE_QUERY), "id")


@query
def kw_phrase(spark, folder):
    """A word with punctuation is a phrase of adjacent tokens."""
    return _scored(fts.search_rows(model.corpus(spark, folder), ["content"], PHRASE_QUERY), "id")


@query
def kw_indexed(spark, folder):
    """The ranking of kw_documents, from an inverted index."""
    rows = model.corpus(spark, folder)
    found = fts.search_postings(
        fts.build_postings(rows, "id", "content"), fts.corpus_stats(rows, ["content"]), NOTE_QUERY
    )
    return _scored(found, F.col("row_id").alias("id"))


@query
def kw_phrase_indexed(spark, folder):
    rows = model.corpus(spark, folder)
    found = fts.search_postings(
        fts.build_postings(rows, "id", "content", positions=True), fts.corpus_stats(rows, ["content"]), PHRASE_QUERY
    )
    return _scored(found, F.col("row_id").alias("id"))


@query
def kw_indexed_filters(spark, folder):
    """A page of one agent, channel and period from the stored index; no text is read."""
    found = search.stored_page(
        stored.corpus_index(spark, folder), model.corpus(spark, folder), model.corpus_sessions(spark, folder), NOTE_QUERY, 50,
        agent="SRC0", channel="direct", date_from="2024-01-01 02:00:00", date_to="2024-01-05 12:00:00",
    )
    return _scored(found, "id", "session_id", "agent_id", "channel", shown_time("timestamp").alias("at"))


@query
def kw_stored(spark, folder):
    """The ranking of kw_documents, from the stored index."""
    return _scored(stored.corpus_index(spark, folder).search(NOTE_QUERY), F.col("row_id").alias("id"))


@query
def kw_index_updates(spark, folder):
    """The ranking after batches, replaced rows and deletions, from the segments as they are."""
    return _scored(stored.changed_index(spark, folder).search(NOTE_QUERY), F.col("row_id").alias("id"))


@query
def kw_index_merged(spark, folder):
    """A phrase from the same index after its segments were merged."""
    return _scored(stored.updated_index(spark, folder).search(PHRASE_QUERY), F.col("row_id").alias("id"))


@query
def index_stats(spark, folder):
    """Rows and tokens of the updated and merged index, from its list of segments."""
    return stored.updated_index(spark, folder).stats()


@query
def kw_thoughts(spark, folder):
    """Notes matching over content, metadata, source and agent."""
    found = fts.search_rows(model.notes(spark, folder), search.NOTE_TEXTS, "er src3 origin")
    return _scored(found, "id", "source", "agent")


@query
def kw_thoughts_page(spark, folder):
    rows = model.notes(spark, folder)
    found = search.keyword_notes(
        rows, "tion", agent="EN", days=30, now=latest(rows, "created_at")
    )
    return _scored(found, "id", "source", "agent", "metadata")


@query
def kw_agent_filter(spark, folder):
    found = search.keyword_messages(
        model.messages(spark, folder), model.sessions(spark, folder), "er", 20, agent=AGENT
    )
    return _scored(found, "id", "agent_id")


@query
def kw_channel_filter(spark, folder):
    found = search.keyword_messages(
        model.messages(spark, folder), model.sessions(spark, folder), "er", 20, channel="discord"
    )
    return _scored(found, "id", "channel")


@query
def kw_date_range(spark, folder):
    found = search.keyword_messages(
        model.messages(spark, folder), model.sessions(spark, folder), "er", 50,
        date_from="2024-01-02 00:00:00", date_to="2024-01-03 12:00:00",
    )
    return _scored(found, "id", shown_time("timestamp").alias("at"))


@query
def corpus_stats(spark, folder):
    return fts.corpus_stats(model.corpus(spark, folder), ["content"])


@query
def postings(spark, folder):
    """The inverted index, summed per term."""
    return (
        fts.build_postings(model.corpus(spark, folder), "id", "content")
        .groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum("tf").alias("occurrences"),
            F.sum("first_pos").alias("first_positions"),
        )
    )


# --- vector search -----------------------------------------------------------


def centroids(spark: SparkSession, folder: str) -> dict[str, list[float]]:
    """Mean vector of each label: ten rows that stand for embedded questions."""
    rows = (
        model.vectors(spark, folder)
        .select("label", F.posexplode("embedding"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("mean"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("mean"))
        .orderBy("label")
        .collect()
    )
    return {str(r["label"]): list(r["mean"]) for r in rows}


@query
def sem_threshold(spark, folder):
    """Every vector above a similarity floor."""
    found = vector.similar(
        model.vectors(spark, folder), "message_id", centroids(spark, folder)["3"], SIMILAR_FLOOR
    )
    return found.select("message_id", F.round("score", 5).alias("score"))


@query
def sem_scores(spark, folder):
    """Similarity of every vector, no floor."""
    found = vector.similar(
        model.vectors(spark, folder), "message_id", centroids(spark, folder)["3"], -2.0
    )
    return found.select("message_id", F.round("score", 5).alias("score"))


@query
def sem_topk(spark, folder):
    found = vector.search_messages(
        model.vectors(spark, folder), model.corpus(spark, folder),
        model.corpus_sessions(spark, folder), centroids(spark, folder)["3"], floor=SIMILAR_FLOOR,
    )
    return found.select("id", "session_id", "agent_id", "role", F.round("score", 5).alias("score"))


@query
def sem_fingerprint(spark, folder):
    """Nearest messages of one agent, equal texts once."""
    found = vector.search_messages(
        model.vectors(spark, folder), model.stained_corpus(spark, folder),
        model.corpus_sessions(spark, folder), centroids(spark, folder)["5"], limit=30,
        agent="SRC4", floor=-2.0,
    )
    return found.select("id", "role", F.round("score", 5).alias("score"))


@query
def sem_thoughts(spark, folder):
    rows = model.notes(spark, folder)
    found = vector.search_notes(
        model.note_vectors(spark, folder), rows, centroids(spark, folder)["1"], limit=10,
        agent="FR", days=365, now=latest(rows, "created_at"), floor=SIMILAR_FLOOR,
    )
    return found.select("id", "source", "agent", F.round("score", 5).alias("score"))


@query
def sem_batch(spark, folder):
    """Nearest vectors of ten questions in one pass."""
    found = vector.nearest_per_query(
        model.vectors(spark, folder), "message_id", centroids(spark, folder), 5, SIMILAR_FLOOR
    )
    return found.select("query", "message_id", "rank", F.round("score", 5).alias("score"))


@query
def embedding_gap(spark, folder):
    """Messages still without a vector, by whether they are long enough for one."""
    rows = model.corpus(spark, folder)
    missing = vector.without_vector(
        rows, "id", model.vectors(spark, folder), "message_id"
    )
    return missing.groupBy(vector.embeddable(F.col("content")).cast("int").alias("long_enough")).agg(
        F.count(F.lit(1)).alias("messages"), F.min("id").alias("first_id")
    )


@query
def embed_inputs(spark, folder):
    """What the embedding service is given for the backlog of notes."""
    backlog = capture.embedding_backlog(
        model.notes(spark, folder), model.note_vectors(spark, folder), MIN_EMBED_CHARS
    )
    return backlog.select("id", F.md5(text.head(F.col("content"), 2000)).alias("input"))


# --- line search -------------------------------------------------------------


@query
def file_lines(spark, folder):
    """All matching lines of all files with their surroundings."""
    hits = lines.find_lines(model.files(spark, folder), LINE_QUERY)
    return hits.select(
        "path", "agent", "line_num", "line",
        F.array_join("context_before", "\n").alias("before"),
        F.array_join("context_after", "\n").alias("after"),
        F.round("score", 3).alias("score"),
    )


@query
def file_search(spark, folder):
    hits = lines.search_files(model.files(spark, folder), LINE_QUERY, limit=20)
    return hits.select("path", "line_num", "line", F.round("score", 3).alias("score"))


@query
def search_docs(spark, folder):
    return lines.document_hits(
        lines.search_files(model.files(spark, folder), "tion", agent="en", limit=10)
    )


@query
def note_agents(spark, folder):
    """Owner of each note file, from its path."""
    path = F.col("path")
    moved = (
        F.when(F.col("agent") == "es", F.replace(path, F.lit("/clawd-es/"), F.lit("/shared/")))
        .when(F.col("agent") == "de", F.replace(path, F.lit("/clawd-de/"), F.lit("/clawd/")))
        .otherwise(path)
    )
    return model.files(spark, folder).select(
        "path", paths.note_agent(moved).alias("owner"),
        paths.in_skipped_directory(F.replace(path, F.lit("/src7/"), F.lit("/tmp/"))).cast("int").alias("skipped"),
    )


# --- unified search ----------------------------------------------------------


def library(spark: SparkSession, folder: str) -> search.Library:
    return search.Library(
        messages=model.corpus(spark, folder),
        sessions=model.corpus_sessions(spark, folder),
        message_vectors=model.vectors(spark, folder),
        notes=model.notes(spark, folder),
        note_vectors=model.note_vectors(spark, folder),
        files=model.files(spark, folder),
    )


@query
def unified_conversations(spark, folder):
    arms = search.unified_search(library(spark, folder), search.SearchRequest("er tion", limit=20))
    return arms["conversations"].select("agent", "role", "content", "session_id", "message_id", F.round("score", 3).alias("score"))


@query
def unified_indexed(spark, folder):
    """The conversations of unified_conversations, ranked by the stored index."""
    tables = replace(library(spark, folder), message_index=stored.corpus_index(spark, folder))
    arms = search.unified_search(tables, search.SearchRequest("er tion", limit=20, conversations_only=True))
    return arms["conversations"].select("agent", "role", "content", "session_id", "message_id", F.round("score", 3).alias("score"))


@query
def unified_summary(spark, folder):
    arms = search.unified_search(library(spark, folder), search.SearchRequest("er tion", limit=20))
    return arms["summary"]


@query
def unified_fallback(spark, folder):
    """A question routed to vectors that finds none, so keywords answer it."""
    far = [0.0] * 64
    arms = search.unified_search(
        library(spark, folder), search.SearchRequest("what of the tion er", limit=20), lambda _: far
    )
    return arms["thoughts"].select("id", "source", F.round("score", 3).alias("score"))


def mean_of_three(spark: SparkSession, folder: str) -> list[float]:
    """A question's vector that lies between those of three messages, the ones with the smallest ids."""
    three = model.vectors(spark, folder).orderBy("message_id").limit(3).select("embedding").collect()
    return [sum(x) / len(three) for x in zip(*(r["embedding"] for r in three))]


@query
def unified_semantic(spark, folder):
    """A question routed to vectors that finds some, ranked by similarity."""
    asked = mean_of_three(spark, folder)
    request = search.SearchRequest("what of the tion er", limit=20, conversations_only=True)
    arms = search.unified_search(library(spark, folder), request, lambda _: asked)
    return arms["conversations"].select("agent", "role", "content", "session_id", "message_id", F.round("score", 3).alias("score"))


@query
def result_dedup(spark, folder):
    """The first message of each role and text beginning."""
    return search.first_of_each(model.corpus(spark, folder), "id").select("id", "role")


@query
def route_queries(spark, folder):
    """Every document's head, and every sentence asked about it, routed."""
    asked = derived.questions(spark, folder)
    return asked.select(
        "doc_id", "place", requests.wants_semantic_column(F.col("question")).cast("int").alias("semantic")
    )


# --- browsing ----------------------------------------------------------------


@query
def recent_transcript(spark, folder):
    rows = model.messages(spark, folder)
    found = browse.recent(rows, model.sessions(spark, folder), latest(rows, "timestamp"), 120)
    return found.select("session_id", "agent_id", "id", "role", "content", shown_time("timestamp").alias("at"), "message_index")


@query
def recent_whole(spark, folder):
    """The transcript of all time, without a limit on rows or minutes."""
    rows = model.messages(spark, folder)
    found = browse.recent(
        rows, model.sessions(spark, folder), latest(rows, "timestamp"), 60_000_000, rows=None, most_minutes=None
    )
    return found.select("session_id", "agent_id", "id", "role", "content", shown_time("timestamp").alias("at"), "message_index")


@query
def recent_truncated(spark, folder):
    """The transcript of the tool interface: long answers cut."""
    rows = derived.tool_messages(spark, folder)
    found = browse.recent(
        rows, model.corpus_sessions(spark, folder), latest(rows, "timestamp"), 120, surface="tool"
    )
    return found.select("session_id", "id", "role", "content")


@query
def recent_headers(spark, folder):
    rows = derived.tool_messages(spark, folder)
    page = browse.recent(
        rows, model.corpus_sessions(spark, folder), latest(rows, "timestamp"), 120, surface="tool"
    )
    return browse.recent_headers(page).select("session_id", "agent_id", "shown", "note", "label", shown_time("first_at").alias("first_at"))


@query
def activity(spark, folder):
    rows = model.messages(spark, folder)
    found = browse.activity(rows, model.sessions(spark, folder), latest(rows, "timestamp"), 14, 30)
    return found.select(
        "session_id", "agent_id", shown_time("started_at").alias("started"),
        shown_time("ended_at").alias("ended"), "message_count", "first_user_message",
        "last_assistant_message",
    )


@query
def activity_tool(spark, folder):
    rows = model.messages(spark, folder)
    found = browse.activity(
        rows, model.sessions(spark, folder), latest(rows, "timestamp"), 14, 10, AGENT, "tool"
    )
    return found.select("session_id", "agent_id", shown_time("started_at").alias("started"), "message_count", "first_user_message")


@query
def agents_counts(spark, folder):
    rows = model.sessions(spark, folder)
    return browse.agent_counts(rows, latest(rows, "ended_at"), 14)


@query
def valid_agents(spark, folder):
    """Sessions each surface would list."""
    rows = model.sessions(spark, folder).withColumnRenamed("id", "session_id")
    return rows.select(
        "session_id",
        *[filters.listed_agent(level).cast("int").alias(level) for level in ("web", "transcript", "activity")],
    )


@query
def context_window(spark, folder):
    """Surroundings of the longest message of each session."""
    rows = model.messages(spark, folder)
    asked = rows.groupBy("session_id").agg(
        F.max_by("id", F.struct(F.char_length("content"), -F.col("id"))).alias("message_id")
    )
    found = browse.context(asked, rows, radius=2)
    return found.select(
        "session_id", "message_id", "id", "role", "content", "message_index",
        *[F.col(c).cast("int").alias(c) for c in ("is_match", "has_more_before", "has_more_after")],
    )


def _page(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "id", "role", "content", "message_index",
        *[F.col(c).cast("int").alias(c) for c in ("has_more_before", "has_more_after")],
    )


@query
def session_window(spark, folder):
    return _page(browse.session_page(model.messages(spark, folder), around=4, window=4))


@query
def session_head(spark, folder):
    return _page(browse.session_page(model.messages(spark, folder), window=3))


@query
def session_bounds(spark, folder):
    return browse.session_bounds(model.messages(spark, folder))


@query
def db_stats(spark, folder):
    tables = {
        "messages": model.messages(spark, folder),
        "sessions": model.sessions(spark, folder),
        "embeddings": model.vectors(spark, folder),
        "thoughts": model.notes(spark, folder),
        "thought_embeddings": model.note_vectors(spark, folder),
    }
    return browse.database_stats(tables, tables["sessions"]).withColumn(
        "last_indexed", shown_time("last_indexed")
    )


@query
def agent_names(spark, folder):
    return browse.agent_names(model.sessions(spark, folder))


@query
def thought_stats(spark, folder):
    return browse.note_counts(model.notes(spark, folder))


@query
def list_thoughts_page(spark, folder):
    page = browse.list_notes(model.notes(spark, folder), limit=20, offset=40)
    return page.select("id", "content", "source", "agent", "metadata", shown_time("created_at").alias("created"))


@query
def author_activity(spark, folder):
    rows = derived.author_posts(spark, folder)
    return browse.author_activity(rows, latest(rows, "posted_at"), 5, 7).select(
        "author", "messages", shown_time("joined_at").alias("joined")
    )


@query
def index_freshness(spark, folder):
    log = derived.index_log(spark, folder)
    listing = derived.listing(spark, folder)
    found = browse.index_freshness(listing, log, latest(listing, "modified_at"))
    return found.withColumn("stale", F.col("stale").cast("int"))


# --- cleaning ----------------------------------------------------------------


@query
def dup_exact(spark, folder):
    found = clean.repeated_messages(
        model.corpus(spark, folder), model.corpus_sessions(spark, folder)
    )
    return found.withColumn("started_at", shown_time("started_at"))


@query
def dup_exact_summary(spark, folder):
    return clean.repeated_summary(model.corpus(spark, folder))


@query
def dup_exact_ids(spark, folder):
    return clean.repeated_ids(model.corpus(spark, folder))


@query
def dup_exact_all(spark, folder):
    """Every session with repeated messages, not a page of them."""
    found = clean.repeated_messages(model.corpus(spark, folder), model.corpus_sessions(spark, folder), limit=None)
    return found.withColumn("started_at", shown_time("started_at"))


@query
def dup_cross_exact_all(spark, folder):
    return clean.similar_messages(model.corpus(spark, folder), "exact", limit=None)


@query
def dup_medium_all(spark, folder):
    return clean.similar_messages(model.corpus(spark, folder), "medium", limit=None)


@query
def dup_cross_exact(spark, folder):
    return clean.similar_messages(model.corpus(spark, folder), "exact")


@query
def dup_high(spark, folder):
    return clean.similar_messages(model.corpus(spark, folder), "high")


@query
def dup_medium(spark, folder):
    return clean.similar_messages(model.corpus(spark, folder), "medium")


@query
def dup_summary(spark, folder):
    rows = model.corpus(spark, folder)
    parts = [
        clean.similar_summary(rows, tier).select(F.lit(tier).alias("tier"), "*")
        for tier in ("exact", "high", "medium")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dup_delete_ids(spark, folder):
    return clean.similar_ids(model.corpus(spark, folder), "medium")


@query
def dup_delete_ids_exact(spark, folder):
    return clean.similar_ids(model.corpus(spark, folder), "exact")


@query
def dup_group_members(spark, folder):
    found = clean.all_group_members(model.corpus(spark, folder), model.corpus_sessions(spark, folder))
    return found.select("id", "keep_id", "session_id", "role", "content_preview", "agent_id", "channel")


@query
def junk_empty(spark, folder):
    return model.stained_corpus(spark, folder).where(text.is_blank(F.col("content"))).select("id", "content")


@query
def junk_orphans(spark, folder):
    found = clean.junk(model.stained_corpus(spark, folder), model.corpus_sessions(spark, folder))
    return found.where(F.col("category") == "orphaned").drop("category")


@query
def junk_emoji(spark, folder):
    return model.stained_corpus(spark, folder).where(text.is_single_emoji(F.col("content"))).select("id", "content")


@query
def junk_all(spark, folder):
    return clean.junk_ids(model.stained_corpus(spark, folder), model.corpus_sessions(spark, folder))


@query
def junk_counts(spark, folder):
    return clean.junk_counts(model.stained_corpus(spark, folder), model.corpus_sessions(spark, folder))


@query
def junk_page(spark, folder):
    return clean.junk_page(model.stained_corpus(spark, folder), model.corpus_sessions(spark, folder))


@query
def noise_reasons(spark, folder):
    return clean.noise_counts(model.stained_corpus(spark, folder))


@query
def noise_ids(spark, folder):
    return clean.noise_ids(model.stained_corpus(spark, folder))


@query
def noise_all(spark, folder):
    return clean.noise_page(model.stained_corpus(spark, folder), limit=None)


@query
def noise_page(spark, folder):
    return clean.noise_page(model.stained_corpus(spark, folder))


@query
def noise_at_ingest(spark, folder):
    """Noise by the patterns alone, as new messages are tested."""
    return model.stained_corpus(spark, folder).select(
        "id", noise_tests.noise_reason(F.col("content")).alias("reason")
    ).where(F.col("reason").isNotNull())


@query
def emb_orphans(spark, folder):
    return clean.orphaned_vectors(model.vectors(spark, folder), model.messages(spark, folder))


@query
def emb_orphans_summary(spark, folder):
    return clean.orphaned_vectors_summary(model.vectors(spark, folder), model.messages(spark, folder))


@query
def emb_kept(spark, folder):
    """Vectors left once those without a message are gone."""
    return clean.without_orphaned_vectors(
        model.vectors(spark, folder), model.messages(spark, folder)
    ).select("id", "message_id")


@query
def dry_run_summary(spark, folder):
    return clean.dry_run(
        model.stained_corpus(spark, folder), model.corpus_sessions(spark, folder),
        model.vectors(spark, folder),
    )


def _cleaned(spark, folder):
    rows, known = model.stained_corpus(spark, folder), model.corpus_sessions(spark, folder)
    return clean.delete_messages(
        rows, known, model.vectors(spark, folder), clean.junk_ids(rows, known)
    )


@query
def delete_effects(spark, folder):
    """Effect of removing all junk."""
    return _cleaned(spark, folder)["effects"]


@query
def delete_recount(spark, folder):
    """Session sizes after all junk is gone."""
    return _cleaned(spark, folder)["sessions"].select("id", "message_count")


@query
def delete_kept(spark, folder):
    return _cleaned(spark, folder)["messages"].select("id", "session_id")


@query
def delete_kept_vectors(spark, folder):
    return _cleaned(spark, folder)["embeddings"].select("id", "message_id")


def _purged(spark, folder):
    known = model.sessions(spark, folder)
    doomed = known.where(paths.is_excluded(F.col("source_file"))).select(F.col("id").alias("session_id"))
    return clean.delete_sessions(
        model.messages(spark, folder), known, model.vectors(spark, folder),
        derived.index_log(spark, folder), doomed,
    )


@query
def purge_excluded(spark, folder):
    """Effect of removing sessions whose file is now excluded."""
    return _purged(spark, folder)["effects"]


@query
def purge_excluded_kept(spark, folder):
    return _purged(spark, folder)["messages"].select("id")


@query
def purge_excluded_log(spark, folder):
    return _purged(spark, folder)["index_log"].select("source_file")


@query
def cleanup_history(spark, folder):
    runs = derived.cleanup_runs(spark, folder)
    return clean.history(runs).select(shown_time("ran_at").alias("ran"), "mode", "deleted", "freed_bytes")


# --- secrets -----------------------------------------------------------------


@query
def redact(spark, folder):
    return model.secret_texts(spark, folder).select("id", F.md5(secrets.redact(F.col("content"))).alias("digest"))


@query
def redact_custom(spark, folder):
    """With one more pattern, as an installation would configure it."""
    custom = secrets.load_custom_patterns(["# tokens", r"token = \"[0-9a-f]{40}\""])
    return model.secret_texts(spark, folder).select(
        "id", F.md5(secrets.redact(F.col("content"), custom)).alias("digest")
    )


@query
def redact_changed(spark, folder):
    return secrets_history.changed_rows(model.secret_texts(spark, folder), "id", "content").select("id")


@query
def redact_counts(spark, folder):
    return secrets_history.family_totals(model.secret_texts(spark, folder), "id", "content")


@query
def redact_report(spark, folder):
    return secrets_history.redaction_report(model.secret_texts(spark, folder), "id", "content")


# --- text --------------------------------------------------------------------


@query
def html_text(spark, folder):
    return model.table(spark, folder, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@query
def tag_strip(spark, folder):
    return derived.tagged_texts(spark, folder).select(
        "id", F.md5(text.without_system_tags(F.col("content"))).alias("digest")
    )


@query
def deep_links(spark, folder):
    return derived.linked_texts(spark, folder).select("id", text.deep_link(F.col("content")).alias("link"))


@query
def truncations(spark, folder):
    rows = derived.tool_messages(spark, folder)
    role, content = F.col("role"), F.col("content")
    return rows.select(
        "id",
        F.md5(text.shorten_by_role(role, content, browse.WEB_LIMITS)).alias("web"),
        F.md5(text.shorten_by_role(role, content, browse.TOOL_LIMITS)).alias("tool"),
        F.md5(text.shorten(content, 150)).alias("snippet"),
    )


@query
def agent_aliases(spark, folder):
    naming = paths.Naming({"agent0": "Ada", "boot": "Starter"})
    return model.sessions(spark, folder).select(
        "id", naming.display_column(F.col("agent_id")).alias("agent")
    )


# --- paths and ingest --------------------------------------------------------


@query
def path_metadata(spark, folder):
    naming = paths.Naming({"main": "Mara", "claude": "Claude", "orla": "Orla"}, local_home="/home/me")
    return paths.with_session_metadata(derived.session_paths(spark, folder), naming).select(
        "path", "agent_id", "channel", "channel_id"
    )


@query
def session_uuid(spark, folder):
    return derived.session_paths(spark, folder).select("path", paths.session_uuid(F.col("path")).alias("uuid"))


@query
def path_suffix(spark, folder):
    return derived.session_paths(spark, folder).select("path", paths.path_suffix(F.col("path")).alias("suffix"))


@query
def excluded_files(spark, folder):
    return derived.session_paths(spark, folder).select(
        "path", (paths.is_session_file(F.col("path")) & ~paths.is_excluded(F.col("path"))).cast("int").alias("taken")
    )


@query
def ingest_messages(spark, folder):
    """Session files written from the conversations, parsed back."""
    kept = ingest.number_messages(ingest.parse_lines(derived.session_lines(spark, folder)))
    return kept.select("path", "message_index", "role", "content", shown_time("timestamp").alias("at"))


@query
def ingest_sessions(spark, folder):
    kept = ingest.number_messages(ingest.parse_lines(derived.session_lines(spark, folder)))
    return ingest.session_rows(kept).select(
        "path", "message_count", shown_time("started_at").alias("started"), shown_time("ended_at").alias("ended")
    )


@query
def raw_lines(spark, folder):
    """Every line that is a JSON object, whatever its shape."""
    kind = F.try_variant_get(F.col("entry"), "$.type", "string")
    return ingest.parse_raw(derived.session_lines(spark, folder)).select("path", "offset", kind.alias("type"))


@query
def append_guard(spark, folder):
    """New messages without those whose place in the session is stored already."""
    rows = model.messages(spark, folder)
    stored = rows.where(F.col("message_index") % 3 != 0)
    return ingest.not_stored(rows, stored).select("id", "session_id", "message_index")


@query
def replaced_sessions(spark, folder):
    """Sessions after every second one was indexed anew."""
    known = model.sessions(spark, folder)
    anew = known.where(F.col("id").cast("long") % 2 == 0).withColumn("message_count", F.col("message_count") + 1)
    return ingest.replaced_sessions(known, anew).select("id", "agent_id", "message_count")


@query
def deleted_notes(spark, folder):
    """Notes and their vectors without some of them."""
    rows = model.notes(spark, folder)
    ids = rows.where(F.col("id") % 4 == 1).select("id")
    vectors = rows.select(F.col("id").alias("note_id"))
    left = capture.delete_notes(rows, vectors, ids)
    return left["notes"].select("id", F.lit("note").alias("kind")).unionByName(
        left["deleted"].select("id", F.lit("deleted").alias("kind"))
    ).unionByName(left["embeddings"].select(F.col("note_id").alias("id"), F.lit("vector").alias("kind")))


@query
def ingest_status(spark, folder):
    planned = ingest.plan_files(
        derived.listing(spark, folder), derived.index_log(spark, folder), derived.indexed_sessions(spark, folder)
    )
    return planned.select("path", "action", "reason", "start_offset", "start_index")


@query
def watch_state(spark, folder):
    """Listing against the watcher's memory: new, changed, gone."""
    return ingest.compare_listing(
        derived.listing(spark, folder), derived.index_log(spark, folder)
    ).groupBy("state").agg(F.count(F.lit(1)).alias("files"))


@query
def time_in_text(spark, folder):
    rows = derived.dated_texts(spark, folder)
    return rows.select("id", shown_time(ingest.time_in_text(F.col("content"))).alias("at"))


# --- capture -----------------------------------------------------------------


@query
def mail_noise(spark, folder):
    return model.mail(spark, folder).select(
        "id", noise_tests.is_mail_noise(F.col("sender"), F.col("subject")).cast("int").alias("noise")
    )


@query
def mail_capture(spark, folder):
    found = capture.capture_mail(model.mail(spark, folder), model.mail_log(spark, folder))
    return found.select("source_id", "account", "outcome", "content")


@query
def mail_backfill(spark, folder):
    """Mail since a date, previews only."""
    found = capture.capture_mail(
        model.mail(spark, folder), model.mail_log(spark, folder), full_body=False, after="2024-01-04 00:00:00"
    )
    return found.select("source_id", "account", "outcome", "content")


@query
def mail_merge(spark, folder):
    """Inbox and sent mail of which some is in both."""
    rows = model.mail(spark, folder)
    sent = rows.where(F.contains("snippet", F.lit("/en/"))).withColumn("subject", F.concat(F.lit("sent: "), "subject"))
    inbox = rows.where(F.contains("snippet", F.lit(".org/")))
    return capture.merge_boxes(inbox, sent).select("id", "account", "subject")


@query
def drive_noise(spark, folder):
    return model.drive_documents(spark, folder).select(
        "id", noise_tests.is_document_noise(F.col("mime"), F.col("name")).cast("int").alias("noise")
    )


@query
def drive_capture(spark, folder):
    found = capture.capture_documents(model.drive_documents(spark, folder), model.drive_log(spark, folder))
    return found.select("source_id", "account", "outcome", F.md5("content").alias("content"))


@query
def drive_backfill(spark, folder):
    found = capture.capture_documents(
        model.drive_documents(spark, folder), model.drive_log(spark, folder), created_after="2024-01-01 04:00:00"
    )
    return capture.outcome_counts(found)


@query
def slack_capture(spark, folder):
    log = model.capture_log(spark, folder).where(F.lit(False))
    return capture.capture_chat(model.posts(spark, folder), log).select("source_id", "outcome", "content")


@query
def capture_status(spark, folder):
    found = capture.capture_status(model.capture_log(spark, folder))
    return found.withColumn("latest", shown_time("latest"))


@query
def capture_upsert(spark, folder):
    """The log after each key's entries replaced one another."""
    rows = model.keyed_captures(spark, folder)
    half = F.col("captured_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    merged = capture.upsert_log(rows.where(half), rows.where(~half))
    return merged.select("source_type", "source_id", "account", "thought_id", "source_modified", shown_time("captured_at").alias("captured"))


@query
def not_captured(spark, folder):
    items = model.mail(spark, folder).select(
        F.lit("gmail").alias("source_type"), F.col("id").cast("string").alias("source_id"), "account"
    )
    return capture.not_captured(items, model.mail_log(spark, folder))


@query
def thought_dedup_24h(spark, folder):
    return capture.drop_repeats(model.repeated_notes(spark, folder)).select(
        "id", "content", shown_time("created_at").alias("created")
    )


@query
def thought_repeats(spark, folder):
    """What capturing each note answers: the id stored for it, and whether it was a repeat."""
    answers = capture.capture_answers(model.repeated_notes(spark, folder))
    return answers.withColumn("duplicate", F.col("duplicate").cast("int"))


@query
def thought_prepare(spark, folder):
    """Incoming notes stripped and redacted."""
    raw = model.secret_texts(spark, folder).withColumn(
        "content", F.concat(F.lit(" \n\t"), "content", F.lit("\n "))
    )
    return capture.prepared_notes(raw).select("id", F.md5("content").alias("digest"))


@query
def purge_mail_noise(spark, folder):
    return capture.stored_mail_noise(model.stored_feed_notes(spark, folder)).withColumn(
        "noise", F.col("noise").cast("int")
    )


@query
def purge_drive_noise(spark, folder):
    return capture.stored_document_noise(model.stored_feed_notes(spark, folder)).withColumn(
        "noise", F.col("noise").cast("int")
    )


@query
def purge_totals(spark, folder):
    rows = model.stored_feed_notes(spark, folder)
    mail = capture.noise_totals(capture.stored_mail_noise(rows)).select(F.lit("gmail").alias("source"), "*")
    drive = capture.noise_totals(capture.stored_document_noise(rows)).select(F.lit("drive").alias("source"), "*")
    return mail.unionByName(drive)
