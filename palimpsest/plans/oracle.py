"""The queries as SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

from palimpsest.fixed_values import (
    DOCUMENT_CODE_ENDINGS,
    DOCUMENT_DESIGN_ENDINGS,
    DOCUMENT_TYPE_BLOCKLIST,
    MAIL_SENDER_BLOCKLIST,
    MAIL_SUBJECT_PATTERNS,
    SECRET_FAMILIES,
)

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def shown(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def pick(key: str, *values: str) -> str:
    return f"([{', '.join(quoted(v) for v in values)}])[CAST(({key}) % {len(values)} AS BIGINT) + 1]"


EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def agent_of(key: str) -> str:
    return (
        f"CASE WHEN {key} % 7 = 5 THEN 'boot' WHEN {key} % 7 = 6 THEN 'abc12' || {key} "
        f"ELSE 'Agent' || ({key} % 5) END"
    )


MESSAGES = f"""
messages AS (
  SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS session_id, role, text AS content,
         {EPOCH} + to_hours(conv_id) + to_minutes(turn) AS timestamp, CAST(turn AS INTEGER) AS message_index
  FROM conversations)"""
SESSIONS = f"""
sessions AS (
  SELECT CAST(conv_id AS VARCHAR) AS id, {agent_of('conv_id')} AS agent_id,
         {pick('conv_id', 'direct', 'discord', 'telegram')} AS channel,
         min({EPOCH} + to_hours(conv_id) + to_minutes(turn)) AS started_at,
         max({EPOCH} + to_hours(conv_id) + to_minutes(turn)) AS ended_at, count(*) AS message_count,
         '/srv/agents/' || {agent_of('conv_id')} || '/sessions/' ||
           CASE WHEN conv_id % 4 = 0 THEN 'boot-' ELSE '' END || conv_id || '.jsonl' AS source_file
  FROM conversations GROUP BY conv_id)"""
CORPUS = f"""
corpus AS (
  SELECT doc_id AS id, source || '/' || (doc_id // 60) AS session_id, lang AS role, text AS content,
         {EPOCH} + to_minutes(doc_id) AS timestamp, CAST((doc_id // 20) % 2 AS INTEGER) AS message_index
  FROM documents)"""
CORPUS_SESSIONS = """
corpus_sessions AS (
  SELECT session_id AS id, split_part(session_id, '/', 1) AS agent_id, 'direct' AS channel,
         min(timestamp) AS started_at, max(timestamp) AS ended_at, count(*) AS message_count
  FROM corpus GROUP BY session_id
  HAVING bool_or(id IN (SELECT doc_id FROM labels)))"""
STAINED = """
stained AS (
  SELECT * REPLACE (CASE id % 17
    WHEN 0 THEN 'HEARTBEAT_OK'
    WHEN 1 THEN 'Gateway restarting ' || content
    WHEN 2 THEN NULL
    WHEN 3 THEN '   '
    WHEN 4 THEN chr(128077)
    WHEN 5 THEN content || ' OpenClaw Health Check Report'
    WHEN 6 THEN 'If nothing needs attention ' || content || ' reply with ONLY: NO_REPLY'
    WHEN 7 THEN 'note: ' || content || ' gateway restarted and back online'
    WHEN 8 THEN 'SECURITY NOTICE: The following content is from an EXTERNAL ' || content
    WHEN 9 THEN 'Gateway restarting now, will reconnect: ' || content
    WHEN 10 THEN '<3'
    WHEN 11 THEN 'You are running a boot check ' || content
    ELSE content END AS content)
  FROM corpus)"""
VECTORS = "vectors AS (SELECT vec_id AS id, vec_id AS message_id, embedding, label FROM embeddings)"
NOTES = f"""
notes AS (
  SELECT doc_id AS id, text AS content, source, CASE WHEN lang <> 'de' THEN lang END AS agent,
         '{{"origin": "' || source || '"}}' AS metadata, {EPOCH} + to_minutes(doc_id * 7) AS created_at
  FROM documents)"""
FILES = """
files AS (
  SELECT '/home/u/clawd-' || lang || '/' || source || '/' || doc_id || '.md' AS path, lang AS agent,
         text AS content FROM documents)"""


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


# --- keyword search ----------------------------------------------------------


def words(column: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(strip_accents(lower(coalesce({column}, ''))), "
        r"'[^\p{L}\p{N}]+'), lambda x: x <> '')"
    )


def occurrences(column: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter({column}, lambda x: x = '{phrase[0]}'))"
    test = " AND ".join(f"{column}[i + {j}] = '{w}'" for j, w in enumerate(phrase))
    return f"len(list_filter(range(1, len({column}) + 1), lambda i: {test}))"


def ranked(source: str, texts: list[str], phrases: list[list[str]]) -> str:
    """CTEs ending in `ranked`: rows of the source with their BM25 score."""
    lists = ", ".join(f"{words(t)} AS w{i}" for i, t in enumerate(texts))
    frequencies = ", ".join(
        " + ".join(occurrences(f"w{i}", p) for i in range(len(texts))) + f" AS f{j}"
        for j, p in enumerate(phrases)
    )
    length = " + ".join(f"len(w{i})" for i in range(len(texts)))
    dfs = ", ".join(f"count(*) FILTER (f{j} > 0) AS df{j}" for j in range(len(phrases)))
    terms = " + ".join(
        f"greatest(ln((n - df{j} + 0.5) / (df{j} + 0.5)), 0.000001) * f{j} * 2.2 / "
        f"(f{j} + 1.2 * (0.25 + 0.75 * d / (total / n)))"
        for j in range(len(phrases))
    )
    every = " AND ".join(f"f{j} > 0" for j in range(len(phrases)))
    return f"""
    split AS MATERIALIZED (SELECT *, {lists} FROM {source}),
    counted AS MATERIALIZED (SELECT *, {frequencies}, {length} AS d FROM split),
    stats AS (SELECT count(*)::DOUBLE AS n, sum(d)::DOUBLE AS total, {dfs} FROM counted),
    ranked AS (SELECT counted.*, -({terms}) AS score FROM counted, stats WHERE {every})"""


MESSAGE_RANK = ranked("messages", ["content"], [["er"], ["th"]])
ONE_WORD_RANK = ranked("messages", ["content"], [["er"]])
DOCUMENT_RANK = ranked("corpus", ["content"], [["tion"], ["er"]])
PHRASE_RANK = ranked("corpus", ["content"], [["er", "th"]])

SQL["kw_messages"] = f"""{with_(MESSAGES, SESSIONS, MESSAGE_RANK)}
SELECT r.id, r.session_id, s.agent_id, s.channel, r.role, r.content, round(r.score, 6) AS score
FROM ranked r JOIN sessions s ON r.session_id = s.id ORDER BY r.score, r.id LIMIT 20"""
SQL["kw_documents"] = SQL["kw_indexed"] = f"""{with_(CORPUS, DOCUMENT_RANK)}
SELECT id, round(score, 6) AS score FROM ranked"""
SQL["kw_phrase"] = SQL["kw_phrase_indexed"] = f"""{with_(CORPUS, PHRASE_RANK)}
SELECT id, round(score, 6) AS score FROM ranked"""
SQL["kw_stored"] = SQL["kw_indexed"]
SQL["kw_indexed_filters"] = f"""{with_(CORPUS, CORPUS_SESSIONS, DOCUMENT_RANK)}
SELECT r.id, r.session_id, s.agent_id, s.channel, {shown('r.timestamp')} AS at, round(r.score, 6) AS score
FROM ranked r JOIN corpus_sessions s ON r.session_id = s.id
WHERE lower(s.agent_id) = 'src0' AND s.channel = 'direct'
  AND r.timestamp BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-05 12:00:00'
ORDER BY r.score, r.id LIMIT 50"""
CHANGED = """
changed AS (
  SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN content || ' er tion' ELSE content END AS content) FROM corpus WHERE id % 5 <> 3)"""
SQL["kw_index_updates"] = f"""{with_(CORPUS, CHANGED, ranked('changed', ['content'], [['tion'], ['er']]))}
SELECT id, round(score, 6) AS score FROM ranked"""
SQL["kw_index_merged"] = f"""{with_(CORPUS, CHANGED, ranked('changed', ['content'], [['er', 'th']]))}
SELECT id, round(score, 6) AS score FROM ranked"""
SQL["index_stats"] = f"""{with_(CORPUS, CHANGED)}
SELECT count(*) AS rows, CAST(sum(len({words('content')})) AS BIGINT) AS total_length FROM changed"""
SQL["kw_thoughts"] = f"""{with_(NOTES, ranked('notes', ['content', 'metadata', 'source', 'agent'], [['er'], ['src3'], ['origin']]))}
SELECT id, source, agent, round(score, 6) AS score FROM ranked"""
SQL["kw_thoughts_page"] = f"""{with_(NOTES, ranked('notes', ['content', 'metadata', 'source', 'agent'], [['tion']]))}
SELECT id, source, agent, metadata, round(score, 6) AS score FROM ranked
WHERE created_at >= (SELECT max(created_at) FROM notes) - INTERVAL 30 DAY AND lower(agent) = 'en'
ORDER BY ranked.score, id LIMIT 10"""
SQL["kw_agent_filter"] = f"""{with_(MESSAGES, SESSIONS, ONE_WORD_RANK)}
SELECT r.id, s.agent_id, round(r.score, 6) AS score FROM ranked r JOIN sessions s ON r.session_id = s.id
WHERE lower(s.agent_id) = 'agent1' ORDER BY r.score, r.id LIMIT 20"""
SQL["kw_channel_filter"] = f"""{with_(MESSAGES, SESSIONS, ONE_WORD_RANK)}
SELECT r.id, s.channel, round(r.score, 6) AS score FROM ranked r JOIN sessions s ON r.session_id = s.id
WHERE s.channel = 'discord' ORDER BY r.score, r.id LIMIT 20"""
SQL["kw_date_range"] = f"""{with_(MESSAGES, SESSIONS, ONE_WORD_RANK)}
SELECT r.id, {shown('r.timestamp')} AS at, round(r.score, 6) AS score
FROM ranked r JOIN sessions s ON r.session_id = s.id
WHERE r.timestamp BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-03 12:00:00'
ORDER BY r.score, r.id LIMIT 50"""
SQL["corpus_stats"] = f"""{with_(CORPUS)}
SELECT count(*) AS rows, CAST(sum(len({words('content')})) AS BIGINT) AS total_length FROM corpus"""
SQL["postings"] = f"""{with_(CORPUS)},
split AS (SELECT id, {words('content')} AS w FROM corpus),
tokens AS (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM split),
per_row AS (SELECT id, term, count(*) AS tf, min(pos) AS first_pos FROM tokens GROUP BY ALL)
SELECT term, count(*) AS documents, CAST(sum(tf) AS BIGINT) AS occurrences,
       CAST(sum(first_pos) AS BIGINT) AS first_positions FROM per_row GROUP BY term"""

# --- vectors -----------------------------------------------------------------

CENTROIDS = """
parts AS (SELECT id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM vectors),
means AS (SELECT label AS query, pos, avg(x) AS m FROM parts GROUP BY label, pos),
cosines AS (
  SELECT m.query, p.id AS message_id,
         sum(p.x * m.m) / (sqrt(sum(p.x * p.x)) * sqrt(sum(m.m * m.m)) + 1e-10) AS score
  FROM parts p JOIN means m ON p.pos = m.pos GROUP BY m.query, p.id)"""

SQL["sem_threshold"] = f"""{with_(VECTORS, CENTROIDS)}
SELECT message_id, round(score, 5) AS score FROM cosines WHERE query = 3 AND score >= 0.1"""
SQL["sem_scores"] = f"""{with_(VECTORS, CENTROIDS)}
SELECT message_id, round(score, 5) AS score FROM cosines WHERE query = 3"""
SQL["sem_topk"] = f"""{with_(VECTORS, CENTROIDS, CORPUS, CORPUS_SESSIONS)},
best AS (
  SELECT c.id, c.session_id, s.agent_id, c.role, c.content, k.score
  FROM cosines k JOIN corpus c ON k.message_id = c.id JOIN corpus_sessions s ON c.session_id = s.id
  WHERE k.query = 3 AND k.score >= 0.1),
once AS (SELECT *, row_number() OVER (PARTITION BY role || ':' || left(content, 200) ORDER BY score DESC, id) AS copy FROM best)
SELECT id, session_id, agent_id, role, round(once.score, 5) AS score FROM once WHERE copy = 1
ORDER BY once.score DESC, id LIMIT 20"""
SQL["sem_fingerprint"] = f"""{with_(VECTORS, CENTROIDS, CORPUS, CORPUS_SESSIONS, STAINED)},
best AS (
  SELECT c.id, c.role, c.content, k.score
  FROM cosines k JOIN stained c ON k.message_id = c.id JOIN corpus_sessions s ON c.session_id = s.id
  WHERE k.query = 5 AND lower(s.agent_id) = 'src4'),
once AS (SELECT *, row_number() OVER (PARTITION BY role || ':' || left(coalesce(content, ''), 200) ORDER BY score DESC, id) AS copy FROM best)
SELECT id, role, round(once.score, 5) AS score FROM once WHERE copy = 1 ORDER BY once.score DESC, id LIMIT 30"""
SQL["sem_thoughts"] = f"""{with_(VECTORS, CENTROIDS, NOTES)}
SELECT n.id, n.source, n.agent, round(k.score, 5) AS score FROM cosines k JOIN notes n ON n.id = k.message_id
WHERE k.query = 1 AND k.score >= 0.1 AND lower(n.agent) = 'fr'
  AND n.created_at >= (SELECT max(created_at) FROM notes) - INTERVAL 365 DAY
ORDER BY k.score DESC, n.id LIMIT 10"""
SQL["sem_batch"] = f"""{with_(VECTORS, CENTROIDS)},
placed AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, message_id) AS rank FROM cosines WHERE score >= 0.1)
SELECT CAST(query AS VARCHAR) AS query, message_id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score
FROM placed WHERE rank <= 5"""
SQL["embedding_gap"] = f"""{with_(CORPUS)}
SELECT CAST(length(content) >= 20 AS INTEGER) AS long_enough, count(*) AS messages, min(id) AS first_id
FROM corpus WHERE id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1"""
SQL["embed_inputs"] = f"""{with_(NOTES)}
SELECT id, md5(substr(content, 1, 2000)) AS input FROM notes
WHERE length(content) >= 20 AND id NOT IN (SELECT vec_id FROM embeddings)"""

# --- line search -------------------------------------------------------------


def line_hits(terms: list[str]) -> str:
    any_word = " OR ".join(f"contains(low, '{t}')" for t in terms)
    nearby = " AND ".join(f"contains(around, '{t}')" for t in terms)
    share = " + ".join(f"CAST(contains(low, '{t}') AS INTEGER)" for t in terms)
    return f"""
    broken AS (SELECT path, agent, string_split(rtrim(content, chr(10)) , chr(10)) AS ls FROM files),
    numbered AS (SELECT path, agent, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS line_num FROM broken),
    seen AS (
      SELECT path, agent, line_num, raw, lower(raw) AS low,
             string_agg(lower(raw), ' ') OVER w AS around,
             string_agg(rtrim(raw), chr(10)) OVER b AS before, string_agg(rtrim(raw), chr(10)) OVER a AS after
      FROM numbered
      WINDOW w AS (PARTITION BY path ORDER BY line_num ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
             b AS (PARTITION BY path ORDER BY line_num ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
             a AS (PARTITION BY path ORDER BY line_num ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
    hits AS (
      SELECT path, agent, CAST(line_num AS INTEGER) AS line_num, rtrim(raw) AS line,
             coalesce(before, '') AS before, coalesce(after, '') AS after, ({share}) / {len(terms)}::DOUBLE AS score
      FROM seen WHERE ({any_word}) AND ({nearby})),
    unique_hits AS (
      SELECT *, row_number() OVER (PARTITION BY left(line, 100) ORDER BY score DESC, path, line_num) AS copy FROM hits)"""


SQL["file_lines"] = f"""{with_(FILES, line_hits(['tion', 'er']))}
SELECT path, agent, line_num, line, before, after, round(score, 3) AS score FROM hits"""
SQL["file_search"] = f"""{with_(FILES, line_hits(['tion', 'er']))}
SELECT path, line_num, line, round(unique_hits.score, 3) AS score FROM unique_hits WHERE copy = 1
ORDER BY unique_hits.score DESC, path, line_num LIMIT 20"""
SQL["search_docs"] = f"""{with_(FILES.replace('FROM documents', "FROM documents WHERE lang = 'en'"), line_hits(['tion']))}
SELECT path, agent, line_num, left(line, 500) AS line, round(unique_hits.score, 3) AS score FROM unique_hits WHERE copy = 1
ORDER BY unique_hits.score DESC, path, line_num LIMIT 10"""
SQL["note_agents"] = f"""{with_(FILES)}
SELECT path, CASE agent WHEN 'es' THEN 'shared' WHEN 'de' THEN 'main' ELSE agent END AS owner,
       CAST(contains(path, '/src7/') AS INTEGER) AS skipped FROM files"""

# --- unified search ----------------------------------------------------------

UNIFIED = f"""{with_(CORPUS, CORPUS_SESSIONS, DOCUMENT_RANK)},
page AS (
  SELECT s.agent_id, r.* FROM ranked r JOIN corpus_sessions s ON r.session_id = s.id ORDER BY r.score, r.id LIMIT 20),
once AS (SELECT *, row_number() OVER (PARTITION BY role || ':' || left(content, 500) ORDER BY score, id) AS copy FROM page)"""
SQL["unified_conversations"] = f"""{UNIFIED}
SELECT agent_id AS agent, role, left(content, 500) AS content, session_id, id AS message_id,
       round(score, 3) AS score FROM once WHERE copy = 1"""
SQL["unified_indexed"] = SQL["unified_conversations"]
SQL["unified_summary"] = f"""{with_(NOTES, FILES, CORPUS, CORPUS_SESSIONS, DOCUMENT_RANK, line_hits(['er', 'tion']))},
page AS (
  SELECT r.* FROM ranked r JOIN corpus_sessions s ON r.session_id = s.id ORDER BY r.score, r.id LIMIT 20),
sizes AS (SELECT
  (SELECT count(DISTINCT role || ':' || left(content, 500)) FROM page) AS conversations,
  (SELECT least(20, count(*)) FROM unique_hits WHERE copy = 1) AS files,
  (SELECT least(20, count(*)) FROM notes WHERE list_has_all(
     {words("content || ' . ' || metadata || ' . ' || source || ' . ' || coalesce(agent, '')")}, ['er', 'tion'])) AS thoughts)
SELECT *, 'Found ' || conversations || ' conversation matches' || CASE WHEN thoughts > 0
  THEN ', ' || files || ' file matches, and ' || thoughts || ' thought matches'
  ELSE ' and ' || files || ' file matches' END AS summary FROM sizes"""
SQL["unified_fallback"] = f"""{with_(NOTES, ranked('notes', ['content', 'metadata', 'source', 'agent'], [['tion'], ['er']]))}
SELECT id, source, round(ranked.score, 3) AS score FROM ranked ORDER BY ranked.score, id LIMIT 20"""
SQL["unified_semantic"] = f"""{with_(VECTORS, CORPUS, CORPUS_SESSIONS)},
parts AS (SELECT id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM vectors),
asked AS (SELECT pos, avg(x) AS m FROM parts WHERE id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 3) GROUP BY pos),
near AS (
  SELECT p.id, sum(p.x * a.m) / (sqrt(sum(p.x * p.x)) * sqrt(sum(a.m * a.m)) + 1e-10) AS score
  FROM parts p JOIN asked a USING (pos) GROUP BY p.id),
best AS (
  SELECT c.id, c.session_id, s.agent_id, c.role, c.content, n.score
  FROM near n JOIN corpus c ON n.id = c.id JOIN corpus_sessions s ON c.session_id = s.id WHERE n.score >= 0.45),
once AS (SELECT *, row_number() OVER (PARTITION BY role || ':' || left(content, 200) ORDER BY score DESC, id) AS copy FROM best),
page AS (SELECT * FROM once WHERE copy = 1 ORDER BY once.score DESC, id LIMIT 20),
shown AS (SELECT *, row_number() OVER (PARTITION BY role || ':' || left(content, 500) ORDER BY score DESC, id) AS again FROM page)
SELECT agent_id AS agent, role, left(content, 500) AS content, session_id, id AS message_id, round(shown.score, 3) AS score
FROM shown WHERE again = 1"""
SQL["result_dedup"] = f"""{with_(CORPUS)}
SELECT min(id) AS id, role FROM corpus GROUP BY role, left(content, 500)"""
QUESTIONS = f"""
bodies AS (
  SELECT doc_id, list_concat(
           [array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:(doc_id % 4 + 1)], ' ')],
           list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' '))) AS all_bodies
  FROM documents),
asked AS (SELECT doc_id, unnest(all_bodies) AS body, CAST(unnest(range(len(all_bodies))) AS INTEGER) AS place FROM bodies),
questions AS (
  SELECT doc_id, place, {pick('doc_id', 'what is ', 'the plan for ', '"', 'how ', 'act_', 'did we settle on ', '', 'docs/', 'tell me: ', 'please discuss ')}
    || body
    || {pick('doc_id // 10', '?', '', '"', '.md', ' again', ' 1.2.3', ' 0123456789', ' now')} AS q
  FROM asked)"""
SQL["route_queries"] = f"""{with_(QUESTIONS)},
lowered AS (
  SELECT doc_id, place, q, trim(lower(q), ' ' || chr(10)) AS l,
         list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda x: x <> '') AS w FROM questions)
SELECT doc_id, place, CAST(NOT (
    (starts_with(q, '"') AND ends_with(q, '"')) OR contains(q, '/') OR ends_with(q, '.md') OR ends_with(q, '.py')
    OR regexp_matches(q, 'act_\\d{{1,20}}|\\d{{10,30}}|UC[a-zA-Z0-9_-]{{10,50}}|[a-f0-9]{{24,64}}|\\d+\\.\\d+\\.\\d+')
    OR (len(w) <= 2 AND NOT list_has_any(w, ['what', 'how', 'why', 'when', 'where', 'who', 'which'])))
  AND regexp_matches(l, '^(what|how|why|when|where|who|which)([^\\pL\\pN_]|$)|\\?$|(did we|have we|was there|were there)|(discuss|talk|mention|say about)')
  AS INTEGER) AS semantic FROM lowered"""

# --- browsing ----------------------------------------------------------------

LISTED = {
    "activity": "message_count > 2 AND length(agent_id) BETWEEN 2 AND 14 AND NOT regexp_matches(agent_id, '^[0-9a-fA-F]{5}')",
}
LISTED["transcript"] = LISTED["activity"] + (
    " AND lower(agent_id) NOT LIKE 'agent:%' AND agent_id NOT IN ('boot', 'acompact', 'compact')"
)
LISTED["web"] = LISTED["transcript"] + " AND lower(s.id) NOT LIKE 'boot-%'"
TOOLED = f"""
tooled AS (SELECT * REPLACE ({pick('id', 'user', 'assistant', 'tool_result')} AS role) FROM corpus)"""


def cut(column: str, chars: int) -> str:
    return f"CASE WHEN length({column}) > {chars} THEN left({column}, {chars}) || '...' ELSE {column} END"


SQL["recent_transcript"] = f"""{with_(MESSAGES, SESSIONS)}
SELECT m.session_id, s.agent_id, m.id, m.role, m.content, {shown('m.timestamp')} AS at, m.message_index
FROM messages m JOIN sessions s ON m.session_id = s.id
WHERE m.timestamp >= (SELECT max(timestamp) FROM messages) - INTERVAL 120 MINUTE AND {LISTED['web']}
ORDER BY m.timestamp, m.message_index, m.id LIMIT 500"""
SQL["recent_whole"] = f"""{with_(MESSAGES, SESSIONS)}
SELECT m.session_id, s.agent_id, m.id, m.role, m.content, {shown('m.timestamp')} AS at, m.message_index
FROM messages m JOIN sessions s ON m.session_id = s.id WHERE {LISTED['web']}"""
TRANSCRIPT = f"""{with_(CORPUS, CORPUS_SESSIONS, TOOLED)},
page AS (
  SELECT m.session_id, s.agent_id, s.message_count, m.id, m.role, m.content, m.timestamp
  FROM tooled m JOIN corpus_sessions s ON m.session_id = s.id
  WHERE m.timestamp >= (SELECT max(timestamp) FROM corpus) - INTERVAL 120 MINUTE AND {LISTED['transcript']}
  ORDER BY m.timestamp, m.message_index, m.id LIMIT 500)"""
SQL["recent_truncated"] = f"""{TRANSCRIPT}
SELECT session_id, id, role, CASE role WHEN 'tool_result' THEN {cut('content', 300)}
  WHEN 'assistant' THEN {cut('content', 2000)} ELSE content END AS content FROM page"""
SQL["recent_headers"] = f"""{TRANSCRIPT}
SELECT session_id, agent_id, count(*) AS shown,
  CASE WHEN count(*) < message_count THEN ' (' || count(*) || ' of ' || message_count || ' msgs)'
       ELSE ' (' || message_count || ' msgs)' END AS note,
  'session:' || left(session_id, 12) AS label, {shown('min(timestamp)')} AS first_at
FROM page GROUP BY session_id, agent_id, message_count"""
ENDS = """
firsts AS (SELECT session_id, arg_min(content, message_index) AS msg FROM messages WHERE role = 'user' GROUP BY 1),
lasts AS (SELECT session_id, arg_max(content, message_index) AS msg FROM messages WHERE role = 'assistant' GROUP BY 1)"""
SQL["activity"] = f"""{with_(MESSAGES, SESSIONS, ENDS)}
SELECT s.id AS session_id, s.agent_id, {shown('s.started_at')} AS started, {shown('s.ended_at')} AS ended, s.message_count,
       left(coalesce(f.msg, ''), 500) AS first_user_message, left(coalesce(l.msg, ''), 500) AS last_assistant_message
FROM sessions s LEFT JOIN firsts f ON f.session_id = s.id LEFT JOIN lasts l ON l.session_id = s.id
WHERE {LISTED['web']} AND coalesce(s.ended_at, s.started_at) >= (SELECT max(timestamp) FROM messages) - INTERVAL 14 DAY
ORDER BY coalesce(s.ended_at, s.started_at) DESC, s.id LIMIT 30"""
SQL["activity_tool"] = f"""{with_(MESSAGES, SESSIONS, ENDS)}
SELECT s.id AS session_id, s.agent_id, {shown('s.started_at')} AS started, s.message_count,
       left(coalesce(f.msg, ''), 150) AS first_user_message
FROM sessions s LEFT JOIN firsts f ON f.session_id = s.id
WHERE {LISTED['activity']} AND lower(s.agent_id) = 'agent1'
  AND s.started_at >= (SELECT max(timestamp) FROM messages) - INTERVAL 14 DAY
ORDER BY s.started_at DESC, s.id LIMIT 10"""
SQL["agents_counts"] = f"""{with_(SESSIONS)}
SELECT agent_id, count(*) AS sessions FROM sessions s
WHERE {LISTED['web']} AND coalesce(ended_at, started_at) >= (SELECT max(ended_at) FROM sessions) - INTERVAL 14 DAY
GROUP BY agent_id"""
SQL["valid_agents"] = f"""{with_(SESSIONS)}
SELECT id AS session_id, CAST({LISTED['web']} AS INTEGER) AS web, CAST({LISTED['transcript']} AS INTEGER) AS transcript,
       CAST({LISTED['activity']} AS INTEGER) AS activity FROM sessions s"""
SQL["context_window"] = f"""{with_(MESSAGES)},
asked AS (
  SELECT session_id, id AS message_id, message_index AS target FROM messages
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY length(content) DESC, id) = 1),
bounds AS (SELECT session_id, min(message_index) AS lo, max(message_index) AS hi FROM messages GROUP BY 1)
SELECT a.session_id, a.message_id, m.id, m.role, left(m.content, 1000) AS content, m.message_index,
       CAST(m.message_index = a.target AS INTEGER) AS is_match,
       CAST(min(m.message_index) OVER (PARTITION BY a.session_id) > b.lo AS INTEGER) AS has_more_before,
       CAST(max(m.message_index) OVER (PARTITION BY a.session_id) < b.hi AS INTEGER) AS has_more_after
FROM asked a JOIN messages m ON m.session_id = a.session_id AND m.message_index BETWEEN a.target - 2 AND a.target + 2
JOIN bounds b ON b.session_id = a.session_id"""
BOUNDS = "bounds AS (SELECT session_id, min(message_index) AS lo, max(message_index) AS hi FROM messages GROUP BY 1)"
SQL["session_window"] = f"""{with_(MESSAGES, BOUNDS)}
SELECT m.session_id, m.id, m.role, m.content, m.message_index, CAST(2 > lo AS INTEGER) AS has_more_before,
       CAST(6 < hi AS INTEGER) AS has_more_after
FROM messages m JOIN bounds b ON m.session_id = b.session_id WHERE m.message_index BETWEEN 2 AND 6"""
SQL["session_head"] = f"""{with_(MESSAGES, BOUNDS)},
page AS (SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index) <= 3)
SELECT p.session_id, p.id, p.role, p.content, p.message_index, 0 AS has_more_before,
       CAST(max(p.message_index) OVER (PARTITION BY p.session_id) < hi AS INTEGER) AS has_more_after
FROM page p JOIN bounds b ON p.session_id = b.session_id"""
SQL["session_bounds"] = f"""{with_(MESSAGES)}
SELECT session_id, min(message_index) AS first_index, max(message_index) AS last_index FROM messages GROUP BY 1"""
SQL["db_stats"] = f"""{with_(MESSAGES, SESSIONS)}
SELECT (SELECT count(*) FROM messages) AS messages, (SELECT count(*) FROM sessions) AS sessions,
       (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM documents) AS thoughts,
       (SELECT count(*) FROM embeddings) AS thought_embeddings,
       (SELECT count(DISTINCT agent_id) FROM sessions) AS agents,
       (SELECT {shown('max(started_at)')} FROM sessions) AS last_indexed"""
SQL["agent_names"] = f"{with_(SESSIONS)} SELECT DISTINCT agent_id FROM sessions"
SQL["thought_stats"] = """
SELECT 'source' AS grouping, source AS name, count(*) AS notes FROM documents GROUP BY source
UNION ALL
SELECT 'agent', CASE WHEN lang = 'de' THEN 'none' ELSE lang END, count(*) FROM documents GROUP BY 2"""
SQL["list_thoughts_page"] = f"""{with_(NOTES)}
SELECT id, content, source, agent, metadata, {shown('created_at')} AS created FROM notes
ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40"""
SQL["author_activity"] = f"""
SELECT 'u' || user_id AS author, count(*) AS messages, {shown("min(date_trunc('second', ts))")} AS joined
FROM events WHERE event_type <> 'error' GROUP BY user_id
HAVING count(*) >= 5 AND min(date_trunc('second', ts)) <= (SELECT max(date_trunc('second', ts)) FROM events) - INTERVAL 7 DAY"""

# --- session files -----------------------------------------------------------


def uuid_of(key: str) -> str:
    digest = f"md5(CAST({key} AS VARCHAR))"
    pieces = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "(" + " || '-' || ".join(f"substr({digest}, {s}, {n})" for s, n in pieces) + ")"


FILE_OF = (
    "('/srv/agents/main/sessions/' || CASE WHEN conv_id % 11 = 10 THEN 'boot-' ELSE '' END || "
    + uuid_of("conv_id") + " || '.jsonl')"
)
SIZED = f"""
sized AS (
  SELECT conv_id, {uuid_of('conv_id')} AS uuid, {FILE_OF} AS file, CAST(sum(length(text)) AS BIGINT) AS size, count(*) AS turns
  FROM conversations GROUP BY conv_id)"""
LOG = """
logged AS (
  SELECT CASE WHEN conv_id % 7 = 3 THEN '/gone/' || conv_id || '.jsonl' ELSE file END AS source_file,
         CASE conv_id % 5 WHEN 1 THEN size - 100 WHEN 2 THEN size + 100 ELSE size END AS old, turns, conv_id
  FROM sized WHERE turns > 3)"""
SQL["index_freshness"] = f"""{with_(SIZED, LOG)},
counts AS (SELECT
  (SELECT count(*) FROM sized WHERE conv_id >= (SELECT max(conv_id) FROM sized) - 120) AS changed_files,
  (SELECT count(*) FROM logged WHERE conv_id * 60 + 30 >= (SELECT max(conv_id) FROM sized) * 60 - 7200) AS indexed_files)
SELECT *, CAST(changed_files > 0 AND indexed_files = 0 AS INTEGER) AS stale FROM counts"""
SQL["ingest_status"] = f"""{with_(SIZED, LOG)},
stored AS (
  SELECT uuid, CASE WHEN conv_id % 8 = 2 THEN '/archive/' || uuid || '.jsonl' ELSE file END AS other
  FROM sized WHERE turns > 3),
judged AS (
  SELECT f.file AS path, l.turns, CASE WHEN l.conv_id % 10 = 6 THEN 0 ELSE l.old - 10 END AS off,
    CASE WHEN f.conv_id % 11 = 10 THEN 'excluded'
         WHEN s.other <> f.file THEN 'session already indexed from ' || s.other
         WHEN l.old = f.size THEN 'already indexed' END AS reason,
    CASE WHEN f.size > l.old AND CASE WHEN l.conv_id % 10 = 6 THEN 0 ELSE l.old - 10 END > 0 THEN 'append'
         WHEN l.old IS NOT NULL THEN 'reload' ELSE 'load' END AS act
  FROM sized f LEFT JOIN stored s ON s.uuid = f.uuid LEFT JOIN logged l ON l.source_file = f.file)
SELECT path, CASE WHEN reason IS NULL THEN act ELSE 'skip' END AS action, reason,
       CASE WHEN reason IS NULL AND act = 'append' THEN off ELSE 0 END AS start_offset,
       CASE WHEN reason IS NULL AND act = 'append' THEN turns ELSE 0 END AS start_index FROM judged"""
SQL["watch_state"] = f"""{with_(SIZED, LOG)}
SELECT CASE WHEN f.file IS NULL THEN 'deleted' WHEN l.source_file IS NULL THEN 'new'
            WHEN l.old <> f.size THEN 'changed' ELSE 'same' END AS state, count(*) AS files
FROM sized f FULL JOIN logged l ON l.source_file = f.file GROUP BY 1"""
FORMS = [
    "'/srv/agents/main/sessions/' || u || '.jsonl'",
    "'/srv/agents/orla/sessions/boot-' || k || '.jsonl'",
    "'/srv/agents-archive-cc/agent-main-cron-' || u || '-20260220.jsonl'",
    "'/srv/agents-archive-claude/agent-orla-discord-ch-' || k || '-x.jsonl'",
    "'/srv/agents-archive-vps/' || u || '.jsonl.bak-1'",
    "'/srv/agents-archive/rook/agent-main-telegram-' || k || '-y.jsonl'",
    "'/srv/agents-grok-sessions/' || k || '.jsonl'",
    "'/srv/agents-chat-sessions/' || k || '.jsonl'",
    "'/home/me/.claude/projects/-p/' || u || '.jsonl'",
    "'/home/you/.claude/projects/-p/subagents/' || u || '.jsonl'",
    "'/data/' || u || '.jsonl'",
    "'/data/orla-' || k || '.jsonl'",
    "'/data/main/abcdef' || k || '-z.jsonl'",
    "'/data/agent-abcdef-slack-' || k || '-q.jsonl.deleted.2026'",
]
PATHS = (
    f"keyed AS (SELECT DISTINCT conv_id AS k, {uuid_of('conv_id')} AS u FROM conversations), "
    f"paths AS (SELECT k, u, k % {len(FORMS)} AS form, CASE k % {len(FORMS)} "
    + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(FORMS))
    + " END AS path FROM keyed)"
)


def by_form(*values: str) -> str:
    return "CASE form " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# Expected agent, channel and channel id of each form, worked out by hand.
SQL["path_metadata"] = f"""{with_(PATHS)}
SELECT path, {by_form("'Mara'", "'Orla'", "'claude-code'", "'Orla'", "'Mara'", "'rook'", "'grok'", "'chat'",
  "'cc-vps'", "'claude-code'", "'claude-code'", "'Orla'", "'Mara'", "'unknown'")} AS agent_id,
  {by_form("'direct'", "'direct'", "'cron'", "'discord'", "'direct'", "'telegram'", "'direct'", "'direct'",
  "'terminal'", "'terminal'", "'terminal'", "'unknown'", "'unknown'", "'slack'")} AS channel,
  {by_form(*["NULL"] * 3, "'ch-' || k || '-x'", "NULL", "CAST(k AS VARCHAR)", *["NULL"] * 7, "CAST(k AS VARCHAR)")} AS channel_id
FROM paths"""
SQL["session_uuid"] = f"""{with_(PATHS)}
SELECT path, CASE WHEN form IN (0, 2, 4, 8, 9, 10) THEN u END AS uuid FROM paths"""
SQL["path_suffix"] = f"""{with_(PATHS)}
SELECT path, CASE WHEN form IN (8, 9) THEN substr(path, instr(path, '.claude/projects')) ELSE split_part(path, '/', -1) END AS suffix FROM paths"""
SQL["excluded_files"] = f"""{with_(PATHS)}
SELECT path, CAST(form NOT IN (1, 4, 9, 13) AS INTEGER) AS taken FROM paths"""
INGESTED = f"""
lines AS (SELECT *, (conv_id + turn) % 9 AS shape, {EPOCH} + to_hours(conv_id) + to_minutes(turn) AS t FROM conversations),
kept AS (
  SELECT '/srv/agents/main/sessions/s' || conv_id || '.jsonl' AS path, turn,
    CASE WHEN shape = 1 THEN 'user' ELSE role END AS role,
    CASE shape WHEN 2 THEN text || '  end' WHEN 3 THEN '[2024-05-06 07:08 GMT] ' || text
               WHEN 8 THEN text || ' password=[REDACTED]' ELSE text END AS content,
    CASE WHEN shape < 3 THEN t WHEN shape = 3 THEN TIMESTAMP '2024-05-06 07:08:00' END AS t
  FROM lines WHERE shape IN (0, 1, 2, 3, 8)),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY turn) - 1 AS INTEGER) AS message_index FROM kept)""".replace(
    "text || '  end'", "text || ' end'"
)
SQL["ingest_messages"] = f"""{with_(INGESTED)}
SELECT path, message_index, role, content, {shown('t')} AS at FROM numbered"""
SQL["ingest_sessions"] = f"""{with_(INGESTED)}
SELECT path, count(*) AS message_count, {shown('arg_min(t, turn) FILTER (t IS NOT NULL)')} AS started,
       {shown('arg_max(t, turn) FILTER (t IS NOT NULL)')} AS ended FROM numbered GROUP BY path"""
SQL["raw_lines"] = f"""{with_(INGESTED)}
SELECT '/srv/agents/main/sessions/s' || conv_id || '.jsonl' AS path, turn * 100000 AS "offset",
       CASE shape WHEN 0 THEN 'message' WHEN 1 THEN 'user' WHEN 2 THEN 'assistant' WHEN 4 THEN 'message' WHEN 5 THEN 'message'
         WHEN 7 THEN 'summary' END AS type FROM lines WHERE shape <> 6"""
SQL["append_guard"] = f"""{with_(MESSAGES)}
SELECT id, session_id, message_index FROM messages m
WHERE NOT EXISTS (SELECT 1 FROM messages s WHERE s.session_id = m.session_id AND s.message_index = m.message_index AND s.message_index % 3 <> 0)"""
SQL["replaced_sessions"] = f"""{with_(MESSAGES, SESSIONS)}
SELECT id, agent_id, message_count + CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS message_count FROM sessions"""
SQL["deleted_notes"] = f"""{with_(NOTES)}
SELECT id, 'note' AS kind FROM notes WHERE id % 4 <> 1 UNION ALL SELECT id, 'vector' FROM notes WHERE id % 4 <> 1
UNION ALL SELECT id, 'deleted' FROM notes WHERE id % 4 = 1"""
SQL["time_in_text"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 3 <> 0 AND doc_id % 40 BETWEEN 1 AND 28
  THEN '2026-02-' || lpad(CAST(doc_id % 40 AS VARCHAR), 2, '0') || ' 10:25:00' END AS at FROM documents"""

# --- cleaning ----------------------------------------------------------------

REPEATED = """
slots AS (
  SELECT session_id, role, message_index, count(*) AS n, min(id) AS keep, arg_min(length(content), id) AS chars
  FROM corpus GROUP BY ALL HAVING count(*) > 1),
per_session AS (
  SELECT session_id, count(*) AS repeated_messages, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
         CAST(sum(chars * (n - 1)) AS BIGINT) AS bytes_saved FROM slots GROUP BY session_id)"""
SQL["dup_exact"] = f"""{with_(CORPUS, CORPUS_SESSIONS, REPEATED)},
samples AS (SELECT session_id, content, role FROM corpus QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_index, id) = 1)
SELECT p.session_id, coalesce(s.agent_id, 'unknown') AS agent, coalesce(s.channel, 'unknown') AS channel,
       {shown('s.started_at')} AS started_at, coalesce(s.message_count, 0) AS expected_messages,
       coalesce(s.message_count, 0) + p.duplicate_rows AS actual_messages, p.repeated_messages, p.duplicate_rows,
       left(x.content, 100) AS sample_preview, x.role AS sample_role, p.bytes_saved
FROM (SELECT * FROM per_session ORDER BY duplicate_rows DESC, session_id LIMIT 200) p
LEFT JOIN corpus_sessions s ON s.id = p.session_id LEFT JOIN samples x ON x.session_id = p.session_id"""
SQL["dup_exact_all"] = SQL["dup_exact"].replace(" LIMIT 200", "")
SQL["dup_exact_summary"] = f"""{with_(CORPUS, REPEATED)}
SELECT CAST(coalesce(sum(repeated_messages), 0) AS BIGINT) AS total_groups, CAST(coalesce(sum(duplicate_rows), 0) AS BIGINT) AS total_removable,
       round(coalesce(sum(bytes_saved), 0) / 1048576, 2) AS estimated_savings_mb, count(*) AS affected_sessions FROM per_session"""
SQL["dup_exact_ids"] = f"""{with_(CORPUS)}
SELECT session_id, id FROM corpus QUALIFY row_number() OVER (PARTITION BY session_id, role, message_index ORDER BY id) > 1"""

TIER_TEXT = {
    "exact": "content",
    "high": "lower(substr(trim(content), 1, 500))",
    "medium": "lower(substr(trim(content), 1, 200))",
}
TIER_SCORE = {"exact": 1.0, "high": 0.95, "medium": 0.85}


def similar(tier: str, source: str = "corpus", name: str = "alike") -> str:
    return f"""
    {name} AS (
      SELECT {TIER_TEXT[tier]} AS fp, count(*) AS copies, count(DISTINCT session_id) AS sessions, min(id) AS keep_id,
             CAST(sum(length(content)) AS BIGINT) AS chars
      FROM {source} WHERE length(content) > 20 GROUP BY 1 HAVING count(DISTINCT session_id) >= 2)"""


def similar_report(tier: str) -> str:
    fingerprint = "CAST(NULL AS VARCHAR)" if tier == "exact" else "left(a.fp, 200)"
    return f"""{with_(CORPUS, similar(tier))}
SELECT left(c.content, 200) AS content_preview, c.role, a.copies, a.sessions, a.keep_id, {fingerprint} AS fingerprint,
       a.chars - a.chars // a.copies AS bytes_saved, {TIER_SCORE[tier]}::DOUBLE AS score
FROM (SELECT * FROM alike ORDER BY copies DESC, keep_id LIMIT 200) a JOIN corpus c ON c.id = a.keep_id"""


def similar_totals(tier: str, source: str = "alike") -> str:
    return f"""SELECT '{tier}' AS tier, count(*) AS total_groups, CAST(coalesce(sum(copies - 1), 0) AS BIGINT) AS total_removable,
       round(coalesce(sum(chars / copies * (copies - 1)), 0) / 1048576, 2) AS estimated_savings_mb FROM {source}"""


def similar_removals(tier: str) -> str:
    return f"""{with_(CORPUS, similar(tier))}
SELECT c.id FROM corpus c JOIN alike a ON {TIER_TEXT[tier].replace('content', 'c.content')} = a.fp
WHERE length(c.content) > 20 AND c.id <> a.keep_id"""


SQL["dup_cross_exact"] = similar_report("exact")
SQL["dup_high"] = similar_report("high")
SQL["dup_medium"] = similar_report("medium")
SQL["dup_cross_exact_all"] = similar_report("exact").replace(" LIMIT 200", "")
SQL["dup_medium_all"] = similar_report("medium").replace(" LIMIT 200", "")
SQL["dup_summary"] = (
    with_(CORPUS, *[similar(t, name=f"alike_{t}") for t in TIER_TEXT])
    + " UNION ALL ".join(similar_totals(t, f"alike_{t}") for t in TIER_TEXT)
)
SQL["dup_delete_ids"] = similar_removals("medium")
SQL["dup_delete_ids_exact"] = similar_removals("exact")
SQL["dup_group_members"] = f"""{with_(CORPUS, CORPUS_SESSIONS, similar('exact'))}
SELECT c.id, a.keep_id, c.session_id, c.role, left(c.content, 500) AS content_preview, s.agent_id, s.channel
FROM corpus c JOIN alike a ON c.content = a.fp LEFT JOIN corpus_sessions s ON s.id = c.session_id"""

EMOJI = r"content IS NOT NULL AND length(trim(content)) BETWEEN 1 AND 10 AND regexp_full_match(trim(content), '([^\x00-\x7E]|[+<=>|~^`])+')"
BLANK = "content IS NULL OR trim(content) = ''"
ORPHAN = "session_id NOT IN (SELECT id FROM corpus_sessions)"
JUNK = f"""
junk AS (
  SELECT *, 'empty' AS category FROM stained WHERE {BLANK}
  UNION ALL SELECT *, 'orphaned' FROM stained WHERE {ORPHAN}
  UNION ALL SELECT *, 'single_char' FROM stained WHERE length(content) BETWEEN 1 AND 10 AND {EMOJI})"""
CLEANING = with_(CORPUS, CORPUS_SESSIONS, STAINED, JUNK)
SQL["junk_empty"] = f"{with_(CORPUS, STAINED)} SELECT id, content FROM stained WHERE {BLANK}"
SQL["junk_orphans"] = f"""{CLEANING}
SELECT id, role, session_id, left(coalesce(content, ''), 200) AS content FROM junk WHERE category = 'orphaned'"""
SQL["junk_emoji"] = f"{with_(CORPUS, STAINED)} SELECT id, content FROM stained WHERE {EMOJI}"
SQL["junk_all"] = f"{CLEANING} SELECT id, category FROM junk"
SQL["junk_counts"] = f"{CLEANING} SELECT category, count(*) AS messages FROM junk GROUP BY category"
SQL["junk_page"] = f"""{CLEANING}
SELECT id, role, session_id, left(coalesce(content, ''), 200) AS content, category FROM junk ORDER BY category, id LIMIT 500"""

NOISE_CASE = """CASE
  WHEN regexp_matches(content, '^HEARTBEAT_OK\\n?$') THEN 'Heartbeat ping'
  WHEN regexp_matches(content, '^NO_REPLY\\n?$') THEN 'No-reply marker'
  WHEN starts_with(content, 'Read HEARTBEAT.md') THEN 'Heartbeat instruction'
  WHEN starts_with(content, 'You are running a boot check') THEN 'Boot check prompt'
  WHEN regexp_matches(content, '(?i)gateway restart(ed|ing)\\b[^\\n]*(back online|reconnect)') THEN 'Gateway restart status'
  WHEN starts_with(content, 'Gateway is back up') THEN 'Gateway back online'
  WHEN starts_with(content, 'Gateway restarted — back online') THEN 'Gateway restart notice'
  WHEN contains(content, 'OpenClaw Health Check Report') THEN 'Health check webhook'
  WHEN starts_with(content, 'SECURITY NOTICE: The following content is from an EXTERNAL') THEN 'External content wrapper'
  WHEN starts_with(content, 'If BOOT.md asks you to send a message') THEN 'Boot instruction footer'
  WHEN starts_with(content, 'If nothing needs attention') AND contains(content, 'reply with ONLY: NO_REPLY') THEN 'Boot no-reply instruction'
END"""
NOISE_LIKE = """(content ILIKE 'HEARTBEAT_OK' OR content ILIKE 'NO_REPLY' OR content ILIKE 'Read HEARTBEAT%'
  OR content ILIKE 'You are running a boot check%' OR content ILIKE 'Gateway restart%' OR content ILIKE 'Gateway is back%'
  OR content ILIKE '%OpenClaw Health Check Report%' OR content ILIKE 'SECURITY NOTICE: The following content%'
  OR content ILIKE 'If BOOT.md asks%' OR content ILIKE 'If nothing needs attention%')"""
NOISE = f"noise AS (SELECT *, {NOISE_CASE} AS reason FROM stained WHERE {NOISE_LIKE} AND {NOISE_CASE} IS NOT NULL)"
NOISY = with_(CORPUS, STAINED, NOISE)
SQL["noise_reasons"] = f"{NOISY} SELECT reason, count(*) AS messages FROM noise GROUP BY reason"
SQL["noise_ids"] = f"{NOISY} SELECT id FROM noise"
SQL["noise_page"] = f"{NOISY} SELECT id, role, session_id, left(content, 300) AS content, reason FROM noise ORDER BY id LIMIT 500"
SQL["noise_all"] = SQL["noise_page"].replace(" LIMIT 500", "")
SQL["noise_at_ingest"] = f"""{with_(CORPUS, STAINED)}
SELECT id, {NOISE_CASE} AS reason FROM stained WHERE {NOISE_CASE} IS NOT NULL"""
SQL["emb_orphans"] = f"""{with_(MESSAGES)}
SELECT vec_id AS embedding_id, vec_id AS message_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM messages)"""
SQL["emb_orphans_summary"] = f"""{with_(MESSAGES)}
SELECT count(*) AS total, count(*) * 6194 AS freed_bytes, round(count(*) * 6194 / 1048576, 2) AS estimated_savings_mb
FROM embeddings WHERE vec_id NOT IN (SELECT id FROM messages)"""
SQL["emb_kept"] = f"""{with_(MESSAGES)}
SELECT vec_id AS id, vec_id AS message_id FROM embeddings WHERE vec_id IN (SELECT id FROM messages)"""
SQL["dry_run_summary"] = f"""{CLEANING}, {NOISE}, {similar('exact', 'stained')},
{REPEATED.replace('FROM corpus', 'FROM stained').replace('arg_min(length(content), id)', 'arg_min_null(coalesce(length(content), 0), id)')},
found AS (SELECT
  (SELECT count(*) FROM stained) AS total_messages, (SELECT count(*) FROM corpus_sessions) AS total_sessions,
  (SELECT CAST(sum(duplicate_rows) AS BIGINT) FROM per_session) AS duplicates_found, (SELECT count(*) FROM junk) AS junk_found,
  (SELECT count(*) FROM noise) AS noise_found,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM stained)) AS orphaned_embeddings_found,
  (SELECT CAST(sum(copies - 1) AS BIGINT) FROM alike) AS similar_found,
  (SELECT round(sum(bytes_saved) / 1048576, 2) FROM per_session) AS a,
  (SELECT round(sum(chars / copies * (copies - 1)) / 1048576, 2) FROM alike) AS b)
SELECT total_messages, total_sessions, duplicates_found, junk_found, noise_found, orphaned_embeddings_found, similar_found,
       round(a + b + round(orphaned_embeddings_found * 6194 / 1048576, 2), 2) AS estimated_savings_mb FROM found"""
GONE = "gone AS (SELECT * FROM stained WHERE id IN (SELECT id FROM junk)), kept AS (SELECT * FROM stained WHERE id NOT IN (SELECT id FROM junk))"
SQL["delete_effects"] = f"""{CLEANING}, {GONE}
SELECT count(*) AS deleted, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS freed_bytes,
       count(DISTINCT session_id) AS sessions_updated FROM gone"""
SQL["delete_recount"] = f"""{CLEANING}, {GONE}
SELECT s.id, CASE WHEN s.id IN (SELECT session_id FROM gone) THEN (SELECT count(*) FROM kept k WHERE k.session_id = s.id)
                  ELSE s.message_count END AS message_count FROM corpus_sessions s"""
SQL["delete_kept"] = f"{CLEANING}, {GONE} SELECT id, session_id FROM kept"
SQL["delete_kept_vectors"] = f"""{CLEANING}
SELECT vec_id AS id, vec_id AS message_id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM junk)"""
SQL["purge_excluded"] = f"""{with_(MESSAGES, SESSIONS)},
doomed AS (SELECT * FROM sessions WHERE CAST(id AS BIGINT) % 4 = 0)
SELECT count(*) AS sessions, CAST(sum(message_count) AS BIGINT) AS listed_messages,
  (SELECT count(*) FROM messages WHERE session_id IN (SELECT id FROM doomed)) AS deleted_messages,
  (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT id FROM messages WHERE session_id IN (SELECT id FROM doomed))) AS deleted_embeddings
FROM doomed"""
SQL["purge_excluded_kept"] = f"{with_(MESSAGES)} SELECT id FROM messages WHERE CAST(session_id AS BIGINT) % 4 <> 0"
SQL["purge_excluded_log"] = f"{with_(SIZED, LOG)} SELECT source_file FROM logged"
SQL["cleanup_history"] = f"""
SELECT {shown("date_trunc('second', ts)")} AS ran, event_type AS mode, user_id AS deleted, event_id AS freed_bytes
FROM events ORDER BY date_trunc('second', ts) DESC, event_type LIMIT 20"""

# --- secrets -----------------------------------------------------------------


def secret_texts(value: str, digest: str = "h") -> str:
    """Documents with credentials, either planted or as they look once redacted."""
    return f"""
    planted AS (
      SELECT doc_id AS id, CASE doc_id % 11
        WHEN 0 THEN text || ' password=' || {value} || ' end'
        WHEN 1 THEN 'api_key: ''' || {value} || ''' ' || text
        WHEN 2 THEN text || {digest}2 || text
        WHEN 3 THEN text || ' Authorization: Bearer ' || {digest}3 || text
        WHEN 4 THEN 'x ' || {digest}4 || ' ' || text
        WHEN 5 THEN text || {digest}5
        WHEN 6 THEN text || ' postgres://user:' || {value} || '@db '
        WHEN 7 THEN text || ' COOKIE_SECRET=' || {value} || chr(10) || 'PWD: ' || {value}
        ELSE text END AS content
      FROM (SELECT *, md5(CAST(doc_id AS VARCHAR)) AS h,
                   ' AKIA' || upper(left(md5(CAST(doc_id AS VARCHAR)), 16)) || ' ' AS h2,
                   md5(CAST(doc_id AS VARCHAR)) || '. ' AS h3, 'sk-' || md5(CAST(doc_id AS VARCHAR)) AS h4,
                   ' xoxb-' || md5(CAST(doc_id AS VARCHAR)) || ' ghp_' || md5(CAST(doc_id AS VARCHAR)) AS h5,
                   '[REDACTED]' AS r, ' [REDACTED] ' AS r2, '[REDACTED] ' AS r3, '[REDACTED]' AS r4,
                   ' [REDACTED] [REDACTED]' AS r5 FROM documents))"""


PLANTED, REDACTED = secret_texts("h"), secret_texts("r", "r")
SQL["redact"] = f"{with_(REDACTED)} SELECT id, md5(content) AS digest FROM planted"
SQL["redact_custom"] = f"""{with_(REDACTED)}
SELECT id, md5(regexp_replace(content, 'token = "[0-9a-f]{{40}}"', '[REDACTED]', 'g')) AS digest FROM planted"""
SQL["redact_changed"] = "SELECT doc_id AS id FROM documents WHERE doc_id % 11 < 8"
SQL["redact_counts"] = (
    f"{with_(PLANTED)}, changed AS (SELECT * FROM planted WHERE id % 11 < 8), found AS ("
    + " UNION ALL ".join(
        f"SELECT {quoted(name)} AS family, CAST(sum(len(regexp_extract_all(content, {quoted('(?i)' + p)}))) AS BIGINT) AS found FROM changed"
        for name, p in SECRET_FAMILIES.items()
    )
    + ") SELECT * FROM found WHERE found > 0"
)
SQL["redact_report"] = "SELECT count(*) AS scanned, count(*) FILTER (doc_id % 11 < 8) AS redacted FROM documents"

# --- text --------------------------------------------------------------------


def html_text(column: str) -> str:
    steps = [
        ("(?is)<style[^>]*>.*?</style>", ""),
        ("(?is)<script[^>]*>.*?</script>", ""),
        ("(?i)<(br|p|div|tr|li|h[1-6])[^>]*/?>", "\n"),
        ("<[^>]+>", ""),
        ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;?", "&"),
        ("[ \\t]+", " "),
        ("\\n{3,}", "\n\n"),
    ]
    for pattern, value in steps:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(value)}, 'g')"
    return f"trim({column}, ' ' || chr(9) || chr(10) || chr(13))"


SQL["html_text"] = f"SELECT page_id, {html_text('html')} AS text FROM pages"
SQL["tag_strip"] = f"""
SELECT doc_id AS id, md5(trim(CASE WHEN doc_id % 4 = 3 THEN '<other a=1>x' || chr(10) || 'y</other> ' || text || ' ' ELSE text END,
  ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM documents"""
SQL["deep_links"] = """
SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 = 2 AND
    length(text) + length('[Discord guild channel id:7' || doc_id || '] hi [message_id: ' || doc_id || ']') <= 500)
  THEN 'https://discord.com/channels/@me/7' || doc_id || '/' || doc_id END AS link FROM documents"""
SQL["truncations"] = f"""{with_(CORPUS, TOOLED)}
SELECT id, md5(CASE role WHEN 'tool_result' THEN {cut('content', 500)} ELSE content END) AS web,
  md5(CASE role WHEN 'tool_result' THEN {cut('content', 300)} WHEN 'assistant' THEN {cut('content', 2000)} ELSE content END) AS tool,
  md5({cut('content', 150)}) AS snippet FROM tooled"""
SQL["agent_aliases"] = f"""{with_(SESSIONS)}
SELECT id, CASE lower(agent_id) WHEN 'agent0' THEN 'Ada' WHEN 'boot' THEN 'Starter' ELSE agent_id END AS agent FROM sessions"""

# --- capture -----------------------------------------------------------------

MAIL = f"""
mail AS (
  SELECT page_id AS id, CAST(page_id % 2 AS VARCHAR) AS account,
    {pick('page_id', 'alice@', 'News@', 'sales@', 'no-reply@', 'bob.x.com@', 'team@', 'orders@')}
      || regexp_extract(url, '://([^/?#:]+)', 1) AS sender,
    {pick('page_id', 'Your  Order ', 'Re: ', 'minutes ', 'Weekly report ', 'please verify your account ')}
      || coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') AS subject,
    {EPOCH} + to_hours(page_id) AS received_at, url AS snippet, html AS body
  FROM pages)"""
MAIL_NOISE = (
    "(" + " OR ".join(f"contains(lower(sender), {quoted(s)})" for s in MAIL_SENDER_BLOCKLIST)
    + " OR " + " OR ".join(f"regexp_matches(subject, {quoted('(?i)' + p)})" for p in MAIL_SUBJECT_PATTERNS) + ")"
)


def mail_outcome(body: str) -> str:
    return f"""
    decided AS (SELECT *, CASE WHEN contains(snippet, '://m.') THEN 'skipped' WHEN {MAIL_NOISE} THEN 'filtered' ELSE 'captured' END AS outcome FROM mail)
    SELECT CAST(id AS VARCHAR) AS source_id, account, outcome,
           CASE WHEN outcome = 'captured' THEN 'Email from ' || sender || ': ' || subject || chr(10) || {body} END AS content FROM decided"""


SQL["mail_noise"] = f"{with_(MAIL)} SELECT id, CAST({MAIL_NOISE} AS INTEGER) AS noise FROM mail"
MAIL_BODY = f"left({html_text('body')}, 8000)"
SQL["mail_capture"] = f"{with_(MAIL)}, {mail_outcome(MAIL_BODY)}"
SQL["mail_backfill"] = f"{with_(MAIL)}, {mail_outcome('snippet')} WHERE received_at >= TIMESTAMP '2024-01-04 00:00:00'"
SQL["mail_merge"] = f"""{with_(MAIL)}
SELECT id, account, CASE WHEN contains(snippet, '.org/') THEN subject ELSE 'sent: ' || subject END AS subject
FROM mail WHERE contains(snippet, '.org/') OR contains(snippet, '/en/')"""
KINDS = [
    ("text/plain", ".txt"), ("application/vnd.google-apps.document", ""), ("image/png", ".png"),
    ("application/vnd.google-apps.spreadsheet", ""), ("text/plain", ".min.js"),
    ("application/vnd.google-apps.presentation", ""), ("application/x-novel", ".bin"),
    ("text/markdown", ".PSD"), ("text/markdown", ".md"),
]
DRIVE = f"""
drive AS (
  SELECT doc_id AS id, lang AS account, source || '-' || doc_id || {pick('doc_id', *[e for _, e in KINDS])} AS name,
         {pick('doc_id', *[m for m, _ in KINDS])} AS mime, 'v' || (doc_id % 3) AS modified, n_chars AS size, text,
         {EPOCH} + to_minutes(doc_id) AS created_at FROM documents)"""
DOCUMENT_NOISE = (
    "(mime IN (" + ", ".join(quoted(m) for m in DOCUMENT_TYPE_BLOCKLIST) + ") OR "
    + " OR ".join(f"ends_with(lower(name), {quoted(e)})" for e in DOCUMENT_CODE_ENDINGS + DOCUMENT_DESIGN_ENDINGS) + ")"
)
DRIVE_DECIDED = f"""
decided AS (
  SELECT *, CASE WHEN {DOCUMENT_NOISE} THEN 'filtered'
    WHEN id IN (SELECT doc_id FROM labels) THEN CASE WHEN modified = 'v1' THEN 'skipped' ELSE 'updated' END
    ELSE 'captured' END AS outcome,
    CASE mime WHEN 'application/vnd.google-apps.spreadsheet' THEN '(Google Spreadsheet — ' || name || ')'
      WHEN 'application/vnd.google-apps.presentation' THEN '(Google Slides — ' || name || ')'
      WHEN 'application/x-novel' THEN '(application/x-novel, size: ' || size || ')' ELSE left(text, 8000) END AS body
  FROM drive)"""
SQL["drive_noise"] = f"{with_(DRIVE)} SELECT id, CAST({DOCUMENT_NOISE} AS INTEGER) AS noise FROM drive"
SQL["drive_capture"] = f"""{with_(DRIVE, DRIVE_DECIDED)}
SELECT CAST(id AS VARCHAR) AS source_id, account, outcome,
       CASE WHEN outcome IN ('captured', 'updated') THEN md5('Drive: ' || name || chr(10) || body) END AS content FROM decided"""
SQL["drive_backfill"] = f"""{with_(DRIVE, DRIVE_DECIDED)}
SELECT 'drive' AS source_type, outcome, count(*) AS items FROM decided
WHERE created_at > TIMESTAMP '2024-01-01 04:00:00' GROUP BY outcome"""
SQL["slack_capture"] = """
SELECT 'C' || (conv_id % 20) || ':' || (1704067200 + conv_id * 3600 + turn * 60) || '.000100' AS source_id, 'captured' AS outcome,
       'Slack [room-' || (conv_id % 20) || '] ' || upper(left(role, 1)) || substr(role, 2) || ': ' || left(text, 8000) AS content
FROM conversations WHERE role <> 'system' AND text <> ''"""
SQL["capture_status"] = f"""
SELECT event_type || ':' || (user_id % 2) AS source, count(*) AS captured, {shown('max(ts)')} AS latest FROM events GROUP BY 1"""
SQL["capture_upsert"] = f"""
SELECT event_type AS source_type, CAST(user_id AS VARCHAR) AS source_id, CAST(user_id % 2 AS VARCHAR) AS account,
       event_id AS thought_id, json_extract_string(props, '$.k') AS source_modified, {shown('ts')} AS captured
FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1"""
SQL["not_captured"] = """
SELECT 'gmail' AS source_type, CAST(page_id AS VARCHAR) AS source_id, CAST(page_id % 2 AS VARCHAR) AS account
FROM pages WHERE NOT contains(url, '://m.')"""
NOTE_CHAINS = """
WITH RECURSIVE notes AS (
  SELECT event_type || ':' || user_id AS content, date_trunc('second', ts) AS t, min(event_id) AS id FROM events GROUP BY 1, 2),
chain AS (
  SELECT content, min(t) AS t FROM notes GROUP BY content
  UNION ALL
  SELECT c.content, (SELECT min(n.t) FROM notes n WHERE n.content = c.content AND n.t > c.t + INTERVAL 24 HOUR) AS t
  FROM chain c WHERE c.t IS NOT NULL),
kept AS (SELECT n.id, n.content, n.t FROM chain c JOIN notes n ON n.content = c.content AND n.t = c.t)"""
SQL["thought_dedup_24h"] = f"""{NOTE_CHAINS}
SELECT id, content, {shown('t')} AS created FROM kept"""
SQL["thought_repeats"] = f"""{NOTE_CHAINS}
SELECT e.event_id AS id, k.id AS stored_id, CAST(e.event_id <> k.id AS INTEGER) AS duplicate
FROM events e ASOF JOIN kept k ON e.event_type || ':' || e.user_id = k.content AND date_trunc('second', e.ts) >= k.t"""
SQL["thought_prepare"] = f"""{with_(REDACTED)}
SELECT id, md5(trim(content, ' ' || chr(9) || chr(10) || chr(13))) AS digest FROM planted"""
SQL["purge_mail_noise"] = f"""{with_(MAIL)},
told AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN sender ELSE split_part(sender || ': ' || subject, ': ', 1) END AS sender,
         CASE WHEN id % 2 = 0 THEN subject ELSE substr(sender || ': ' || split_part(subject, chr(10), 1), instr(sender || ': ' || subject, ': ') + 2) END AS subject
  FROM mail)
SELECT id, sender, subject, CAST({MAIL_NOISE} AS INTEGER) AS noise FROM told"""
DRIVE_TOLD = """
told AS (
  SELECT id + 1000000000 AS id, name, CASE WHEN (id + 1000000000) % 2 = 0 THEN mime ELSE '' END AS mime FROM (
    SELECT id, name, CASE WHEN id % 2 = 0 THEN mime ELSE '' END AS mime FROM drive))"""
SQL["purge_drive_noise"] = f"""{with_(DRIVE, DRIVE_TOLD)}
SELECT id, name, mime, CAST({DOCUMENT_NOISE} AS INTEGER) AS noise FROM told"""
SQL["purge_totals"] = f"""{with_(MAIL, DRIVE, DRIVE_TOLD)}
SELECT 'gmail' AS source, count(*) AS total, count(*) FILTER {MAIL_NOISE} AS noise, count(*) FILTER (NOT {MAIL_NOISE}) AS kept FROM mail
UNION ALL
SELECT 'drive', count(*), count(*) FILTER {DOCUMENT_NOISE}, count(*) FILTER (NOT {DOCUMENT_NOISE}) FROM told"""
