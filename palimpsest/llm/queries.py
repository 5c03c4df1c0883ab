"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import chat, dart_minhash, hard_negatives, hmm, line_dedup, merkle, mixing, packing, prefix_tokens, projection_forest, quality_rules, token_alignment, toxicity
from palimpsest.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def tokenizer_file(name: str) -> str:
    """The path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


SQL["op1_chat_format"] = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
logs AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS log, max(turn) AS ends
  FROM turns GROUP BY conv_id),
gone AS (
  SELECT DISTINCT a.conv_id FROM logs a JOIN logs b ON a.log[1] = b.log[1] AND a.conv_id <> b.conv_id
  WHERE a.log = list_filter(b.log, lambda x: x.turn <= a.ends) AND (b.ends > a.ends OR b.conv_id < a.conv_id))
SELECT conv_id, turn >> 6 AS part, count(*) AS n_turns,
       string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
                  ORDER BY turn, role, text) AS text
FROM turns WHERE conv_id NOT IN (SELECT conv_id FROM gone) GROUP BY conv_id, turn >> 6"""


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = prefix_tokens.prefix_table(docs, tokenizer_file("piece_bpe_32k.model"), budget=4096, keep_table=False)
    return counts.select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), F.col("fits").alias("n_chars_within")
    )


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


SQL["op3_line_dedup"] = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM cut),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(*mixing.mix(docs)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )


@query
def op5_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, counts, texts = hmm.train(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return hmm.score(model, counts, texts).withColumn("train_tokens", F.lit(model.tokens).cast("long"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, machine).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dart_minhash.near_duplicates(docs).select(
        "doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "n_shingles"
    )


@query
def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
    tree = {p: (F.col(f"{p}_root"), F.col(f"{p}_clauses")) for p in ("own", "edit", "next")}
    return rows.select(
        "doc_id",
        F.char_length("_text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        merkle.fingerprint("own").alias("fingerprint"),
        merkle.fingerprint("edit").alias("edited_fingerprint"),
        merkle.likeness(*tree["own"], *tree["edit"]).alias("near_edited"),
        merkle.likeness(*tree["own"], *tree["next"]).alias("near_next"),
    )


@query
def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_forest.near_duplicates(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


@query
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SQL["op11_quality_rules"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT row, pos, words[pos] AS a, words[pos + 1] AS b, words[pos + 2] AS c
  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS pos FROM texts)),
again AS (SELECT row, pos, count(*) OVER (PARTITION BY row, a, b, c) AS times FROM windows),
covered AS (
  SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest([pos, pos + 1, pos + 2]) AS place FROM again WHERE times > 1)
  GROUP BY row),
counted AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, length(array_to_string(words, '')) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(words, lambda w: trim(lower(w), '.,;:!?"''()[]') IN ({_sql_list(quality_rules.STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
         CAST(len(list_filter(words, lambda w: w = upper(w) AND w <> lower(w))) AS BIGINT) AS n_upper_words,
         coalesce(n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*+•‣]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS BIGINT) AS n_ellipsis_lines
  FROM texts LEFT JOIN covered USING (row)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {quality_rules.rules_sql()} AS kept
FROM based"""


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


SQL["op12_hard_negatives"] = r"""
WITH usable AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.ints, b.ints) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.row <> b.row AND len(a.ints) = len(b.ints) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT row, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE same QUALIFY place <= 5),
ranked AS (
  SELECT s.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY s.row, place ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM scored s JOIN positives p ON s.row = p.row
  WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = [tokenizer_file(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return token_alignment.with_counts(token_alignment.aligned(docs, *models)).drop("groups")
