"""The registered queries and the pipeline on the smallest given tables."""

import collections
import hashlib
import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from palimpsest.llm import dart_minhash, mixing, packing, toxicity  # noqa: E402
from palimpsest.llm.common import table  # noqa: E402
from palimpsest.llm.queries import QUERIES, SQL, tokenizer_file  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    return dict(rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for view in ("documents", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    found = QUERIES[name](spark, FOLDER).toPandas()
    want = connection.execute(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    both = [collections.Counter(map(tuple, frame[columns].astype(str).itertuples(index=False))) for frame in (found, want)]
    assert both[0] == both[1]


def test_token_counts(spark, texts):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    for r in QUERIES["op2_token_counts"](spark, FOLDER).collect():
        n = len(processor.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_mix(spark, texts):
    rows = QUERIES["op4_mixing"](spark, FOLDER).collect()
    assert {r.doc_id: r.size for r in rows} == {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert all(r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * sum(r.size for r in rows)) < 40


def test_language_model_beats_the_base(spark, texts):
    rows = QUERIES["op5_hmm_scores"](spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 7 == 2}
    assert sum(r.score - r.base_score for r in held) > 0.1 * sum(r.n_tokens for r in held)


def test_packing(spark):
    rows = QUERIES["op7_packing"](spark, FOLDER).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(by) <= -(-sum(r.length for r in rows) // packing.CAPACITY) + 1
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]


def test_fingerprints(spark, texts):
    ids = sorted(texts)
    found = {r.doc_id: r for r in QUERIES["op8_merkle"](spark, FOLDER).collect()}
    nearer = 0
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (found[i].fingerprint == found[i].edited_fingerprint) == (edited == texts[i])
        nearer += found[i].near_edited > found[i].near_next
    assert nearer > 0.9 * len(ids)


def test_toxicity_held_out(spark):
    rows = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    held = rows.where("held_out").select("toxic", "predicted").collect()
    right = [r.predicted for r in held if r.toxic]
    wrong = [r.predicted for r in held if not r.toxic]
    assert sum(right) > 0.8 * len(right) and sum(wrong) < 0.01 * len(wrong)


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]

    clean = stages["toxicity"](spark, docs, FOLDER)
    scores = {r.doc_id: r["_score"] for r in toxicity.score(docs, toxicity.fit(docs, table(spark, FOLDER, "labels"))).collect()}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < corpus_pipeline.TOXIC}

    lines = stages["line_dedup"](spark, docs, FOLDER)
    kept = {r.doc_id: r.kept_sha256 for r in QUERIES["op3_line_dedup"](spark, FOLDER).collect()}
    assert lines.columns == docs.columns
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in lines.collect()} == kept
    assert lines.where(F.col("n_chars") != F.char_length("text")).count() == 0

    single = stages["near_dedup"](spark, docs, FOLDER)
    classes = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs).collect()}
    assert {r.doc_id for r in single.collect()} == set(classes.values())

    mixed = stages["mixing"](spark, docs, FOLDER)
    want = {r.doc_id: r["_taken"] for r in mixing.taken(*mixing.mix(docs)).collect()}
    got = collections.Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert mixed.columns == docs.columns and got == collections.Counter({i: n for i, n in want.items() if n})

    packed = stages["packing"](spark, docs.select("doc_id", "text"), FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_run(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.CAPACITY).count() == 0
