"""What must hold at any size: balanced joins, full pages, parallel reads."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import skew, vector
from palimpsest.operators.search import _or_else
from palimpsest.sources import tail


def test_keys_without_a_partner_are_spread(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 4 > 0, F.lit("gone")).when(F.col("id") % 8 > 0, None).otherwise(F.lit("here")).alias("key"))
    sized = spark.createDataFrame([("here", 1), ("other", 2)], "key string, fact int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_on_sized_key(rows, sized, "key", None, "id", "left", slice_rows=500)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 20_000 and len(sizes) > 1 and max(sizes) < 12_000
        assert joined.where("fact = 1").count() == 2_500
        assert skew.join_on_sized_key(rows, sized, "key", None, "id", slice_rows=500).count() == 2_500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_vectors_of_another_size_have_no_similarity(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0]), (4, None), (5, [None, 1.0]), (6, [3.0, 4.0]), (7, [])]
    frame = spark.createDataFrame(rows, "id int, embedding array<float>").coalesce(1)
    found = {r.id: r.score for r in frame.select("id", vector.cosine_to([1.0, 0.0])("embedding").alias("score")).collect()}
    assert [i for i, s in found.items() if s is not None] == [1, 6]
    assert np.isclose(found[1], 1) and np.isclose(found[6], 0.6)
    each = frame.select("id", vector.cosine_to_each({"a": [1.0, 0.0], "b": [0.0, 1.0]})("embedding").alias("s")).collect()
    assert {r.id: r.s and [round(x, 6) for x in r.s] for r in each} == {1: [1, 0], 2: None, 3: None, 4: None, 5: None, 6: [0.6, 0.8], 7: None}


def test_a_repeated_text_does_not_empty_the_page(spark):
    messages = spark.range(60).select(
        "id", F.lit("s").alias("session_id"), F.lit("user").alias("role"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("id") < 50, F.lit("the same")).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("content"),
    )
    sessions = spark.createDataFrame([("s", "agent", "direct", 60)], "id string, agent_id string, channel string, message_count long")
    vectors = spark.range(60).select(F.col("id").alias("message_id"), F.array(F.lit(1.0), F.col("id") / 1000).cast("array<float>").alias("embedding"))
    found = vector.search_messages(vectors, messages, sessions, [1.0, 0.0], limit=5).collect()
    assert [r.id for r in found] == [0, 50, 51, 52, 53]


def test_fallback_only_without_hits(spark):
    some, none = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([], "x int")
    other = spark.createDataFrame([(2,), (3,)], "x int")
    assert [r.x for r in _or_else(some, other).collect()] == [1]
    assert sorted(r.x for r in _or_else(none, other).collect()) == [2, 3]


def test_chunks_are_read_by_many_tasks(spark, tmp_path):
    lines = [f'{{"n": {i}}}' for i in range(4000)]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(lines) + "\n")
    size = path.stat().st_size
    ranges = spark.createDataFrame([(str(path), 0, size, "load")], "path string, start_offset long, size long, action string")
    found = tail.read_ranges(ranges, chunk_bytes=40)
    assert size // 40 > 1000
    tasks = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(tasks) >= int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(tasks) == 4000
