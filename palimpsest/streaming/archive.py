"""A stream of session lines into stored messages, sessions and index log.

Each micro-batch writes one partition folder per table and overwrites it when it is
replayed, so a batch counts once however often it runs. The index log is the state:
its latest row per file says how far the file was read and how many messages it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions.paths import Naming, file_stem, session_uuid
from palimpsest.operators import ingest
from palimpsest.operators.skew import join_on_sized_key
from palimpsest.sources.tail import read_ranges, stream_sessions

LOG_SCHEMA = (
    "source_file string, uuid string, last_byte_offset bigint, message_count bigint, "
    "base_batch bigint, started_at timestamp_ntz, ended_at timestamp_ntz, batch bigint"
)
MESSAGE_SCHEMA = (
    "id bigint, session_id string, role string, content string, timestamp timestamp_ntz, "
    "message_index int, source_file string, batch bigint"
)
# An id holds batch, task and row numbers: 27, 14 and 22 bits, so batches last for 20 years at five seconds each. Task
# and row numbers beyond their bits are an error, not another batch's ids.
TASK_BITS, ROW_BITS = 14, 22


@dataclass(frozen=True)
class Archive:
    """Tables below one folder of the shared file system."""

    spark: SparkSession
    folder: str
    naming: Naming = field(default_factory=Naming)

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def log(self, before: int | None = None) -> DataFrame:
        """Latest log row of each file, of batches before a given one."""
        rows = self._read("index_log", LOG_SCHEMA)
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return (
            rows.groupBy("source_file")
            .agg(F.max_by(F.struct(*[c for c in rows.columns if c != "source_file"]), "batch").alias("_row"))
            .select("source_file", "_row.*")
        )

    def messages(self) -> DataFrame:
        """Stored messages, without those from before a file was read anew."""
        current = self.log().select("source_file", "message_count", "base_batch")
        rows = self._read("messages", MESSAGE_SCHEMA)
        return (
            join_on_sized_key(rows, current, "source_file", "message_count", "id")
            .where(F.col("batch") >= F.col("base_batch"))
            .select("id", "session_id", "role", "content", "timestamp", "message_index")
        )

    def sessions(self) -> DataFrame:
        files = self.log().where(F.col("message_count") > 0).withColumnRenamed("source_file", "path")
        return ingest.describe_sessions(files, self.naming)

    def add_batch(self, lines: DataFrame, batch: int) -> None:
        """Store one micro-batch of session lines."""
        self._add(self._work(lines, "lines"), batch)

    def _work(self, df: DataFrame, name: str) -> DataFrame:
        """The batch's intermediate table in the shared folder; the next batch takes its place."""
        path = f"{self.folder}/_work/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _add(self, lines: DataFrame, batch: int) -> None:
        log = self.log(before=batch)
        ranges = lines.groupBy("path").agg(
            F.count(F.lit(1)).alias("lines"),
            F.max("next_offset").alias("last_byte_offset"),
            F.bool_or("reload").alias("reload"),
        )
        files = self._first_of_uuid(ranges, log)
        kept = ingest.parse_lines(
            join_on_sized_key(lines.select("path", "offset", "value"), files.select("path", "lines"), "path", "lines", "offset")
            .drop("lines")
        )
        kept = self._work(kept, "messages")
        known = files.join(log.withColumnRenamed("source_file", "path").drop("uuid", "last_byte_offset"), "path", "left")
        fresh = F.col("reload") | F.col("message_count").isNull()
        starts = known.select("path", F.when(fresh, F.lit(0)).otherwise(F.col("message_count")).alias("start_index"))
        numbered = ingest.number_messages(kept, starts)
        ids = F.monotonically_increasing_id()
        row = ids.bitwiseAND(F.lit((1 << 33) - 1))
        task = F.shiftright(ids, 33)
        safe_row = F.when((row < (1 << ROW_BITS)) & (task < (1 << TASK_BITS)), row).otherwise(
            F.raise_error(F.lit("too many messages in one task, or too many tasks in one batch")).cast("bigint")
        )
        message_id = (
            F.lit(batch << (TASK_BITS + ROW_BITS)) + F.shiftleft(task, ROW_BITS) + safe_row
        )
        self._write(
            numbered.select(
                message_id.alias("id"), file_stem(F.col("path")).alias("session_id"), "role", "content",
                "timestamp", "message_index", F.col("path").alias("source_file"),
            ),
            "messages", batch,
        )
        added = ingest.session_rows(kept).withColumnsRenamed(
            {"message_count": "_added", "started_at": "_first", "ended_at": "_last"}
        )
        self._write(
            known.join(added, "path", "left").select(
                F.col("path").alias("source_file"),
                session_uuid(F.col("path")).alias("uuid"),
                "last_byte_offset",
                (F.when(fresh, F.lit(0)).otherwise(F.col("message_count")) + F.coalesce("_added", F.lit(0))).alias("message_count"),
                F.when(fresh, F.lit(batch)).otherwise(F.col("base_batch")).cast("bigint").alias("base_batch"),
                F.when(fresh, F.col("_first")).otherwise(F.coalesce("started_at", "_first")).alias("started_at"),
                F.when(fresh, F.col("_last")).otherwise(F.coalesce("_last", "ended_at")).alias("ended_at"),
            ),
            "index_log", batch,
        )

    @staticmethod
    def _first_of_uuid(ranges: DataFrame, log: DataFrame) -> DataFrame:
        """Files whose session was not stored from another path before."""
        key = F.coalesce(session_uuid(F.col("path")), F.col("path"))
        owners = log.where(F.col("uuid").isNotNull()).groupBy(F.col("uuid").alias("_key")).agg(
            F.min_by("source_file", F.struct("base_batch", "source_file")).alias("_owner")
        )
        keyed = ranges.withColumn("_key", key)
        firsts = keyed.groupBy("_key").agg(F.min("path").alias("_first"))
        return (
            keyed.join(firsts, "_key")
            .join(owners, "_key", "left")
            .where(F.col("path") == F.coalesce("_owner", "_first"))
            .drop("_key", "_first", "_owner")
        )


def start_ingest(
    archive: Archive,
    roots: Sequence[str],
    checkpoint: str,
    every: str | None = "5 seconds",
    **options: str,
) -> StreamingQuery:
    """Follow the session folders. Without `every` the stream takes one pass and ends."""
    writer = (
        stream_sessions(archive.spark, roots, **options)
        .writeStream.foreachBatch(archive.add_batch)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(processingTime=every).start() if every else writer.start()


def index_once(archive: Archive, listing: DataFrame, batch: int) -> DataFrame:
    """One batch run over a file listing: plan, read the new ranges, store.

    Returns the plan. Nothing about single files passes through the driver.
    """
    log = archive.log(before=batch).select(
        "source_file", F.col("last_byte_offset").alias("file_size"), "last_byte_offset", "message_count"
    )
    stored = archive.sessions().select("id", "source_file")
    planned = ingest.first_of_uuid(ingest.plan_files(listing, log, stored))
    archive.add_batch(read_ranges(planned), batch)
    return planned
