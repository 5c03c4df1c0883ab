"""What the operators of this package share: tables, words, and results kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a run of characters other than ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch between Spark and a Python worker, where the session names none; either side holds a few.
ARROW_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def as_row(docs: DataFrame) -> Column:
    """All columns as one, so that other columns may have any names."""
    return F.struct(*[docs[c] for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only on one machine (a local master) a temporary folder stands in where none is named.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    unnamed = spark.conf.get(bound, None) is None
    if unnamed:
        spark.conf.set(bound, str(ARROW_BYTES))
    try:
        df.write.parquet(path)
    finally:
        if unnamed:
            spark.conf.unset(bound)
    return spark.read.schema(df.schema).parquet(path)


def hashed_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most so many rows, those with the smallest hash of the keys.

    Rows are first thinned to hardly more than that by a bound on the hash, so that no task gets the first rows of all
    the others.
    """
    share = min(1.0, 1.1 * most / max(1, df.count()))
    place = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 62) - 1))
    return df.where(place <= F.lit(int(share * ((1 << 62) - 1)))).orderBy(place, *keys).limit(most)


def numbered(df: DataFrame, *order: str, into: str = "_no") -> DataFrame:
    """Rows with their 0-based number in the order of the columns, nulls last.

    A range partitioning puts the rows in order; what meets in one task afterwards is one count per partition.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    dealt = stage(
        df.repartitionByRange(partitions(spark), *keys).withColumn("_block", F.spark_partition_id()), "numbered"
    )
    counts = dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "_block",
        (F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
    )
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*keys))
    return dealt.join(before, "_block").withColumn(into, F.col("_before") + inside - 1).drop("_block", "_before")


def tiled(rows: DataFrame, key: str, tile: int, weight: Column | None = None) -> DataFrame:
    """Rows with (low, high), the pairs of tiles of their group that they are in, and `own`, their tile.

    A tile has about `tile` rows, or rows of about so much weight together, which is a whole number for each row.

    A group of k tiles has k (k + 1) / 2 tasks' worth of pairs, and each of its rows is in k of them.
    """
    held = F.sum(F.lit(1) if weight is None else weight).alias("_held")
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), held).where(F.col("_n") > 1)
    counts = counts.select(key, F.ceil(F.col("_held") / F.lit(float(tile))).alias("_k"))
    rows = rows.join(counts, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_k")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    return rows.withColumn("low", F.least("own", "_other")).withColumn("high", F.greatest("own", "_other")).drop("_other", "_k")
