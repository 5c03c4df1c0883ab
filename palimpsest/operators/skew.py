"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key handled by one task before the key is split further.
SLICE_ROWS = 1_000_000


def heavy_keys(rows: DataFrame, sized: DataFrame, key: str, weight: str | None, slice_rows: int) -> DataFrame:
    """(_heavy, _slices): every key worth splitting and into how many slices.

    Without a weight the rows themselves are counted, by key and before the shuffle, so NULL and keys that the other
    side lacks are split too. A weight must be an exact count of the rows, as a preceding aggregation gives it.
    """
    counted = sized.select(key, F.col(weight).alias("_n")) if weight else rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > slice_rows).select(
        F.col(key).alias("_heavy"), F.ceil(F.col("_n") / slice_rows).cast("int").alias("_slices")
    )


def join_on_sized_key(
    rows: DataFrame,
    sized: DataFrame,
    key: str,
    weight: str | None,
    spread_by: str,
    how: str = "inner",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Join many rows to a table with one row per key.

    Rows of a heavy key are spread over slices by `spread_by`, and the key's one row is repeated once per slice, so the
    work of a key is shared in proportion to its size. There is at most one heavy key per `slice_rows` rows; whether
    the list of them is broadcast is left to Spark, which knows its size.
    """
    heavy = heavy_keys(rows, sized, key, weight, slice_rows)
    slices = F.coalesce(F.col("_slices"), F.lit(1))
    spread = (
        rows.join(heavy, rows[key].eqNullSafe(heavy["_heavy"]), "left")
        .withColumn("_slice", F.pmod(F.xxhash64(spread_by), slices).cast("int"))
        .drop("_heavy", "_slices")
    )
    repeated = (
        sized.join(heavy, sized[key] == heavy["_heavy"], "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_heavy", "_slices")
    )
    return spread.join(repeated, [key, "_slice"], how).drop("_slice")
