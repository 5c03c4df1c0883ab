"""Computing a costly column once.

Filters move below projections, and Spark then repeats the projected expression in
the filter. A one-row generator stops that: what is above it cannot move below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Add or replace columns, each evaluated once per row.

    Rows failing `keep`, a test on the columns already there, are dropped.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    generated = F.inline(row if keep is None else F.when(keep, row))
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, generated)
