"""Row-level helpers shared by the operators: latest row and top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "_rank"
) -> DataFrame:
    """First ``n`` rows of every group, numbered in ``rank``.

    The ``row_number() <= n`` shape lets Spark prune every group to ``n`` rows inside
    each map task before the shuffle (WindowGroupLimit), so that a group with a third
    of all rows still sends only ``n`` rows per task to its reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1).drop("_rank")


def as_timestamp(value) -> Column:
    """Literal or Column as TIMESTAMP; NULL-safe ``as_of`` arguments."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")
