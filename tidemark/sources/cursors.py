"""Collection cursors: lower bounds with overlap, and their safe advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.merge import merge_upsert, source
from tidemark.operators.rows import as_timestamp
from tidemark.sources.providers import next_page_token

RULE = ["tenant_id", "source_id", "rule_id"]


def _with_bound(
    rows: DataFrame, cursors: DataFrame, as_of, lookback_hours: int, overlap_minutes: int
) -> DataFrame:
    """Rows with their rule's ``lower_bound``: the cursor, else ``as_of`` minus the
    look-back, in both cases minus the overlap."""
    fallback = as_timestamp(as_of) - F.make_dt_interval(hours=F.lit(lookback_hours))
    bound = F.coalesce("cursor_at", fallback) - F.make_dt_interval(mins=F.lit(overlap_minutes))
    known = cursors.select(*RULE, "cursor_at")
    return rows.join(known, RULE, "left").withColumn("lower_bound", bound)


def watermarks(
    rules: DataFrame, cursors: DataFrame, as_of, lookback_hours: int = 24, overlap_minutes: int = 5
) -> DataFrame:
    """Lower bound of every rule."""
    bounded = _with_bound(rules.select(*RULE), cursors, as_of, lookback_hours, overlap_minutes)
    return bounded.select(*RULE, "lower_bound")


def since_watermark(
    rows: DataFrame,
    cursors: DataFrame,
    as_of,
    lookback_hours: int = 24,
    overlap_minutes: int = 5,
) -> DataFrame:
    """Rows created at or after their rule's lower bound."""
    bounded = _with_bound(rows, cursors, as_of, lookback_hours, overlap_minutes)
    return bounded.filter(F.col("created_at") >= F.col("lower_bound")).select(*rows.columns)


def advance_cursors(
    cursors: DataFrame, pages: DataFrame, as_of, guard: bool = True
) -> DataFrame:
    """Move the cursor of every rule whose last page was read to the batch start.

    The newest batch of a rule decides, by its last page: while that names a next page,
    the cursor stays and the next run reads the gap again. ``guard=False`` always advances.
    """
    now = as_timestamp(as_of)
    read_to_end = F.max_by(
        next_page_token(F.col("body")).isNull(), F.struct("collected_at", "page_no")
    )
    done = pages.groupBy(*RULE).agg(read_to_end.alias("_complete"))
    if guard:
        done = done.filter("_complete")
    advanced = done.select(*RULE, now.alias("cursor_at"), now.alias("updated_at"))
    return merge_upsert(
        cursors,
        advanced,
        RULE,
        when_matched={c: source(c) for c in ("cursor_at", "updated_at")},
    )
