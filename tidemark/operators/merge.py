"""Upsert of one DataFrame into another: the MERGE that plain Parquet tables lack."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# NULL keys never match, so their rows are spread over this many buckets instead of
# piling up in the one partition that NULL hashes to.
SPREAD = 1024


def target(name: str) -> Column:
    """Column of the target row inside a merge condition or assignment."""
    return F.col(f"_t.{name}")


def source(name: str) -> Column:
    """Column of the source row inside a merge condition or assignment."""
    return F.col(f"_s.{name}")


def _any_null(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def _with_spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    hashable = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    spread = F.pmod(F.xxhash64(*hashable), F.lit(SPREAD)).cast("int")
    return df.withColumn("_spread", F.when(_any_null(keys), spread).otherwise(F.lit(0)))


def _checked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail on a second row with the same non-NULL key; ``df`` carries ``_spread``.

    The row number streams over the partitioning and order that the merge join needs
    anyway, so the check adds no shuffle and buffers no group.
    """
    window = Window.partitionBy(*keys, "_spread").orderBy(*keys)
    duplicate = (F.row_number().over(window) > 1) & ~_any_null(keys)
    message = F.concat_ws(
        ", ",
        F.lit("merge source has several rows for key"),
        *[F.col(k).cast("string") for k in keys],
    )
    passes = F.when(F.col("_duplicate"), F.raise_error(message).cast("boolean"))
    return (
        df.withColumn("_duplicate", duplicate)
        .filter(passes.otherwise(F.lit(True)))
        .drop("_duplicate")
    )


def unique_on(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows; the query fails when two of them share a non-NULL key."""
    return _checked(_with_spread(df, keys), keys).drop("_spread")


def _packed(df: DataFrame, alias: str, keys: Sequence[str]) -> DataFrame:
    """The row as one struct beside its keys, so that presence is one NULL test."""
    columns = [c for c in df.columns if c != "_spread"]
    return df.select(
        *[F.col(k).alias(f"{alias}_{k}") for k in keys],
        F.col("_spread").alias(f"{alias}_spread"),
        F.struct(*columns).alias(alias),
    )


def merge_upsert(
    target_df: DataFrame,
    source_df: DataFrame,
    keys: Sequence[str],
    *,
    when_matched: Mapping[str, Column] | None = None,
    matched_condition: Column | None = None,
    insert: bool = True,
    insert_values: Mapping[str, Column] | None = None,
    when_not_matched_by_source: Mapping[str, Column] | None = None,
    not_matched_by_source_condition: Column | None = None,
) -> DataFrame:
    """New snapshot of ``target_df`` after merging ``source_df`` on ``keys``.

    * ``when_matched`` assigns target columns of matched rows (``target("c")`` and
      ``source("c")`` name the two sides), only where ``matched_condition`` holds.
    * ``insert`` adds source rows without a match; ``insert_values`` overrides single
      columns, columns that the source lacks become NULL.
    * ``when_not_matched_by_source`` assigns target rows without a match, only where
      ``not_matched_by_source_condition`` holds.

    NULL keys never match. Two source rows with one key fail the query. The clauses
    decide the join: insert-only reads just the target's keys (anti join), update-only
    keeps the target in place (left join, broadcast when the source is small), all
    clauses together take one full outer join. Keys are unique on both sides, so no
    reducer receives more than its share.
    """
    columns = target_df.columns
    types = {f.name: f.dataType for f in target_df.schema.fields}
    checked_source = _checked(_with_spread(source_df, keys), keys)

    def inserted(name: str, alias: str) -> Column:
        if insert_values and name in insert_values:
            value = insert_values[name]
        elif name in source_df.columns:
            value = F.col(f"{alias}.{name}")
        else:
            value = F.lit(None)
        return value.cast(types[name])

    updates = bool(when_matched) or bool(when_not_matched_by_source)
    if not updates and not insert:
        return target_df
    if not updates:
        # On keys and spread, as the check is dealt: the source is shuffled once, NULL keys apart.
        known = _with_spread(target_df.select(*keys), keys)
        fresh = (
            checked_source.alias("_s")
            .join(known, [*keys, "_spread"], "left_anti")
            .select(*[inserted(c, "_s").alias(c) for c in columns])
        )
        return target_df.unionByName(fresh)

    left = _packed(_with_spread(target_df, keys), "_t", keys)
    right = _packed(checked_source, "_s", keys)
    same = [left[f"_t_{k}"] == right[f"_s_{k}"] for k in (*keys, "spread")]
    on = reduce(lambda a, b: a & b, same)
    joined = left.join(right, on, "full_outer" if insert else "left")

    in_target = F.col("_t").isNotNull()
    in_source = F.col("_s").isNotNull()
    apply_match = in_target & in_source
    if matched_condition is not None:
        apply_match = apply_match & F.coalesce(matched_condition, F.lit(False))
    apply_unmatched = in_target & ~in_source
    if not_matched_by_source_condition is not None:
        apply_unmatched = apply_unmatched & F.coalesce(
            not_matched_by_source_condition, F.lit(False)
        )

    def merged(name: str) -> Column:
        value = F.when(~in_target, inserted(name, "_s")) if insert else F.when(
            F.lit(False), F.lit(None).cast(types[name])
        )
        if when_matched and name in when_matched:
            value = value.when(apply_match, when_matched[name].cast(types[name]))
        if when_not_matched_by_source and name in when_not_matched_by_source:
            value = value.when(
                apply_unmatched, when_not_matched_by_source[name].cast(types[name])
            )
        return value.otherwise(target(name))

    return joined.select(*[merged(c).alias(c) for c in columns])


def update_all(columns: Sequence[str], keys: Sequence[str]) -> dict[str, Column]:
    """Assignments of every non-key column from the source (update all by name)."""
    return {c: source(c) for c in columns if c not in keys}
