"""A database of tables through which the refresh stages communicate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.quality import measures_of
from tidemark.sources import files
from tidemark.sources import tables as catalog

# Tables that streams append to; they are read where the stream writes, never copied.
APPENDED = ("bronze_social_events", "bronze_connector_runs")


@dataclass(frozen=True)
class Warehouse:
    """Tables of one catalog database, with streams and checkpoints under one shared root.

    Small tables are replaced as a whole behind a view, so a stage may read the table that it
    replaces and a lost run leaves it as it was. Facts are partitioned by day and rewritten by touched
    partition (see ``plans.incremental``).
    """

    spark: SparkSession
    root: str
    database: str = "tidemark"

    def __post_init__(self) -> None:
        place = f"{self.root}/tables".replace("'", "\\'")
        name = files.qualified(self.database)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{place}'")

    def name(self, table: str) -> str:
        return f"{self.database}.{files.identifier(table)}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root}/_checkpoints/{name}"

    def exists(self, name: str) -> bool:
        if name in APPENDED:
            return files.path_exists(self.spark, self.path(name))
        return catalog.exists(self.spark, self.name(name))

    def table(self, name: str) -> DataFrame:
        if name in APPENDED:
            return self.spark.read.parquet(self.path(name))
        return self.spark.table(self.name(name))

    def table_or_empty(self, name: str, schema: T.StructType) -> DataFrame:
        if self.exists(name):
            return self.table(name)
        return files.inline_values(self.spark, [], schema)

    def durable(self, name: str) -> DataFrame:
        """A control, decision or label table; empty before its first version."""
        return self.table_or_empty(name, schemas.DURABLE_TABLES[name])

    def replace(
        self,
        name: str,
        df: DataFrame,
        sort_by: Sequence[str] = (),
    ) -> DataFrame:
        """Publish the rows under the name (an empty result too) and return them as stored.

        ``sort_by`` orders the rows inside each file, without a shuffle, so that filters
        on those columns skip row groups and pages by their statistics. The counts that the acceptance
        checks rest on are observed on the way and stay with the table (see ``observed``).
        """
        if name in APPENDED:
            raise ValueError(f"{name} only grows; streams append to it")
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        catalog.replace_table(df, self.name(name), metrics=measures_of(name))
        return self.table(name)

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """Write what only the run under way reads, so that it is computed once."""
        df.write.mode("overwrite").format("parquet").saveAsTable(self.name(name))
        return self.table(name)

    def parts(self, name: str) -> list[str]:
        """Partitions that hold rows, from the catalog alone."""
        return catalog.parts_of(self.spark, self.name(name)) if self.exists(name) else []

    def observed(self, *names: str) -> dict[str, dict]:
        """Counts observed while tables were written; a few numbers for each table."""
        found = {n: catalog.observed(self.spark, self.name(n)) for n in names if n not in APPENDED}
        return {n: counts for n, counts in found.items() if counts}

    def overwrite(self, name: str, df: DataFrame, part: str, parts: Sequence[str]) -> DataFrame:
        """Rewrite these partitions of a table and return the whole table."""
        catalog.overwrite_parts(df, self.name(name), part, parts)
        return self.table(name)

    def view(self, name: str, of: str, where: str, hidden: Sequence[str]) -> DataFrame:
        """A view of some rows of another table without some of its columns."""
        kept = ", ".join(f"`{files.identifier(c)}`" for c in self.table(of).columns if c not in hidden)
        rows = f"SELECT {kept} FROM {files.qualified(self.database, of)}"
        self.spark.sql(f"CREATE OR REPLACE VIEW {files.qualified(self.database, name)} AS {rows} WHERE {where}")
        return self.table(name)

    def drop(self, *names: str) -> None:
        """Forget tables that the next run builds anew."""
        for name in names:
            if self.exists(name):
                kind = "VIEW" if self._is_view(name) else "TABLE"
                self.spark.sql(f"DROP {kind} {files.qualified(self.database, name)}")

    def _is_view(self, name: str) -> bool:
        return self.spark.catalog.getTable(self.name(name)).tableType == "VIEW"

    def tables(self, *names: str) -> Mapping[str, DataFrame]:
        return {name: self.table(name) for name in names}
