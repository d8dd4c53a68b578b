"""Collected provider pages taken into the landing folder, with what could not be mapped beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.envelope import envelope_to_record
from tidemark.operators.incremental import DAY, day_of
from tidemark.plans.warehouse import Warehouse
from tidemark.sources import files, providers
from tidemark.sources.tables import values_of

UNLINKED = "bronze_unlinked_media"
RUN = ["tenant_id", "source_id", "collected_at"]


def collect_media(w: Warehouse, media_pages: DataFrame, account_pages: DataFrame, landing: str) -> DataFrame:
    """Land the envelopes of a collection run's media; the media of sources without an account.

    Those are kept by day of collection until the account is linked and the run is repeated; a
    repeated run replaces its own rows.
    """
    accounts = providers.linked_accounts(account_pages)
    mapped = providers.map_instagram_media(media_pages, accounts)
    files.land_ndjson(envelope_to_record(providers.post_envelopes(mapped)), landing)
    rows = w.stage("increment_unlinked", providers.unlinked_media(media_pages, accounts).withColumn(DAY, day_of("collected_at")))
    runs = media_pages.select(*RUN).distinct()
    days = values_of(runs.select(day_of("collected_at").alias(DAY)), DAY)
    if w.exists(UNLINKED):
        held = w.table(UNLINKED)
        others = held.filter(held[DAY].isin(days)).join(runs, RUN, "left_anti")
        rows = rows.unionByName(others)
    return w.overwrite(UNLINKED, rows, DAY, days)
