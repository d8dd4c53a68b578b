"""Event envelopes: building, validating, quarantine, acceptance and payload parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import identity as ids
from tidemark.functions.text import sorted_json

# Fixed values of the envelope contract, version 1.0.
SCHEMA_VERSION = "1.0"
POST_EVENT_TYPES = ("social.post.observed", "social.post.updated")
TREND_EVENT_TYPES = ("social.trend.observed",)
SUPPORTED_EVENT_TYPES = (
    "social.post.observed",
    "social.post.updated",
    "social.post.deleted",
    "social.engagement.observed",
    "social.trend.observed",
)
REQUIRED_FIELDS = (
    "correlation_id",
    "event_id",
    "event_type",
    "idempotency_key",
    "platform",
    "source_id",
    "source_object_id",
    "tenant_id",
)
TENANT_PATTERN = "^[A-Za-z0-9][A-Za-z0-9_-]{0,62}$"
KEY_PATTERN = "^[a-f0-9]{64}$"
MAX_SOURCE_ID_LENGTH = 128
MAX_PLATFORM_LENGTH = 64
CLOUDEVENTS_VERSION = "1.0"
DEFAULT_DATA_SCHEMA = "urn:schema:social-event-data:v1"
DEFAULT_URN_PREFIX = "urn:audience-signals:"


def _reasons(*labelled: tuple[str, Column]) -> Column:
    """Comma-joined labels of the conditions that hold, in the given order."""
    return F.concat_ws(",", *[F.when(cond, F.lit(label)) for label, cond in labelled])


def build_envelope(
    mapped: DataFrame,
    *,
    tenant_id: Column,
    source_id: Column,
    platform: Column,
    event_type: Column,
    source_object_id: Column,
    occurred_at: Column,
    collected_at: Column,
    payload: Column,
    attributes: Column | None = None,
    correlation_id: Column | None = None,
    event_id: Column | None = None,
) -> DataFrame:
    """Project mapped provider rows to landed envelopes.

    Without ``event_id`` the delivery id is derived from the delivery itself
    (logical key + collection time): a task retried after an executor loss writes the
    same id again, which a random id would not.
    """
    key = ids.idempotency_key(tenant_id, platform, source_object_id, event_type, occurred_at)
    delivery = ids.record_id(F.lit("delivery"), key, ids.utc_text(collected_at))
    empty = F.create_map().cast("map<string,string>")
    return mapped.select(
        F.coalesce(event_id, delivery).alias("event_id") if event_id is not None
        else delivery.alias("event_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        tenant_id.alias("tenant_id"),
        source_id.alias("source_id"),
        platform.alias("platform"),
        event_type.alias("event_type"),
        source_object_id.alias("source_object_id"),
        occurred_at.alias("occurred_at"),
        collected_at.alias("collected_at"),
        key.alias("idempotency_key"),
        (correlation_id if correlation_id is not None else ids.record_id(F.lit("trace"), delivery))
        .alias("correlation_id"),
        payload.alias("payload"),
        (attributes if attributes is not None else empty).alias("attributes"),
    )


def validate_envelope(events: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``validation_errors`` (comma-joined, empty when valid) and ``is_valid``.

    ``strict`` also applies the JSON-schema limits: tenant pattern, 64-hex key, lengths.
    """
    col = F.col
    checks = [(f"missing_{name}", ids.is_blank(col(name))) for name in REQUIRED_FIELDS]
    checks += [
        (
            "unsupported_schema_version",
            ~col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)),
        ),
        (
            "unsupported_event_type",
            col("event_type").isNull() | ~col("event_type").isin(*SUPPORTED_EVENT_TYPES),
        ),
        ("missing_timestamp", col("occurred_at").isNull() | col("collected_at").isNull()),
        ("missing_payload", col("payload").isNull()),
    ]
    if strict:
        checks += [
            ("bad_tenant_id", ~col("tenant_id").rlike(TENANT_PATTERN)),
            ("bad_idempotency_key", ~col("idempotency_key").rlike(KEY_PATTERN)),
            ("long_source_id", F.length("source_id") > MAX_SOURCE_ID_LENGTH),
            ("long_platform", F.length("platform") > MAX_PLATFORM_LENGTH),
        ]
    return events.withColumn("validation_errors", _reasons(*checks)).withColumn(
        "is_valid", F.col("validation_errors") == ""
    )


def envelope_to_record(events: DataFrame) -> DataFrame:
    """JSON-safe landing record: UTC ISO text times, payload as JSON text.

    Object keys are in order on every level; text that is no JSON stays as it is.
    """
    payload = F.col("payload")
    if not isinstance(events.schema["payload"].dataType, T.StringType):
        payload = F.to_json(payload, {"ignoreNullFields": "false"})
    payload = sorted_json(payload)
    return events.withColumns(
        {
            "occurred_at": ids.iso_text(F.col("occurred_at")),
            "collected_at": ids.iso_text(F.col("collected_at")),
            "payload": payload,
        }
    )


def to_cloudevent(
    events: DataFrame,
    data_schema: str = DEFAULT_DATA_SCHEMA,
    urn_prefix: str = DEFAULT_URN_PREFIX,
) -> DataFrame:
    """CloudEvents 1.0 structured form: URN source, lower-case extensions, nested data.

    The payload is a VARIANT, so that ``to_json`` of an event nests it as an object
    instead of quoting its text.
    """
    encode = ids.percent_encode
    platform = encode(F.lower("platform"))
    source = F.concat(
        F.lit(urn_prefix),
        F.concat_ws(":", encode(F.col("tenant_id")), platform, encode(F.col("source_id"))),
    )
    return events.select(
        F.lit(CLOUDEVENTS_VERSION).alias("specversion"),
        F.col("event_id").alias("id"),
        source.alias("source"),
        F.col("event_type").alias("type"),
        F.concat_ws("/", platform, encode(F.col("source_object_id"))).alias("subject"),
        ids.iso_text(F.col("occurred_at")).alias("time"),
        F.lit("application/json").alias("datacontenttype"),
        F.lit(data_schema).alias("dataschema"),
        F.col("tenant_id").alias("tenantid"),
        F.col("source_id").alias("sourceid"),
        F.col("correlation_id").alias("correlationid"),
        F.col("idempotency_key").alias("idempotencykey"),
        ids.iso_text(F.col("collected_at")).alias("collectedat"),
        F.col("schema_version").alias("schemaversion"),
        F.struct(
            "schema_version",
            F.try_parse_json(F.col("payload")).alias("payload"),
            "attributes",
        ).alias("data"),
    )


def classify_deliveries(
    events: DataFrame,
    contracts: DataFrame,
    registry: DataFrame,
    reject_unparseable: bool = False,
) -> DataFrame:
    """Tag every delivery once with its ``rejection_reasons`` (empty when accepted).

    Quarantine, acceptance and source health all read this one pass instead of
    repeating the contract and source joins. The control tables carry no hint: Spark
    broadcasts them while they are below the broadcast threshold and otherwise joins by
    shuffle, where adaptive execution splits a hot source.
    """
    active = contracts.filter("active").select(
        "schema_version", "event_type", F.lit(True).alias("_contract")
    )
    enabled = registry.filter("enabled").select(
        "tenant_id", "source_id", F.lit(True).alias("_source")
    )
    reasons = [
        ("missing_event_id", F.col("event_id").isNull()),
        ("missing_idempotency_key", F.col("idempotency_key").isNull()),
        ("missing_tenant_id", F.col("tenant_id").isNull()),
        ("missing_source_id", F.col("source_id").isNull()),
        ("missing_payload", F.col("payload").isNull()),
        ("unsupported_contract", F.col("_contract").isNull()),
        ("disabled_or_unregistered_source", F.col("_source").isNull()),
    ]
    if reject_unparseable:
        parsed = F.try_parse_json(F.col("payload"))
        reasons.append(("unparseable_payload", F.col("payload").isNotNull() & parsed.isNull()))
    return (
        events.join(active, ["schema_version", "event_type"], "left")
        .join(enabled, ["tenant_id", "source_id"], "left")
        .withColumn("rejection_reasons", _reasons(*reasons))
        .select(*events.columns, "rejection_reasons")
    )


def dead_letter(events: DataFrame, contracts: DataFrame, registry: DataFrame) -> DataFrame:
    """Deliveries that fail any check, with deterministic comma-joined reasons."""
    return classify_deliveries(events, contracts, registry).filter("rejection_reasons <> ''")


def accepted_of(classified: DataFrame, event_types: Sequence[str]) -> DataFrame:
    """Accepted deliveries of some event types out of ``classify_deliveries``."""
    return classified.filter(
        (F.col("rejection_reasons") == "") & F.col("event_type").isin(*event_types)
    ).drop("rejection_reasons")


def accept_events(
    events: DataFrame,
    contracts: DataFrame,
    registry: DataFrame,
    event_types: Sequence[str] = POST_EVENT_TYPES,
) -> DataFrame:
    """Deliveries of some event types that pass every check.

    The filters reach the scan; the control tables only prove membership, so semi joins
    suffice and can never multiply deliveries.
    """
    active = contracts.filter("active").select("schema_version", "event_type")
    enabled = registry.filter("enabled").select("tenant_id", "source_id")
    complete = (
        F.col("event_type").isin(*event_types)
        & F.col("event_id").isNotNull()
        & F.col("idempotency_key").isNotNull()
        & F.col("payload").isNotNull()
    )
    return (
        events.filter(complete)
        .join(active, ["schema_version", "event_type"], "left_semi")
        .join(enabled, ["tenant_id", "source_id"], "left_semi")
        .select(*events.columns)
    )


_LINEAGE = (
    "event_id",
    "schema_version",
    "tenant_id",
    "source_id",
    "event_type",
    "source_object_id",
    "idempotency_key",
    "correlation_id",
    "occurred_at",
)


def _parsed(events: DataFrame, schema: T.StructType, *columns: str | Column) -> DataFrame:
    """The columns and the payload's fields, with the JSON parsed once.

    As a generator the parse stays one step: a filter on a parsed field would otherwise be
    pushed through the projection and parse every payload a second time.
    """
    return events.select(*columns, F.inline(F.array(F.from_json("payload", schema))))


def parse_post_payload(deliveries: DataFrame) -> DataFrame:
    """Flatten the post payload; rows without a ``post_id`` are not posts."""
    return flatten_post_payload(deliveries).filter(F.col("post_id").isNotNull())


def flatten_post_payload(deliveries: DataFrame, *more: Column) -> DataFrame:
    """The post payload's fields of every delivery, null where it is no post.

    ``more`` names further columns of the delivery to keep.
    """
    kept = (
        F.col("payload").alias("raw_event_payload"),
        F.col("attributes").alias("event_attributes"),
        "ingested_at",
    )
    rows = _parsed(deliveries, schemas.POST_PAYLOAD, *_LINEAGE, *kept, *more)
    others = [c for c in rows.columns if c not in (*_LINEAGE, *schemas.POST_PAYLOAD.names)]
    return rows.select(*_LINEAGE, *schemas.POST_PAYLOAD.names, *others)


def parse_trend_payload(deliveries: DataFrame) -> DataFrame:
    """Flatten the trend payload; name and place are required, the rank is optional."""
    named = F.col("trend_name").isNotNull() & F.col("woeid").isNotNull()
    return flatten_trend_payload(deliveries).filter(named)


def flatten_trend_payload(deliveries: DataFrame) -> DataFrame:
    """The trend payload's fields of every delivery, null where it is no trend."""
    kept = (
        "collected_at",
        F.col("payload").alias("raw_event_payload"),
        F.col("attributes").alias("event_attributes"),
        "ingested_at",
    )
    return _parsed(deliveries, schemas.TREND_PAYLOAD, *_LINEAGE, *kept).select(
        *_LINEAGE,
        "collected_at",
        *schemas.TREND_PAYLOAD.names,
        F.col("event_attributes")["trend_rank"].try_cast("int").alias("trend_rank"),
        "raw_event_payload",
        "event_attributes",
        "ingested_at",
    )
