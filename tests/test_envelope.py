import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import envelope, posts
from tidemark.queries import tables as t
from tidemark.sources.files import inline_values

AT = datetime(2026, 8, 8, 11, 55)
KEY = "a" * 64


def event(event_id="e1", tenant="demo", source="src", kind="social.post.observed",
          version="1.0", key=KEY, payload='{"post_id": "p1", "views": 5}', at=AT):
    return (event_id, version, tenant, source, "x", kind, "obj", at, at, key, "corr", payload,
            {"trend_rank": "1"})


@pytest.fixture
def control(spark):
    contracts = inline_values(
        spark,
        [
            ("1.0", "social.post.observed", "B", "S", True, AT),
            ("1.0", "social.post.deleted", "B", "S", True, AT),
            ("1.0", "social.post.updated", "B", "S", False, AT),
        ],
        schemas.EVENT_CONTRACTS,
    )
    registry = inline_values(
        spark,
        [
            ("demo", "src", "x", "c", "m", True, "1.0", 300, None, None, "o", AT),
            ("demo", "off", "x", "c", "m", False, "1.0", 300, None, None, "o", AT),
        ],
        schemas.SOURCE_REGISTRY,
    )
    return contracts, registry


def events(spark, *rows):
    df = inline_values(spark, list(rows), schemas.EVENT_ENVELOPE)
    return df.withColumn("ingested_at", F.col("collected_at"))


def test_all_null_line_has_every_reason(spark, control):
    empty = events(spark, (None,) * 13)
    assert envelope.dead_letter(empty, *control).first().rejection_reasons == (
        "missing_event_id,missing_idempotency_key,missing_tenant_id,missing_source_id,"
        "missing_payload,unsupported_contract,disabled_or_unregistered_source"
    )


def test_reasons_of_single_defects(spark, control):
    rows = {
        "missing_payload": event("1", payload=None),
        "unsupported_contract": event("2", kind="social.post.updated"),
        "disabled_or_unregistered_source": event("3", source="off"),
        "missing_tenant_id,disabled_or_unregistered_source": event("4", tenant=None),
    }
    df = events(spark, *rows.values(), event("ok"))
    got = {r.rejection_reasons for r in envelope.dead_letter(df, *control).collect()}
    assert got == set(rows)


def test_quarantine_and_acceptance_partition_the_deliveries(spark, folder):
    df = t.deliveries(spark, folder)
    control = (t.contracts(spark), t.registry(spark))
    rejected = envelope.dead_letter(df, *control).select("event_id")
    accepted = envelope.accept_events(df, *control, envelope.SUPPORTED_EVENT_TYPES)
    accepted = accepted.select("event_id")
    assert rejected.join(accepted, "event_id", "left_semi").isEmpty()
    assert rejected.count() + accepted.count() == df.count()
    classified = envelope.classify_deliveries(df, *control)
    split = envelope.accepted_of(classified, envelope.SUPPORTED_EVENT_TYPES)
    assert split.count() == accepted.count()


def test_deleted_posts_enter_neither_output(spark, control):
    df = events(spark, event(kind="social.post.deleted"))
    assert envelope.dead_letter(df, *control).isEmpty()
    assert envelope.accept_events(df, *control).isEmpty()


def test_unparseable_payload_is_opt_in(spark, control):
    df = events(spark, event(payload="{not json"))
    assert envelope.dead_letter(df, *control).isEmpty()
    tagged = envelope.classify_deliveries(df, *control, reject_unparseable=True)
    assert tagged.first().rejection_reasons == "unparseable_payload"
    assert envelope.parse_post_payload(df).isEmpty()


def test_dedup_takes_the_last_delivery_and_is_idempotent(spark):
    later = AT + timedelta(hours=1)
    df = events(spark, event("a"), event("b", at=later), event("c", at=later), event("d", key="k2"))
    once = posts.dedup_deliveries(df)
    ids = {r.event_id for r in once.collect()}
    assert ids == {"c", "d"}
    assert {r.event_id for r in posts.dedup_deliveries(once).collect()} == ids


def test_hot_key_is_pruned_before_the_shuffle(spark, folder, plan_of):
    text = plan_of(posts.dedup_deliveries(t.deliveries(spark, folder)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_control_tables_join_by_broadcast(spark, folder, plan_of):
    text = plan_of(
        envelope.accept_events(t.deliveries(spark, folder), t.contracts(spark), t.registry(spark))
    )
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_parse_post_payload(spark):
    payload = json.dumps(
        {"post_id": "p1", "platform": "x", "hashtags": ["a"], "views": 7,
         "created_at": "2026-08-08T11:55:00Z"}
    )
    df = events(spark, event(payload=payload), event("e2", payload='{"views": 1}'))
    row = envelope.parse_post_payload(df).collect()
    assert len(row) == 1
    assert (row[0].post_id, row[0].hashtags, row[0].views) == ("p1", ["a"], 7)
    assert row[0].created_at == AT and row[0].raw_event_payload == payload


def test_parse_trend_payload_tolerates_a_bad_rank(spark):
    payload = json.dumps({"trend_name": "n", "woeid": 1, "observed_at": "2026-08-08T11:55:00Z"})
    bad = list(event("e2", payload=payload))
    bad[-1] = {"trend_rank": "first"}
    df = events(spark, event(payload=payload), tuple(bad), event("e3", payload='{"woeid": 1}'))
    got = {r.event_id: r.trend_rank for r in envelope.parse_trend_payload(df).collect()}
    assert got == {"e1": 1, "e2": None}


def test_validation(spark):
    df = events(
        spark, event(), event("e2", version="2"), event("e3", kind="other"),
        event("e4", tenant=" "), event("e5", key="XYZ"), event("e6", tenant="../x"),
    )
    plain = {r.event_id: r.validation_errors for r in envelope.validate_envelope(df).collect()}
    assert plain == {
        "e1": "", "e2": "unsupported_schema_version", "e3": "unsupported_event_type",
        "e4": "missing_tenant_id", "e5": "", "e6": "",
    }
    strict = envelope.validate_envelope(df, strict=True)
    strict = {r.event_id: r.validation_errors for r in strict.collect()}
    assert strict["e5"] == "bad_idempotency_key" and strict["e6"] == "bad_tenant_id"


def test_cloudevent(spark):
    sent = envelope.to_cloudevent(events(spark, event(tenant="de mo")))
    row = sent.withColumn("data", F.to_json("data")).first()
    assert row.source.endswith(":de%20mo:x:src") and row.source.startswith("urn:")
    assert row.subject == "x/obj" and row.time == "2026-08-08T11:55:00+00:00"
    assert json.loads(row.data) == {
        "schema_version": "1.0", "payload": {"post_id": "p1", "views": 5},
        "attributes": {"trend_rank": "1"},
    }


def test_record_sorts_struct_payload(spark):
    df = events(spark, event()).withColumn("payload", F.struct(F.lit(1).alias("b"), F.lit("é").alias("a")))
    assert envelope.envelope_to_record(df).first().payload == '{"a":"é","b":1}'


@pytest.mark.parametrize(
    ("payload", "expected"),
    [
        ('{"b": {"d": 1, "c": [{"z": null, "y": 2}]}, "a": 0}', '{"a":0,"b":{"c":[{"y":2,"z":null}],"d":1}}'),
        ("no json", "no json"),
        (None, None),
    ],
)
def test_record_sorts_all_levels_of_text(spark, payload, expected):
    df = events(spark, event()).withColumn("payload", F.lit(payload).cast("string"))
    assert envelope.envelope_to_record(df).first().payload == expected


def test_record_sorts_maps(spark):
    df = events(spark, event()).withColumn("payload", F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))
    assert envelope.envelope_to_record(df).first().payload == '{"a":2,"b":1}'


def test_built_envelopes_are_valid_and_repeatable(spark):
    def build():
        return envelope.build_envelope(
            spark.range(3),
            tenant_id=F.lit("demo"), source_id=F.lit("src"), platform=F.lit("x"),
            event_type=F.lit("social.post.observed"),
            source_object_id=F.col("id").cast("string"),
            occurred_at=F.lit(AT), collected_at=F.lit(AT), payload=F.lit("{}"),
        )

    rows = build().collect()
    assert rows == build().collect() and len({r.event_id for r in rows}) == 3
    assert envelope.validate_envelope(build(), strict=True).filter("not is_valid").isEmpty()
