import hashlib
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import identity, scoring, text

L = F.lit


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


def test_engagement_rate(one):
    engaged = scoring.engagements(L(50), L(10), L(20), L(20))
    assert one(scoring.engagement_rate(engaged, L(1000))) == pytest.approx(0.1)
    assert one(scoring.engagement_rate(engaged, L(0))) == 0.0


def test_trend_score_and_penalty(one):
    args = [L(v) for v in (3.5, 3.0, 1.5, 80, 3, 0.9, 0.8)]
    plain = one(scoring.trend_score(*args))
    assert plain > 75
    assert plain - one(scoring.trend_score(*args, L(25.0))) == pytest.approx(25.0)


def test_trend_score_ignores_negative_parts(one):
    assert one(scoring.trend_score(*[L(v) for v in (-9.0, -9.0, -1.0, 0, 0, 0.0, 0.0)])) == 0.0


def test_challenge_score(one):
    assert one(scoring.challenge_score(*[L(v) for v in (2.5, 75, 5, 3, 30)])) > 80
    assert one(scoring.challenge_score(*[L(v) for v in (9.0, 500, 9, 9, 99)])) == 100.0


@settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.floats(-1e6, 1e6), st.integers(-5, 10**9), st.floats(-2, 2), st.floats(-2, 2)
        ),
        min_size=1,
        max_size=30,
    )
)
def test_scores_are_bounded(rows, samples):
    df = rows("s DOUBLE, n BIGINT, p DOUBLE, c DOUBLE", *samples)
    args = [F.col(c) for c in "snpc"]
    for r in df.select(
        scoring.opportunity_score(*args).alias("a"), scoring.confidence_score(*args).alias("b")
    ).collect():
        assert 0 <= r.a <= 100 and 0 <= r.b <= 100


def test_experiment_result(one):
    args = (L(10000.0), L(11500.0), L(300.0), L(0.6))
    r = one(scoring.experiment_result(*args))
    assert (r.valid, r.measured_lift_pct, r.contribution_margin) == (True, 15.0, 600.0)
    no_control = one(scoring.experiment_result(L(0.0), L(5.0), L(0.0), L(0.5)))
    assert no_control.valid and no_control.measured_lift_pct is None
    for bad in ((-1.0, 1.0, 0.0, 0.5), (1.0, 1.0, 0.0, 1.5), (1.0, 1.0, -2.0, 0.5)):
        refused = one(scoring.experiment_result(*[L(v) for v in bad]))
        assert not refused.valid and refused.contribution_margin is None


@pytest.mark.parametrize(
    ("value", "expected"),
    [("12500", 12500), ("-4", 0), ("12.5", 12), ("1.9e1", 19), ("-0.5", 0), ("1e30", 0), ("n/a", 0), (None, 0), ("", 0)],
)
def test_nonneg_int(one, value, expected):
    assert one(scoring.nonneg_int(F.col("x")), "x STRING", value) == expected


def test_idempotency_key_matches_its_definition(one):
    at = datetime(2026, 8, 8, 11, 55, 0, 1234)
    key = identity.idempotency_key(
        L(" Demo "), L("X"), L(" 1888 "), L("Social.Post.Observed"), F.col("at")
    )
    expected = sha("demo|x|1888|social.post.observed|2026-08-08T11:55:00.001234+00:00")
    assert one(key, "at TIMESTAMP", at) == expected


def test_idempotency_key_separates_tenants_and_rejects_null(one):
    def key(tenant):
        return identity.idempotency_key(tenant, L("x"), L("1"), L("e"), F.col("at"))

    at = datetime(2026, 8, 8)
    assert one(key(L("a")), "at TIMESTAMP", at) != one(key(L("b")), "at TIMESTAMP", at)
    assert one(key(L(None).cast("string")), "at TIMESTAMP", at) is None


def test_utc_text_does_not_depend_on_the_session_zone(spark, rows):
    df = rows("at TIMESTAMP", (datetime(2024, 1, 1, 12),)).cache()
    df.count()
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        value = df.select(identity.utc_text(F.col("at"), 0).alias("v")).first().v
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert value == "2024-01-01T12:00:00+00:00"


@pytest.mark.parametrize(
    ("micros", "expected"),
    [(0, "2024-01-01T00:00:05+00:00"), (120, "2024-01-01T00:00:05.000120+00:00")],
)
def test_iso_text(one, micros, expected):
    at = datetime(2024, 1, 1, 0, 0, 5, micros)
    assert one(identity.iso_text(F.col("at")), "at TIMESTAMP", at) == expected


def test_stable_decision_id(one):
    a = one(identity.stable_decision_id(L(" Demo "), L("OPP")))
    assert a == sha("demo|opp") == one(identity.stable_decision_id(L("demo"), L("opp ")))
    assert one(identity.stable_decision_id(L(" "), L(""))) is None


@pytest.mark.parametrize(
    ("raw", "encoded"),
    [("a b", "a%20b"), ("~*/", "~%2A%2F"), ("é:", "%C3%A9%3A"), ("A-z_0.", "A-z_0.")],
)
def test_percent_encode(one, raw, encoded):
    assert one(identity.percent_encode(L(raw))) == encoded


@pytest.mark.parametrize(
    ("content", "labels"),
    [
        ("Battery OVERHEATING again", ("battery_issue", "negative", "high")),
        ("my glow up tips", ("glow_up_challenge", "positive", "none")),
        ("a useful tutorial", ("product_tips", "positive", "none")),
        ("I hate mornings", ("lifestyle", "negative", "none")),
        (None, ("lifestyle", "neutral", "none")),
    ],
)
def test_rules(one, content, labels):
    c = F.col("x")
    got = tuple(
        one(f(c), "x STRING", content)
        for f in (text.classify_topic, text.classify_sentiment, text.classify_risk)
    )
    assert got == labels


def test_hashtags(one):
    found = text.extract_hashtags(L("#One mail#no #two-2 #One"), L("#Été #three"))
    assert one(found) == ["One", "two-2", "Été", "three"]
    assert one(text.extract_hashtags(L("#a #a"), distinct=False)) == ["a", "a"]


def test_severity_bands(one):
    assert [one(scoring.severity(L(v))) for v in (70.0, 45.0, 44.99)] == [
        "critical", "high", "info",
    ]
    assert one(scoring.brand_severity(L(0.1), L(10))) == "critical"
    assert one(scoring.brand_severity(L(0.25), L(0))) == "high"
    assert one(scoring.brand_severity(L(0.0), L(0))) == "info"
