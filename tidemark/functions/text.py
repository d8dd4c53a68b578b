"""Rule-based text labels and hashtag extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered (label, pattern) rules of enrichment version "rules-v1".
ENRICHMENT_VERSION = "rules-v1"
TOPIC_RULES = (
    ("battery_issue", "overheating|poor charging|problem|issue"),
    ("glow_up_challenge", "glow up"),
    ("product_tips", "tips|tutorial|setup"),
)
TOPIC_DEFAULT = "lifestyle"
SENTIMENT_RULES = (
    ("negative", "overheating|poor charging|problem|issue|hate|broken"),
    ("positive", "inspiration|useful|glow up|love|great"),
)
SENTIMENT_DEFAULT = "neutral"
RISK_RULES = (("high", "overheating|poor charging"),)
RISK_DEFAULT = "none"
# Fixed value: a hash sign not preceded by a word character, then word characters or dashes.
HASHTAG_PATTERN = r"(?U)(?<!\w)#([\w-]+)"


def sorted_json(text: Column) -> Column:
    """The same JSON with object keys in order; text that is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def fill(template: str, *values: Column | str) -> Column:
    """The template with ``{}`` replaced by the values; NULL when a value is NULL."""
    texts = template.split("{}")
    parts: list[Column | str] = [F.lit(texts[0])]
    for value, text in zip(values, texts[1:], strict=True):
        parts += [value, F.lit(text)]
    return F.concat(*parts)


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern occurs in ``text``."""
    label = F.when(F.lit(False), F.lit(default))
    for name, pattern in rules:
        label = label.when(text.rlike(pattern), F.lit(name))
    return label.otherwise(F.lit(default))


def classify_topic(text: Column) -> Column:
    return first_match(F.lower(text), TOPIC_RULES, TOPIC_DEFAULT)


def classify_sentiment(text: Column) -> Column:
    return first_match(F.lower(text), SENTIMENT_RULES, SENTIMENT_DEFAULT)


def classify_risk(text: Column) -> Column:
    return first_match(F.lower(text), RISK_RULES, RISK_DEFAULT)


def extract_hashtags(*texts: Column, distinct: bool = True) -> Column:
    """Hashtags of the texts in order of appearance, without the hash sign."""
    found = [
        F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(HASHTAG_PATTERN), F.lit(1))
        for t in texts
    ]
    tags = found[0] if len(found) == 1 else F.concat(*found)
    return F.array_distinct(tags) if distinct else tags
