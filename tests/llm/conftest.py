import pytest
from pyspark.sql import functions as F

from tidemark.llm import common

WORDS = "amber brook cedar delta ember fjord grove heath islet jetty knoll lagoon mesa nook oasis".split()
#: Columns of the caller that clash with names the operators use themselves.
CLASHING = (
    "_k1", "_k2", "_k3", "_key", "w", "h", "block", "n", "size", "row", "name", "v", "root", "kept", "source_size",
    "_lang", "_score", "_text", "_hits", "_copy", "_copies", "copies", "copy", "doc", "hits", "items", "slot", "shard",
)


def prose(seed: int, count: int) -> str:
    """Words by a fixed rule; different seeds share no long passage."""
    out, state = [], seed * 7919 + 13
    for _ in range(count):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[state >> 16 & 15 % len(WORDS)] + str((state >> 8) % 97))
    return " ".join(out)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls, empty and very long texts, ties and repeated rows, with clashing extra columns."""
    long_text = prose(1, 30_000)
    passage = prose(2, 60)
    shared = "This very line is shared by many of the documents, word for word."
    rows = [
        (1, prose(3, 50), "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (4, " \t\n\x0b\x0c\r ", "de", "b"),
        (5, long_text, "en", "b"),
        (6, long_text, "en", None),
        (7, f"{prose(4, 30)} {passage} {prose(5, 20)}", "en", "a"),
        (8, f"{passage} {passage}", "fr", "a"),
        (None, prose(6, 12), "en", "c"),
        (None, None, None, None),
        (9, "Größe ÉTÉ İstanbul K\n\nßß", "de", "c"),
        (10, prose(7, 40), "en", "c"),
        (10, prose(7, 40), "en", "c"),
        (11, prose(7, 40).replace(" ", "  ", 3), "en", "c"),
        (12, "one", "en", "a"),
        (13, "!!! 123 ???", "en", "a"),
        *((n, f"{prose(n, 9)}\n  {shared.upper() if n % 2 else shared}\t\n{prose(n + 50, 8)}", "en", "d") for n in range(20, 27)),
        *((n, prose(8, 80) + f" tail{n}", "es", "d") for n in range(30, 36)),
    ]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")
    return df.withColumns({c: F.lit(f"x{i}") for i, c in enumerate(CLASHING)}).repartition(3)


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.filter(F.lit(False))


@pytest.fixture(scope="session")
def plain(corpus):
    """The corpus as (doc_id, text) pairs."""
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def tuples():
    """Rows of a frame as a sorted list of tuples."""

    def collect(df, *columns):
        rows = df.select(*columns).collect() if columns else df.collect()
        return sorted((tuple(r) for r in rows), key=repr)

    return collect
