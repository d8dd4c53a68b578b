import pytest
from pyspark.sql import functions as F

from tidemark.operators.merge import merge_upsert, source, target, unique_on, update_all

DDL = "k STRING, t STRING, v INT, note STRING"


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def old(rows):
    return rows(DDL, ("a", "x", 1, "old"), ("b", "x", 2, "old"), ("c", "y", 3, "old"))


@pytest.fixture
def new(rows):
    return rows("k STRING, t STRING, v INT", ("b", "x", 20), ("d", "x", 40))


def test_update_and_insert(old, new):
    merged = merge_upsert(old, new, ["k"], when_matched={"v": source("v")})
    assert table(merged) == [
        ("a", "x", 1, "old"), ("b", "x", 20, "old"), ("c", "y", 3, "old"),
        ("d", "x", 40, None),
    ]


def test_conditional_update_reads_both_sides(old, new):
    merged = merge_upsert(
        old,
        new,
        ["k"],
        when_matched={"v": target("v") + source("v"), "note": F.lit("sum")},
        matched_condition=source("v") > 100,
        insert=False,
    )
    assert table(merged) == table(old)
    merged = merge_upsert(
        old, new, ["k"], when_matched={"v": target("v") + source("v")}, insert=False
    )
    assert ("b", "x", 22, "old") in table(merged) and len(table(merged)) == 3


def test_insert_only_keeps_matched_rows(old, new):
    merged = merge_upsert(old, new, ["k"], insert_values={"note": F.lit("new")})
    assert table(merged) == [*table(old), ("d", "x", 40, "new")]


def test_not_matched_by_source_is_scoped(old, new):
    merged = merge_upsert(
        old,
        new,
        ["k"],
        when_matched=update_all(["v"], ["k"]),
        when_not_matched_by_source={"note": F.lit("gone")},
        not_matched_by_source_condition=target("t") == "x",
    )
    assert {r[0]: r[3] for r in table(merged)} == {
        "a": "gone", "b": "old", "c": "old", "d": None,
    }


def test_null_keys_never_match(rows):
    old = rows(DDL, (None, "x", 1, "old"), ("a", "x", 2, "old"))
    new = rows(DDL, (None, "x", 9, "new"), (None, "x", 9, "new"), ("a", "x", 3, "new"))
    merged = merge_upsert(old, new, ["k"], when_matched={"v": source("v")})
    assert table(merged) == sorted(
        [(None, "x", 1, "old"), (None, "x", 9, "new"), (None, "x", 9, "new"),
         ("a", "x", 3, "old")],
        key=repr,
    )
    inserted = merge_upsert(old, new, ["k"])
    assert inserted.count() == 4


@pytest.mark.parametrize("update", [False, True])
def test_duplicate_source_keys_fail(rows, old, update):
    clauses = {"when_matched": {"v": source("v")}} if update else {}
    twice = rows(DDL, ("z", "x", 1, ""), ("z", "x", 2, ""))
    with pytest.raises(Exception, match="several rows for key, z"):
        merge_upsert(old, twice, ["k"], **clauses).collect()


def test_twice_is_once(old, new):
    def run(df):
        return merge_upsert(df, new, ["k"], when_matched={"v": source("v")})

    assert table(run(run(old))) == table(run(old))


def test_two_column_keys(rows):
    old = rows(DDL, ("a", "x", 1, ""), ("a", "y", 2, ""))
    new = rows(DDL, ("a", "y", 5, ""), ("a", "z", 6, ""))
    merged = merge_upsert(old, new, ["k", "t"], when_matched=update_all(old.columns, ["k", "t"]))
    assert [r[:3] for r in table(merged)] == [("a", "x", 1), ("a", "y", 5), ("a", "z", 6)]


def test_unique_on_is_transparent(old):
    assert table(unique_on(old, ["k"])) == table(old)


def test_source_is_shuffled_once(spark, old, new, plan_of):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan_of(merge_upsert(old, new, ["k"], when_matched={"v": source("v")}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
