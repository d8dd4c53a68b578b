"""The corpus pipeline, stage by stage, and the registered queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontaminate, mixing, near_join, queries

from .conftest import CLASHING
from .test_scans import hit_truth, near_truth, token_truth

SMALL = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = common.documents(spark, SMALL)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.settle(stage(spark, docs, SMALL))
        seen[name] = (before, docs)
        assert name == "token_files" or docs.columns == columns
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    before, after = map(pairs, seen["language_id"])
    assert sorted(after) == sorted((d, t) for d, t in before if t and any(map(str.isalpha, t)))
    before, after = map(pairs, seen["near_duplicates"])
    assert {d for d, _ in after} == {r[0] for r in near_truth(before) if r[0] == r[1]}
    before, after = map(pairs, seen["decontamination"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert {d for d, _ in after} == {r[0] for r in hit_truth(before, items) if not r[5]}
    before, after = seen["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    got = [d for d, _ in pairs(after)]
    assert all(got.count(d) == n for d, n in want.items())
    before, after = seen["token_files"]
    assert sorted(tuple(r) for r in after.collect()) == sorted(token_truth(pairs(before)))


def test_stages_take_odd_rows_and_empty_tables(spark, corpus, nothing):
    kept = corpus_pipeline.language_stage(spark, corpus, SMALL)
    assert kept.columns == corpus.columns and kept.filter("text IS NULL").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
    assert near_join.one_per_group(corpus).count() < corpus.count()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.removed_documents(corpus, items).count() == corpus.count()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_callers_columns_and_rows_survive_every_stage(spark, corpus):
    """Values under clashing names, and rows that differ only in other columns."""
    odd = corpus.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("lang", F.lit("-"))) for c in CLASHING})
    twice = odd.filter("doc_id = 12").withColumns({"lang": F.lit("de"), "copies": F.lit("other")})
    docs = common.settle(odd.unionByName(twice))
    whole = set(rows_of(docs))
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    named = corpus_pipeline.language_stage(spark, docs, SMALL)
    assert rows_of(named) == rows_of(docs.filter(F.rlike("text", F.lit(r"\p{L}"))))
    assert rows_of(decontaminate.removed_documents(docs, items)) == rows_of(docs)
    passage = docs.filter("doc_id = 8").select(F.lit(1).alias("item_id"), "text")
    cleaned = decontaminate.removed_spans(docs, passage)
    assert rows_of(cleaned.drop("text")) == rows_of(docs.drop("text"))
    assert rows_of(decontaminate.removed_documents(docs, passage)) == rows_of(
        docs.filter("doc_id IS NULL OR doc_id NOT IN (7, 8)")
    )
    one = near_join.one_per_group(docs)
    assert set(rows_of(one)) <= whole and [r.lang for r in one.filter("doc_id = 12").collect()] == ["de"]
    mixed = mixing.mixed_documents(docs)
    assert set(rows_of(mixed)) <= whole
    decided = mixing.mix(docs).filter("doc_id = 12").agg(F.sum("copies")).first()[0]
    langs = sorted(r.lang for r in mixed.filter("doc_id = 12").collect())
    assert len(langs) == decided and abs(langs.count("de") - langs.count("en")) <= 1


def test_repeated_rows_are_mixed_in_groups_like_others(spark):
    docs = spark.range(900).select(
        F.lit(5).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 600, "x").otherwise("y").alias("source"),
    ).withColumn("mark", F.monotonically_increasing_id())
    mixed = mixing.mix(docs, group=100)
    goal = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    taken = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(taken[s] - goal[s]) <= 12 for s in goal)
    parts = mixing.mixed_documents(docs, group=100).groupBy("mark").count().agg(F.max("count"), F.count("*")).first()
    assert parts[0] <= 2 and 600 < parts[1] < 900  # of one source every row, of the other six in seven


def test_documents_with_letters_stay_whatever_the_number_of_families(spark):
    langs = [f"q{c}" for c in "abcdefghijkl"]
    rows = [(40 * n + i, f"{x}{x} {x}o", x, "a") for n, x in enumerate(langs) for i in range(40)]
    rows += [(9000 + i, x, None, "a") for i, x in enumerate(["ωψχ φυτ", "amber brook", "wvu", "12 !?", None])]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING")
    kept = corpus_pipeline.language_stage(spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows[:-2]]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns, key=lambda c: (c != "doc_id", c))
    frames = [x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want)]
    assert frames[0].equals(frames[1])
