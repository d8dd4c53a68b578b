"""Sharding, fill-in-the-middle frames and the Merkle manifest against brute force and round trips."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import common, fill_middle, manifest, sharding

from .conftest import CLASHING, prose


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Sharding


def placed(df):
    return {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.digest(df).collect()}


def stored(docs, **options):
    folder = common.shared_folder(docs.sparkSession)
    sharding.write_shards(docs, folder, **options)
    return sharding.read_shards(docs.sparkSession, folder, docs.schema)


@pytest.mark.parametrize(("bucket_bytes", "shards"), [(1 << 10, 8), (20_000, 100), (1 << 30, 1)])
def test_shards_hold_every_row_once_and_are_even(corpus, plain, bucket_bytes, shards):
    rows = sharding.digest(stored(corpus, shards=shards, bucket_bytes=bucket_bytes)).collect()
    raw = [(d, (t or "").encode()) for d, t in plain]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((d, len(t) + 1, zlib.crc32(t)) for d, t in raw)
    held = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(slots == list(range(len(slots))) for slots in held.values())
    counts = [len(slots) for slots in held.values()]
    assert sum(counts) == len(plain) and max(counts) - min(counts) <= 1


def test_all_columns_come_back(corpus, tuples):
    back = stored(corpus).select("doc.*")
    assert back.columns == corpus.columns and set(CLASHING) <= set(back.columns)
    assert tuples(back) == tuples(corpus)


def test_order_depends_on_rows_and_seed_alone(corpus):
    docs = corpus.filter("doc_id <> 10 AND doc_id IS NOT NULL")
    first = placed(sharding.shuffled(docs, bucket_bytes=4096))
    assert first == placed(sharding.shuffled(docs.repartition(7, "lang"), bucket_bytes=4096))
    assert first != placed(sharding.shuffled(docs, seed=1, bucket_bytes=4096))


def test_repeated_rows_scatter_like_others(spark):
    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    other = spark.range(1000).select((F.col("id") + 100).alias("doc_id"), F.lit("same text").alias("text"))
    docs = same.unionByName(other).repartition(5)
    rows = sharding.digest(sharding.shuffled(docs, bucket_bytes=800)).groupBy("shard").agg(
        F.count("*").alias("n"), F.sum((F.col("doc_id") == 7).cast("int")).alias("hot")
    )
    held = rows.collect()
    assert [r.n for r in held] == [500] * 8 and all(330 <= r.hot <= 420 for r in held)
    assert sharding._offsets(spark.createDataFrame([(b, 2) for b in range(9000)], "bucket INT, n LONG")).filter(
        "base <> 2 * bucket"
    ).count() == 0


def test_every_place_is_as_likely(spark):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    seen = Counter()
    for seed in range(12):
        rows = sharding.digest(sharding.shuffled(docs, 4, seed, 64)).collect()
        seen.update(r.shard for r in rows if r.doc_id < 16)
    assert sum(seen.values()) == 192 and all(20 < seen[s] < 80 for s in range(4))


def test_shards_of_an_empty_table(nothing):
    back = stored(nothing)
    assert back.count() == 0 and sharding.digest(back).columns[-1] == "grown_shard"


def test_no_python_in_the_sharding_plan_and_one_exchange_of_texts(corpus, plan_of):
    docs = common.settle(corpus.filter("doc_id <> 10 AND doc_id IS NOT NULL"))
    plan = plan_of(sharding.shuffled(docs, bucket_bytes=1 << 12))
    assert not re.search("Python|Arrow|Pandas", plan)
    assert plan.count("Exchange") - plan.count("BroadcastExchange") == 1, plan


# Fill in the middle


def units(text):
    return re.findall("[A-Za-z]+|[^A-Za-z]", text)


def middle_truth(doc_id, text):
    text = text or ""
    u = units(text)
    n, h = len(u), sha("1:", str(doc_id))
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text)), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text)), out


MARKED = ["a <P> b", "<S", "x<M>", "<", "P>", "<<P", "S>S>", "<P", "\x00\x7f", "🙂é" * 9, "z" * 300, "a" * 64 + "é" + "b" * 70]


@pytest.mark.parametrize("frame", [3, 64])
def test_outputs_match_brute_force(spark, corpus, plain, tuples, monkeypatch, frame):
    monkeypatch.setattr(fill_middle, "FRAME_BYTES", frame)
    small = [(d, t) for d, t in plain if len(t or "") < 5000 or frame > 60]
    rows = [(d, t) for d, t in small if d is not None] + [(500 + i, t) for i, t in enumerate(MARKED * 3)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").withColumns({c: F.lit("x") for c in CLASHING})
    store = common.shared_folder(spark)
    fill_middle.write_frames(docs.repartition(3), store)
    outputs = common.settle(fill_middle.outputs(spark, store))
    truth = [middle_truth(d, t) for d, t in rows]
    assert {t[2] for t, _ in truth} == {"plain", "psm", "spm"}
    assert tuples(fill_middle.digests(outputs)) == sorted((t for t, _ in truth), key=repr)
    texts = tuples(fill_middle.texts_of(outputs), "doc_id", "text")
    assert texts == sorted(((t[0], out) for t, out in truth), key=repr)
    assert tuples(fill_middle.texts_of(outputs, restore=True), "doc_id", "text") == sorted(
        ((d, t or "") for d, t in rows), key=repr
    )


def test_null_ids_and_empty_tables(corpus, nothing):
    rows = fill_middle.transformed(corpus.filter("doc_id IS NULL")).collect()
    assert sorted(r.n for r in rows)[0] == 0 and len(rows) == 2
    assert all(r.restored_sha256 == sha(t or "") for r, t in zip(sorted(rows, key=lambda r: r.n), (None, prose(6, 12))))
    assert fill_middle.transformed(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ <PSM>é\n🙂", max_size=80), st.integers(0, 90))
def test_cuts_read_one_frame(text, unit):
    held, fill_middle.FRAME_BYTES = fill_middle.FRAME_BYTES, 5
    try:
        frames = fill_middle.Frames.pack([text.encode()], zstandard.ZstdCompressor(3))
    finally:
        fill_middle.FRAME_BYTES = held
    calls = []
    read = frames._read
    frames._read = lambda data: calls.append(1) or read(data)
    u = units(text)
    before = "".join(u[:unit])
    assert frames.n == len(u) and frames.cut(unit) == (len(before.encode()), len(before)) and len(calls) <= 1
    assert b"".join(map(bytes, frames.stream(3, 11))) == text.encode()[3:11]


# Manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves):
    """Levels of a Merkle tree over runs of three."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def manifest_truth(rows):
    by_source, order = {}, lambda s: (s is not None, (s or "").encode())
    for r in rows:
        r = dict(r, leaf=sha(*(field(r[c]) for c in manifest.FIELDS)))
        lost = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
        text = r["text"].replace("\n", "") if lost else r["text"]
        r["claimed"] = sha(*(field(text if c == "text" else r[c]) for c in manifest.FIELDS))
        by_source.setdefault(r["source"], []).append(r)
    sources = sorted(by_source, key=order)
    for s in sources:
        by_source[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
    trees = [tree([r["leaf"] for r in by_source[s]]) for s in sources]
    crown = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(by_source[s]):
            path, d = siblings(trees[k], i) + siblings(crown, k), r["claimed"]
            for left, right in path:
                d = sha(left, d, right)
            proof = sha(*(a + b for a, b in path))
            out.append((r["doc_id"], r["leaf"], trees[k][-1][0], crown[-1][0], proof, d, d == crown[-1][0]))
    return sorted(out, key=repr)


def with_lengths(corpus):
    return corpus.withColumn("n_chars", F.length("text").cast("long"))


@pytest.mark.parametrize("band", [2, 6])
def test_proofs_match_brute_force(spark, corpus, tuples, monkeypatch, band):
    monkeypatch.setattr(manifest, "BAND", band)
    monkeypatch.setattr(manifest, "WIDTH", 3**band)
    more = spark.range(60).select(
        (F.col("id") + 1000).alias("doc_id"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("line\nof "), F.col("id").cast("string"))).alias("text"),
        F.when(F.col("id") % 5 > 0, F.lit("de")).alias("lang"),
        F.when(F.col("id") < 40, F.lit("hot")).otherwise(F.concat(F.lit("é"), (F.col("id") % 9).cast("string"))).alias("source"),
        F.col("id").alias("n_chars"),
    )
    docs = with_lengths(corpus).unionByName(more, allowMissingColumns=True).cache()
    rows = [r.asDict() for r in docs.select(*manifest.FIELDS).collect()]
    got = tuples(manifest.digest(manifest.proofs(docs, manifest.without_line_ends())))
    assert got == manifest_truth(rows)
    assert {r[-1] for r in got} == {True, False}
    intact = manifest.proofs(docs)
    assert intact.filter(manifest.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    docs.unpersist()


def test_a_lone_row_is_its_own_root(corpus, nothing):
    row = manifest.digest(manifest.proofs(with_lengths(corpus).filter("doc_id = 12"))).collect()
    assert len(row) == 1 and row[0].leaf == row[0].subroot == row[0].root == row[0].folded_root
    assert row[0].proof_sha256 == sha("") and row[0].verified
    assert manifest.digest(manifest.proofs(with_lengths(nothing))).count() == 0


def test_ranks_of_a_source_over_many_parts(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("g"), F.col("id").alias("x"))
    got = manifest.ranked(rows.repartition(6), F.col("x").desc()).collect()
    assert all(r.n == (3333 if r.g == "a" else 1667) for r in got)
    for g in "ab":
        own = sorted((r.lo, -r.x) for r in got if r.g == g)
        assert [lo for lo, _ in own] == list(range(len(own))) and np.all(np.diff([x for _, x in own]) > 0)
