"""Incremental, reversible line deduplication.

State of a corpus (`LineIndex`), all of it tables in the shared folder:

* ``refs``    per document the 128-bit keys of its long lines: what a deletion takes back;
* ``counts``  the exact reference counts: per key the number of documents and the largest doc_id;
* ``filters`` one cuckoo filter per shard of the key space over the keys that are *shared*, those
  that `min_docs` documents hold. Insertions that lift a key over that line add it, deletions that
  drop it below take it out again: a filter that cannot delete could not follow.

Deduplication asks the filters first, inside the scan, so only lines that may be shared go on to
the exact counts; a filter's false positive costs a lookup, never a line. Keys are counted by
(key, document) with map-side combining, so that a line which a third of all documents hold sends
one row per map task. The filters go to all executors while they measure below
`filter_limit` bytes together; beyond it every line takes the exact join, with the same result.

Rows of one doc_id count as one document. Null or empty text is one empty line. A null doc_id
counts as one document, smaller than all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, keyed, settle, texts
from tidemark.llm.cuckoo import CuckooFilter

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 1 << 17
FILTER_LIMIT = 32 << 20
BLANK_BYTES = b" \t\n\v\f\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line, None where its stripped form is too short to count."""
    core = line.strip(BLANK_BYTES)
    if len(core) < min_chars or (len(core) < 4 * min_chars and len(core.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(core.lower())


def _key_lists(min_chars: int):
    """Arrow function: the distinct line keys of each text as two lists of longs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for text in batch.column("text"):
                lines = text.as_py().encode().split(b"\n")
                keys = dict.fromkeys(line_key(line, min_chars) for line in lines)
                keys.pop(None, None)
                lists.append(b"".join(keys))
            ends = np.cumsum([0] + [len(x) // 16 for x in lists]).astype(np.int32)
            halves = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2)
            columns = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(halves[:, i])))
                for i in (0, 1)
            ]
            kept = [batch.column(c) for c in (*KEY, "doc_id")]
            yield pa.RecordBatch.from_arrays(kept + columns, names=[*KEY, "doc_id", "a", "b"])

    return scan


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    schema = f"{KEY[0]} LONG, {KEY[1]} LONG, doc_id LONG, a ARRAY<LONG>, b ARRAY<LONG>"
    return settle(keyed(docs, texts()).mapInArrow(_key_lists(min_chars), schema))


def _pairs(refs: DataFrame) -> DataFrame:
    return refs.select(*KEY, "doc_id", F.explode(F.arrays_zip("a", "b")).alias("k")).select(*KEY, "doc_id", "k.*")


def reference_counts(refs: DataFrame) -> DataFrame:
    """Exact counts: documents per key and the largest doc_id that holds it."""
    held = _pairs(refs).groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    return settle(held.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")))


def _shard(shards: int):
    return F.pmod(F.col("a"), F.lit(shards)).cast("int").alias("shard")


def build_filters(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """One filter per shard over the shared keys; a shard holds about SHARD_KEYS of them."""

    def build(keys: pd.DataFrame) -> pd.DataFrame:
        room = len(keys)
        while not (made := CuckooFilter.sized(room)).insert(keys.a.to_numpy(), keys.b.to_numpy()):
            room *= 2
        return pd.DataFrame({"shard": keys.shard[:1], "n_keys": [len(keys)], "filter": [made.dump()]})

    shared = counts.filter(F.col("n_docs") >= min_docs).select(_shard(shards), "a", "b")
    return settle(shared.groupBy("shard").applyInPandas(build, "shard INT, n_keys LONG, filter BINARY"))


def _change(before: DataFrame, after: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """Keys that became shared (+1) or stopped being shared (-1)."""
    old = before.filter(F.col("n_docs") >= min_docs).select("a", "b", F.lit(1).alias("old"))
    new = after.filter(F.col("n_docs") >= min_docs).select("a", "b", F.lit(1).alias("new"))
    both = old.join(new, ["a", "b"], "full")
    delta = F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))
    return both.select(_shard(shards), "a", "b", delta.alias("delta")).filter("delta != 0")


def update_filters(filters: DataFrame, changes: DataFrame, counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    """Insert and delete keys in the stored filters; a shard that runs full is built from the counts."""

    def apply(old: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
        plus, minus = delta[delta.delta > 0], delta[delta.delta < 0]
        keys = int(old.n_keys.sum()) + len(plus) - len(minus)
        made = CuckooFilter.load(old["filter"].iloc[0]) if len(old) else CuckooFilter.sized(keys)
        made.delete(minus.a.to_numpy(), minus.b.to_numpy())
        fits = keys <= 0.9 * made.table.size and made.insert(plus.a.to_numpy(), plus.b.to_numpy())
        shard = (old if len(old) else delta).shard.iloc[0]
        return pd.DataFrame({"shard": [shard], "n_keys": [keys], "filter": [made.dump() if fits else None]})

    schema = "shard INT, n_keys LONG, filter BINARY"
    updated = settle(filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, schema))
    full = updated.filter("filter IS NULL").select("shard")
    if full.isEmpty():
        return updated.filter("n_keys > 0")
    again = counts.withColumn("shard", _shard(shards)).join(full, "shard", "left_semi").drop("shard")
    return updated.filter("filter IS NOT NULL AND n_keys > 0").unionByName(build_filters(again, min_docs, shards))


@dataclass(frozen=True)
class LineIndex:
    """Lines of a corpus that grows and shrinks by documents; every change gives a new index."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def of(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineIndex:
        refs = line_refs(docs, min_chars)
        counts = reference_counts(refs)
        if shards is None:
            shards = 1 + counts.filter(F.col("n_docs") >= min_docs).count() // SHARD_KEYS
        return cls(refs, counts, build_filters(counts, min_docs, shards), shards, min_chars, min_docs)

    def _changed(self, refs: DataFrame) -> LineIndex:
        counts = reference_counts(refs)
        changes = _change(self.counts, counts, self.min_docs, self.shards)
        filters = update_filters(self.filters, changes, counts, self.min_docs, self.shards)
        return replace(self, refs=refs, counts=counts, filters=filters)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(settle(self.refs.unionByName(line_refs(docs, self.min_chars))))

    def remove(self, doc_ids: DataFrame) -> LineIndex:
        """Take documents back out, by doc_id: all that they added is undone."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        return self._changed(settle(self.refs.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")))

    def _suspects(self, refs: DataFrame, filter_limit: int) -> DataFrame:
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        if size > filter_limit:
            return refs
        filters = {r.shard: CuckooFilter.load(bytes(r["filter"])) for r in self.filters.collect()}
        shards = self.shards

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("a")
                ends = np.asarray(lists.offsets)
                a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in "ab")
                hit = np.zeros(len(a), bool)
                shard = np.mod(a, shards)
                for n, made in filters.items():
                    at = np.flatnonzero(shard == n)
                    hit[at] = made.contains(a[at], b[at])
                ends = np.concatenate([[0], np.cumsum(hit)])[ends - ends[0]].astype(np.int32)
                left = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[hit])) for x in (a, b)]
                kept = [batch.column(c) for c in (*KEY, "doc_id")]
                yield pa.RecordBatch.from_arrays(kept + left, names=[*KEY, "doc_id", "a", "b"])

        return refs.mapInArrow(screen, refs.schema)

    def dropped_keys(self, docs_refs: DataFrame, filter_limit: int = FILTER_LIMIT) -> DataFrame:
        """Per document the keys whose lines it loses: shared ones that a larger doc_id holds too."""
        shared = self.counts.filter(F.col("n_docs") >= self.min_docs).select("a", "b", "max_doc")
        lost = _pairs(self._suspects(docs_refs, filter_limit)).join(shared, ["a", "b"])
        # A document's rows may repeat, so a list holds each key once; it is bounded by the document.
        return (
            lost.filter(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
            .groupBy(*KEY)
            .agg(F.collect_set(F.struct("a", "b")).alias("lost"))
            .select(*KEY, F.col("lost.a").alias("a"), F.col("lost.b").alias("b"))
        )

    def dedup(
        self, docs: DataFrame, refs: DataFrame | None = None, filter_limit: int = FILTER_LIMIT, with_text: bool = True
    ) -> DataFrame:
        """Each row's text without the lines it loses: doc_id, n_lines, n_dropped, kept_sha256, kept_text.

        Without `with_text` the kept text is only hashed and does not travel back.
        """
        lost = self.dropped_keys(line_refs(docs, self.min_chars) if refs is None else refs, filter_limit)
        min_chars = self.min_chars

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for text, a, b in zip(batch.column("text"), batch.column("a"), batch.column("b")):
                    lines = text.as_py().encode().split(b"\n")
                    kept = lines
                    if a.is_valid:
                        halves = np.stack([x.values.to_numpy(zero_copy_only=False) for x in (a, b)], 1)
                        gone = {x.tobytes() for x in np.ascontiguousarray(halves)}
                        kept = [line for line in lines if line_key(line, min_chars) not in gone]
                    body = b"\n".join(kept)
                    made.append((len(lines), len(lines) - len(kept), hashlib.sha256(body).hexdigest(), body))
                if made:
                    counts, dropped, digests, bodies = zip(*made)
                    columns = [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests)]
                    if with_text:
                        columns.append(pa.array(bodies, pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

        names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *["kept_text"] * with_text]
        schema = "doc_id LONG, n_lines LONG, n_dropped LONG, kept_sha256 STRING" + ", kept_text STRING" * with_text
        return keyed(docs, texts()).join(lost, KEY, "left").mapInArrow(strip, schema)


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = True
) -> DataFrame:
    """A whole corpus at once: every document inserted, then every document deduplicated."""
    index = LineIndex.of(docs, min_chars, min_docs)
    return index.dedup(docs, index.refs, with_text=with_text)
