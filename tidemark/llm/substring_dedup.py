"""Removal of long repeated passages, found by recompression.

*Rounds.* Every text is a string of words. A run round replaces maximal runs of one symbol by a new
symbol; a pair round splits all symbols into left and right ones by a bit of their name and
replaces each left symbol that is followed by a right one, together with it. Names are derived
from content alone, so all tasks name a run or pair alike. Which symbols are joined depends
only on near neighbours, hence equal passages get equal symbols in their interior, wherever
they stand. Each symbol carries its *context*: the words that decided its shape.

*Sharing.* A Spark round counts the symbols of at least `TESTED` words over the corpus. A symbol that
occurs once proves that any window around its context occurs once: the same window elsewhere would
have made the same symbol again. Windows without such a proof are candidates.

*Verification.* Candidates are named by 128 bits of their whole word sequence and counted over the
corpus; those that occur at least twice repeat, exactly. The rounds only save work: a clash of two
symbols' 64-bit names costs a candidate more, and never changes the result.

Documents lie in blocks of about `BLOCK_BYTES`; what a block needs from the corpus comes to it as one
row per symbol or window *and block*, so a passage that a third of all documents share sends
a row per block and not one per occurrence.

Null and empty texts have no words. Repeated rows are documents of their own, so all their windows
repeat. Texts with fewer words than a window stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import KEY, keyed, settle, sliced, texts

WINDOW = 35
BLOCK_BYTES = 12 << 20
#: What is split into words at a time: a worker takes about 40 bytes per byte of it.
SLICE_BYTES = 2 << 20
ROUNDS = ("runs", "pairs", "pairs", "pairs", "pairs", "pairs")
LONGEST = 12
TESTED = 3

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_FAR = np.int64(1 << 40)


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Words:
    """Word sequences of several texts, end to end, with two 64-bit names per word."""

    def __init__(self, texts: list[bytes]):
        number = _Numbers()
        self.words = [x.split() for x in texts]
        self.counts = np.array([len(x) for x in self.words], np.int64)
        numbers = chain.from_iterable(map(number.__getitem__, own) for own in self.words)
        flat = np.fromiter(numbers, np.int64, int(self.counts.sum()))
        names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), np.uint64).reshape(-1, 2)
        self.first, self.second = names[flat, 0], names[flat, 1]
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ODD[0] + (b ^ (b >> np.uint64(29))) * _ODD[1]
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    return x ^ (x >> np.uint64(29))


class Symbols:
    """One level of the recompression: name, first word, end word, context and text of each symbol."""

    def __init__(self, words: Words):
        place = np.arange(len(words.first), dtype=np.int64)
        self.name, self.start, self.end = words.first, place, place + 1
        self.low, self.high = place, place + 1
        self.text = np.repeat(np.arange(len(words.counts)), words.counts)

    def _beside(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether i and i+1 are of one text; the context's low end before and high end behind each."""
        joined = self.text[1:] == self.text[:-1]
        before = np.concatenate([[-_FAR], np.where(joined, self.low[:-1], -_FAR)])
        behind = np.concatenate([np.where(joined, self.high[1:], _FAR), [_FAR]])
        return joined, before, behind

    def _merge(self, heads: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Symbols from one head to the next become one."""
        last = np.append(heads[1:], len(self.name)) - 1
        self.name, self.start, self.end, self.text = name, self.start[heads], self.end[last], self.text[heads]
        self.low, self.high = low, high

    def runs(self) -> None:
        joined, before, behind = self._beside()
        same = joined & (self.name[1:] == self.name[:-1])
        heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
        last = np.append(heads[1:], len(self.name)) - 1
        size = (last - heads + 1).astype(np.uint64)
        name = np.where(size > 1, _mixed(self.name[heads], size), self.name[heads])
        self._merge(heads, name, np.minimum(self.low[heads], before[heads]), np.maximum(self.high[last], behind[last]))

    def pairs(self, number: int) -> None:
        joined, before, behind = self._beside()
        left = (self.name * _ODD[number % 3] >> np.uint64(40 + number)) & np.uint64(1) == 0
        fits = self.end[1:] - self.start[:-1] <= LONGEST
        pair = joined & left[:-1] & ~left[1:] & fits
        second = np.concatenate([[False], pair])
        first = np.append(pair, False)
        heads = np.flatnonzero(~second)
        two = first[heads]
        after = np.minimum(heads + 1, len(self.name) - 1)
        name = np.where(two, _mixed(self.name[heads], self.name[after]), self.name[heads])
        # A symbol left alone shows what stands on the side where it could have joined.
        low = np.where(two | left[heads], self.low[heads], np.minimum(self.low[heads], before[heads]))
        high = np.where(
            two, self.high[after], np.where(left[heads], np.maximum(self.high[heads], behind[heads]), self.high[heads])
        )
        low = np.where(two, np.minimum(low, self.low[after]), low)
        high = np.where(two, np.maximum(high, self.high[heads]), high)
        self._merge(heads, name, low, high)


def recompress(words: Words) -> Symbols:
    symbols = Symbols(words)
    if len(symbols.name):
        for number, kind in enumerate(ROUNDS):
            symbols.runs() if kind == "runs" else symbols.pairs(number)
    return symbols


def tested(symbols: Symbols) -> np.ndarray:
    """Symbols that are counted: long enough to be rare, decided inside of some window."""
    return (symbols.end - symbols.start >= TESTED) & (symbols.high - symbols.low <= WINDOW)


def candidate_starts(words: Words, symbols: Symbols, once: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold no whole context of a symbol that occurs once."""
    n = len(words.first)
    edge = np.zeros(n + 2, np.int64)
    low, high = symbols.low[once], symbols.high[once]
    np.add.at(edge, np.maximum(high - WINDOW, 0), 1)
    np.add.at(edge, low + 1, -1)
    free = np.cumsum(edge[:n]) == 0
    room = np.repeat(words.ends, words.counts) - np.arange(n) >= WINDOW
    return np.flatnonzero(free & room)


def window_names(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the word sequences of windows: two polynomials modulo 2**64."""
    out = []
    for values, odd in ((words.first, _ODD[0]), (words.second, _ODD[1])):
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        up = np.multiply.accumulate(np.full(len(values), odd, np.uint64))
        down = np.multiply.accumulate(np.full(len(values), inverse, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * down, dtype=np.uint64)])
        out.append((sums[starts + WINDOW] - sums[starts]) * up[starts])
    return out[0].view(np.int64), out[1].view(np.int64)


def _bytes(column) -> list[bytes]:
    return [x.as_py().encode() for x in column]


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, and how often each occurs."""
    order = np.lexsort(columns)
    columns = [c[order] for c in columns]
    if not len(order):
        return list(columns), np.zeros(0, np.int64)
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    heads = np.flatnonzero(new)
    return [c[heads] for c in columns], np.diff(np.append(heads, len(order)))


def _symbol_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in sliced(batches, "text", SLICE_BYTES):
        symbols = recompress(Words(_bytes(piece.column("text"))))
        own = tested(symbols)
        blocks = piece.column("block").to_numpy()[symbols.text[own]]
        (names, blocks), counts = _counted(symbols.name[own].view(np.int64), blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array(blocks, pa.int32()), pa.array(counts, pa.int64())], names=["h", "block", "n"]
        )


def _by_slice(work, docs: pd.DataFrame, *more) -> pd.DataFrame:
    """The work over slices of a block's documents; each text is worked on by itself."""
    sizes = docs.text.str.len().to_numpy(np.int64)
    numbers = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    return pd.concat([work(own, *more) for _, own in docs.groupby(numbers)] or [work(docs, *more)], ignore_index=True)


def _screen(docs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """Candidate windows of a block's documents; a document without any is finished."""
    return _by_slice(_screened, docs, np.sort(shared.h.to_numpy()))


def _screened(docs: pd.DataFrame, known: np.ndarray) -> pd.DataFrame:
    words = Words([x.encode() for x in docs.text])
    symbols = recompress(words)
    own = tested(symbols)
    names = symbols.name.view(np.int64)
    at = np.minimum(np.searchsorted(known, names), max(0, len(known) - 1))
    once = own & (known[at] != names if len(known) else True)
    starts = candidate_starts(words, symbols, once)
    bounds = np.searchsorted(starts, np.append(words.starts, len(words.first)))
    open_ = np.diff(bounds) > 0
    local = [
        (starts[a:b] - s).astype(np.int32).tobytes() if b > a else None
        for a, b, s in zip(bounds[:-1], bounds[1:], words.starts)
    ]
    return pd.DataFrame(
        {
            "block": docs.block.to_numpy(),
            "doc_id": docs.doc_id.astype("Int64").to_numpy(),
            "n_words": words.counts,
            "starts": local,
            "text": [x if o else None for x, o in zip(docs.text, open_)],
            "kept_sha256": [
                None if o else hashlib.sha256(b" ".join(w)).hexdigest() for w, o in zip(words.words, open_)
            ],
        }
    )


def _window_starts(words: Words, starts: list[bytes]) -> np.ndarray:
    return np.concatenate(
        [np.frombuffer(x, np.int32).astype(np.int64) + s for x, s in zip(starts, words.starts)] or [np.zeros(0, np.int64)]
    )


def _window_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in sliced(batches, "text", SLICE_BYTES):
        words = Words(_bytes(piece.column("text")))
        starts = _window_starts(words, piece.column("starts").to_pylist())
        owner = np.searchsorted(words.ends, starts, side="right")
        blocks = piece.column("block").to_numpy()[owner]
        (g, h, blocks), counts = _counted(*window_names(words, starts), blocks)
        yield pa.RecordBatch.from_arrays(
            [pa.array(g), pa.array(h), pa.array(blocks, pa.int32()), pa.array(counts, pa.int64())],
            names=["g", "h", "block", "n"],
        )


def _strip(docs: pd.DataFrame, once: pd.DataFrame) -> pd.DataFrame:
    """Texts of a block without the words that a repeated window covers."""
    return _by_slice(_stripped, docs, _named(once.g.to_numpy(np.int64), once.h.to_numpy(np.int64)))


def _named(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.stack([g, h], 1).view([("g", np.int64), ("h", np.int64)]).ravel()


def _stripped(docs: pd.DataFrame, alone: np.ndarray) -> pd.DataFrame:
    words = Words([x.encode() for x in docs.text])
    starts = _window_starts(words, list(docs.starts))
    pairs = _named(*window_names(words, starts))
    starts = starts[~np.isin(pairs, alone)]
    edge = np.zeros(len(words.first) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept = [
        b" ".join(w for w, x in zip(own, gone[s:e].tolist()) if not x)
        for own, s, e in zip(words.words, words.starts, words.ends)
    ]
    removed = np.concatenate([[0], np.cumsum(gone)])
    return pd.DataFrame(
        {
            "doc_id": docs.doc_id.astype("Int64").to_numpy(),
            "n_words": words.counts,
            "n_removed": removed[words.ends] - removed[words.starts],
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
            "kept_text": [x.decode() for x in kept],
        }
    )


def _total(rows: DataFrame, *names: str) -> DataFrame:
    """The rows with the corpus-wide count of their name; a name has a row per block and task at most."""
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy(*names)))


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept_text where words were removed."""
    read = keyed(docs, texts())
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64(*KEY), F.lit(1 + size // block_bytes)).cast("int").alias("block")
    read = read.select(block, "doc_id", "text")

    counts = read.select("block", "text").mapInArrow(_symbol_counts, "h LONG, block INT, n LONG")
    shared = _total(counts, "h").filter("total > 1").select(F.col("block").alias("b"), "h")
    screened = settle(
        read.groupBy("block")
        .cogroup(shared.groupBy("b"))
        .applyInPandas(
            _screen, "block INT, doc_id LONG, n_words LONG, starts BINARY, text STRING, kept_sha256 STRING"
        )
    )
    open_ = screened.filter("text IS NOT NULL")
    names = open_.select("block", "text", "starts").mapInArrow(_window_counts, "g LONG, h LONG, block INT, n LONG")
    once = _total(names, "g", "h").filter("total = 1").select(F.col("block").alias("b"), "g", "h")
    done = screened.filter("text IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text")
    )
    stripped = (
        open_.select("block", "doc_id", "text", "starts")
        .groupBy("block")
        .cogroup(once.groupBy("b"))
        .applyInPandas(_strip, "doc_id LONG, n_words LONG, n_removed LONG, kept_sha256 STRING, kept_text STRING")
    )
    return done.unionByName(stripped)
