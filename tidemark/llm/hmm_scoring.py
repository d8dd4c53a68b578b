"""Language-model scores from a hidden Markov model.

*Corpus.* One pass cuts the documents into blocks of about `BLOCK_BYTES` of text and writes, per
block, the token ids over the block's own vocabulary together with that vocabulary and its training
counts. Words then meet their corpus-wide counts once per block that holds them, not once per
token, and no task ever holds the vocabulary of the corpus.

*Model.* A state emits symbols: each of the `FREQUENT` commonest words is one, all others share `BUCKETS` hash
classes. Inside of its class every training word has a probability of its own in every state: it follows from
J = (c + 1) (E + k r) / (c + k), with c its training count, E its expected count in the state, r the share of
the state in its class and k = `SHRINK`; so a rare word leans on its class and a commoner one on its own counts.
One slot in each class is for all words never seen. The counts E are a table by word and state that grows with
the vocabulary; the symbols' table, start and moves, and the sums of J by class and state are of fixed size.

*Training.* Baum-Welch: every task runs the scaled forward-backward recursion over its blocks. All training
documents take part in every round; long ones as stretches of `STRETCH` tokens, whose first state follows
the overall occupancy of the states. Rounds over the symbols part the states and go on until one gains less
than `TOLERANCE` of the log likelihood. A last pass gathers E for every word: a block keeps those of words that
no other block holds; the others are added up by word along `links`, which say where in the blocks'
vocabularies a word stands, and return to each block. They travel as shares of the word's count in 16 bits.
Blocks lie in buckets, so that messages come to them and they do not move.

*Score.* The scaled forward recursion over the whole text, end included: its exact log10 probability.

Null and empty texts are one end token. A null doc_id is never held out. Repeated rows count and
are scored each. Without training tokens, all words are unknown.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, settle, shared_folder, sliced, texts

BLOCK_BYTES = 32 << 20
#: Tokens that run through the recursions side by side.
CHUNK = 1 << 20
STATES = 6
#: Least rounds; more follow until one gains less than TOLERANCE of the log likelihood.
ROUNDS = 3
TOLERANCE = 0.005
FREQUENT = 1 << 15
BUCKETS = 1 << 12
STRETCH = 1024
PIECE = 1024
PART_WORDS = 1 << 19
PARTS = 64
PRIOR = 1.0
SHRINK = 2.0
SEED = 11

BLOCKS = (
    "block LONG, doc_ids ARRAY<LONG>, held ARRAY<BOOLEAN>, lengths ARRAY<INT>, ids BINARY, "
    "words ARRAY<BINARY>, counts ARRAY<LONG>"
)


class _Vocabulary(dict):
    """Numbers words in order of appearance; the end token is number 0."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def corpus_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, out=None) -> DataFrame:
    """Blocks of documents as ids over their own vocabulary, with its training counts."""
    schema = pa.schema(
        [("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_()))]
        + [("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("words", pa.list_(pa.binary()))]
        + [("counts", pa.list_(pa.int64()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, piece in enumerate(sliced(batches, "text", block_bytes)):
            number, ids = _Vocabulary(), []
            get = number.__getitem__
            for text in piece.column("text"):
                own = np.array([*map(get, text.as_py().encode().lower().split()), 0], np.int32)
                ids.append(own)
            lengths = np.array([len(x) for x in ids], np.int32)
            held = np.array(piece.column("held").to_pylist(), bool)
            flat = np.concatenate(ids)
            counts = np.bincount(flat[~np.repeat(held, lengths)], minlength=len(number))
            row = [(part << 32) + seq, piece.column("doc_id").to_pylist(), held.tolist(), lengths.tolist()]
            row += [_packed(flat), list(number), counts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    out = held_out(7, 2) if out is None else out
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held"), texts())
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return _bucketed(read.mapInArrow(encode, BLOCKS), max(8, -(-size // block_bytes)))


def _bucketed(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks as a scratch table bucketed by their number: what joins them on it moves alone."""
    spark, folder = blocks.sparkSession, shared_folder(blocks.sparkSession)
    name = "llm_blocks_" + folder.rsplit("-", 1)[1]
    blocks.write.bucketBy(buckets, "block").option("path", folder).saveAsTable(name)
    return spark.table(name)


def _packed(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers as compressed byte planes: all lowest bytes first, the nearly empty high ones last."""
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _tokens(packed: bytes, kind: str = "<i4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def word_totals(blocks: DataFrame) -> DataFrame:
    """Training count of every word of the corpus."""
    pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.*")
    return settle(pairs.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")))


@dataclass(frozen=True)
class Alphabet:
    """Symbols of the model and the share of a word within its class."""

    frequent: dict[bytes, int]
    tokens: int
    distinct: int
    totals: np.ndarray  # training tokens per symbol
    kinds: np.ndarray  # distinct training words per symbol

    @property
    def buckets(self) -> int:
        return len(self.totals) - len(self.frequent)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        low, get = len(self.frequent), self.frequent.get
        known = np.array([get(w, -1) for w in words], np.int64)
        classes = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % self.buckets
        return np.where(known < 0, low + classes, known)

    def within(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each word within its symbol; a frequent word is its symbol."""
        share = (counts + 1) / (self.totals[symbols] + self.kinds[symbols] + 1)
        return np.where(symbols < len(self.frequent), 0.0, np.log10(share))


def alphabet(totals: DataFrame, frequent: int = FREQUENT, buckets: int = BUCKETS) -> Alphabet:
    """Chosen by exact counts; what comes to the driver is bounded by the two parameters.

    The frequent words are all those from some count on, as many as fit into `frequent`.
    """
    spark = totals.sparkSession
    known = totals.filter("c > 0")
    sums = known.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    # A histogram of counts on a log scale shows from which count on the words are few enough.
    scale = F.floor(F.log2("c") * 16)
    bars = sorted(known.groupBy(scale.alias("b")).count().collect(), key=lambda r: -r.b)
    ends = np.cumsum([r["count"] for r in bars])
    edge = next((r.b for r, n in zip(bars[::-1], ends[::-1]) if n <= frequent), None)
    top = known.filter("word != X''").filter(scale >= edge).collect() if edge is not None else []
    top.sort(key=lambda r: (-r.c, bytes(r.word)))
    end = known.filter("word = X''").first()
    rows = [(b"", end.c if end else 0), *((bytes(r.word), r.c) for r in top)]
    named = spark.createDataFrame([(bytearray(w),) for w, _ in rows], "word BINARY")
    rest = known.join(F.broadcast(named), "word", "left_anti")
    classes = rest.groupBy((F.crc32("word") % buckets).alias("b")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    sizes, kinds = np.zeros(len(rows) + buckets), np.zeros(len(rows) + buckets)
    sizes[: len(rows)] = [c for _, c in rows]
    kinds[: len(rows)] = 1
    for r in classes.collect():
        sizes[len(rows) + r.b], kinds[len(rows) + r.b] = r.n, r.v
    return Alphabet({w: i for i, (w, _) in enumerate(rows)}, sums.n or 0, sums.v or 0, sizes, kinds)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    occupancy: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # symbol x state


def first_model(symbols: Alphabet, states: int = STATES) -> Model:
    """Unigram emissions, shaken apart so that the states can part, and states that persist."""
    rng = np.random.default_rng(SEED)
    base = _base(symbols)
    emits = base[:, None] * np.exp(0.5 * rng.standard_normal((len(base), states)))
    moves = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return Model(even, even, moves, emits / emits.sum(0))


def _base(symbols: Alphabet) -> np.ndarray:
    return (symbols.totals + 1) / (symbols.totals + 1).sum()


def _laid_out(lengths: np.ndarray) -> tuple:
    """Order of work of many sequences side by side, longest first.

    Returns the order, how many sequences live at each step, where each step begins, and the place of
    every token when all first tokens come first, then all second ones, and so on.
    """
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")
    offsets = np.concatenate([[0], np.cumsum(live)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return order, live.tolist(), offsets.tolist(), offsets[step] + np.repeat(rank, lengths)


def forward(model: Model, symbols: np.ndarray, lengths: np.ndarray, first: np.ndarray, kind=np.float64) -> tuple:
    """Scaled forward recursion of many sequences side by side, states by tokens in the order of work.

    `first` has the distribution of each sequence's first state. Returns the scaled forward probabilities,
    the scales, the emissions, the symbols in the order of work, and that order.
    """
    layout = order, live, offsets, to = _laid_out(lengths)
    laid = np.empty(len(symbols), np.int64)
    laid[to] = symbols
    emits = np.take(np.ascontiguousarray(model.emits.T, kind), laid, axis=1)
    alpha, scale = np.empty_like(emits), np.empty(len(symbols), kind)
    now, moves = np.ascontiguousarray(first[order].T, kind), np.ascontiguousarray(model.moves.T, kind)
    for step, n in enumerate(live):
        at = slice(offsets[step], offsets[step] + n)
        now = (now if step == 0 else moves @ now[:, :n]) * emits[:, at]
        total = now.sum(0)
        now /= total
        alpha[:, at], scale[at] = now, total
    return alpha, scale, emits, laid, layout


def log10_probability(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of symbols."""
    first = np.broadcast_to(model.start, (len(lengths), len(model.start)))
    _, scale, _, _, (_, _, _, to) = forward(model, symbols, lengths, first)
    return np.add.reduceat(np.log10(scale)[to], np.cumsum(lengths) - lengths)


def expected_counts(
    model: Model, symbols: np.ndarray, lengths: np.ndarray, opening: np.ndarray, kind=np.float64
) -> tuple:
    """Baum-Welch counts: first states, moves, emissions (symbol x state), log10 probability.

    `opening` says which sequences open a text; the others follow the states' occupancy.
    """
    first = np.where(opening[:, None], model.start, model.occupancy)
    gamma, scale, emits, laid, (order, live, offsets, _) = forward(model, symbols, lengths, first, kind)
    states, matrix = len(model.start), np.ascontiguousarray(model.moves, kind)
    moves, later = np.zeros((states, states)), np.zeros((states, 0), kind)
    for step in range(len(live) - 1, -1, -1):
        n, at = live[step], slice(offsets[step], offsets[step] + live[step])
        beta, alive = np.ones((states, n), kind), later.shape[1]
        if alive:
            moves += gamma[:, offsets[step] : offsets[step] + alive] @ later.T
            beta[:, :alive] = matrix @ later
        gamma[:, at] *= beta
        later = emits[:, at] * beta / scale[at]
    heads = gamma[:, : len(order)][:, opening[order]].sum(1, dtype=float)
    emitted = np.stack([np.bincount(laid, g, minlength=len(model.emits)) for g in gamma], 1)
    return heads, moves * model.moves, emitted, float(np.log10(scale, dtype=float).sum())


def _chunks(lengths: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """Runs of sequences of about CHUNK tokens, and their tokens."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        before = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield slice(first, last), slice(before, int(ends[last - 1]))
        first = last


def _gathered(model: Model, symbols: np.ndarray, lengths: np.ndarray) -> tuple:
    """Expected counts of whole texts, cut into stretches."""
    cut, opening = _stretches(lengths)
    found = None
    for some, tokens in _chunks(cut):
        own = expected_counts(model, symbols[tokens], cut[some], opening[some], np.float32)
        found = own if found is None else tuple(a + b for a, b in zip(found, own))
    return found


def _stretches(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the training stretches and whether each opens a text."""
    pieces = -(-lengths // STRETCH)
    opening = np.zeros(int(pieces.sum()), bool)
    opening[np.cumsum(pieces) - pieces] = True
    cut = np.full(len(opening), STRETCH)
    cut[np.cumsum(pieces) - 1] = lengths - (pieces - 1) * STRETCH
    return cut, opening


def _step(blocks: DataFrame, symbols: Alphabet, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all training documents."""
    states = len(model.start)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        emitted, head, loglik = np.zeros_like(model.emits), np.zeros((states + 1, states)), 0.0
        for batch in batches:
            for row in batch.to_pylist():
                keep = ~np.array(row["held"], bool)
                lengths = np.array(row["lengths"], np.int64)
                tokens = _tokens(row["ids"])[np.repeat(keep, lengths)]
                if not len(tokens):
                    continue
                own = symbols.symbols(row["words"])[tokens]
                first, moves, emits, fit = _gathered(model, own, lengths[keep])
                emitted += emits
                head += np.vstack([first, moves])
                loglik += fit
        part = TaskContext.get().partitionId()
        pieces = [(-1, np.append(head.ravel(), loglik))]
        pieces += [(i, emitted[i : i + PIECE].ravel()) for i in range(0, len(emitted), PIECE)]
        yield pa.RecordBatch.from_pylist(
            [{"piece": n, "part": part, "sums": x.tobytes()} for n, x in pieces],
            schema=pa.schema([("piece", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())]),
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")  # a fixed order, so reruns add up to the same bits
        total = sum(np.frombuffer(x, float) for x in rows.sums)
        return pd.DataFrame({"piece": rows.piece[:1], "sums": [total.tobytes()]})

    read = blocks.select("held", "lengths", "ids", "words")
    counts = read.mapInArrow(count, "piece INT, part INT, sums BINARY")
    counts = counts.groupBy("piece").applyInPandas(add, "piece INT, sums BINARY").collect()  # of fixed size
    sums = {r.piece: np.frombuffer(bytes(r.sums), float) for r in counts}
    if not sums:
        return model, 0.0
    head = sums.pop(-1)
    head, loglik = head[:-1].reshape(states + 1, states), float(head[-1])
    emitted = np.concatenate([sums[n] for n in sorted(sums)]).reshape(-1, states)
    smooth = lambda x: (x + 1) / (x + 1).sum(-1, keepdims=True)
    # PRIOR pseudo-counts per symbol, drawn towards the unigram: much in a small corpus, little in a large one.
    share = emitted.sum(0)
    prior = PRIOR * len(emitted) * share / share.sum()
    emits = (emitted + prior * _base(symbols)[:, None]) / (share + prior)
    return Model(smooth(head[0]), smooth(emitted.sum(0)), smooth(head[1:]), emits), loglik


def _until_settled(step: Callable, model, least: int, rounds: int | None):
    """Rounds as many as asked for; without a number `least` at least, then until the gain is below TOLERANCE."""
    done, last = 0, -math.inf
    while rounds is None or done < rounds:
        model, fit = step(model)
        done += 1
        if rounds is None and done >= least and fit - last < TOLERANCE * abs(fit):
            break
        last = fit
    return model


def train(blocks: DataFrame, symbols: Alphabet, states: int = STATES, rounds: int | None = None) -> Model:
    model = first_model(symbols, states)
    if not symbols.tokens:
        return model
    return _until_settled(lambda m: _step(blocks, symbols, m), model, ROUNDS, rounds)


LINKS = "part INT, at LONG, codes BINARY, owns BINARY, places BINARY"
NEWS = "at LONG, part INT, places BINARY, totals BINARY, sums BINARY"
SHARES = 65_535


def links(blocks: DataFrame, symbols: Alphabet) -> DataFrame:
    """Rare words of several blocks, in parts of about `PART_WORDS` places by hash of the word.

    A row of a block has the words' numbers in the part, their training counts in the block and their places
    in its vocabulary; the row with `at` -1 has count and class of each word over the corpus. Frequent
    words are left out, so no word is in more blocks than it has tokens below that bar.
    """
    spark, buckets = blocks.sparkSession, symbols.buckets
    spots = blocks.select(F.col("block").alias("at"), F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x"))
    frequent = spark.createDataFrame([(bytearray(w),) for w in symbols.frequent], "word BINARY")
    spots = spots.select("at", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("own"))
    spots = spots.join(F.broadcast(frequent), "word", "left_anti")  # at most FREQUENT words
    places = blocks.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    part = F.pmod(F.xxhash64("word"), F.lit(max(PARTS, -(-places // PART_WORDS)))).cast("int").alias("part")

    def number(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "place"])
        codes, words = pd.factorize(rows.word)
        totals = np.bincount(codes, rows.own).astype(np.int64)
        shared = (np.bincount(codes) > 1) & (totals > 0)
        renumbered = np.cumsum(shared) - 1
        kept = shared[codes]
        codes, at = renumbered[codes[kept]], rows["at"].to_numpy()[kept]
        own, place = rows.own.to_numpy()[kept], rows.place.to_numpy()[kept]
        heads = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.zeros(0, np.int64)
        cut = lambda x, kind: [_packed(p, kind) for p in np.split(x, heads[1:])] if len(at) else []
        classes = np.array([zlib.crc32(w) % buckets for w in words[shared]], np.int64)
        return pd.DataFrame(
            {
                "part": np.full(len(heads) + 1, rows.part.iloc[0], np.int32),
                "at": np.append(at[heads], -1),
                "codes": [*cut(codes, "<i4"), None],
                "owns": [*cut(own, "<i8"), _packed(totals[shared], "<i8")],
                "places": [*cut(place, "<i4"), _packed(classes)],
            }
        )

    return settle(spots.select(part, "at", "place", "word", "own").groupBy("part").applyInPandas(number, LINKS))


def _shares(sums: np.ndarray, counts: np.ndarray) -> bytes:
    """Expected counts by state as shares of the count, in 16 bits each."""
    part = sums / np.maximum(counts, 1)[:, None]
    return _packed(np.clip(np.rint(part * SHARES), 0, SHARES).ravel(), "<u2")


def _sums(shares: bytes, counts: np.ndarray, states: int) -> np.ndarray:
    return _tokens(shares, "<u2").reshape(-1, states) * (counts[:, None] / SHARES)


def class_shares(symbols: Alphabet, model: Model) -> np.ndarray:
    """Share of each state in each class of rare words."""
    joint = model.emits[len(symbols.frequent) :] * model.occupancy
    return joint / joint.sum(1, keepdims=True)


def _leaning(sums: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """J of words from expected counts, counts and the shares of their class; a word never seen has those of its class."""
    own = (sums + SHRINK * shares) / (counts + SHRINK)[:, None]
    return (counts + 1)[:, None] * own


@dataclass(frozen=True)
class WordModel:
    """The symbols' model, the sums of J by class and state, and the counts by word as messages to the blocks."""

    symbols: Model
    sums: np.ndarray
    news: DataFrame  # at, part, places, totals, sums; part -1 has the words of this block alone


def _by_class(classes: np.ndarray, values: np.ndarray, buckets: int) -> np.ndarray:
    return np.stack([np.bincount(classes, v, minlength=buckets) for v in values.T], 1)


def word_counts(blocks: DataFrame, known: DataFrame, symbols: Alphabet, model: Model) -> WordModel:
    """Expected counts of every training word in every state, gathered under a model of the symbols."""
    states, low, buckets = len(model.start), len(symbols.frequent), symbols.buckets
    shares = class_shares(symbols, model)

    def count(block: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        own, counts = symbols.symbols(list(row.words)), np.asarray(row.counts, np.int64)
        keep, lengths = ~np.array(row.held, bool), np.asarray(row.lengths, np.int64)
        tokens = _tokens(row.ids)[np.repeat(keep, lengths)]
        emitted = np.zeros((len(own), states))
        if len(tokens):
            local = Model(model.start, model.occupancy, model.moves, model.emits[own])
            emitted = _gathered(local, tokens, lengths[keep])[2]
        alone = (own >= low) & (counts > 0)
        out = []
        for part, packed in zip(places.part, places.places):
            at = _tokens(packed)
            alone[at] = False
            out.append((int(part), _shares(emitted[at], counts[at])))
        home = _shares(emitted[alone], counts[alone])
        leaning = _leaning(_sums(home, counts[alone], states), counts[alone], shares[own[alone] - low])
        heads = _by_class(own[alone] - low, leaning, buckets)
        out += [(-1, home), (-2, heads.tobytes())]
        return pd.DataFrame({"at": row.block, "part": [p for p, _ in out], "sums": [x for _, x in out]})

    columns = ["block", "held", "lengths", "ids", "words", "counts"]
    theirs = known.filter("at >= 0").select("at", "part", "places")
    found = blocks.select(*columns).groupBy("block").cogroup(theirs.groupBy("at"))
    found = settle(found.applyInPandas(count, "at LONG, part INT, sums BINARY"))

    def add(place: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        heads = place[place["at"] < 0]
        if not len(heads):
            return pd.DataFrame({"at": [], "part": [], "totals": [], "sums": []})
        counts, classes = _tokens(heads.owns.iloc[0], "<i8"), _tokens(heads.places.iloc[0])
        total = np.zeros((len(counts), states))
        place, got = place[place["at"] >= 0].sort_values("at"), dict(zip(sums["at"], sums.sums))
        codes = [_tokens(x) for x in place.codes]
        for at, own, owns in zip(place["at"], codes, place.owns):
            total[own] += _sums(got[at], _tokens(owns, "<i8"), states)  # a word stands once in a block
        part = int(heads.part.iloc[0])
        rows = [(at, part, _packed(counts[c], "<i8"), _shares(total[c], counts[c])) for at, c in zip(place["at"], codes)]
        leaning = _leaning(_sums(_shares(total, counts), counts, states), counts, shares[classes])
        rows.append((-1 - part, -2, None, _by_class(classes, leaning, buckets).tobytes()))
        return pd.DataFrame(rows, columns=["at", "part", "totals", "sums"])

    theirs = known.select("part", "at", "codes", "owns", "places").groupBy("part")
    theirs = theirs.cogroup(found.filter("part >= 0").groupBy("part"))
    added = settle(theirs.applyInPandas(add, "at LONG, part INT, totals BINARY, sums BINARY"))

    def add_heads(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")  # a fixed order, so reruns add up to the same bits
        total = sum(np.frombuffer(x, float) for x in rows.sums)
        return pd.DataFrame({"g": rows.g[:1], "sums": [total.tobytes()]})

    heads = found.select("at", "part", "sums").union(added.select("at", "part", "sums")).filter("part = -2")
    heads = heads.select(F.pmod("at", F.lit(PARTS)).alias("g"), "at", "sums")
    heads = heads.groupBy("g").applyInPandas(add_heads, "g LONG, sums BINARY").collect()  # of fixed size
    sums = shares + sum(np.frombuffer(bytes(r.sums), float).reshape(-1, states) for r in sorted(heads, key=lambda r: r.g))
    none = F.lit(None).cast("binary")
    news = known.filter("at >= 0").select("at", "part", "places", none.alias("totals"), none.alias("sums"))
    news = news.union(added.filter("part >= 0").select("at", "part", none, "totals", "sums"))
    news = news.union(found.filter("part = -1").select("at", "part", none, none, "sums"))
    return WordModel(model, sums, news)


def block_words(block: pd.Series, news: pd.DataFrame, symbols: Alphabet, states: int) -> tuple:
    """Symbols, corpus-wide counts and expected counts (of rare words) of a block's vocabulary."""
    own, low = symbols.symbols(list(block.words)), len(symbols.frequent)
    counts, sums = np.asarray(block.counts, np.int64).copy(), np.zeros((len(own), states))
    alone, home = (own >= low) & (counts > 0), None
    counts[own < low] = symbols.totals[own[own < low]]
    for _, rows in news.groupby("part"):
        held = {c: next((x for x in rows[c] if x is not None), None) for c in ("places", "totals", "sums")}
        if held["places"] is None:
            home = held["sums"]
            continue
        at = _tokens(held["places"])
        counts[at], alone[at] = _tokens(held["totals"], "<i8"), False
        sums[at] = _sums(held["sums"], counts[at], states)
    if home is not None:
        sums[alone] = _sums(home, counts[alone], states)
    return own, counts, sums


def word_emissions(own: np.ndarray, counts: np.ndarray, sums: np.ndarray, symbols: Alphabet, model: WordModel) -> np.ndarray:
    """Probability of each word in each state: of its symbol, and for rare words of the word in its class."""
    emits, low = model.symbols.emits[own], len(symbols.frequent)
    rare = own >= low
    classes = own[rare] - low
    leaning = _leaning(sums[rare], counts[rare], class_shares(symbols, model.symbols)[classes])
    emits[rare] *= leaning / model.sums[classes]
    return emits


def scores(
    docs: DataFrame, states: int = STATES, rounds: int | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = corpus_blocks(docs, block_bytes)
    symbols = alphabet(word_totals(blocks))
    model = train(blocks, symbols, states, rounds)
    return scored(blocks, symbols, word_counts(blocks, links(blocks, symbols), symbols, model))


def scored(blocks: DataFrame, symbols: Alphabet, model: WordModel) -> DataFrame:
    """The rows of `scores` under a model."""
    states, hidden = len(model.symbols.start), model.symbols
    base_size, train_tokens = symbols.tokens + symbols.distinct + 1, symbols.tokens
    fixed = WordModel(hidden, model.sums, None)

    def score(block: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        own, counts, expected = block_words(row, news, symbols, states)
        local = Model(hidden.start, hidden.occupancy, hidden.moves, word_emissions(own, counts, expected, symbols, fixed))
        lengths, tokens = np.asarray(row.lengths, np.int64), _tokens(row.ids)
        starts = np.cumsum(lengths) - lengths
        sums = lambda per_word: np.add.reduceat(per_word[tokens], starts)
        # Texts of like length run side by side.
        order, found = np.argsort(lengths, kind="stable"), np.empty(len(lengths))
        sorted_tokens = np.concatenate([tokens[a : a + n] for a, n in zip(starts[order], lengths[order])])
        for some, at in _chunks(lengths[order]):
            found[order[some]] = log10_probability(local, sorted_tokens[at], lengths[order][some])
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"),
                "held_out": np.asarray(row.held, bool),
                "n_tokens": lengths,
                "n_known": sums((counts > 0).astype(np.int64)),
                "train_tokens": train_tokens,
                "base_score": sums(np.log10((counts + 1) / base_size)),
                "score": found,
            }
        )

    schema = (
        "doc_id LONG, held_out BOOLEAN, n_tokens LONG, n_known LONG, train_tokens LONG, base_score DOUBLE, score DOUBLE"
    )
    columns = ["block", "doc_ids", "held", "lengths", "ids", "words", "counts"]
    return blocks.select(*columns).groupBy("block").cogroup(model.news.groupBy("at")).applyInPandas(score, schema)
