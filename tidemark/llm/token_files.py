"""Token ids as directly addressable codes, in files that give random access to any token.

An id is split into chunks of `CHUNK_BITS` bits, lowest first. Level k holds the k-th chunk of every
id that has one, and a continuation bitmap that says which ids go on to level k+1. A rank
directory (set bits before each block of 512) leads from a position on one level to its place on
the next, so token i is read from one chunk per level without decoding a block around it.

A dataset is a Parquet folder of *segments* in ascending doc_id order. A row holds: `part` and
`seq` (place in the order), `n_tokens`, `ends` (little-endian 64-bit token offsets of its
documents), `doc_ids`, and per level `chunks`, `bitmap`, `ranks`. Token offsets of the whole
dataset follow from the segments' totals.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import column_bytes, shared_folder, sliced, texts

CHUNK_BITS = 8
RANK_BLOCK = 512
SEGMENT_BYTES = 2 << 20
CACHED_WORDS = 500_000
#: What a worker's caches may hold, a word's place in them (tables, a call's hash of it) counted beside its letters and ids.
CACHED_BYTES = 96 << 20
WORD_BYTES = 60
BATCH = 500
END_ID = 1
#: Letters that are in normal form and whose case has no exceptions.
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
LETTERS = frozenset(filter(LATIN, map(chr, range(256))))
LATIN_AND_TAIL = re.compile(f"[A-Za-zÀ-ÖØ-öø-ÿ]*[{re.escape(string.punctuation)}]*").fullmatch
#: The same letters by bytes of UTF-8: one of ASCII, or a lead byte and a second one.
ASCII_LETTER = np.array([chr(x) in LETTERS and x < 128 for x in range(256)])
LATIN_LEAD = 0xC3
LATIN_SECOND = np.array([0x80 <= x < 0xC0 and chr(x + 0x40) in LETTERS for x in range(256)])
#: A word that stands for itself alone; a word that holds it is asked for by itself.
SEPARATOR = "\x01"

SEGMENT = (
    "part INT, seq INT, n_tokens LONG, doc_ids ARRAY<LONG>, ends BINARY, "
    "chunks ARRAY<BINARY>, bitmaps ARRAY<BINARY>, ranks ARRAY<BINARY>"
)


class Levels:
    """Directly addressable code of one id sequence."""

    def __init__(self, chunks: list, bitmaps: list, ranks: list):
        self.chunks = [np.frombuffer(x, np.uint8) for x in chunks]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, np.uint32) for x in ranks]

    @classmethod
    def encode(cls, ids: np.ndarray) -> Levels:
        chunks, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint32)
        while True:
            chunks.append((rest & (2**CHUNK_BITS - 1)).astype(np.uint8).tobytes())
            rest = rest >> CHUNK_BITS
            more = rest != 0
            bitmaps.append(np.packbits(more, bitorder="little").tobytes())
            ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK)) if len(more) else np.zeros(0)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32).tobytes())
            if not more.any():
                return cls(chunks, bitmaps, ranks)
            rest = rest[more]

    def __getitem__(self, i: int) -> int:
        """Id at a position: one chunk per level, one directory entry between levels."""
        value = 0
        for level, (chunk, bitmap, ranks) in enumerate(zip(self.chunks, self.bitmaps, self.ranks)):
            value |= int(chunk[i]) << (CHUNK_BITS * level)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BLOCK
            bits = np.unpackbits(bitmap[block * RANK_BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(bits[: i - block * RANK_BLOCK].sum())
        raise ValueError("the last level must not continue")

    def decode(self) -> np.ndarray:
        """All ids: each level is scattered to the positions that continue."""
        values = np.zeros(len(self.chunks[-1]), np.uint32)
        for level in range(len(self.chunks) - 1, -1, -1):
            own = self.chunks[level].astype(np.uint32)
            if level + 1 < len(self.chunks):
                more = np.unpackbits(self.bitmaps[level], count=len(own), bitorder="little").astype(bool)
                own[more] |= values << CHUNK_BITS
            values = own
        return values


class _Pieces:
    """Id sequences end to end, with their keys in an Arrow array and how many calls met each."""

    def __init__(self):
        self.keys = pa.array([], pa.large_string())
        self.flat, self.start, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    @property
    def number(self) -> dict[str, int]:
        """The number of each key's sequence."""
        return {x: n for n, x in enumerate(self.keys.to_pylist())}

    def held(self) -> int:
        """Bytes, about."""
        return WORD_BYTES * len(self.keys) + self.keys.nbytes + self.flat.nbytes

    def find(self, keys: pa.Array, since: int = 0) -> np.ndarray:
        """The numbers of keys among those added since, -1 for others."""
        found = pc.index_in(keys, value_set=self.keys[since:]).fill_null(-1).to_numpy().astype(np.int64)
        return np.where(found < 0, found, found + since)

    def add(self, keys: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.keys = pa.concat_arrays([self.keys, keys])
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths, dtype=np.int64)])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int32)])

    def trim(self) -> None:
        """Forget what a single call met, and at least half of all."""
        often = np.argsort(-self.uses, kind="stable")[: len(self.uses) // 2]
        kept = np.sort(often[self.uses[often] > 1])
        self.keys = self.keys.take(pa.array(kept))
        self.flat, lengths = self.joined(kept)
        self.start = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.uses = self.uses[kept] // 2

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of these numbers, end to end, and their lengths."""
        lengths = np.diff(self.start)[numbers]
        behind = np.cumsum(lengths)
        total = int(behind[-1]) if len(behind) else 0
        return self.flat[np.repeat(self.start[numbers] - behind + lengths, lengths) + np.arange(total)], lengths


class WordEncoder:
    """The tokenizer over whole texts, asked once for each distinct word.

    Its pre-tokenizer drops white space, and no token, normalisation or merge reaches across it, so
    the ids of a text are those of its words between blanks and line ends, in order. Nor does
    one reach from a Latin-1 letter to ASCII punctuation that ends the word, unless an added token does (other
    letters may lower to a letter and a mark, which joins a stop); so a word is asked for as a core and a tail.
    Cores of Latin-1 letters are parted and lowered by their bytes, all words of a call at once, and have nothing
    left to normalise or split: many of them go in one call to the same model, and the vocabulary tells by its end marks
    which id ends a word. All others take the whole tokenizer, with a separator between them: those of
    ASCII lowered, unless an added token stands in them in any case, since the tokenizer looks for
    added tokens before it lowers. The caches live as long as the Python worker and are bounded by bytes,
    words being of any length.
    """

    def __init__(self, path: str):
        # A task has one core; the library would start a thread per core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        self.tails = "" if any(map(LATIN_AND_TAIL, added)) else string.punctuation
        self.letters.normalizer = None
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), as_bytes])
        vocabulary, mark = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[n for x, n in vocabulary.items() if mark and x.endswith(mark)]] = True
        self.separator = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.words, self.cores = _Pieces(), _Pieces()

    def _parts(self, word: str) -> tuple[str, str]:
        core = word.rstrip(".,")
        if not core or core[-1] not in LETTERS:
            core = word
        tail = word[len(core) :]
        if core.isascii():
            lowered = core.isalpha() or not self.added(core)
        else:
            lowered = LATIN(core)
        return core.lower() if lowered else core, tail

    @staticmethod
    def _each(tokenizer, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast(cores, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), np.uint32), np.array([len(x) for x in ids], np.int64)

    def _letters(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cores of letters and their lengths; an id with an end mark is a core's last."""
        ids = self.letters.encode_batch_fast([" ".join(cores)], add_special_tokens=False)[0].ids
        ids = np.array(ids, np.uint32)
        lengths = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
        return (ids, lengths) if len(lengths) == len(cores) else self._each(self.letters, cores)

    def _others(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any cores and their lengths, parted by the separator's one id."""
        between = f" {SEPARATOR} "
        text = between.join([*cores, ""])
        if len(self.separator) == 1 and text.count(SEPARATOR) == len(cores):
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.separator[0])
            if len(at) == len(cores):
                return np.delete(ids, at), np.diff(at, prepend=-1) - 1
        return self._each(self.tokenizer, cores)

    def _ask(self, cores: list[str]) -> None:
        simple, rest = [], []
        for core in cores:
            (simple if (core.isalpha() if core.isascii() else LATIN(core)) else rest).append(core)
        found = [self._letters(simple[i : i + BATCH]) for i in range(0, len(simple), BATCH)]
        found += [self._others(rest[i : i + BATCH]) for i in range(0, len(rest), BATCH)]
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for ids, own in found:
            flat.append(ids)
            lengths.append(own)
        self.cores.add(pa.array(simple + rest, pa.large_string()), np.concatenate(flat), np.concatenate(lengths))

    def _learn(self, words: list[str]) -> None:
        held = pa.array(words, pa.large_string())
        cores = pc.ascii_rtrim(held, self.tails) if self.tails else held
        lowered, simple = _lowered(cores)
        behind = pc.subtract(pc.binary_length(held), pc.binary_length(cores)).to_numpy()
        tailed, others = np.flatnonzero(simple & (behind > 0)), np.flatnonzero(~simple)
        tails = [words[i][-n:] for i, n in zip(tailed.tolist(), behind[tailed].tolist())]
        rest = list(chain.from_iterable(self._parts(words[i]) for i in others.tolist()))
        simple = np.flatnonzero(simple)
        parts = pa.concat_arrays([pa.array(["", *tails, *rest], pa.large_string()), lowered.take(pa.array(simple))])
        found = parts.dictionary_encode()
        known = self.cores.find(found.dictionary)
        if len(new := np.flatnonzero(known < 0)):
            asked, before = found.dictionary.take(pa.array(new)), len(self.cores.keys)
            self._ask(asked.to_pylist())
            known[new] = self.cores.find(asked, before)
        self.cores.uses[known] += 1
        known = known[found.indices.to_numpy()]
        # Core and tail of each word; without a tail, the empty one.
        numbers = np.full((len(words), 2), known[0])
        numbers[tailed, 1] = known[1 : 1 + len(tails)]
        numbers[others] = known[1 + len(tails) : 1 + len(tails) + len(rest)].reshape(-1, 2)
        numbers[simple, 0] = known[1 + len(tails) + len(rest) :]
        flat, lengths = self.cores.joined(numbers.ravel())
        self.words.add(held, flat, lengths.reshape(-1, 2).sum(1))

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END_ID, and the offset behind each text.

        Arrow splits the texts, finds their distinct words and which of them the cache holds.
        """
        if len(self.words.keys) > CACHED_WORDS or self.words.held() + self.cores.held() > CACHED_BYTES:
            self.words.trim()
            self.cores.trim()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        counts = pc.list_value_length(split).to_numpy().astype(np.int64)
        found = split.flatten().dictionary_encode()
        known = self.words.find(found.dictionary)
        if len(new := np.flatnonzero(known < 0)):
            known[new] = len(self.words.keys) + np.arange(len(new))
            self._learn(found.dictionary.take(pa.array(new)).to_pylist())
        self.words.uses[known] += 1
        ids, lengths = self.words.joined(known[found.indices.to_numpy()])
        ends = np.cumsum(lengths)[np.cumsum(counts) - 1]
        return np.insert(ids, ends, END_ID).astype(np.uint32), ends + np.arange(1, len(texts) + 1)


def _lowered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words with their Latin-1 letters lowered, by bytes of UTF-8, and which are of such letters alone."""
    data, offsets = column_bytes(words)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    follows = np.concatenate([[False], data[:-1] == LATIN_LEAD])
    letter = np.where(follows, LATIN_SECOND[data], ASCII_LETTER[data])
    # A lead byte counts as its letter does.
    letter[:-1] |= follows[1:] & letter[1:]
    lengths = np.diff(offsets)
    letters = np.diff(np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])[offsets])
    upper = letter & np.where(follows, data < 0x9F, (data >= ord("A")) & (data <= ord("Z")))
    low = data + (upper * np.uint8(0x20))
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low)]
    return pa.Array.from_buffers(pa.large_string(), len(words), buffers), (lengths > 0) & (letters == lengths)


@cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: the tasks that follow know its words already."""
    return WordEncoder(path)


def _segments(tokenizer_path: str, segment_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seq = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for piece in sliced(batches, "text", segment_bytes):
            ids, ends = encoder.encode(piece.column("text"))
            code = Levels.encode(ids)
            row = {
                "part": part,
                "seq": seq,
                "n_tokens": len(ids),
                "doc_ids": piece.column("doc_id").to_pylist(),
                "ends": ends.astype("<i8").tobytes(),
                "chunks": [x.tobytes() for x in code.chunks],
                "bitmaps": [x.tobytes() for x in code.bitmaps],
                "ranks": [x.tobytes() for x in code.ranks],
            }
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)
            seq += 1
            # What a slice took goes back, or the worker keeps the most that any slice took.
            pa.default_memory_pool().release_unused()

    return encode


_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
    + [("ends", pa.binary()), *((n, pa.list_(pa.binary())) for n in ("chunks", "bitmaps", "ranks"))]
)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode all texts in ascending doc_id order (null first; ties by text) and write the files.

    A null text is empty and leaves the end id alone. Repeated rows are written each.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts())
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer_path, segment_bytes), SEGMENT).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    Segment starts come from the totals per part and, inside a part, of its earlier segments.
    """
    segments = spark.read.schema(SEGMENT).parquet(folder)
    # One row per part, as many as there were shuffle partitions: a small window.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = segments.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before"))
    places = places.join(parts, F.col("part") == F.col("p")).select(
        F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("base") + F.col("before")).alias("start")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Levels(row["chunks"], row["bitmaps"], row["ranks"]).decode().astype("<u4")
                ends = np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * len(ends), pa.int32()),
                        pa.array([row["seq"]] * len(ends), pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts),
                        pa.array(ends - starts),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"],
                )

    schema = "part INT, seq INT, doc_id LONG, offset LONG, n_tokens LONG, ids_crc32 LONG"
    rows = segments.mapInArrow(digest, schema)
    return rows.join(places, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select(
        "doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """Ids at (part, seq, i) positions: random access, no segment is decoded."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                code = Levels(row["chunks"], row["bitmaps"], row["ranks"])
                ids = [code[i] for i in row["at"]]
                n = len(ids)
                arrays = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["seq"]] * n, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    arrays + [pa.array(row["at"], pa.int64()), pa.array(ids, pa.int64())], names=["part", "seq", "i", "id"]
                )

    wanted = positions.distinct().groupBy("part", "seq").agg(F.collect_list("i").alias("at"))
    held = spark.read.schema(SEGMENT).parquet(folder).join(wanted, ["part", "seq"])
    return held.mapInArrow(look, "part INT, seq INT, i LONG, id LONG")


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the files to a new shared folder and read them back."""
    folder = shared_folder(docs.sparkSession)
    write_tokens(docs, folder, tokenizer_path)
    return read_tokens(docs.sparkSession, folder)
