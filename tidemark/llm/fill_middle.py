"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of `FRAME_BYTES` bytes each. A directory holds, up to the
end of each frame, how many bytes, units and characters have started. Units are
`[A-Za-z]+|[^A-Za-z]`.

* *Selection* finds the frame in which the wanted unit starts by its directory and decompresses that
  frame alone, so a cut costs one frame however long the text is.
* *Transformation* streams spans of frames in the order of the output, which becomes frames of the same kind,
  to be stored or read on.
* *Digests* stream the output's frames once; the text is rebuilt from output and form by seeking the
  markers and streaming the spans between them in the order of the text.

Null texts are empty; empty texts have no frames and stay plain. A null doc_id hashes as no digits.
Rows that repeat are transformed each. Memory is one Arrow slice and a frame at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shared_folder, sliced, texts

FRAME_BYTES = 16 << 10
SLICE_BYTES = 4 << 20
LEVEL = 3
#: Fixed by the contract: markers, and the percentages of plain and of suffix-first outputs.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20

_LISTS = {"offsets": pa.list_(pa.int64()), "units": pa.list_(pa.int64()), "chars": pa.list_(pa.int64())}
_FRAMES = {**_LISTS, "frames": pa.list_(pa.binary())}
FRAMES = "offsets ARRAY<LONG>, units ARRAY<LONG>, chars ARRAY<LONG>, frames ARRAY<BINARY>"
STORE = f"doc_id LONG, marked BOOLEAN, {FRAMES}"
OUTPUT = f"doc_id LONG, n LONG, form STRING, prefix_chars LONG, middle_chars LONG, {FRAMES}"
_STORE = pa.schema({"doc_id": pa.int64(), "marked": pa.bool_(), **_FRAMES})
_OUTPUT = pa.schema(
    {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
    | _FRAMES
)

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= ord("a")) & ((_BYTES | 32) <= ord("z"))
_CHAR = (_BYTES & 0xC0) != 0x80


def _starts(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and characters start; `inside` tells that a letter stands before the data."""
    letter, char = _LETTER[data], _CHAR[data]
    before = np.empty_like(letter)
    before[:1], before[1:] = inside, letter[:-1]
    return np.where(letter, ~before, char), char


class Frames:
    """A text as compressed frames with cumulative counts of bytes, units and characters."""

    def __init__(self, offsets, units, chars, frames, tool=None):
        self.offsets, self.units, self.chars, self.frames = offsets, units, chars, frames
        self._read = (tool or zstandard.ZstdDecompressor()).decompress

    @classmethod
    def pack(cls, pieces: Iterable, write: zstandard.ZstdCompressor, read=None) -> Frames:
        """Frames of a stream of buffers, cut every `FRAME_BYTES` bytes."""
        offsets, units, chars, frames, inside, held = [0], [0], [0], [], False, bytearray()

        def close(data: bytes) -> None:
            nonlocal inside
            codes = np.frombuffer(data, np.uint8)
            starts, char = _starts(codes, inside)
            offsets.append(offsets[-1] + len(data))
            units.append(units[-1] + int(np.count_nonzero(starts)))
            chars.append(chars[-1] + int(np.count_nonzero(char)))
            frames.append(write.compress(data))
            inside = bool(_LETTER[codes[-1]])

        for piece in pieces:
            held += piece
            whole = len(held) - len(held) % FRAME_BYTES
            for at in range(0, whole, FRAME_BYTES):
                close(bytes(held[at : at + FRAME_BYTES]))
            del held[:whole]
        if held:
            close(bytes(held))
        return cls(offsets, units, chars, frames, read)

    @property
    def n(self) -> int:
        return self.units[-1]

    def cut(self, unit: int) -> tuple[int, int]:
        """Bytes and characters before the unit of this number; decompresses one frame."""
        if unit >= self.n:
            return self.offsets[-1], self.chars[-1]
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        data = np.frombuffer(self._read(self.frames[k]), np.uint8)
        starts, char = _starts(data, False)
        # A letter that goes on from the frame before starts no unit; the directory tells.
        if np.count_nonzero(starts) > self.units[k + 1] - self.units[k]:
            starts[0] = False
        at = int(np.flatnonzero(starts)[unit - self.units[k]])
        return self.offsets[k] + at, self.chars[k] + int(np.count_nonzero(char[:at]))

    def stream(self, lo: int = 0, hi: int | None = None) -> Iterator[memoryview]:
        """The bytes [lo, hi), frame by frame."""
        hi = self.offsets[-1] if hi is None else hi
        if lo >= hi:
            return
        first = int(np.searchsorted(self.offsets, lo, side="right")) - 1
        for k in range(first, len(self.frames)):
            start = self.offsets[k]
            if start >= hi:
                return
            yield memoryview(self._read(self.frames[k]))[max(lo - start, 0) : hi - start]

    def find(self, marker: bytes, lo: int) -> int:
        """Byte offset of the first marker from `lo` on; it may lie across frames."""
        tail, at = b"", lo
        for piece in self.stream(lo):
            window = tail + bytes(piece)
            found = window.find(marker)
            if found >= 0:
                return at - len(tail) + found
            at += len(piece)
            tail = window[1 - len(marker) :]
        raise ValueError("the output lacks a marker")

    def columns(self) -> dict:
        """As stored: each count at the frames' ends; it starts from 0."""
        return {"offsets": self.offsets[1:], "units": self.units[1:], "chars": self.chars[1:], "frames": self.frames}

    @classmethod
    def stored(cls, row: dict, read) -> Frames:
        return cls(*([0, *row[c]] for c in _LISTS), row["frames"], read)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers of a document, from the digest of its decimal id."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def write_frames(docs: DataFrame, folder: str) -> None:
    """Store every text as frames: one row per document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, read = zstandard.ZstdCompressor(LEVEL), zstandard.ZstdDecompressor()
        for piece in sliced(batches, "text", SLICE_BYTES):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text")):
                data = text.as_buffer().to_pybytes()
                marked = PREFIX in data or SUFFIX in data or MIDDLE in data
                rows.append({"doc_id": doc_id, "marked": marked, **Frames.pack([data], write, read).columns()})
            yield pa.RecordBatch.from_pylist(rows, schema=_STORE)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts())
    read.mapInArrow(pack, STORE).write.parquet(folder)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _gathered(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about `SLICE_BYTES` of frames."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 200 + sum(map(len, row["frames"]))
        if weight >= SLICE_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _transformed(row: dict, write, read) -> dict:
    text = Frames.stored(row, read)
    n = text.n
    h1, h2, h3, h4 = draws(row["doc_id"])
    if not n or row["marked"] or h3 % 100 >= PLAIN_FROM:
        plain = {"form": "plain", "prefix_chars": None, "middle_chars": None}
        return {"doc_id": row["doc_id"], "n": n, **plain, **text.columns()}
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, a_chars), (b, b_chars) = text.cut(first), text.cut(last)
    prefix, middle, suffix = (0, a), (a, b), (b, text.offsets[-1])
    form = "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"
    ends = ((SUFFIX, suffix), (PREFIX, prefix)) if form == "spm" else ((PREFIX, prefix), (SUFFIX, suffix))

    def output() -> Iterator:
        for marker, span in (*ends, (MIDDLE, middle)):
            yield marker
            yield from text.stream(*span)

    made = Frames.pack(output(), write, read)
    counts = {"prefix_chars": a_chars, "middle_chars": b_chars - a_chars}
    return {"doc_id": row["doc_id"], "n": n, "form": form, **counts, **made.columns()}


def outputs(spark: SparkSession, store: str) -> DataFrame:
    """All stored texts transformed; the outputs are frames again, with the form of each."""

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, read = zstandard.ZstdCompressor(LEVEL), zstandard.ZstdDecompressor()
        yield from _gathered((_transformed(r, write, read) for r in _rows(batches)), _OUTPUT)

    return spark.read.schema(STORE).parquet(store).mapInArrow(transform, OUTPUT)


def spans_in_order(output: Frames, form: str) -> list[tuple[int, int]]:
    """Byte spans of an output that make up the text, in the text's order.

    A text with a marker in it stays plain, and no marker can begin inside another, so the first
    one found is the one that was put in.
    """
    end = output.offsets[-1]
    if form == "plain":
        return [(0, end)]
    inner = SUFFIX if form == "psm" else PREFIX
    at = output.find(inner, len(PREFIX))
    middle = output.find(MIDDLE, at + len(inner))
    first, second = (len(PREFIX), at), (at + len(inner), middle)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return [prefix, (middle + len(MIDDLE), end), suffix]


def texts_of(made: DataFrame, restore: bool = False) -> DataFrame:
    """(doc_id, form, text) of all outputs, or of the texts rebuilt from them."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor()
        for row in _rows(batches):
            output = Frames.stored(row, read)
            spans = spans_in_order(output, row["form"]) if restore else [(0, output.offsets[-1])]
            text = b"".join(bytes(p) for span in spans for p in output.stream(*span)).decode()
            yield pa.RecordBatch.from_pylist([{"doc_id": row["doc_id"], "form": row["form"], "text": text}], schema=schema)

    schema = pa.schema({"doc_id": pa.int64(), "form": pa.string(), "text": pa.string()})
    return made.mapInArrow(unpack, "doc_id LONG, form STRING, text STRING")


def digests(made: DataFrame) -> DataFrame:
    """Columns of the registered query; digests stream the frames and never hold a text."""

    def hashed(output: Frames, spans: list[tuple[int, int]]) -> str:
        digest = hashlib.sha256()
        for span in spans:
            for piece in output.stream(*span):
                digest.update(piece)
        return digest.hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in _rows([batch]):
                output = Frames.stored(row, read)
                kept = {c: row[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars")}
                kept["output_sha256"] = hashed(output, [(0, output.offsets[-1])])
                kept["restored_sha256"] = hashed(output, spans_in_order(output, row["form"]))
                out.append(kept)
            yield pa.RecordBatch.from_pylist(out, schema=result)

    result = pa.schema([f for f in _OUTPUT if f.name not in _FRAMES])
    result = result.append(pa.field("output_sha256", pa.string())).append(pa.field("restored_sha256", pa.string()))
    names = "doc_id LONG, n LONG, form STRING, prefix_chars LONG, middle_chars LONG"
    return made.mapInArrow(digest, f"{names}, output_sha256 STRING, restored_sha256 STRING")


def transformed(docs: DataFrame) -> DataFrame:
    """Store all documents in a new shared folder and transform them; columns of the query."""
    store = shared_folder(docs.sparkSession)
    write_frames(docs, store)
    return digests(outputs(docs.sparkSession, store))
