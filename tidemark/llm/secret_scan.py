"""Secret scan with one automaton over all rules.

The rules' regular expressions become one nondeterministic automaton, subset construction turns
it into a deterministic one over byte classes, and partition refinement minimises that. What is
left is a flat transition array and, per state, the set of rules that end there. Texts are
scanned as bytes, once, for all rules together: many stretches of text advance side by side, one
array lookup per byte. Stretches begin at a document's start or behind a byte that leads every
state back to the start, so that no match can lie across a cut.

The automaton finds which stretches hold a match and of which rules, and misses none. Exact spans
inside those are then taken by each rule's own expression, leftmost and without overlap. Counted
repetitions are cut short in the automaton (`Rule.scan`), which keeps it at some hundred states, and
checked in full afterwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import column_bytes, keyed, sliced, texts

SLICE_BYTES = 8 << 20
STRETCH = 256
ABREAST = 8192


@dataclass(frozen=True)
class Rule:
    """`find` gives leftmost matches; those shorter than `least` (in `group`) are dropped.

    `scan` is what the automaton looks for: it must match inside every span that is kept.
    """

    kind: str
    find: bytes
    scan: bytes
    group: int = 0
    least: int = 0


# The three base rules of the contract, then public key formats that the scan adds.
RULES = (
    Rule(
        "assign",
        rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        rb"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}",
        2,
        6,
    ),
    Rule("access", rb"AKIA[A-Z0-9]+", rb"AKIA[A-Z0-9]{6}", 0, 20),
    Rule("hex", rb"[0-9a-f]+", rb"[0-9a-f]{12}", 0, 24),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,}", rb"gh[pousr]_[A-Za-z0-9]{6}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}", rb"xox[abprs]-[A-Za-z0-9-]{6}"),
    Rule("google", rb"AIza[A-Za-z0-9_-]{35}", rb"AIza[A-Za-z0-9_-]{6}"),
    Rule("stripe", rb"[rs]k_live_[A-Za-z0-9]{24,}", rb"[rs]k_live_[A-Za-z0-9]{6}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", rb"eyJ[A-Za-z0-9_-]{6}"),
    Rule("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", rb"PRIVATE KEY-----"),
)


class _Nfa:
    """Thompson automaton of the rules; state 0 is the common start."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.empty: list[list[int]] = [[]]
        self.steps: list[list[tuple[frozenset, int]]] = [[]]
        self.accepts: dict[int, int] = {}
        for n, rule in enumerate(rules):
            self.accepts[self._build(re._parser.parse(rule.scan), 0)] = n

    def _state(self) -> int:
        self.empty.append([])
        self.steps.append([])
        return len(self.empty) - 1

    def _build(self, items, at: int) -> int:
        for op, value in items:
            kind = str(op)
            if kind in ("LITERAL", "IN"):
                to = self._state()
                self.steps[at].append((frozenset([value]) if kind == "LITERAL" else _members(value), to))
                at = to
            elif kind == "SUBPATTERN":
                at = self._build(value[-1], at)
            elif kind == "BRANCH":
                to = self._state()
                for option in value[1]:
                    fork = self._state()
                    self.empty[at].append(fork)
                    self.empty[self._build(option, fork)].append(to)
                at = to
            elif kind == "MAX_REPEAT":
                at = self._repeat(*value, at)
            else:
                raise ValueError(f"not in the rule language: {kind}")
        return at

    def _repeat(self, least: int, most: int, body, at: int) -> int:
        for _ in range(least):
            at = self._build(body, at)
        loop = str(most) == "MAXREPEAT"
        for _ in range(1 if loop else most - least):
            fork, to = self._state(), self._state()
            self.empty[at] += [fork, to]
            end = self._build(body, fork)
            self.empty[end].append(to)
            if loop:
                self.empty[end].append(fork)
            at = to
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def _members(items) -> frozenset:
    out: set[int] = set()
    for op, value in items:
        out.update(range(value[0], value[1] + 1) if str(op) == "RANGE" else [value])
    return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """`moves[state * classes + byte_class[byte]]` is the next state; `ends[state]` a set of rules as bits."""

    byte_class: np.ndarray
    moves: np.ndarray
    ends: np.ndarray
    classes: int
    resets: np.ndarray


@cache
def compile_rules(rules: tuple[Rule, ...] = RULES) -> Automaton:
    nfa = _Nfa(rules)
    sets = {s for steps in nfa.steps for s, _ in steps}
    marks = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {m: i for i, m in enumerate(dict.fromkeys(marks))}
    byte_class = np.array([kinds[m] for m in marks], np.uint8)
    sample = [marks.index(m) for m in kinds]
    start = nfa.closure([0])
    number, todo, moves = {start: 0}, [start], []
    while todo:
        here, row = todo.pop(), []
        for byte in sample:
            # The start stays active, so a match may begin at any byte.
            there = nfa.closure([0, *(t for s in here for chars, t in nfa.steps[s] if byte in chars)])
            if there not in number:
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        moves.append((number[here], row))
    table = np.array([row for _, row in sorted(moves)], np.int64)
    ends = np.zeros(len(table), np.int64)
    for states, n in number.items():
        ends[n] = sum(1 << nfa.accepts[s] for s in states if s in nfa.accepts)
    group = _minimise(table, ends)
    first = np.unique(group, return_index=True)[1]
    table, ends = group[table[first]], ends[first]
    resets = np.flatnonzero((table == group[0]).all(0))
    order = np.concatenate([[group[0]], np.setdiff1d(np.arange(len(table)), [group[0]])])
    place = np.argsort(order)
    return Automaton(
        byte_class,
        place[table[order]].astype(np.int32).ravel(),
        ends[order].astype(np.int32),
        len(sample),
        np.isin(byte_class, resets),
    )


def _minimise(table: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each state: split classes until all members agree on where every byte leads."""
    group = np.unique(ends, return_inverse=True)[1]
    while True:
        view = np.concatenate([group[:, None], group[table]], axis=1)
        finer = np.unique(view, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            return finer
        group = finer


def stretches(data: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Start of every stretch: documents' starts, and cuts behind a resetting byte about every STRETCH."""
    low, high = int(offsets[0]), int(offsets[-1])
    safe = np.flatnonzero(automaton.resets[data[low:high]]) + low + 1
    cuts = safe[np.unique(np.searchsorted(safe, np.arange(low, high, STRETCH)))[:-1]] if len(safe) else safe
    return np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts[cuts < high]]))


def scan(data: np.ndarray, starts: np.ndarray, high: int, automaton: Automaton) -> np.ndarray:
    """Rules that end in each stretch, as bits: one lookup per byte, ABREAST stretches side by side."""
    if not len(starts):
        return np.zeros(0, np.int32)
    low = int(starts[0])
    classes = automaton.byte_class[data[low:high]]
    lengths = np.diff(np.append(starts, high))
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros(len(starts), np.int32)
    for first in range(0, len(order), ABREAST):
        own = order[first : first + ABREAST]
        at, own_lengths = starts[own] - low, lengths[own]
        state, seen = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
        live = np.searchsorted(-own_lengths, -np.arange(int(own_lengths[0])), side="left")
        for n in live.tolist():
            now = state[:n]
            now *= automaton.classes
            now += classes[at[:n]]
            automaton.moves.take(now, out=now, mode="clip")
            seen[:n] |= automaton.ends[now]
            at += 1
        out[own] = seen
    return out


def _spans(line: bytes, bits: int, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    found = []
    for n, rule in enumerate(rules):
        if bits >> n & 1:
            for m in re.finditer(rule.find, line):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    found.append((m.start(), n, m.end()))
    return found


def scan_batch(batch: pa.RecordBatch, rules: tuple[Rule, ...], automaton: Automaton) -> list[list[tuple[int, int, int]]]:
    """Spans (start, rule, end) in code points of every text of the batch, by start, then rule."""
    data, offsets = column_bytes(batch.column("text"))
    spans: list[list] = [[] for _ in range(batch.num_rows)]
    high = int(offsets[-1])
    starts = stretches(data, offsets, automaton)
    bits = scan(data, starts, high, automaton)
    ends = np.append(starts[1:], high)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    for i in np.flatnonzero(bits):
        line = data[starts[i] : ends[i]].tobytes()
        if found := _spans(line, int(bits[i]), rules):
            shift = int(starts[i] - offsets[owner[i]])
            spans[owner[i]] += [(a + shift, n, b + shift) for a, n, b in found]
    for row, found in enumerate(spans):
        if found:
            own = data[offsets[row] : offsets[row + 1]]
            points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            spans[row] = sorted((int(points[a]), n, int(points[b])) for a, n, b in found)
    return spans


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id and `found`, an array of (kind, start, end) in code points.

    Null and empty texts hold no secret. Nothing is shuffled.
    """
    automaton = compile_rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for piece in sliced(batches, "text", SLICE_BYTES):
            rows = [
                [{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in found]
                for found in scan_batch(piece, rules, automaton)
            ]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])

    return keyed(docs, texts()).select("doc_id", "text").mapInArrow(
        run, "doc_id LONG, found ARRAY<STRUCT<kind: STRING, start: LONG, end: LONG>>"
    )


def redact(text: str, spans: list, mask: str = "[secret]") -> str:
    """Text with every span replaced; overlapping spans are replaced as one."""
    out, done = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()
