"""Line, exact and substring deduplication against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_dedup, substring_dedup
from tidemark.llm.cuckoo import CuckooFilter

from .conftest import prose

BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_truth(docs, least=5):
    keys = defaultdict(set)

    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))

    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                keys[key(line)].add(doc_id)
    top = {k: max((d for d in v if d is not None), default=None) for k, v in keys.items() if len(v) >= least}
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def line_result(tuples, df):
    return tuples(df, "doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_lines_match_brute_force(corpus, plain, tuples):
    got = line_result(tuples, line_dedup.dedup_lines(corpus))
    assert got == line_truth(plain)
    assert sum(r[2] for r in got) == 6


def test_lines_without_the_filter_screen_are_the_same(corpus, plain, tuples):
    index = line_dedup.LineIndex.of(corpus)
    assert line_result(tuples, index.dedup(corpus, filter_limit=0)) == line_truth(plain)


def test_kept_text_of_lines(corpus):
    rows = line_dedup.dedup_lines(corpus).collect()
    assert all(sha(r.kept_text) == r.kept_sha256 for r in rows)


def test_lines_of_an_empty_table(nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_insertions_and_deletions_undo_each_other(corpus, plain, tuples):
    first = corpus.filter("doc_id IS NULL OR doc_id < 23")
    second = corpus.filter("doc_id >= 23")
    index = line_dedup.LineIndex.of(first, shards=3)
    grown = index.insert(second)
    assert line_result(tuples, grown.dedup(corpus)) == line_truth(plain)
    back = grown.remove(second.select("doc_id"))
    assert tuples(back.counts) == tuples(index.counts)
    assert tuples(back.filters, "shard", "n_keys") == tuples(index.filters, "shard", "n_keys")
    left = [d for d in plain if d[0] is None or d[0] < 23]
    assert line_result(tuples, back.dedup(first)) == line_truth(left)
    assert grown.filters.agg(F.sum("n_keys")).first()[0] == 1


def test_removing_the_keeper_hands_its_line_on(corpus, plain, tuples):
    index = line_dedup.LineIndex.of(corpus).remove(corpus.filter("doc_id = 26").select("doc_id"))
    left = corpus.filter("doc_id IS NULL OR doc_id <> 26")
    assert line_result(tuples, index.dedup(left)) == line_truth([d for d in plain if d[0] != 26])


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    made = CuckooFilter.sized(5000)
    assert made.insert(a, b) and made.contains(a, b).all()
    made.delete(a[:2500], b[:2500])
    assert made.contains(a[2500:], b[2500:]).all()
    assert made.contains(a[:2500], b[:2500]).mean() < 0.01
    made.delete(a[2500:], b[2500:])
    assert not made.table.any()
    again = CuckooFilter.load(made.dump())
    assert again.table.shape == made.table.shape
    assert not CuckooFilter(2).insert(a[:50], b[:50])


def exact_truth(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, sha(text)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 100, 4096])
def test_exact_groups_match_brute_force(corpus, plain, tuples, block):
    short = corpus.filter("doc_id IS NULL OR doc_id NOT IN (5, 6)") if block == 7 else corpus
    docs = [d for d in plain if d[0] not in (5, 6)] if block == 7 else plain
    got = tuples(exact_dedup.exact_groups(short, block), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_truth(docs)


def test_names_are_redrawn_when_fingerprints_clash(corpus, plain, tuples, monkeypatch):
    real = exact_dedup._print
    monkeypatch.setattr(exact_dedup, "_print", lambda b, s: [F.length(b).cast("long")] * 2 if s == 0 else real(b, s))
    got = tuples(exact_dedup.exact_groups(corpus), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == exact_truth(plain)


def test_exact_groups_of_an_empty_table(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


def repeats_truth(docs, width=35):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    seen = Counter(tuple(w[i : i + width]) for _, w in split for i in range(len(w) - width + 1))
    out = []
    for doc_id, w in split:
        gone = {
            i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)
        }
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 12, substring_dedup.BLOCK_BYTES])
def test_repeats_match_brute_force(corpus, plain, tuples, block):
    got = tuples(substring_dedup.remove_repeats(corpus, block), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats_truth(plain)
    assert sum(r[2] > 0 for r in got) >= 10


def test_repeats_in_periodic_text(spark, tuples):
    docs = [(1, "a b " * 60), (2, "x " * 34), (3, "x " * 36), (4, "y " + "x " * 35 + "z"), (5, "a b c " * 11 + "a b c")]
    df = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    got = tuples(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == repeats_truth(docs)


def test_repeats_of_an_empty_table(nothing):
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_symbols_that_occur_once_never_hide_a_repeat():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, k, 400))).encode() for k in (2, 3, 8, 40, 1000) for _ in range(4)]
    cut = texts[7].split()[100:180]
    texts.append(b" ".join([b"before", *cut, b"behind"]))
    words = substring_dedup.Words(texts)
    symbols = substring_dedup.recompress(words)
    own = substring_dedup.tested(symbols)
    counts = Counter(symbols.name[own].tolist())
    once = own & np.array([counts[x] == 1 for x in symbols.name.tolist()])
    starts = set(substring_dedup.candidate_starts(words, symbols, once).tolist())
    flat = [w for own_words in words.words for w in own_words]
    width = substring_dedup.WINDOW
    spots = [i for s, e in zip(words.starts, words.ends) for i in range(s, e - width + 1)]
    seen = Counter(tuple(flat[i : i + width]) for i in spots)
    assert {i for i in spots if seen[tuple(flat[i : i + width])] > 1} <= starts


def test_a_block_is_worked_on_in_slices_of_bounded_memory():
    size = 6 << 20
    texts = [prose(n, 2_000) for n in range(20)]
    texts = (texts * (size // sum(map(len, texts)) + 1)) + [""]
    docs = pd.DataFrame({"block": 0, "doc_id": pd.array(range(len(texts)), "Int64"), "text": texts})
    none = pd.DataFrame({"h": np.zeros(0, np.int64)})
    whole = substring_dedup._screened(docs, none.h.to_numpy())
    tracemalloc.start()
    parts = substring_dedup._screen(docs, none)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pd.testing.assert_frame_equal(parts, whole)
    assert peak < 25 * size
