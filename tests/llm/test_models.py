"""Hidden Markov scores and language identification."""

import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import hmm_scoring, language
from tidemark.llm.common import held_out, sliced


@pytest.fixture(scope="module")
def small_model():
    rng = np.random.default_rng(0)
    return hmm_scoring.Model(
        rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3).T
    )


def path_sum(model, sequence):
    total = 0.0
    for path in itertools.product(range(3), repeat=len(sequence)):
        p = model.start[path[0]] * model.emits[sequence[0], path[0]]
        for i in range(1, len(sequence)):
            p *= model.moves[path[i - 1], path[i]] * model.emits[sequence[i], path[i]]
        total += p
    return total


def test_scaled_forward_equals_the_sum_over_all_paths(small_model):
    sequences = [np.array(x) for x in ([0, 4, 2, 2, 1], [3], [1, 1, 1])]
    lengths = np.array([len(s) for s in sequences])
    got = hmm_scoring.log10_probability(small_model, np.concatenate(sequences), lengths)
    assert np.allclose(got, [math.log10(path_sum(small_model, s)) for s in sequences])


def test_expected_counts_match_numeric_posteriors(small_model):
    sequence = [0, 4, 2, 1]
    first, moves, emitted, _ = hmm_scoring.expected_counts(
        small_model, np.array(sequence), np.array([4]), np.array([True])
    )
    want = np.zeros((3, 3))
    start = np.zeros(3)
    total = path_sum(small_model, sequence)
    for path in itertools.product(range(3), repeat=4):
        p = small_model.start[path[0]] * small_model.emits[sequence[0], path[0]]
        for i in range(1, 4):
            p *= small_model.moves[path[i - 1], path[i]] * small_model.emits[sequence[i], path[i]]
        start[path[0]] += p / total
        for i in range(1, 4):
            want[path[i - 1], path[i]] += p / total
    assert np.allclose(moves, want) and np.allclose(first, start)
    assert np.allclose(emitted.sum(1), np.bincount(sequence, minlength=5))


def tokens(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), ""]


def test_counts_and_base_score_match_brute_force(corpus, plain, tuples):
    got = tuples(
        hmm_scoring.scores(corpus, rounds=1, block_bytes=1 << 12),
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score",
    )
    out = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in plain}
    counts = Counter(t for d, x in plain if not out[d] for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, x in plain:
        own = tokens(x)
        base = sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in own)
        want.append((d, out[d], len(own), sum(counts[t] > 0 for t in own), total, base))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_training_raises_the_likelihood_and_beats_the_base(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    blocks = hmm_scoring.corpus_blocks(docs)
    symbols = hmm_scoring.alphabet(hmm_scoring.word_totals(blocks))
    model, fits = hmm_scoring.first_model(symbols), []
    for _ in range(4):
        model, fit = hmm_scoring._step(blocks, symbols, model)
        fits.append(fit)
    assert fits == sorted(fits)
    assert np.allclose(model.moves.sum(1), 1) and np.allclose(model.emits.sum(0), 1)
    rows = hmm_scoring.scores(docs).filter("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum()


def test_chunks_and_stretches_change_no_count(small_model, monkeypatch):
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 40, 60)
    symbols = rng.integers(0, 5, lengths.sum())
    whole = hmm_scoring._gathered(small_model, symbols, lengths)
    exact = hmm_scoring.expected_counts(small_model, symbols, lengths, np.ones(60, bool))
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(whole, exact))
    monkeypatch.setattr(hmm_scoring, "CHUNK", 70)
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(hmm_scoring._gathered(small_model, symbols, lengths), exact))
    cut, opening = hmm_scoring._stretches(np.array([1, 1024, 1025, 3000]))
    assert cut.tolist() == [1, 1024, 1024, 1, 1024, 1024, 952] and opening.tolist() == [True] * 3 + [False, True, False, False]


def learned_words(blocks, symbols, model):
    """(probability by state, count, expected counts) of every word of the blocks, as the scores see them."""
    news, out = model.news.toPandas(), {}
    fixed = hmm_scoring.WordModel(model.symbols, model.sums, None)
    for _, block in blocks.toPandas().iterrows():
        own, counts, sums = hmm_scoring.block_words(
            block, news[news["at"] == block.block], symbols, len(model.symbols.start)
        )
        emits = hmm_scoring.word_emissions(own, counts, sums, symbols, fixed)
        for word, *found in zip(map(bytes, block.words), emits, counts, sums):
            assert word not in out or all(np.array_equal(a, b) for a, b in zip(found, out[word]))
            out[word] = found
    return out


def test_every_training_word_is_learned_by_state(spark, folder):
    """Expected counts by word and state, gathered over blocks, equal those of the corpus as one block."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(200)
    found = []
    for size in (1 << 14, 1 << 30):
        blocks = hmm_scoring.corpus_blocks(docs.coalesce(1), size)
        totals = hmm_scoring.word_totals(blocks)
        symbols = hmm_scoring.alphabet(totals, frequent=50, buckets=20)
        known = hmm_scoring.links(blocks, symbols)
        coarse = hmm_scoring.train(blocks, symbols, rounds=3)
        model = hmm_scoring.word_counts(blocks, known, symbols, coarse)
        words = learned_words(blocks, symbols, model)
        want = {bytes(r.word): r.c for r in totals.collect()}
        assert {w: x[1] for w, x in words.items()} == want and len(want) > 200
        rare = [w for w in want if w not in symbols.frequent and want[w]]
        assert len(rare) > 100
        assert np.allclose([words[w][2].sum() for w in rare], [want[w] for w in rare], rtol=2e-4)
        classes = symbols.symbols(rare) - len(symbols.frequent)
        sums = np.zeros((symbols.buckets, 6))
        np.add.at(sums, classes, np.array([words[w][0] for w in rare]))
        shares = hmm_scoring.class_shares(symbols, coarse)
        unseen = coarse.emits[len(symbols.frequent) :] * shares / model.sums
        # All rare words and the slot for unseen ones share what the class has.
        assert np.allclose(sums + unseen, coarse.emits[len(symbols.frequent) :], rtol=1e-6)
        found.append((coarse, np.array([words[w][0] for w in sorted(want)])))
    assert blocks.count() == 1 and np.allclose(found[0][0].emits, found[1][0].emits, rtol=1e-3, atol=1e-9)
    assert np.allclose(found[0][1], found[1][1], rtol=2e-2, atol=1e-9)


def test_scores_match_a_plain_forward_recursion(spark, corpus, plain):
    """The whole run beside a word-by-word forward recursion under the emissions that were learned."""
    blocks = hmm_scoring.corpus_blocks(corpus, 1 << 14)
    symbols = hmm_scoring.alphabet(hmm_scoring.word_totals(blocks), frequent=30, buckets=10)
    coarse = hmm_scoring.train(blocks, symbols, rounds=2)
    model = hmm_scoring.word_counts(blocks, hmm_scoring.links(blocks, symbols), symbols, coarse)
    words = learned_words(blocks, symbols, model)

    def score(text):
        total, now = 0.0, coarse.start
        for i, word in enumerate(x.encode() for x in tokens(text)):
            now = (now if i == 0 else now @ coarse.moves) * words[word][0]
            total += math.log10(now.sum())
            now = now / now.sum()
        return total

    got = sorted((r.n_tokens, r.score) for r in hmm_scoring.scored(blocks, symbols, model).collect())
    want = sorted((len(tokens(t)), score(t)) for _, t in plain)
    assert len(got) == len(want)
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want))


def test_training_goes_on_until_the_gain_is_small():
    fits = [-100.0, -99.9, -90.0, -80.0, -79.0, -78.9, -70.0]
    rounds = lambda n: hmm_scoring._until_settled(lambda i: (i + 1, fits[i]), 0, hmm_scoring.ROUNDS, n)
    assert rounds(None) == 6 and rounds(1) == 1 and rounds(4) == 4


def test_scores_repeat_and_empty_tables_have_none(corpus, nothing, tuples):
    assert tuples(hmm_scoring.scores(corpus)) == tuples(hmm_scoring.scores(corpus))
    assert hmm_scoring.scores(nothing).count() == 0


def test_unseen_only_training_still_scores(corpus):
    rows = hmm_scoring.scores(corpus.filter("doc_id = 1"), rounds=1).collect()
    assert len(rows) == 1 and math.isfinite(rows[0].score)


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    named = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = named.filter("lang_pred = lang").count()
    assert right >= 0.98 * named.count()


def test_language_of_odd_texts(corpus, plain):
    rows = {r.doc_id: r for r in language.predictions(corpus).collect() if r.doc_id is not None}
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[n].lang_pred == "und" and rows[n].score == 0 for n in (2, 3, 4, 13))
    assert all(rows[n].lang_pred in ("en", "de", "fr", "es") for n in (1, 5, 9, 12))
    for doc_id, r in rows.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_language_ignores_labels_sources_and_ids_of_what_it_predicts(spark, corpus):
    model = language.train(corpus.filter(~held_out(5, 0)))
    texts = ["amber brook cedar", "Größe", None]
    one = spark.createDataFrame([(1, t, "en", "a") for t in texts], "doc_id LONG, text STRING, lang STRING, source STRING")
    two = spark.createDataFrame([(9, t, None, "z") for t in texts], one.schema)
    assert [r._lang for r in language.identify(one, model).collect()] == [r._lang for r in language.identify(two, model).collect()]


def test_language_without_examples_or_rows(corpus, nothing):
    assert language.predictions(nothing).count() == 0
    model = language.train(corpus.filter("lang = 'en'"))
    assert model.predict(["text", None])[0] == ["en", "und"]
    assert language.train(nothing).predict(["text"]) == (["und"], [0.0])


def test_families_come_before_languages():
    names = language.machines(["de", "en", "es", "fr", "xx"])
    assert names == [("germanic",), ("only-xx",), ("romance",), ("de", "en"), ("es", "fr")]
    names = language.machines(["hi", "mr", "pt-BR", "pt-PT", "zh", "ja"])
    assert ("hi", "mr") in names and ("pt-BR", "pt-PT") in names and ("zh", "ja") in names
    assert language.family_of("tr") == language.family_of("az") and language.family_of("qq") == "only-qq"


def test_only_the_winning_family_is_asked_for_its_pairs():
    """Labels and scores beside an evaluation of every machine on every text."""
    rng = np.random.default_rng(3)
    languages = ("de", "en", "es", "fr", "it", "qq")
    names = tuple(language.machines(list(languages)))
    model = language.LanguageModel(
        languages, names, rng.normal(size=(len(names), len(language.GROUPS) << language.BITS)).astype(np.float32),
        rng.normal(size=len(names)),
    )
    words = ["amber", "brook", "Größe", "été", "дом", "x"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)] + ["", None, "12"]

    def chance(name, text):
        numbers, values = language.features(text)
        n = names.index(name)
        return 1 / (1 + math.exp(-language.STEEPNESS * (float(model.weights[n][numbers] @ values) + model.bias[n])))

    labels, scores = model.predict(texts)
    assert labels[-3:] == ["und"] * 3 and scores[-3:] == [0.0] * 3
    for text, label, score in zip(texts[:-3], labels, scores):
        families = sorted({language.family_of(x) for x in languages})
        sure = [chance((f,), text) for f in families]
        family = families[int(np.argmax(sure))]
        members = [x for x in languages if language.family_of(x) == family]
        votes = {x: sum(chance(p, text) if p[0] == x else 1 - chance(p, text)
                        for p in itertools.combinations(members, 2) if x in p) for x in members}
        best = max(members, key=lambda x: votes[x])
        level = votes[best] / (len(members) - 1) if len(members) > 1 else 1.0
        assert label == best and math.isclose(score, max(sure) / sum(sure) * level, rel_tol=1e-3)


def test_prediction_takes_bounded_memory_and_slices_change_nothing():
    rng = np.random.default_rng(1)
    names = (("germanic",), ("romance",), ("de", "en"))
    model = language.LanguageModel(
        ("de", "en", "fr"), names, rng.normal(size=(3, 3 << language.BITS)).astype(np.float32), np.zeros(3)
    )
    texts = [f"{n} amber brook cedar delta ember fjord " * 40 for n in range(3_000)]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    found = [model.predict(x.column("text").to_pylist()) for x in sliced([batch], "text", language.SLICE_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    labels, scores = model.predict(texts)
    assert [x for own, _ in found for x in own] == labels and [x for _, own in found for x in own] == scores
